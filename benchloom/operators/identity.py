"""Identities by content: hashes that don't depend on where a row lies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..storage import by_shuffle, drop, stored


def short_id(*parts: Column, length: int = 20, separator: str = ":") -> Column:
    """The start of the SHA-256 of joined parts."""
    return F.left(F.sha2(F.concat_ws(separator, *(p.cast("string") for p in parts)), 256), F.lit(length))


def json_strings(*parts: Column) -> Column:
    """A JSON array of texts without characters to escape, blanks after commas."""
    return F.concat(F.lit('["'), F.concat_ws('", "', *parts), F.lit('"]'))


def variant_id(base: Column, image_language: Column, query_language: Column) -> Column:
    return F.concat(F.lit("variant_"), F.sha2(json_strings(base, image_language, query_language, query_language), 256))


def normalized_hash(text: Column) -> Column:
    """Of lower-cased text with white space collapsed; for full Unicode folding see functions.udfs.nfkc_casefold."""
    return F.sha2(F.lower(collapse(text)), 256)


def duplicate_groups(rows: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(key, n, first_id) of keys that several rows share."""
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("first_id")).where("n > 1")


def dedup_keys(visual: Column, table: Column, paper: Column) -> Column:
    """Keys under which two rows count as the same: visual=, table= and paper=."""
    named = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c))
    return F.array_compact(F.array(named("visual", visual), named("table", table), named("paper", paper)))


def diversity_tokens(values: dict[str, Column], tasks: Column) -> Column:
    """key=value tokens of a row; one task= for each tag, lookup_or_other if there is none."""
    named = F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in values.items())))
    tags = F.when(F.size(tasks) > 0, tasks).otherwise(F.array(F.lit("lookup_or_other")))
    return F.concat(named, F.transform(tags, lambda t: F.concat(F.lit("task="), t)))


def archived_content(rows: DataFrame, current: DataFrame, archive: DataFrame) -> DataFrame:
    """rows(sha256) with the path of their content: the current file, else the archived copy."""
    now = current.select("sha256", F.col("path").alias("__now")).dropDuplicates(["sha256"])
    then = archive.select("sha256", F.col("path").alias("__then")).dropDuplicates(["sha256"])
    return rows.join(now, "sha256", "left").join(then, "sha256", "left").select(*rows.columns, F.coalesce("__now", "__then").alias("path"), (F.col("__now").isNull() & F.col("__then").isNotNull()).alias("archived"))


def lineage(predictions: DataFrame, requests: DataFrame, attempts: DataFrame, responses: DataFrame, judgments: DataFrame) -> DataFrame:
    """predictions with their request, selected attempt, its response and judgment, and columns that say whether they agree."""
    wrap = lambda df, keys, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))
    p = predictions.withColumn("attempt_number", F.col("selected_attempt"))
    rows = p.join(wrap(requests, ["id"], "request"), "id", "left").join(wrap(attempts, ["id", "attempt_number"], "attempt"), ["id", "attempt_number"], "left")
    rows = rows.join(wrap(responses, ["id", "attempt_number"], "response"), ["id", "attempt_number"], "left").join(wrap(judgments, ["id"], "judgment"), "id", "left")
    return rows.withColumns({"has_request": F.col("request").isNotNull(), "has_attempt": F.col("selected_attempt").isNull() | F.col("attempt").isNotNull(), "judged_this": F.col("judgment.prediction").eqNullSafe(F.col("prediction"))})


def first_of_rings(links: DataFrame) -> DataFrame:
    """(revision): the least revision of each ring in links(revision, up), one row for each revision, stored.

    Each round doubles how far a revision looks up; the least one on that way is itself only for the least of a ring, once the way goes
    round it. Ways that end drop out, and so do those into rings that are found: what is left is never more than the links.
    """
    spark = links.sparkSession
    jump = stored(links.select("revision", "up", F.col("up").alias("least")), "ways")
    found = []
    while jump.take(1):
        found.append(stored(jump.where("least = revision").select("revision"), "rings"))
        open_ = jump.join(by_shuffle(found[-1].select(F.col("revision").alias("least"))), "least", "left_anti")
        over = open_.select(F.col("revision").alias("up"), F.col("up").alias("top"), F.col("least").alias("further"))
        longer = open_.join(by_shuffle(over), "up").select("revision", F.col("top").alias("up"), F.least("least", "further").alias("least"))
        jump, before = stored(longer, "ways"), jump
        drop(spark, before)
    rings = stored(reduce(DataFrame.unionByName, found, links.select("revision").limit(0)), "rings")
    drop(spark, jump, *found)
    return rings


def ancestry(revisions: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, revision, depth, error): each of starts(revision) with itself (depth 0) and all its ancestors along revisions(revision, parent).

    Chains can have any length: each round doubles the distance that is known, for all starts together, over stored tables. A start
    whose chain comes back to itself or to another revision in it has one row, with an error. A parent that has no row is the last of its chain.
    Rings are found first and cut above their least revision, so that no chain is followed round a ring more than once.
    """
    spark = revisions.sparkSession
    links = stored(revisions.where("revision is not null and parent is not null").groupBy("revision").agg(F.min("parent").alias("up")), "ups")
    rings = first_of_rings(links)
    jump = stored(links.join(by_shuffle(rings), "revision", "left_anti"), "jump")
    known = stored(starts.select(F.col("revision").alias("start"), F.col("revision")).where("start is not null").distinct().withColumn("depth", F.lit(0).cast("long")), "known")
    step = 1
    while jump.take(1):
        further = known.join(by_shuffle(jump), "revision").select("start", F.col("up").alias("revision"), F.col("depth") + step)
        longer = stored(known.unionByName(further.toDF("start", "revision", "depth")), "known")
        jump, before = stored(jump.join(by_shuffle(jump.select(F.col("revision").alias("up"), F.col("up").alias("top"))), "up").select("revision", F.col("top").alias("up")), "jump"), jump
        drop(spark, known, before)
        known, step = longer, 2 * step
    # Who comes to the least revision of a ring goes round it without end.
    cyclic = stored(known.join(by_shuffle(rings), "revision", "left_semi").select("start").distinct(), "cyclic")
    drop(spark, jump, links, rings)
    fine = known.join(by_shuffle(cyclic), "start", "left_anti").withColumn("error", F.lit(None).cast("string"))
    wrong = cyclic.select("start", F.col("start").alias("revision"), F.lit(0).cast("long").alias("depth"), F.lit("is its own ancestor, or has one that is").alias("error"))
    return fine.unionByName(wrong)


def nearest_revision(rows: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """Of rows(key, revision) the one from the nearest revision, for each key and start of chains(start, revision, depth, error); with the start."""
    own = [c for c in rows.columns]
    ranked = rows.join(chains.where("error is null").select("start", F.col("revision").alias("of_"), F.col("depth").alias("depth_")), F.col("revision") == F.col("of_"))
    return ranked.groupBy(key, "start").agg(F.min_by(F.struct(*own), "depth_").alias("r")).select("start", "r.*")


def with_identity(candidates: DataFrame, identities: DataFrame, key: str = "id") -> DataFrame:
    """candidates with their identity columns; a candidate without exactly one identity is an error when it is read."""
    own = [c for c in identities.columns if c != key]
    found = identities.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), F.min(F.struct(*own)).alias("own_"))
    joined = candidates.join(found, key, "left")
    checked = joined.where(F.assert_true(F.coalesce(F.col("n_") == 1, F.lit(False)), F.concat(F.lit("no single identity of "), F.col(key).cast("string"))).isNull())
    return checked.select(*candidates.columns, "own_.*")


def with_evidence(pool: DataFrame, manifest: DataFrame) -> DataFrame:
    """pool(file, row_index, slot, ...) with `provenance` from manifest(file, repo, revision, sha256), a row for each downloaded file."""
    entry = manifest.select("file", F.col("repo").alias("repo_"), F.col("revision").alias("revision_"), F.col("sha256").alias("sha256_"))
    made = F.struct(F.col("repo_").alias("repo"), F.col("revision_").alias("revision"), F.col("sha256_").alias("file_sha256_at_download"), "file", "row_index", "slot")
    return pool.join(entry, "file").withColumn("provenance", made).drop("repo_", "revision_", "sha256_")
