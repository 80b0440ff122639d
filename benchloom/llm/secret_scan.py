"""Secrets by rules and by character Markov models, in DataFrame functions only.

Two bigram models over the characters of a token, one of random strings and one of ordinary identifiers, are counted from
labelled samples by aggregation. A long token whose log-likelihood ratio is MARGIN or more for each of its pairs of characters is a secret. The models
are one array of (characters + 1) squared numbers, whatever the corpus; a token's ratio is a sum over its pairs.

No table labels tokens. The random class is what the access and hex rules find in all documents (the rules are its labels) and
SAMPLE_STRINGS made-up strings, pieces of SHA-256 digests in hexadecimal, base 64, and capitals with digits. The ordinary class is the words of
up to SAMPLE_DOCUMENTS documents labelled good, and joins of them as identifiers have them. `held_out_rates` trains on four fifths of the
samples and judges the rest.

Places of matches follow from what lies between them: a text split by the pattern, and the matches themselves, with running sums
of their lengths. All steps take time in proportion to a text's length, or to n log n of its n matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .docstats import sample

# The base patterns. `[0-9a-f]{24,}` and `AKIA[A-Z0-9]{16,}` find what the open-ended ones do, less the short ones.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

KINDS = ("assign", "access", "hex", "random")

#: Characters that the models know (others count as one more), least length of a token that they judge.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"

#: Natural-log odds asked for in each pair of characters; documents and made-up strings in the samples; weight of the even prior of each bigram.
MARGIN, SAMPLE_DOCUMENTS, SAMPLE_STRINGS, PRIOR = 1.6, 4000, 3000, 0.5


#: Samples are held out if their hash leaves 0 here.
FOLDS = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array what `combine` makes of all values up to it, by doubled steps: n log n in all."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(values) - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(held: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(held, lambda x, i: F.when(i >= back, combine(x, F.get(held, i - back))).otherwise(x))

    return F.aggregate(steps, values, step)


def places(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the pattern's matches, leftmost and non-overlapping, in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(matches: Column) -> Column:
        sizes = F.zip_with(matches, F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(1))), lambda m, g: F.char_length(F.coalesce(g, F.lit(""))) + F.char_length(F.coalesce(m, F.lit(""))))
        ends = let(sizes, lambda n: running(n, lambda x, y: x + y))
        at = lambda m, e: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("value"))
        return F.filter(F.zip_with(matches, ends, at), lambda x: x["value"].isNotNull())

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def apart(tokens: Column, base: Column) -> Column:
    """Those of tokens(start, end, value) that overlap none of base(start, end), both in any order."""
    last = 2**31 - 1
    marked = lambda spans, own, value: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("base"), value(x).alias("value")))
    events = F.array_sort(F.concat(marked(tokens, False, lambda x: x["value"]), marked(base, True, lambda _: F.lit(None).cast("string"))))

    def free(all_: Column) -> Column:
        # The furthest end of base spans up to here, and the nearest start of those from here on.
        before = let(F.transform(all_, lambda x: F.when(x["base"], x["end"]).otherwise(0)), lambda v: running(v, F.greatest))
        after = F.reverse(let(F.reverse(F.transform(all_, lambda x: F.when(x["base"], x["start"]).otherwise(last))), lambda v: running(v, F.least)))
        around = F.zip_with(before, after, lambda x, y: F.struct(x.alias("before"), y.alias("after")))
        kept = F.zip_with(all_, around, lambda x, y: F.when(~x["base"] & (y["before"] <= x["start"]) & (y["after"] >= x["end"]), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))))
        return F.filter(kept, lambda x: x.isNotNull())

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(events, free))


def of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))


def pairs_of(token: Column) -> Column:
    """array<int> of a token's pairs of characters: a * (characters + 1) + b, where a and b count from 1 in ALPHABET and 0 is any other."""
    width = len(ALPHABET) + 1
    known = F.array(*(F.lit(ALPHABET.find(chr(c)) + 1) for c in range(128)))
    codes = F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(known, F.ascii(c)), F.lit(0)))
    return let(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * width + b))


def bigrams(tokens: DataFrame) -> DataFrame:
    """(random, pair, n) over tokens(token, random[, n]): how often each pair of characters stands in each class; n counts a token's rows."""
    rows = tokens if "n" in tokens.columns else tokens.withColumn("n", F.lit(1).cast("long"))
    pairs = rows.where(F.char_length("token") > 1).select("random", "n", F.explode(pairs_of(F.col("token"))).alias("pair"))
    return pairs.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def made_up(spark: SparkSession, n: int = SAMPLE_STRINGS) -> DataFrame:
    """(token) of random strings, a third each in hexadecimal, base 64 and capitals with digits; always the same."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    capitals = F.translate(F.base64(F.unhex(digest)), "abcdefghijklmnopqrstuvwxyz+/=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ012")
    token = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, F.rtrim(F.base64(F.unhex(digest)), F.lit("="))).otherwise(capitals)
    return spark.range(0, n, 1, 4).select(F.substring(token, 1, 40).alias("token"))


def samples(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(token, random boolean, n): labelled samples for the models, n of each.

    Random: the values that the access and hex rules find in all documents, and made-up strings. Ordinary: the words
    of at most `most` documents labelled good, those in capitals, and joins as identifiers have them.
    """
    spark = docs.sparkSession
    rows = documents(docs)
    values = rows.select(F.explode(F.concat(places(F.col("text"), ACCESS), places(F.col("text"), HEX))["value"]).alias("token"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = sample(good, most, 3)
    tokens = rows.join(F.broadcast(good), "doc_id").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0))).alias("token"))
    # Words are counted before they are joined to forms and parted into pairs.
    plain = tokens.where(~F.col("token").rlike(HEX) & ~F.col("token").rlike(ACCESS)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    word = F.col("token")
    forms = [F.upper(word), F.concat(F.lit("get"), F.initcap(word)), F.concat(word, F.initcap(word)), F.concat(word, F.lit("_"), word), F.concat(word, F.lit("-"), word), F.concat(F.upper(word), F.lit("_"), F.upper(word)), F.concat(word, F.lit("2"))]
    named = plain.select(F.explode(F.when(F.length(word) > 4, F.array(word, *forms)).otherwise(F.array(word))).alias("token"), "n")
    strings = values.unionByName(made_up(spark)).select("token", F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))
    return strings.unionByName(named.select("token", F.lit(False).alias("random"), "n"))


def ratios(tokens: DataFrame) -> list[float]:
    """The table of log-likelihood ratios from tokens(token, random), at a * (characters + 1) + b."""
    width = len(ALPHABET) + 1
    counted = {(r["random"], r["pair"]): r["n"] for r in bigrams(tokens).collect()}  # at most 2 * width * width rows
    tables = []
    for wanted in (True, False):
        counts = Counter({p: n for (random, p), n in counted.items() if random == wanted})
        rows = [sum(counts[a * width + b] for b in range(width)) for a in range(width)]
        tables.append([(counts[a * width + b] + PRIOR) / (rows[a] + PRIOR * width) for a in range(width) for b in range(width)])
    return [math.log(p / q) for p, q in zip(*tables, strict=True)]


def is_random(token: Column, table: list[float], margin: float = MARGIN) -> Column:
    """Whether a token's log-likelihood ratio is `margin` or more for each of its pairs of characters."""
    numbers = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    ratio = F.aggregate(pairs_of(token), F.lit(0.0), lambda s, p: s + F.get(numbers, p))
    return ratio >= margin * (F.char_length(token) - 1)


def held_out_rates(tokens: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(random, n, flagged): models of four fifths of the distinct tokens(token, random), and what they say of the rest of LEAST_TOKEN characters or more."""
    tokens = tokens.select("token", "random").distinct()
    held = F.pmod(F.xxhash64("token"), F.lit(FOLDS)) == 0
    table = ratios(tokens.where(~held))
    judged = tokens.where(held & (F.char_length("token") >= LEAST_TOKEN) & F.col("token").rlike("[A-Za-z]"))
    return judged.groupBy("random").agg(F.count(F.lit(1)).alias("n"), F.sum(is_random(F.col("token"), table, margin).cast("long")).alias("flagged"))


def listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, tokens: DataFrame, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found), a row for each of docs.

    tokens(token, random[, n]): labelled samples for the models. found has (start, rank of the kind, end). Tokens with a
    letter that overlap no base span are judged by the models. Null and empty texts have no spans. Null
    doc_ids and repeated rows are kept as they are. Empty table: no rows.
    """
    text = F.col("text")
    assigned = F.filter(places(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["value"], ASSIGN, 2)) >= LEAST_VALUE)
    rows = documents(docs, id_col, text_col).select("doc_id", of_kind(assigned, "assign").alias("assign"), of_kind(places(text, ACCESS), "access").alias("access"), of_kind(places(text, HEX), "hex").alias("hex"), places(text, TOKEN).alias("tokens"))
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    table = ratios(tokens)
    judged = F.filter("tokens", lambda x: x["value"].rlike("[A-Za-z]") & is_random(x["value"], table, margin))
    rows = rows.withColumn("random", of_kind(apart(judged, F.col("base")), "random"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    found = F.concat("base", "random")
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(found).alias("spans"), F.array_sort(found).alias("found"))
