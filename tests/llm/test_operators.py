"""Each corpus operator against a brute-force version, and on odd input."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from benchloom.llm import common, decontaminate, docstats, html_extract, line_dedup, packing, pii, quality_model, quality_rules, queries, secret_scan, simhash, substring_dedup, tiles

from ..compare import database, from_duckdb, from_spark

#: A null, an empty, a blank and a very long text, ties, repeated rows, a null id, odd characters, columns with clashing names.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (6, "One TWO"), (None, "one two"), (8, "word " * 30_000), (9, "é한\U0001f600 \x85 \xa0 x\x0by"), (10, "a\n\n a \na")]


def odd(spark):
    rows = spark.createDataFrame([(i, t, "en", "s", "k", 1, 2, 3) for i, t in ODD], "doc_id long, text string, lang string, source string, key string, fp long, n_removed int, component_id long")
    return rows


def empty(spark):
    return odd(spark).where("false")


def docs(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents")


def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in docs(spark, sf_dir).select("doc_id", "text").collect()]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_fingerprint(text):
    words = words_of(text.translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    values = np.array([prints[d] for d in ids], dtype=np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = find(d), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def test_simhash(spark, sf_dir):
    prints = {d: brute_fingerprint(t) for d, t in texts(spark, sf_dir)}
    want = brute_components(prints)
    got = queries.op1_simhash_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in want}
    assert len(got) == len(want)


def test_simhash_links_within_two_bits(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for i, j in rng.integers(0, 63, (30, 2))])
    prints = {i: int(v) for i, v in enumerate(dict.fromkeys(near.tolist()))}
    classes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in prints.items()], "fp long, rep long")
    from benchloom.operators.clusters import connected_components

    labels = {r.node: r.label for r in connected_components(simhash.near_links(classes)).collect()}
    assert {i: labels.get(i, i) for i in prints} == brute_components(prints)


@pytest.mark.parametrize("hot", [1, 8, 64])
def test_simhash_crowded_segments(spark, hot):
    """Thousands of fingerprints that share a segment, so that tables are indexed down to the last level."""
    from benchloom.operators.clusters import connected_components

    rng = np.random.default_rng(3)
    family = rng.integers(0, 2**9, 400, dtype=np.uint64) | np.uint64(0xABCD_0000_0000_0000)
    split = np.array([0x1234_5678_0000_0000 ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (300, 2))], dtype=np.uint64)
    far = rng.integers(0, 2**63, 200, dtype=np.uint64)
    far = np.concatenate([far, far[:20] ^ np.uint64(1 << 63), far[10:30] ^ np.uint64(1 << 63 | 1)])
    prints = {i: int(v) for i, v in enumerate(dict.fromkeys(np.concatenate([family, split, far]).tolist()))}
    classes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in prints.items()], "fp long, rep long")
    links = simhash.near_links(classes, hot=hot).collect()
    assert all(bin(prints[r.a] ^ prints[r.b]).count("1") <= 2 for r in links)
    labels = {r.node: r.label for r in connected_components(spark.createDataFrame(links)).collect()}
    assert {i: labels.get(i, i) for i in prints} == brute_components(prints)


def test_simhash_tables():
    """Every pair within 2 bits meets in a table of each level: the ball around one segment or the other holds it."""
    assert [len(simhash.segments(k)) for k in range(3)] == [2, 4, 8]
    assert all(bin(own).count("1") == 32 >> k for k in range(3) for _, own in simhash.segments(k))
    assert sum(len(simhash.ball(own, 1 - t % 2)) for t, (_, own) in enumerate(simhash.segments(0))) == 34


def test_simhash_odd(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(odd(spark)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (6, 4), (None, 4)} <= got
    assert simhash.simhash_components(empty(spark)).count() == 0


def brute_near_duplicates(rows, least=0.8):
    """{doc_id: component} over all pairs of distinct texts whose sets of five-word shingles are similar; and those pairs."""
    shingles = {d: frozenset(" ".join(w[i : i + 5]) for w in [words_of((t or "").translate(LOWER))] for i in range(max(1, len(w) - 4))) for d, t in rows}
    of, holders = {}, defaultdict(list)
    for d in sorted(shingles):
        of.setdefault(shingles[d], d)
    parent = {d: of[s] for d, s in shingles.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = []
    for s, d in of.items():
        met = Counter(o for x in s for o in holders[x])
        for o, both in met.items():
            if both >= least * (len(s) + len(shingles[o]) - both):
                pairs.append((o, d))
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(d)
    return {d: find(d) for d in shingles}, pairs


def test_near_duplicates(spark, sf_dir):
    want, pairs = brute_near_duplicates(texts(spark, sf_dir))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, sf_dir)).collect()}
    assert pairs and got == want


def test_near_duplicates_by_true_similarity(spark):
    # 4 of 200 words far from each other: 176 of 216 shingles, 0.815; 5 words: 171 of 221, 0.774. Estimates fall on both sides of 0.8.
    rows = []
    for k in range(80):
        words = [f"k{k}w{i}" for i in range(200)]
        changed = [f"new{i}" if i % 40 == 20 and i // 40 < 4 + k % 2 else w for i, w in enumerate(words)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[2 * k + 1] == got[2 * k]) == (k % 2 == 0) for k in range(80))


@pytest.mark.parametrize("tile", [tiles.TILE, 20])
def test_near_duplicates_on_a_template(spark, monkeypatch, tile):
    """700 texts of similarity 0.7 to each other on one template, and among them 60 pairs at 0.82 to 0.86: in most entries the first text is unlike both."""
    monkeypatch.setattr(tiles, "TILE", tile)
    template = " ".join(f"t{i}" for i in range(500))
    rows = [(k, template + "".join(f" k{k}w{i}" for i in range(100))) for k in range(700)]
    rows += [(1000 + k, template + "".join(f" k{k}w{i}" if i < 45 + k % 10 else f" new{k}w{i}" for i in range(100))) for k in range(0, 600, 10)]
    want, pairs = brute_near_duplicates(rows)
    assert len(pairs) == 60
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_of_a_chain_of_edits(spark):
    """900 variants of a text of 200 words with 3 words changed, and 400 second copies with 4 more: 2,500 pairs at 0.8 or more in crowded entries."""
    rng = np.random.default_rng(11)
    template = [f"t{i}" for i in range(200)]

    def edited(words, k, n):
        words = list(words)
        for i in rng.choice(200, n, replace=False):
            words[i] = f"x{k}y{i}"
        return words

    first = [edited(template, k, 3) for k in range(900)]
    second = [edited(first[k], 1000 + k, 4) for k in range(400)]
    rows = [(k, " ".join(t)) for k, t in enumerate(first + second)]
    sets = [{hash(tuple(t[i : i + 5])) for i in range(196)} for t in first + second]
    names = {g: i for i, g in enumerate(set().union(*sets))}
    marks = np.zeros((len(rows), len(names)), dtype=np.float32)
    for k, s in enumerate(sets):
        marks[k, [names[g] for g in s]] = 1
    both, size = marks @ marks.T, marks.sum(axis=1)
    near = both / (size[:, None] + size[None, :] - both) >= 0.8
    want = common.components_of(near & ~np.eye(len(rows), dtype=bool))
    assert near.sum() - len(rows) > 2000
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == want.tolist()


def test_overlaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 5, 4000, 9000, 7000, 3)]
    got = simhash.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame([(5, long), (3, long + " more"), (9, long.upper()), (7, "other text"), (1, None), (2, "")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(rows).collect()} == {3, 7, 1}
    assert simhash.keep_one(odd(spark)).columns == odd(spark).columns
    clashing = simhash.keep_one(rows.withColumn("__id", F.col("doc_id") * 11).withColumn("kept", F.lit("x")).withColumn("a.b", F.lit(1))).collect()
    assert {(r.doc_id, r["__id"]) for r in clashing} == {(3, 33), (7, 77), (1, 11)}
    assert simhash.keep_one(empty(spark)).count() == 0


def test_base_statistics(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, sf_dir).collect()}
    for d, text in texts(spark, sf_dir):
        words, r = words_of(text), got[d]
        lines, windows = [x for x in text.split("\n") if words_of(x)], defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        covered = {j for w in windows.values() if len(w) > 1 for i in w for j in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_quality_rules_find_junk(spark, sf_dir):
    labels = queries.table(spark, sf_dir, "labels")
    found = queries.op2_quality_rules(spark, sf_dir).join(labels, "doc_id").where("not base_failed")
    r = found.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r.good >= 0.99 and r.bad <= 0.3


def test_quality_rules_on_held_out_labels(spark, sf_dir):
    """The threshold from four fifths of the labels, judged on the rest."""
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    labels = queries.table(spark, sf_dir, "labels")
    found = quality_rules.judge(docs(spark, sf_dir), labels.where(~held)).join(labels.where(held), "doc_id").where("not base_failed")
    r = found.groupBy().agg(*(F.avg(F.when(F.col("quality") == q, F.col("kept").cast("int"))).alias(n) for q, n in ((1, "good"), (0, "bad")))).first()
    assert r.good >= 0.98 and r.bad <= 0.2


def test_sample_of_hot_rows(spark):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1.0).alias("x"))
    assert docstats.sample(rows, 100, 3).count() == 1
    mixed = rows.unionByName(spark.range(50_000).select(F.col("id").alias("doc_id"), F.rand(1).alias("x")))
    got = docstats.sample(mixed, 1000, 3)
    assert got.count() == 1000 and got.distinct().count() == 1000 and got.where("doc_id is null").count() <= 1


def test_quality_rules_without_ids(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("the quick words of a plain text number"), "id", F.repeat(F.lit("and so on, more or less, "), 8)).alias("text"))
    odd_one = spark.createDataFrame([(1, "## $$ %% && " * 40), (2, "the quick words of a plain text number 5 " + "and so on, more or less, " * 8)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    got = quality_rules.judge(rows.unionByName(odd_one), labels)
    assert got.agg(F.max("anomaly")).first()[0] > 0 and got.count() == 3002


def test_quality_rules_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(odd(spark), none).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and len(got) == 9
    assert quality_rules.judge(empty(spark), none).count() == 0


def test_path_length_of_forest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    forest = quality_rules.IsolationForest().fit(x)
    scores = forest.score(np.vstack([x[:200], np.full((1, 3), 12.0)]))
    assert scores[-1] > scores[:-1].max() and abs(float(np.median(scores)) - 0.45) < 0.1


def test_line_dedup(spark, sf_dir):
    assert from_spark(queries.op3_line_dedup(spark, sf_dir)) == from_duckdb(database(sf_dir), queries.SQL["op3_line_dedup"])


def test_line_dedup_threshold(spark):
    rows = [(s, f"{'own words of this page ' * 6}{s}\nboth\n" + ("shared" if s < 9 else ""), f"site{s}") for s in range(12)]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all("both" not in r.text and r.n_removed == 1 for r in got.values()) and all("shared" in got[s].text for s in range(9))
    copies = [(s, "a whole document\nthat was copied", f"site{s}") for s in range(12)]
    assert all(r.n_removed == 0 for r in line_dedup.remove_boilerplate(spark.createDataFrame(copies, "doc_id long, text string, source string")).collect())
    # A document may be nothing but boilerplate.
    menus = [(s, "menu" if s % 2 else f"menu\nown {s}", f"site{s}") for s in range(24)]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(menus, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in got} == {(s, "" if s % 2 else f"own {s}", 1) for s in range(24)}


def test_line_dedup_random(spark):
    """Spread and class counts around the threshold, against a plain count; null sites and ids, clashing names."""
    rng = np.random.default_rng(14)
    rows = [(None if k % 17 == 0 else k, "\n".join(f" line {x} " for x in (rng.integers(0, 40, rng.integers(0, 5)) * rng.random()).astype(int)), None if k % 7 == 0 else f"s{rng.integers(0, 14)}") for k in range(160)]
    sites, texts_ = defaultdict(set), defaultdict(set)
    for _, text, site in rows:
        for x in text.split("\n"):
            sites[x.strip()].add(site)
            texts_[x.strip()].add(text)
    spread = {x for x in sites if x and min(len(sites[x]), len(texts_[x])) >= 10}
    assert spread and any(8 <= len(s) < 10 for s in sites.values())
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, doc int, __doc int, `a.b` int")
    got = Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_boilerplate(frame).collect())
    want = Counter((d, "\n".join(x for x in t.split("\n") if x.strip() not in spread), sum(x.strip() in spread for x in t.split("\n"))) for d, t, _ in rows)
    assert got == want


def test_spread_counts_near_copies_once(spark):
    near = [(s, f"one line\nanother line\nlast words {s}", f"site{s}") for s in range(12)]
    other = [(100 + s, f"licence\nown words {s}", f"site{s}") for s in range(12)]
    frame = spark.createDataFrame(near + other + [(None, "licence", None)], "doc_id long, text string, source string").withColumn("__class", F.lit(1))
    classes = spark.createDataFrame([(s, 0) for s in range(12)] + [(100 + s, 100 + s) for s in range(12)], "doc_id long, component_id long")
    got = line_dedup.remove_spread(frame, lambda holders: classes.join(holders, "doc_id", "left_semi"))
    assert got.columns == frame.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(d, t) for d, t, _ in near} | {(100 + s, f"own words {s}") for s in range(12)} | {(None, "")}


def test_line_dedup_odd(spark):
    got = line_dedup.remove_boilerplate(odd(spark)).collect()
    assert len(got) == len(ODD) and next(r for r in got if r.doc_id == 1).text is None
    assert next(r for r in got if r.doc_id == 10).n_lines == 3
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0


def brute_repeats(rows):
    """{(doc_id, text): result}; null ids come last, texts of one id by their signed hash."""
    seen, out = set(), {}
    version = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    for d, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, version(r[1]))):
        words = words_of(text)
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone |= set(range(i, i + 20))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d, text] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check_repeats(spark, rows):
    want = brute_repeats(rows)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((d, *want[d, t or ""]) for d, t in rows)
    for r in got:
        assert sum(x.end - x.start for x in r.repeats) == r.n_removed and all(x.end - x.start >= 20 for x in r.repeats)
        assert len(r.kept_text.split()) == r.n_words - r.n_removed


def test_substring_dedup(spark, sf_dir):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, sf_dir).collect()}
    assert got == {d: v for (d, _), v in brute_repeats(texts(spark, sf_dir)).items()}


def test_substring_dedup_small_alphabet(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("ab"), rng.integers(0, 120)))) for i in range(60)] + [(100, "x " * 70), (101, "x " * 19)]
    check_repeats(spark, rows)


def test_substring_dedup_ids(spark):
    """Several null ids, one id with two texts, repeated rows and a random mix of passages."""
    long, more = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(30, 95))
    check_repeats(spark, [(None, long), (None, "short text"), (5, long)])
    check_repeats(spark, [(4, long), (4, "short text"), (5, long)])
    check_repeats(spark, [(None, long), (None, more), (None, long), (4, more), (4, long + " " + more), (4, None)])
    rng = np.random.default_rng(12)
    passages = [" ".join(rng.choice([f"p{k}" for k in range(60)], rng.integers(8, 70))) for _ in range(12)]
    rows = []
    for _ in range(150):
        parts = [passages[k] if rng.random() < 0.7 else " ".join(f"u{x}" for x in rng.integers(0, 5000, 9)) for k in rng.integers(0, 12, rng.integers(0, 6))]
        rows.append((None if rng.random() < 0.2 else int(rng.integers(0, 60)), " ".join(parts)))
    check_repeats(spark, rows)


def test_substring_dedup_odd(spark):
    got = substring_dedup.remove_repeats(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[8].n_removed == 29_999 and by[4].n_removed == 0
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="ad">Buy this, now!</div><div class="cookie-notice">We use cookies.</div>
<article><h1>Heading</h1><p><b>First &amp; best,  <i>really</i>.<br><p>Second
 paragraph &#8212; with text, and more.</p><p>Ok.</p><form><p>Your mail</p></form><div class="comments"><p>Nice, thanks a lot!</p></div></article>
<aside>Related</aside><script>var x = "<p>no</p>";</script><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html_extract.extract(PAGE) == "Heading\nFirst & best, really.\nSecond paragraph — with text, and more.\nOk."
    assert html_extract.extract("") == "" and html_extract.extract("<p") == "<p" and html_extract.extract("<p></p>") == ""
    plain = "<body><div id=menu><a href=x>One</a> <a href=y>Two</a></div><div class=content>" + "".join(f"<p>Sentence number {i}, which is long enough, says something.</p>" for i in range(5)) + "</div></body>"
    assert html_extract.extract(plain).count("\n") == 4 and "One" not in html_extract.extract(plain)


def test_html_paths_choose_blocks():
    text = "A sentence, which is long enough, says something; it goes on, and ends here."
    intro = f"<body><div class=intro><p>{text}</p></div><div class=body><p>{text} {text}</p><p>{text}</p></div></body>"
    assert html_extract.extract(intro).count("\n") == 2
    quote = f"<div class=post><p>{text}</p><blockquote><p>{text} {text} {text}</p></blockquote><p>{text}</p></div>"
    assert html_extract.extract(quote).count("\n") == 2
    # In an article a box of bare words is no content; outside it a long text is.
    page = f"<article><h1>Title</h1><div class=text><p>{text}</p><p>{text}</p><p>Short</p></div><div class=tags>one two</div></article>"
    assert html_extract.extract(page) == f"Title\n{text}\n{text}\nShort"
    assert html_extract.extract(f"<article><p>{text}</p></article><div class=more><p>{' '.join([text] * 6)}</p></div>").count("\n") == 1
    for name in ("class='with-sidebar'", "class='side-effects'", "class='overflow-hidden'", "data-hidden=1"):
        assert html_extract.extract(f"<div {name}><p>{text}</p></div>") == text
    for name in ("class='x site-footer'", "class=sidebar", "hidden", "hidden=''", "aria-hidden=true", "style='color:red;display: none'"):
        assert html_extract.extract(f"<div {name}><p>{text}</p></div><div><p>{text}</p></div>") == text


TEXT = "A sentence, which is long enough, says something; it goes on, and ends here."
PARAGRAPHS = "".join(f"<p>{TEXT} {k}</p>" for k in range(6))


def test_html_threshold_chooses():
    """Without an article it is the paths' ratios that part content from the rest: another threshold gives another text."""
    rest = "".join(f"<div class=teaser>Short words {k}</div>" for k in range(8))
    page = f"<body><div class=top>{rest}</div><div class=story>{PARAGRAPHS}<p>Ok.</p></div><div class=end>{rest}</div></body>"
    want = "\n".join([*(f"{TEXT} {k}" for k in range(6)), "Ok."])
    assert html_extract.extract(page) == want
    assert "Short words" in html_extract.extract(page, threshold=0.0)
    assert html_extract.extract(page, threshold=50.0) == ""


def test_html_wrappers_and_parts():
    want = "\n".join(f"{TEXT} {k}" for k in range(6))
    for name in ("content has-sidebar", "content-sidebar-wrap", "main-sidebar-container", "page no-comments"):
        page = f"<body><div class='{name}'><div class=story>{PARAGRAPHS}</div><div class=sidebar><p>{TEXT}</p></div></div></body>"
        assert html_extract.extract(page) == want, name
    two = f"<article class=a>{PARAGRAPHS}</article><article class=b><h2>Next</h2><p>{TEXT}</p><p>{TEXT}</p></article>"
    assert html_extract.extract(two) == f"{want}\nNext\n{TEXT}\n{TEXT}"
    links = f"<body><ul class=list><li><a href=x>Elsewhere</a></li></ul><article>{PARAGRAPHS}<ul><li><a href=x>A source</a></li><li><a href=y>Another source</a></li></ul></article></body>"
    assert html_extract.extract(links) == f"{want}\nA source\nAnother source"
    # An inline part that isn't content doesn't part its paragraph.
    share = f"<div class=story>{PARAGRAPHS}<p>Before it <span class=share>Share this</span>and after it.</p><p><span class=share>Share</span>Then, this.</p></div>"
    assert html_extract.extract(share) == f"{want}\nBefore it and after it.\nThen, this."


def test_html_ratios_without_names(spark, sf_dir, monkeypatch):
    """With the lists of names and of parts emptied the paths' ratios alone have to find the articles; without their threshold none is found."""
    pages = [r.html for r in queries.table(spark, sf_dir, "pages").collect()]
    want = [html_extract.extract(p) for p in pages]
    monkeypatch.setattr(html_extract, "NOT_CONTENT", frozenset())
    plain = [p.replace("<article", "<div").replace("</article", "</div") for p in pages]
    right = lambda rows, **options: sum(html_extract.extract(p, **options) == w for p, w in zip(rows, want, strict=True)) / len(want)
    assert right(pages) >= 0.9 and right(plain) >= 0.75
    assert right(pages, threshold=0.0) <= 0.05 and right(plain, threshold=0.0) <= 0.05
    monkeypatch.setattr(html_extract, "SKIPPED", html_extract.RAW | frozenset({"head", "template", "svg"}))
    assert right(pages) >= 0.7 and right(pages, threshold=0.0) == 0


def test_html_pages(spark, sf_dir):
    rows = {r.page_id: r.html for r in queries.table(spark, sf_dir, "pages").collect()}
    import html

    for r in queries.op5_html_extraction(spark, sf_dir).collect():
        article = re.search(r"(?s)<article>(.*)</article>", rows[r.page_id])[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_odd(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (3, "u", "<<<>>> &amp; <p>"), (3, "u", "<script>never ends"), (5, "u", "<p>" * 5000 + "x")], "page_id long, url string, html string")
    got = html_extract.main_text(rows.withColumn("text", F.lit(1))).collect()
    assert len(got) == 5 and got[0].text == "" and got[4].text == "x"
    assert html_extract.main_text(rows.where("false")).count() == 0


def test_packing(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts(spark, sf_dir)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, sf_dir).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for runs, most in [(pieces, None), (sequences, 2048)]:
        for key, parts in runs.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == len(ids[key]) if most is None else at <= most
    assert pieces.keys() == ids.keys()
    assert 1 - sum(map(len, ids.values())) / (2048 * len(sequences)) < 0.01


def test_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder, rng = Tokenizer.from_file(path), packing.Encoder(path, limit=40_000, longest=8), np.random.default_rng(4)
    alphabet = list("aAbBzZéÉßẞİıσΣςñ'.,!*#09 \n\t́中\U0001f600’-_|<>sStTǅ")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 15)))
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(b"a <|endoftext|> b"), "<u4").tolist() == tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_other_tokenizers(spark, tmp_path):
    """A tokenizer for which chunks can't be parted is run over whole texts."""
    from tokenizers import Tokenizer, models

    letters = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a ": 3}, merges=[("a", " ")]))
    letters.save(str(tmp_path / "letters.json"))
    encoder = packing.Encoder(str(tmp_path / "letters.json"))
    assert np.frombuffer(encoder.encode(b"a b a"), "<u4").tolist() == letters.encode("a b a").ids == [3, 2, 1, 0]


def test_encoder_is_bounded():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), limit=20_000)
    for k in range(3000):
        encoder.encode(f"word{k} {'x' * 400}{k}".encode())
    assert len(encoder) < 200 and encoder.held <= 20_000 and max(map(len, encoder)) <= 128


def test_repeated_rows_spread_over_groups(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    got = packing.pack(rows, group=100)
    per_group = got.groupBy((F.col("sequence_id") / 2**33).cast("long").alias("g")).count().collect()
    assert got.count() == 3000 and len(per_group) == 30 and max(r["count"] for r in per_group) < 200


def test_best_fit():
    rng = np.random.default_rng(5)
    lengths = sorted(rng.integers(1, 100, 400).tolist(), reverse=True)
    place, offset = packing.best_fit(lengths, 100)
    open_, want = [], []
    for n in lengths:
        fits = [(room, i) for i, room in enumerate(open_) if room >= n]
        if fits:
            room = min(fits)[0]
            want.append(100 - room)
            i = next(i for i, r in enumerate(open_) if r == room)
        else:
            i = len(open_)
            open_.append(100)
            want.append(0)
        open_[i] -= n
    assert offset == want and max(place) + 1 == len(open_)


def test_packing_odd(spark):
    got = packing.pack(odd(spark)).collect()
    assert sum(r.length for r in got if r.doc_id == 8) == 30_001 and {r.doc_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert packing.pack(empty(spark)).count() == 0


def test_classifier(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    got = {r.doc_id: r for r in queries.op7_quality_classifier(spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in got.items())
    held = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_trees_walk_as_nested_ifs():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality_model.BoostedTrees(rounds=40).fit(x, y)

    def one(row):
        raw = model.base
        for t in range(len(model.leaf)):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + 1 + (row[model.feature[t, at]] >= model.cut[t, at])
            raw += model.leaf[t, at - (2**model.depth - 1)]
        return 1 / (1 + np.exp(-raw))

    scores = model.score(x)
    assert np.allclose(scores[:50], [one(r) for r in x[:50]]) and ((scores > 0.5) == y).mean() > 0.97


def test_classifier_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.score(odd(spark), none).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1), (8, 0), (9, 1), (9, 0), (10, None)], "doc_id long, quality int")
    assert quality_model.score(odd(spark), labels).count() == len(ODD)
    assert quality_model.score(empty(spark), labels).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_personal(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and (len(p.lstrip("0")) <= 3) for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_personal_data(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op8_pii(spark, sf_dir).collect()}
    for d, text in texts(spark, sf_dir):
        want = brute_personal(text)
        assert got[d].base_sha256 == hashlib.sha256(pii.listed(want).encode()).hexdigest()
        kinds = Counter(k for k, *_ in want)
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(kinds[k] for k in pii.BASE)


def test_personal_data_fuzz():
    rng = np.random.default_rng(7)
    alphabet = list("a@@..++0123456789- ()%b\né")
    for _ in range(6000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert [x for x in pii.spans(text) if x[0] in pii.BASE] == brute_personal(text), text


def test_more_personal_data():
    text = "mail joe [at] mail (dot) org, IBAN GB82 WEST 1234 5698 7654 32, see https://u:pw@host.org/x, SSN: 078-05-1120, account number 12345678"
    assert {text[s:e] for k, s, e in pii.spans(text) if k not in pii.BASE} == {"joe [at] mail (dot) org", "GB82 WEST 1234 5698 7654 32", "https://u:pw@host.org/x", "078-05-1120", "12345678"}
    assert pii.spans("in 2012, 5 of 1,000 people; account for it all. See http://x.org/a?b=1") == []


def test_cues_in_any_case():
    for text, value in [("Account Number: 12345678", "12345678"), ("ACCOUNT NO 12-345-678", "12-345-678"), ("Social Security 078-05-1120", "078-05-1120"), ("Passport No: X1234567", "X1234567"), ("İ SoCiAl sEcUrItY: 078051120", "078051120"), ("Kontonummer 123456789", "123456789")]:
        assert [(k, text[s:e]) for k, s, e in pii.spans(text)] == [("account", value)], text
    assert [(k, s, e) for k, s, e in pii.spans("x joe [At] mail [DOT] org")] == [("hidden_email", 2, 25)]


def test_recall_of_added_kinds(spark, sf_dir):
    """Spans planted in the driver's texts, in several spellings: all are found at their places, and texts without them gain none."""
    rng = np.random.default_rng(15)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def iban():
        body = "WEST" + digits(14)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        return f"GB{check:02d}{body}"

    made = {
        "hidden_email": lambda k: f"joe{k}" + [" [at] ", "(AT)", " (at) ", "[At]"][k % 4] + "mail" + [" [dot] ", "."][k % 2] + "org",
        "url": lambda k: f"https://user{k}:pw{digits(4)}@host{k}.org/a?b={k}",
        "iban": lambda k: iban(),
        "account": lambda k: "1" + digits(9),
    }
    cue = ["Account Number: ", "ACCOUNT NO. ", "Passport: ", "Konto" + "nummer "]
    planted = missed = gained = 0
    for d, text in texts(spark, sf_dir)[:400]:
        bare = [x for x in pii.spans(text) if x[0] not in pii.BASE]
        gained += len(bare)
        for k, (kind, make) in enumerate(made.items()):
            value, at = make(d), text.find(" ", len(text) // 2) + 1
            before = (cue[d % 4] if kind == "account" else "see ") if at else ""
            if not at:
                continue
            planted += 1
            start = at + len(before)
            missed += (kind, start, start + len(value)) not in pii.spans(f"{text[:at]}{before}{value} {text[at:]}")
    assert planted > 1000 and missed == 0 and gained == 0


def test_personal_data_odd(spark):
    got = pii.find_personal_data(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.spans for r in got} == {""} and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(empty(spark)).count() == 0


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def listed(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def check_secrets(got, rows):
    for d, text in rows:
        want = brute_secrets(text)
        kinds = Counter(k for k, *_ in want)
        assert got[d].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (text[:200], got[d].spans)
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(kinds[k] for k in secret_scan.KINDS[:3])


def test_secrets(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op9_secret_scan(spark, sf_dir).collect()}
    check_secrets(got, texts(spark, sf_dir))


def samples(spark, sf_dir):
    return secret_scan.samples(docs(spark, sf_dir), queries.table(spark, sf_dir, "labels"))


def test_secrets_fuzz(spark, sf_dir):
    rng = np.random.default_rng(8)
    parts = ["token", "API_KEY", "apikey", "passwd", "=", ":", " ", '"', "'", "AKIA", "0123456789abcdef" * 2, "ABCDEFGHIJ0123456", "abc", "é", "\U0001f600", "==", "x.y/z", "\n", "Secret"]
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 14)))) for i in range(1500)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), samples(spark, sf_dir)).collect()}
    check_secrets(got, rows)


def test_secrets_by_model(spark, sf_dir):
    secret = ["ghx_16C7e42F292c6912E7710c838347Ae178B4a", "sk-9aXw3LqPz7RtV2mNb8KcYdEf", "Zm9vYmFyMTIzNDU2Nzg5MA8xQz", "J7K2M9QX4ZP8W3RT6VBN"]
    plain = ["get_user_account_name", "internationalization", "handleMouseMoveEvent2", "the-quick-brown-fox-jumps", "1234567890123456789", "INTERNATIONALISATION", "MAX_CONNECTION_RETRIES", "application-configuration-v2", "HTTPServerConnectionFactory"]
    rows = [(i, f"see {t} there") for i, t in enumerate(secret + plain)]
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), samples(spark, sf_dir)).collect()}
    assert [got[i] for i in range(len(secret))] == [f"random:4:{4 + len(t)}" for t in secret]
    assert all(got[i] == "" for i in range(len(secret), len(rows)))


def test_secret_models_on_held_out_samples(spark, sf_dir):
    got = {r.random: (r.n, r.flagged) for r in secret_scan.held_out_rates(samples(spark, sf_dir)).collect()}
    assert got[True][0] > 500 and got[True][1] >= 0.97 * got[True][0]
    assert got[False][0] > 1000 and got[False][1] <= 0.001 * got[False][0]


def test_secrets_in_long_texts(spark, sf_dir):
    """A token of a million characters and tens of thousands of matches in one text take seconds."""
    import time

    rng = np.random.default_rng(11)
    token = "".join(rng.choice(list("ghXYZQ01"), 1_000_000))
    many = " ".join(f"AKIA{k:016d} token=abc{k:05d} somewhat_long_identifier_{k}" for k in range(20_000))
    rows = [(1, f"see {token} end"), (2, many)]
    tokens = samples(spark, sf_dir)
    start = time.monotonic()
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), tokens).collect()}
    assert time.monotonic() - start < 60
    check_secrets(got, rows)
    assert got[1].spans == "random:4:1000004" and (got[2].n_access, got[2].n_assign) == (20_000, 20_000)


def test_tokens_apart_from_base_spans(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(300):
        spans = [sorted(map(int, rng.choice(60, 2, replace=False))) for _ in range(int(rng.integers(0, 9)))]
        cut = int(rng.integers(0, len(spans) + 1))
        rows.append((i, [(a, b, f"{a}") for a, b in spans[:cut]], [(a, 0, b) for a, b in spans[cut:]]))
    frame = spark.createDataFrame(rows, "i int, tokens array<struct<start:int,end:int,value:string>>, base array<struct<start:int,rank:int,end:int>>")
    for r in frame.select("i", secret_scan.apart(F.col("tokens"), F.col("base")).alias("free")).collect():
        _, tokens, base = rows[r.i]
        assert sorted(map(tuple, r.free)) == sorted(t for t in tokens if not any(a < t[1] and t[0] < b for a, _, b in base))


def test_secrets_native(spark, sf_dir):
    plan = queries.op9_secret_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets_odd(spark, sf_dir):
    got = secret_scan.find_secrets(odd(spark), samples(spark, sf_dir)).collect()
    assert len(got) == len(ODD) and {r.spans for r in got} == {""}
    assert secret_scan.find_secrets(empty(spark), samples(spark, sf_dir)).count() == 0
    none = spark.createDataFrame([], "token string, random boolean")
    assert secret_scan.find_secrets(odd(spark), none).count() == len(ODD)


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers():
    rng = np.random.default_rng(9)
    for _ in range(400):
        pattern, text = (list(map(str, rng.integers(0, 4, rng.integers(1, n)))) for n in (80, 90))
        assert decontaminate.distance(pattern, text) == brute_distance(pattern, text)


def test_leaks(spark):
    rng = np.random.default_rng(10)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(8, 60)))) for i in range(20)] + [(50, "too short to tell"), (51, None), (52, "")]
    rows = []
    for d in range(120):
        words = list(rng.choice(vocabulary, rng.integers(0, 150)))
        item = items[d % 20][1].split()
        for _ in range(int(rng.integers(0, 9))):
            at, what = int(rng.integers(0, len(item))), rng.integers(0, 3)
            item[at : at + 1] = [[], ["new"], [item[at], "more"]][what] if len(item) > 3 else [item[at]]
        if d % 3:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = [w.upper() + "," for w in item]
        if d % 11 == 0:
            words += ["Too short", "to tell.", "w1"] if d % 2 else ["too", "short", "and", "to", "tell"]
        rows.append((d, " ".join(words)))
    want = {(d, i): n for d, t in rows for i, x in items if x and (w := decontaminate.normal(x).split()) for n in [brute_distance(w, decontaminate.normal(t).split())] if n <= decontaminate.budget(len(w))}
    a, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(a, b).collect()}
    assert got == want and len(want) > 30 and {d for d, i in want if i == 50} == {d for d in range(120) if d % 22 == 11}
    assert {r.doc_id for r in decontaminate.without_leaks(a, b).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_leaks_in_scripts_without_blanks():
    item = "这个问题的答案是什么请选择正确的一项"
    matcher = decontaminate.Matcher([(1, item), (2, "短问题")])
    assert matcher.find(f"前面的文字。{item}后面") == {1: 0} and matcher.find("前面" + item.replace("答案", "结果") + "后面") == {1: 2}
    assert matcher.find("一个短问题。") == {2: 0} and matcher.find("没有关系的文字") == {} and matcher.find("短 题问") == {}


def test_leaks_of_repeated_items(spark):
    rows = spark.createDataFrame([(1, "a " * 3 + "one two three four five six seven eight nine")], "doc_id long, text string")
    items = spark.createDataFrame([(i, "one two three four five six seven eight nine") for i in (1, 1, 1, 2, 3)], "item_id long, text string")
    assert sorted((r.item_id, r.distance) for r in decontaminate.leaks(rows, items).collect()) == [(1, 0), (2, 0), (3, 0)]
    assert sum(b.count() for b in decontaminate.item_blocks(items.distinct(), 50)) == 3


def test_leaks_in_blocks(spark, sf_dir, monkeypatch):
    whole = from_spark(queries.op10_decontamination(spark, sf_dir))
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (2000,))
    assert from_spark(queries.op10_decontamination(spark, sf_dir)) == whole


def test_leaks_odd(spark):
    items = spark.createDataFrame([(1, "word " * 12), (2, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(odd(spark), items).collect()] == [(8, 1, 0)]
    assert decontaminate.leaks(empty(spark), items).count() == decontaminate.leaks(odd(spark), items.where("false")).count() == 0


def test_repeats_in_statistics():
    assert docstats.measure("")[0] == [0] * 5
    assert len(docstats.measure("a b c")[1]) == len(docstats.FEATURES)
    with pytest.raises(AttributeError):
        docstats.measure(None)


def test_substring_dedup_first_hash_collides(spark):
    """Two words with the same first hash aren't taken for each other: a second one tells them apart."""
    hashes = common.word_hashes

    def colliding(raw, which=0):
        return hashes(raw.replace(b"other", b"these") if which == 0 else raw, which)

    text = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*text[:20], "these", *text[20:]])), (2, " ".join([*text[:20], "other", *text[20:]])), (3, " ".join([*text[:20], "these", *text[20:]]))]
    real = substring_dedup.word_hashes
    try:
        substring_dedup.word_hashes = colliding
        seen = [substring_dedup.extended(substring_dedup.word_hashes(t.encode(), 0), *substring_dedup.seeds(hashes(rows[0][1].encode()))) for _, t in rows]
        second = [substring_dedup.extended(substring_dedup.word_hashes(t.encode(), 1), *substring_dedup.seeds(hashes(rows[0][1].encode()))) for _, t in rows]
    finally:
        substring_dedup.word_hashes = real
    assert (seen[0] == seen[1]).all() and (seen[0] == seen[2]).all()
    assert (second[0] == second[2]).all() and (second[0] != second[1]).any()
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 40, 3: 41}


def test_windows_that_only_the_first_hash_makes_equal(spark):
    """Planted collisions in what the joins see: equal windows, unequal checks."""
    shape = "doc long, version long, anchor long, start int, offset int, is_hub boolean, windows array<long>, checks array<long>"
    grams = spark.createDataFrame([(1, 1, 9, 0, 2, True, [5, 6, 7], [1, 2, 3]), (2, 1, 9, 4, 2, False, [5, 6, 7], [1, 8, 3])], shape)
    assert [r.same for r in substring_dedup.matched(grams).collect()] == [[True, False, True]]


def test_classifier_fit_is_bounded(spark, monkeypatch):
    """A doc_id on 3,000 rows, labelled both ways: no more than fit_rows rows come to the driver."""
    rows = spark.range(3000).selectExpr("1L as doc_id", "concat('word ', id, ' and some more words.') as text").unionByName(spark.createDataFrame([(k, f"text number {k} is good.") for k in range(2, 60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 0), (1, 1)] + [(k, k % 2) for k in range(2, 60)], "doc_id long, quality int")
    seen = []
    fit = quality_model.BoostedTrees.fit
    monkeypatch.setattr(quality_model.BoostedTrees, "fit", lambda self, x, y: seen.append(len(x)) or fit(self, x, y))
    quality_model.fit(rows, labels, fit_rows=10)
    quality_model.fit(rows, labels, fit_rows=500)
    assert 0 < seen[0] <= 10 and 0 < seen[1] <= 500


def test_pii_of_long_runs():
    began = time.perf_counter()
    assert pii.spans("1" * 1_000_000) == []
    assert len(pii.spans("1.2.3.4." * 50_000)) == 50_000
    assert time.perf_counter() - began < 4
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(2)
    for _ in range(2000):
        text = "".join(rng.choice(list("0125.. x"), 40))
        want = [m.span() for m in plain.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [x[1:] for x in pii.spans(text) if x[0] == "ip"] == want


@pytest.mark.parametrize("page", ["<div>", "<a ", "<a\"'>", "<![CDATA[>", "<!", "<ul><li>", "<div class=comments>", "<div></b>"])
def test_html_in_linear_time(page):
    """20,000 of each would take minutes if anything were looked at again for each of them."""
    began = time.perf_counter()
    html_extract.extract(page * 20_000 + "the end")
    assert time.perf_counter() - began < 4


def test_html_names_as_parts_of_tokens():
    story = "<article><h1>Head</h1><p>" + "A story, told in full. " * 20 + "</p>{}</article>"
    for name in ("class='user-comments'", "class=reader-comments", "class=blog-sidebar", "class='gdpr-banner x'", "class=google-ads", "class=newsletter-signup-form", "id=discussion"):
        text = html_extract.extract(f"<body>{story.format(f'<div {name}><p>Said a reader, at length.</p></div>')}</body>")
        assert text.startswith("Head\nA story") and "reader" not in text, name
    told = "<p>" + "A story, told in full. " * 20 + "</p>"
    for page in (f"<h1>Head</h1><div class=register>{told}</div>", f"<div class='post has-comments'><h1>Head</h1>{told}</div>", f"<div class=comments>{told}</div>"):
        assert "A story, told" in html_extract.extract(f"<body>{page}</body>")
    remarks = "<div class=user-comments><p>" + "A remark, by a reader. " * 90 + "</p></div>"
    assert "remark" not in html_extract.extract(f"<body><div class=text>{told}</div>{remarks}</body>")


def test_decontamination_of_repeated_words():
    """Many places of one item beside each other: those that a verified neighbour rules out are skipped, and nothing is lost."""
    rng = np.random.default_rng(8)
    item = " ".join(["very"] * 60 + [f"w{i}" for i in range(40)])
    matcher = decontaminate.Matcher([(1, item)])
    began = time.perf_counter()
    assert matcher.find(" ".join(["very"] * 20_000)) == {}
    assert time.perf_counter() - began < 3
    for _ in range(150):
        words = ["a", "b", "c"][: rng.integers(2, 4)]
        own = [str(w) for w in rng.choice(words, rng.integers(8, 20))]
        text = [str(w) for w in rng.choice(words, 80)]
        _, _, slack = next(iter(decontaminate.Matcher([(1, " ".join(own))]).items.values()))
        least = min(decontaminate.distance(own, text[max(0, k - slack) : k + len(own) + slack]) for k in range(-slack, len(text)))
        assert decontaminate.Matcher([(1, " ".join(own))]).find(" ".join(text)) == ({1: least} if least <= slack else {})
