"""Queries that SQL can't express, each against a plain version over the same tables."""

import ast
import difflib
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np

from benchloom.operators import sampling
from benchloom.plans import catalog, scores, tables
from benchloom.plans.registry import table

QUERIES = catalog.queries()


def test_bounded_batches(spark, sf_dir):
    want, state = {}, {}
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        batch, total, n = state.get(r.lang, (0, 0, 0))
        if n and (total + r.n_chars > 7500 or n == 8):
            batch, total, n = batch + 1, 0, 0
        want[r.doc_id] = batch
        state[r.lang] = batch, total + r.n_chars, n + 1
    assert {r.doc_id: r.batch for r in QUERIES["bounded_batches"](spark, sf_dir).collect()} == want


def test_similarity_ratios(spark, sf_dir):
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    want = {i: round(difflib.SequenceMatcher(None, t, items[i + 1]).ratio(), 6) for i, t in items.items() if i + 1 in items}
    assert {r.item_id: r.ratio for r in QUERIES["similarity_ratios"](spark, sf_dir).collect()} == want


def test_python_literals(spark, sf_dir):
    names = {r.n_nationkey: r.n_name for r in table(spark, sf_dir, "nation").collect()}
    got = {r.n_nationkey: (ast.literal_eval(r.base_id), ast.literal_eval(r.data), r.charts) for r in QUERIES["python_literals"](spark, sf_dir).collect()}
    assert got == {k: (str(k), {"name": n}, "bar") for k, n in names.items()}


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "table")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "table")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_html_text(spark, sf_dir):
    got = {r.page_id: r.text for r in QUERIES["html_text"](spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        parser = Visible()
        parser.feed(r.html)
        assert re.sub(r"\s", "", got[r.page_id]) == re.sub(r"\s", "", "".join(parser.out))


def clusters(spark, sf_dir):
    rows = defaultdict(list)
    for r in scores.hits(spark, sf_dir).select("source", "hit").collect():
        rows[r.source].append(r.hit)
    return [(sum(v), len(v)) for _, v in sorted(rows.items())]


def test_bootstrap_cluster_ci(spark, sf_dir):
    rows, rng = clusters(spark, sf_dir), random.Random(42)
    samples = []
    for _ in range(2000):
        drawn = [rows[int(rng.random() * len(rows))] for _ in rows]
        samples.append(sum(t for t, _ in drawn) / sum(n for _, n in drawn))
    samples.sort()
    got = QUERIES["bootstrap_cluster_ci"](spark, sf_dir).first()
    assert (got.clusters, got.low, got.high) == (len(rows), samples[int(0.025 * 1999)], samples[int(0.975 * 1999)])
    assert abs(got.estimate - sum(t for t, _ in rows) / sum(n for _, n in rows)) < 1e-12


def test_bootstrap_hashed_ci(spark, sf_dir):
    exact, got = (QUERIES[n](spark, sf_dir).first() for n in ("bootstrap_cluster_ci", "bootstrap_hashed_ci"))
    assert abs(got.estimate - exact.estimate) < 1e-12 and got.low < got.estimate < got.high
    assert abs((got.high - got.low) / (exact.high - exact.low) - 1) < 0.5


def test_bootstrap_linear_ci(spark, sf_dir):
    from benchloom.operators import paired
    from pyspark.sql import functions as F

    one = scores.hits(spark, sf_dir).groupBy(*scores.CELL).agg(F.min_by("hit", "id").alias("hit"))
    rows = paired.seed_metrics(one, ["source"], "lang", "en").orderBy("source").collect()
    values = np.array([[float(r[m]) for m in paired.METRICS] for r in rows])
    draws = np.random.default_rng(20261002).integers(0, len(values), (10_000, len(values)))
    low, high = np.quantile(values[draws].mean(axis=1), [0.025, 0.975], axis=0)
    got = {r.metric: r for r in QUERIES["bootstrap_linear_ci"](spark, sf_dir).collect()}
    for k, m in enumerate(paired.METRICS):
        assert np.allclose([got[m].estimate, got[m].low, got[m].high], [values[:, k].mean(), low[k], high[k]])


def test_quota_greedy(spark, sf_dir):
    pool = tables._pool(spark, sf_dir).collect()
    sizes = Counter(r.stratum for r in pool)
    quotas = {s: 2 for s, n in sizes.items() if n >= 8}
    order = sampling.shuffled_places({s: sizes[s] for s in quotas})
    want = set()
    for source in {r.source for r in pool}:
        used, hints, rows = set(), None, [r for r in pool if r.source == source]
        for stratum in sorted(s for s in quotas if s.startswith(source + "/")):
            mine, hints = sorted((r for r in rows if r.stratum == stratum), key=lambda r: r.id), Counter()
            left = [mine[i] for i in order[stratum]]
            for n in range(4):
                left = [r for r in left if r.group_id not in used]
                best = min(range(len(left)), key=lambda i: (hints[left[i].hint], i))
                r = left.pop(best)
                used.add(r.group_id)
                hints[r.hint] += 1
                want.add((source, r.id, stratum, n >= 2))
    assert {tuple(r) for r in QUERIES["quota_greedy"](spark, sf_dir).select("source", "id", "stratum", "reserve").collect()} == want


def test_greedy_extension(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = tables._pool(spark, sf_dir).withColumn("selected", F.pmod(F.xxhash64("id"), F.lit(20)) == 0).collect()
    tokens = lambda r: [f"task={r.hint}", f"stratum={r.stratum}"]
    chosen = [r for r in rows if r.selected]
    held, used, taken = Counter(t for r in chosen for t in tokens(r)), {r.group_id for r in chosen}, []
    got = QUERIES["greedy_extension"](spark, sf_dir).collect()
    assert len(got) == 12
    weights = Counter(r.source for r in chosen)
    assert all(abs(n - 12 * weights[s] / len(chosen)) < 1 for s, n in Counter(g.source for g in got).items())
    for g in got:
        free = [r for r in rows if r.source == g.source and not r.selected and r.group_id not in used]
        best = min(free, key=lambda r: (-sampling.rarity(tokens(r), held), r.id))
        assert (g.base_id, g.score, g.new_tokens) == (best.id, sampling.rarity(tokens(best), held), sum(held[t] == 0 for t in tokens(best)))
        held.update(tokens(best))
        used.add(best.group_id)
        taken.append(best.id)
