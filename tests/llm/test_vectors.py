"""Hard negatives and near-duplicate embeddings against plain numpy versions, their SQL, and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import embedding_dedup, hard_negatives, queries, tiles

from ..compare import database, from_duckdb, from_spark

SCHEMA = "vec_id long, embedding array<double>, label int, n long, g long, shard int, c int, score string, links int, anchor string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, 2, 3, 4, "s", 5, "a") for i, v, y in rows], SCHEMA).repartition(parts)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rows_of(spark, sf_dir):
    return [(r.vec_id, r.embedding, r.label) for r in queries.table(spark, sf_dir, "embeddings").collect()]


def plain_negatives(rows):
    rows = [(i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if y is not None and good(v)]
    first = lambda i: (i is None, i or 0)
    out = []
    for k, (anchor, v, label) in enumerate(rows):
        if anchor is not None and anchor % 100 == 0:
            scored = [(sum(a * b for a, b in zip(v, w, strict=False)), i, y) for m, (i, w, y) in enumerate(rows) if m != k]
            scored.sort(key=lambda s: (-s[0], first(s[1])))
            for top, positive, _ in [s for s in scored if s[2] == label][:5]:
                fits = [s for s in scored if s[2] != label and 80 * top <= 100 * s[0] <= 100 * top][:5]
                out += [(anchor, positive, rank, i, top, s) for rank, (s, i, _) in enumerate(fits, 1)]
    return sorted(map(str, out))


def negatives(df):
    return sorted(str(tuple(r)) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def mined(df):
    return hard_negatives.hard_negatives(df, F.expr(hard_negatives.ANCHOR), label=hard_negatives.noisy_label())


def odd_vectors(seed, n, dims=40):
    """Ties, repeated rows, nulls, non-finite and short vectors, a hot label and a hot vector."""
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=dims).round(1), int(rng.integers(0, 3)) if rng.random() < 0.6 else 1) for k in range(n)]
    rows += [(n + k, rows[3][1], k % 3) for k in range(n // 3)] + [(100, rows[100][1], 1), (100, rows[100][1], 1)]
    rows += [(None, rows[5][1], 1), (None, rows[200][1], 2), (9000, None, 1), (9100, [math.nan] * dims, 1), (9200, [None] * dims, 1), (9300, [math.inf] * dims, 2), (9400, rows[0][1], None), (9500, rows[0][1][:7], 0), (9600, [], 0), (9700, [0.0] * dims, 1)]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows]


def test_hard_negatives_equal_sql(spark, sf_dir):
    assert from_spark(queries.op12_hard_negatives(spark, sf_dir)) == from_duckdb(database(sf_dir), hard_negatives.SQL)


@pytest.mark.parametrize("sizes", [(512, 1024, 32), (2, 7, 3)])
def test_hard_negatives_in_shards(spark, monkeypatch, sizes):
    for name, value in zip(("ANCHORS", "ROWS", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = odd_vectors(1, 400)
    want = plain_negatives(rows)
    assert len(want) > 20 and negatives(mined(frame(spark, rows))) == want


def test_hard_negatives_of_odd_tables(spark):
    assert negatives(mined(frame(spark, []))) == []
    assert negatives(mined(frame(spark, [(100, [1.0], 1)]))) == []
    assert negatives(mined(frame(spark, [(100, [1.0], 1), (101, [1.0], 2)]))) == []
    with pytest.raises(Exception, match="too long for scores"):
        negatives(mined(frame(spark, [(100, [1e300], 1), (101, [1.0], 1)])))


def plain_links(rows):
    rows = list(rows)
    live = [k for k, (_, v, _) in enumerate(rows) if good(v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for dims in {len(rows[k][1]) for k in live}:
        mine = [k for k in live if len(rows[k][1]) == dims]
        units = np.array([rows[k][1] for k in mine], dtype=float)
        units /= np.abs(units).max(axis=1)[:, None]
        units /= np.linalg.norm(units, axis=1)[:, None]
        near = units @ units.T >= 0.95
        for a, b in np.argwhere(near):
            if a != b:
                links[mine[a]].add(mine[b])
    seen, out = {}, []
    for k in range(len(rows)):
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for b in links[todo.pop()] - group:
                    group.add(b)
                    todo.append(b)
            ids = [rows[b][0] for b in group if rows[b][0] is not None]
            seen |= dict.fromkeys(group, min(ids, default=None))
        out.append((rows[k][0], len(links[k]), seen[k], rows[k][0] == seen[k]))
    return sorted(map(str, out))


def linked(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def near_vectors(seed, dims=64):
    """Groups of near copies from two to hundreds, chains, hot copies, scaled copies and odd rows among unlike vectors."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(600, dims)))
    out = list(base)
    for size, cosine in ((300, 0.985), (40, 0.975), (10, 0.96), *[(1, 0.955), (1, 0.97), (1, 0.945)] * 40):
        center = base[rng.integers(600)]
        noise = rng.normal(size=(size, dims))
        noise = unit(noise - (noise @ center)[:, None] * center)
        out += list(cosine * center + math.sqrt(1 - cosine**2) * noise)
    out += [base[7]] * 150 + [base[8] * 3.0] * 20 + [base[9] * 1e-200, base[9] * 1e200]
    rows = [(int(i), v.tolist(), 0) for i, v in zip(rng.permutation(len(out)), out, strict=True)]
    return rows + [(None, base[7].tolist(), 0), (None, base[10].tolist(), 0), (None, [1.0] + [0.0] * 70, 0), (5000, None, 0), (5001, [0.0] * dims, 0), (5002, [math.nan] * dims, 0), (5003, [None, 1.0], 0), (5004, [], 0), (5005, [3.0], 0), (5006, [2.0], 0), (5007, [-2.0], 0), (5007, [-2.0], 0)]


def test_embedding_dedup_equals_sql(spark, sf_dir):
    assert from_spark(queries.op13_embedding_near_dedup(spark, sf_dir)) == from_duckdb(database(sf_dir), embedding_dedup.SQL)


@pytest.mark.parametrize("tile", [256, 20])
def test_embedding_dedup(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "HOT", 64 if tile > 100 else 8)
    rows = near_vectors(tile)
    assert linked(embedding_dedup.near_duplicates(frame(spark, rows))) == plain_links(rows)


@pytest.mark.parametrize("dims", [1, 2, 3, 9, 17, 200])
def test_embedding_dedup_in_other_dimensions(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([base, base + 0.02 * rng.normal(size=base.shape)]))]
    assert linked(embedding_dedup.near_duplicates(frame(spark, rows))) == plain_links(rows)


def test_embedding_dedup_of_empty_table(spark):
    assert linked(embedding_dedup.near_duplicates(frame(spark, []))) == []
    assert linked(embedding_dedup.near_duplicates(frame(spark, [(1, None, 0)]))) == ["(1, 0, 1, True)"]


def test_pairs_at_the_threshold_share_filters():
    """Recall of the filters themselves, by unlike unit vectors and mates at a cosine of exactly 0.95."""
    rng = np.random.default_rng(0)
    a = embedding_dedup.unit_vectors(rng.normal(size=(1500, 64)))
    b = rng.normal(size=a.shape)
    b = embedding_dedup.unit_vectors(b - (a * b).sum(axis=1)[:, None] * a)
    codes = embedding_dedup.Codes(64, embedding_dedup.codewords(50_000))
    lists = [codes.decode(x) for x in (a, 0.95 * a + math.sqrt(1 - 0.95**2) * b)]
    shared = [len(np.intersect1d(x, y)) for x, y in zip(*lists, strict=True)]
    assert min(shared) >= 1 and np.mean(shared) > 30
    assert 70 < np.mean([len(x) for x in lists[0]]) < 90


def test_balls_hold_linked_vectors_only(spark):
    """Groups at several distances from their middle: what a ball takes is linked, and a tight group is one ball."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    center, out = unit(rng.normal(size=(3, 64))), []
    for c, cosine in zip(center, (0.993, 0.985, 0.978), strict=True):
        noise = rng.normal(size=(200, 64))
        noise = unit(noise - (noise @ c)[:, None] * c)
        out += list(cosine * c + math.sqrt(1 - cosine**2) * noise)
    classes = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(out)], "c long, embedding array<double>, weight long")
    words = embedding_dedup.codewords(600)
    decoded = embedding_dedup.passed_filters(classes, words)
    shared = decoded.select("dims", "c", F.explode("filters").alias("filter")).withColumn("n", F.lit(1000))
    found = {r.c: r.ball for r in embedding_dedup.balls(shared, decoded, words).collect()}
    units = np.array(out)
    for ball in set(found.values()):
        mine = [c for c, b in found.items() if b == ball]
        assert (units[mine] @ units[mine].T).min() >= 0.95
    assert sum(c < 200 for c in found) == 200 and len({b for c, b in found.items() if c < 200}) <= 3
