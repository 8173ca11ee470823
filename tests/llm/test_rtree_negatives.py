"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortrank.llm import queries
from cohortrank.llm import rtree_negatives as rt


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, embedding)."""
    keep = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        keep.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, al, q in keep:
        if a % 100:
            continue
        near = sorted(((-sum(x * y for x, y in zip(q, v, strict=True)), i, label) for i, label, v in keep if len(v) == len(q)), key=lambda t: t[:2])
        pos = [(i, -s) for s, i, label in near if label == al and i != a][:positives]
        for p, ps in pos:
            hits = [(i, -s) for s, i, label in near if label != al and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(hits, 1)]
    return sorted(out)


def cloud(seed, n=1500, d=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, d))
    x = centre[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * 0.4
    x[n // 2:n // 2 + n // 3] = x[0]  # a third of all rows share one vector
    rows = [(i, int(rng.integers(0, 10)), [float(v) for v in x[i]]) for i in range(n)]
    return rows


ODD = [(5000, None, [1.0] * 12), (5100, 1, None), (5200, 2, [1.0] * 11 + [None]), (5300, 3, [float("nan")] * 12), (5400, 3, [float("inf")] * 12), (None, 3, [1.0] * 12),
       (5500, 3, []), (5600, 3, [0.5, 0.25]), (5601, 3, [0.5, 0.5]), (5602, 4, [0.25, 0.25]), (5700, 3, [0.0] * 12), (5800, -4, [-1.0] * 12), (-100, 5, [0.1] * 12), (-7, 5, [0.1] * 12)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, label int, embedding array<double>, rank int, q double").repartition(6)


def test_query_matches_brute_force(spark, tmp_path):
    rows = cloud(1) + ODD
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = brute(rows)
    assert len(want) > 200 and got == want


def test_small_tiles_and_leaves_give_the_same(spark):
    rows = cloud(2, 700, 3)
    df = frame(spark, rows).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    out = rt.hard_negatives(df.union(df), F.col("vec_id") % 100 == 0, tile=64, leaf=8)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_empty_and_unsound_tables(spark):
    df = frame(spark, cloud(3, 30, 3))
    anchors = F.col("vec_id") % 100 == 0
    assert rt.hard_negatives(df.limit(0), anchors).count() == 0
    assert rt.hard_negatives(df, F.lit(False)).count() == 0
    assert rt.hard_negatives(frame(spark, [(0, 1, [1e300] * 3), (1, 1, [1e30] * 3), (2, 1, [1.0] * 3)]), anchors).count() == 0
    twice = rt.integer_rows(frame(spark, [(1, 2, [1.0]), (1, 1, [2.0]), (1, 1, [0.001])])).collect()
    assert [tuple(r) for r in twice] == [(1, 1, [0])]


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_intervals_hold_all_products(scale):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(500, 9)) * 256 * scale)
    q = np.floor(rng.normal(size=(7, 9)) * 256 * scale)
    o = rt.pack(x, [0, 1, 2], 20)
    assert sorted(o.tolist()) == list(range(500))
    tree = rt.Tree(x[o].astype(np.int64), np.arange(500), np.zeros(500, np.int64), 20, 4)
    assert [len(v[2]) for v in tree.levels] == [25, 7, 2, 1]
    low, high = tree.levels[0][:2]
    least, greatest = rt.interval(q, low, high)
    s = q @ x[o].T
    for leaf in range(25):
        part = s[:, leaf * 20:leaf * 20 + 20]
        assert (least[:, leaf] <= part.min(axis=1)).all() and (part.max(axis=1) <= greatest[:, leaf]).all()


def test_queue_leaves_boxes_unopened(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4000, 2)) * 256).astype(np.int64)
    o = rt.pack(x, [0, 1], 32)
    tree = rt.Tree(x[o], o.astype(np.int64), np.zeros(4000, np.int64), 32)
    opened = []
    real = rt.products
    monkeypatch.setattr(rt, "products", lambda *a: opened.append(1) or real(*a))
    got = rt.descend(tree, -1, 0, x[17], [(0, rt.LEAST, rt.MOST, rt.LEAST, rt.MOST)], 5, True)
    score = x @ x[17]
    assert [g[1:] for g in got] == [(int(i), int(score[i])) for i in np.lexsort((np.arange(4000), -score))[:5]]
    assert len(opened) < 20
