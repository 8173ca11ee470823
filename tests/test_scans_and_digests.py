"""Prefix scans, as-of joins, digest trees, header source, staged publishing, gram index, wide correlations."""

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortrank.operators import aggregates as A
from cohortrank.operators import joins as J
from cohortrank.operators import sets as U
from cohortrank.operators.scan import asof_join, prefix_scan
from cohortrank.plans import digest as DG
from cohortrank.plans import league as L
from cohortrank.plans import quality as Q
from cohortrank.plans import registry as RG
from cohortrank.sources import files as FS
from cohortrank.sources import publish as PB
from cohortrank.sources.headers import first_record, read_headers


def plan_of(df):
    return df._jdf.queryExecution().toString()


# ---- scans -------------------------------------------------------------------

@pytest.mark.parametrize("group", [None, "g"])
def test_prefix_scan_matches_pandas(spark, group):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "b", "b", None]), rng.randrange(40), None if rng.random() < 0.3 else rng.randrange(-50, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, x int, v long").repartition(6)
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "prev": ("last", "v"), "nxt": ("next", "v")}
    got = {r.id: r for r in prefix_scan(df, ["x", "id"], aggs, group).collect()}
    groups = {}
    for i, g, x, v in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(g if group else 0, []).append((i, v))
    for seq in groups.values():
        for k, (i, _) in enumerate(seq):
            seen = [v for _, v in seq[:k + 1] if v is not None]
            rest = [v for _, v in seq[k:] if v is not None]
            want = (sum(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None, rest[0] if rest else None)
            assert (got[i].s, got[i].hi, got[i].lo, got[i].prev, got[i].nxt) == want
    assert prefix_scan(df.limit(0), ["x", "id"], aggs, group).count() == 0
    with pytest.raises(ValueError):
        prefix_scan(df, ["x"], {"a": ("median", "v")})


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(2)
    left = [(i, rng.choice([0, 0, 1, None]), None if rng.random() < 0.1 else rng.choice([7.0, rng.randrange(30) / 2])) for i in range(600)]
    right = [(rng.choice([0, 1, 2, None]), rng.randrange(30) / 2, j) for j in range(80)]
    df = spark.createDataFrame(left, "id long, g int, x double")
    r = spark.createDataFrame(right, "g int, rx double, tag int")
    got = {q.id: (q.prev and tuple(q.prev), q.next and tuple(q.next)) for q in asof_join(df, "x", r, "rx", ["rx", "tag"], ["tag"], ["g"]).collect()}
    assert len(got) == len(left)
    for i, g, x in left:
        own = sorted((rx, tag) for gg, rx, tag in right if gg == g)
        prev = [t for t in own if x is not None and t[0] <= x]
        nxt = [t for t in own if x is not None and t[0] > x]
        assert got[i] == (prev[-1] if prev else None, nxt[0] if nxt else None), (i, g, x)


def test_interpolation_over_many_anchors(spark):
    n = 50_000  # more than a broadcast of the session's threshold would take if each row were wide; no nested loop either way
    anchors = spark.range(n).select((F.col("id") * 2.0).alias("ax"), F.sqrt(F.col("id").cast("double")).alias("ay"), (F.col("id") + 1).alias("anchor_ord"))
    xs = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 41.3 - 900).alias("x"))
    out = L.interpolate(xs, "x", anchors)
    assert "NestedLoop" not in plan_of(out)
    got = {r.id: (r.x, r.interp) for r in out.collect()}
    assert len(got) == 3000
    ax, ay = np.arange(n) * 2.0, np.sqrt(np.arange(n))
    for x, y in got.values():
        assert y is None if x is None else math.isclose(y, float(np.interp(x, ax, ay)), rel_tol=1e-12, abs_tol=1e-12)
    assert [r.interp for r in L.interpolate(xs.limit(3), "x", anchors.limit(0)).collect()] == [None] * 3


def test_monotone_anchors_per_group(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.0, 3.0), ("a", 2.0, 9.0), ("b", 1.0, 1.0), ("b", 0.5, 2.0)]
    got = sorted(tuple(r) for r in L.monotone_anchors(spark.createDataFrame(rows, "g string, ax double, ay double"), group_cols="g").collect())
    assert got == [("a", 1.0, 5.0, 1), ("a", 2.0, 5.0, 2), ("a", 2.0, 9.0, 3), ("b", 0.5, 2.0, 1), ("b", 1.0, 2.0, 2)]


def test_registry_numbers_run_on_over_empty_arrays(spark):
    rows = [("green", "x", "X", "AAA", ["p", "q"], 2), ("green", "y", "Y", "BBB", [], 1), ("red", "z", "Z", "CCC", ["r"], 0), ("green", "n", "N", "DDD", None, 0),
            ("yellow", "w", "W", "EEE", ["s", "t", "u"], 5)]
    df = spark.createDataFrame(rows, "tier string, local_name string, english_name string, code string, leagues array<string>, row_ord long")
    assert [(r.num, r.league) for r in RG.build_registry(df).orderBy("num").collect()] == [(1, "p"), (2, "q"), (3, "s"), (4, "t"), (5, "u"), (6, "r")]
    assert [(r.num, r.league) for r in RG.build_registry(df, ("yellow", "red")).orderBy("num").collect()] == [(1, "s"), (2, "t"), (3, "u"), (4, "r")]


def test_suggestions_match_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB é.") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + ["Serie A", "serie b", None]
    leagues = ["", "a", "ab", "é", "abab", "bba", "Serie Z", "serie", "zzzzzzz", "ab abab"]
    cat = spark.createDataFrame([(f"ar{i % 4}", n, i) for i, n in enumerate(names)], "area string, name string, cat_ord int")
    scopes = spark.createDataFrame([(f"x. {q}",) for q in leagues], "scope string")
    out = J.suggest(scopes, cat)
    assert "NestedLoop" not in plan_of(out)
    got = {}
    for r in out.orderBy("scope", "rank").collect():
        got.setdefault(r.scope, []).append((r.rank, r.suggestion))
    for q in leagues:
        key = q.strip().lower()[:6]
        hits = [f"ar{i % 4}. {n}" for i, n in enumerate(names) if n is not None and key in n.lower()][:8]
        assert got.get(f"x. {q}", []) == list(enumerate(hits, 1)), q


# ---- digests -----------------------------------------------------------------

def _tables(spark, seed=5, n=800):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y", None, ""]), rng.choice([0.0, 1.5, None, float("nan")]), f"t{i}") for i in range(n)]
    rows += rows[:5]  # duplicated keys
    a = spark.createDataFrame(rows, "k long, s string, v double, w string")
    b = a.where("k % 97 <> 1").withColumn("w", F.when(F.col("k") % 131 == 2, F.lit("changed")).otherwise(F.col("w"))).withColumn(
        "s", F.when(F.col("k") % 211 == 3, F.concat(F.col("s"), F.lit(" "))).otherwise(F.col("s"))).select("w", "v", "k", "s")
    return a, b


def test_diff_by_digest_is_the_keyed_diff(spark):
    a, b = _tables(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(Q.diff_keyed(a, b, ["k"]))
    assert want
    for groups, leaves in ((256, 64), (2, 2), (1, 1)):
        assert rows(DG.diff_by_digest(a, b, ["k"], groups, leaves)) == want
    assert rows(DG.diff_by_digest(a, a, ["k"])) == []
    assert rows(DG.diff_by_digest(a, b.limit(0), ["k"])) == []


def test_buckets_that_differ_are_few(spark):
    a, b = _tables(spark)
    cols = ["k", "s", "v", "w"]
    leaves = [DG.digest_leaves(t, ["k"], cols) for t in (a, b)]
    assert DG.differing_buckets(leaves[0], leaves[0]).count() == 0
    changed = {r.k for r in a.collect() if r.k % 97 == 1 or r.k % 131 == 2 or (r.k % 211 == 3 and r.s is not None)}
    assert 0 < DG.differing_buckets(*leaves).count() <= len(changed)
    # the order of rows and of partitions does not matter
    assert DG.differing_buckets(leaves[0], DG.digest_leaves(a.orderBy(F.rand(1)).repartition(3), ["k"], cols)).count() == 0


def test_stored_tables_are_pruned_to_differing_groups(spark, tmp_path):
    a, b = _tables(spark, n=400)
    b = b.where("k % 97 <> 1 or true").select(*a.columns)
    one = a.withColumn("w", F.when(F.col("k") == 77, F.lit("z")).otherwise(F.col("w")))
    for name, t in (("a", a), ("b", b), ("one", one)):
        DG.write_digested(t, str(tmp_path / name), ["k"], 16, 4)
    paths = {n: str(tmp_path / n) for n in ("a", "b", "one")}
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(DG.diff_stored(spark, paths["a"], paths["b"], ["k"])) == rows(Q.diff_keyed(a, b, ["k"]))
    out = DG.diff_stored(spark, paths["a"], paths["one"], ["k"])
    assert [tuple(r) for r in out.collect()] == [("77", "w", "t77", "z")]
    assert "dynamicpruning" in plan_of(out)


def test_dedup_by_digest(spark):
    rows = [("a", 0.0, 1), ("a", -0.0, 1), (None, 0.0, 1), (None, 0.0, 1), ("-", None, 1), (None, None, 1), ("1:a", float("nan"), 2), ("1:a", float("nan"), 2), ("", 1.0, 2)]
    df = spark.createDataFrame(rows * 3 + [("only", 1.0, 9)], "s string, v double, i int")
    out = U.dedup_rows(df)
    assert out.columns == df.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.dropDuplicates().collect()))
    assert tuple(U.removed_count(df, out).first()) == (28, 7, 21)
    assert U.dedup_rows(df.limit(0)).count() == 0
    nested = df.withColumn("l", F.array("v"))
    assert U.dedup_rows(nested).count() == 7


# ---- headers -----------------------------------------------------------------

def test_header_source_reads_first_records_only(spark, tmp_path):
    root = tmp_path / "2025-2026"
    texts = {"1 - [GER] - (A+B)/x.csv": '﻿Key,"Pla,yer","Te""am\nname",Key\n1,2,3,4\n' + "5,6,7,8\n" * 200_000, "2 - [FRA] - (C)/y.csv": "Key\r\n1\r\n",
             "3 - [ESP] - (D)/z.csv": "", "4 - [POR] - (E)/no_end.csv": "a,b", "5 - [RSA] - (F)/_hidden.csv": "q\n", "5 - [RSA] - (F)/note.txt": "Key\n"}
    for p, t in texts.items():
        os.makedirs((root / p).parent, exist_ok=True)
        (root / p).write_text(t, encoding="utf-8", newline="")
    got = {os.path.basename(r.path): r for r in read_headers(spark, str(tmp_path), files_per_partition=1).collect()}
    assert {k: r.header for k, r in got.items()} == {"x.csv": ["Key", "Pla,yer", 'Te"am\nname', "Key.1"], "y.csv": ["Key"], "no_end.csv": ["a", "b"]}
    assert got["x.csv"].bytes_read <= 4096 < os.path.getsize(root / "1 - [GER] - (A+B)/x.csv")
    # the paths are those of the scans, so rows find their header, a plus sign included
    spec = ["Key"]
    df, _ = FS.read_exports(spark, str(tmp_path), spec, season="2025-2026", strict=False)
    assert {(r.league, r.n) for r in df.groupBy("league").agg(F.count("*").alias("n")).collect()} == {("A+B", 200_001), ("C", 1)}
    (tmp_path / "empty").mkdir()
    assert read_headers(spark, str(tmp_path / "empty")).count() == 0


def test_first_record_over_block_edges():
    import io
    text = b'"a""b\r\n",c' + b"x" * 50 + b"\rrest"
    for block in (1, 2, 3, 7, 4096):
        record, size = first_record(io.BytesIO(text), block)
        assert record == text[:-5] and size <= len(text)


# ---- publishing --------------------------------------------------------------

def test_publish_holds_back_what_does_not_agree(spark, tmp_path):
    root = str(tmp_path / "pub")
    with pytest.raises(FileNotFoundError):
        PB.read_published(spark, root)
    frame = lambda rows: spark.createDataFrame(rows, "season string, league_code string, v int")
    want = lambda rows: spark.createDataFrame(rows, "season string, league_code string, expected int")
    seen = lambda: sorted(tuple(r) for r in PB.read_published(spark, root).select("season", "league_code", "v").collect())
    first = frame([("s", "A", 1), ("s", "A", 2), ("s", "B", 3), ("s", "C", 4)])
    status = {(r.league_code, r.n_rows, r.expected, r.status) for r in PB.publish(first, root, want([("s", "A", 2), ("s", "B", 5), ("s", "D", 1)])).collect()}
    assert status == {("A", 2, 2, "published"), ("B", 1, 5, "mismatch"), ("C", 1, None, "unexpected"), ("D", None, 1, "missing")}
    assert seen() == [("s", "A", 1), ("s", "A", 2)]
    # a run that was not finished: data without a manifest
    FS.write_merged(frame([("s", "A", 99)]), f"{root}/data/run=r-broken")
    assert seen() == [("s", "A", 1), ("s", "A", 2)]
    PB.publish(frame([("s", "A", 7), ("s", "B", 8)]), root, want([("s", "A", 2), ("s", "B", 1)]))
    assert seen() == [("s", "A", 1), ("s", "A", 2), ("s", "B", 8)]
    PB.publish(frame([("s", "A", 9)]), root, want([("s", "A", 1)]))
    assert seen() == [("s", "A", 9), ("s", "B", 8)]


def test_newest_season_reads_its_folders_only(spark, tmp_path):
    rows = [("2020-2021", "A", 1), ("2021-2022", "A", 2), ("2021-2022", "A", 3), ("2020-2021", "B", 4), ("2019-2020", "B", 5)]
    root = str(tmp_path / "seasons")
    FS.write_merged(spark.createDataFrame(rows, "season string, league_code string, v int"), root)
    df, choice = PB.scan_newest(spark, root)
    assert sorted(r.v for r in df.collect()) == [2, 3, 4]
    assert {(r.league_code, r.latest_season, r.n_rows) for r in choice.collect()} == {("A", "2021-2022", 2), ("B", "2020-2021", 1)}
    assert "dynamicpruning" in plan_of(df)
    counts = spark.createDataFrame([("A", "2022-2023", 0), ("A", "2021-2022", 2), ("C", "2021-2022", 0)], "league_code string, season string, n_rows long")
    assert [tuple(r) for r in PB.newest_seasons(counts).collect()] == [("A", "2021-2022", 2)]


# ---- correlations ------------------------------------------------------------

def test_wide_correlations_equal_the_narrow_ones(spark):
    rng = np.random.default_rng(6)
    n = 700
    x = rng.normal(size=(n, 5))
    x[:, 1] = 1e9 + x[:, 0] * 3 + x[:, 1]  # a large offset
    data = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": np.where(rng.random(n) < 0.4, np.nan, x[:, 2]), "d": np.full(n, 0.1), "e": np.full(n, np.nan)})
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    cols = list(data.columns)
    key = lambda t: {(r.a, r.b): r.r for r in t.collect()}
    wide, narrow = key(A.corr_matrix_wide(df, cols)), key(A.corr_matrix(df, cols))
    assert wide.keys() == narrow.keys()
    for k, v in wide.items():
        assert (v is None) == (narrow[k] is None) and (v is None or abs(v - narrow[k]) < 2e-9), k
    assert abs(wide["a", "b"] - np.corrcoef(x[:, 0], x[:, 1])[0, 1]) < 1e-6
    assert A.corr_matrix_wide(df.limit(0), cols).where("r is not null").count() == 0
    many = [f"m{i}" for i in range(110)]
    big = spark.range(200).select(*[(F.rand(i) + (F.col("id") if i % 2 else F.lit(0))).alias(c) for i, c in enumerate(many)])
    assert A.corr_matrix_wide(big, many).count() == 110 * 110
