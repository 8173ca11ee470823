from pyspark.sql import functions as F

from cohortrank.functions import numeric as N
from cohortrank.functions import text as X
from cohortrank.functions import roles as RO
from cohortrank.plans.league import interpolate, monotone_anchors


def _one(spark, expr, schema="x string", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_to_number(spark):
    rows = [("10",), ("10d",), ("1,000",), ("€10M",), ("nan",), (" 12.5 ",), ("1e3",), ("",), (None,), ("-.5",)]
    got = _one(spark, N.to_number(F.col("x")), rows=rows)
    assert got == [10.0, None, None, None, None, 12.5, 1000.0, None, None, -0.5]


def test_round_half_even(spark):
    rows = [(0.25,), (0.35,), (2.5,), (1.015,)]
    assert _one(spark, N.round_half_even(F.col("x"), 1), "x double", rows)[:3] == [0.2, 0.4, 2.5]
    assert _one(spark, N.round_half_even(F.col("x"), 0), "x double", rows)[2] == 2.0


def test_bucketize_right_closed(spark):
    rows = [(-0.1,), (0.0,), (15.0,), (15.01,), (50.0,), (101.0,), (101.5,), (None,)]
    got = _one(spark, N.bucketize(F.col("x"), [-0.1, 15, 30, 50, 101], ["d", "c", "b", "a"]), "x double", rows)
    assert got == ["nan", "d", "d", "c", "b", "a", "nan", "nan"]


def test_shrink_and_evidence(spark):
    rows = [(None, None), (0.9, 0.5), (0.9, 2.0), (0.2, -1.0)]
    got = _one(spark, N.shrink(F.col("v"), F.col("w")), "v double, w double", rows)
    assert got == [0.5, 0.5 + 0.4 * 0.5, 0.9, 0.5]
    ev = _one(spark, N.evidence(F.col("m")), "m double", [(450.0,), (1800.0,), (5000.0,)])
    assert ev == [0.5, 1.0, 1.0]


def test_league_code(spark):
    rows = [("GER", "2. Bundesliga"), ("ESP", "Primera División RFEF"), ("JPN", "J1 League"), ("ITA", "Serie")]
    got = _one(spark, X.league_code(F.col("c"), F.col("l")), "c string, l string", rows)
    assert got == ["GER_22B", "ESP_PDNR", "JPN_J1L", "ITA_SERIE"]


def test_parse_folder_and_safe_name(spark):
    rows = [("1 - [GER] - (2. Bundesliga)",), ("notes",)]
    df = spark.createDataFrame(rows, "x string")
    n, c, lg = X.parse_folder(F.col("x"))
    got = [tuple(r) for r in df.select(n, c, lg).collect()]
    assert got == [(1, "GER", "2. Bundesliga"), (None, "", "notes")]
    assert _one(spark, X.safe_name(F.col("x")), rows=[(' a:b/c?. ',)]) == ["a-b-c-"]


def test_composite_key_and_cell_equality(spark):
    rows = [("M. Schulz", "Münster", "31"), ("M. Schulz", "Münster", "30.0"), (" M. Schulz ", None, "22")]
    keys = _one(spark, X.composite_key(["p", "t", "a"], numeric=["a"]), "p string, t string, a string", rows)
    assert keys == ["M. Schulz | Münster | 31", "M. Schulz | Münster | 30", "M. Schulz | <NA> | 22"]
    assert _one(spark, X.composite_key(["a"]), "a string", [("007",), ("7",), ("7.0",)]) == ["007", "7", "7.0"]
    eq = _one(spark, X.cells_equal(F.col("a"), F.col("b")), "a string, b string",
              [("3", "3.0"), (None, None), ("x ", "x"), ("1", None), ("a", "b")])
    assert eq == [True, True, True, False, False]


def test_split_scope_and_slug(spark):
    df = spark.createDataFrame([("Germany. 2. Bundesliga",), ("Nowhere",)], "s string")
    a, b = X.split_scope(F.col("s"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("Germany", "2. Bundesliga"), ("Nowhere", "")]
    assert _one(spark, X.slug(F.col("x")), rows=[("Série B — Brasil!",)]) == ["Serie_B_Brasil"]
    names = [("Česko",), ("Şampiyon",), ("Šibenik",), ("ﬁnal",), ("Łódź",), (None,)]
    assert _one(spark, X.slug(F.col("x")), rows=names) == ["Cesko", "Sampiyon", "Sibenik", "final", "odz", None]


def test_natural_key_orders_every_number(spark):
    names = ["10 - [GER] - (10. Liga)", "10 - [GER] - (2. Liga)", "9 - [GER] - (11. Liga)", "b2", "B10"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r.x for r in df.orderBy(X.natural_key("x")).collect()]
    assert got == ["9 - [GER] - (11. Liga)", "10 - [GER] - (2. Liga)", "10 - [GER] - (10. Liga)", "b2", "B10"]


def test_money_label(spark):
    got = _one(spark, X.money_label(F.col("v")), "v double", [(1250000.0,), (1000000.0,), (300400.0,), (None,)])
    assert got == ["1.3 M€", "1 M€", "300 k€", "—"]


def test_roles(spark):
    m = {"CF": "CF", "LW": "W"}
    rows = [("CF, LW",), (" LW",), ("GK",), (None,), ("",)]
    got = _one(spark, RO.assign_role(F.col("x"), m), rows=rows)
    assert got == ["CF", "W", None, "NA", None]
    got = _one(spark, RO.assign_role_default(F.col("x"), m), rows=rows)
    assert got == ["CF", "W", "MID", "MID", "MID"]


def test_interpolation_ties_and_clamps(spark):
    anchors = monotone_anchors(spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 30.0), (3.0, 40.0)], "ax double, ay double"))
    xs = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (2.5,), (3.0,), (9.0,), (None,)], "x double")
    got = {r["x"]: r["interp"] for r in interpolate(xs, "x", anchors).collect()}
    assert got[0.5] == 10.0 and got[1.0] == 10.0 and got[1.5] == 15.0
    assert got[2.0] == 30.0 and got[2.5] == 35.0 and got[3.0] == 40.0 and got[9.0] == 40.0 and got[None] is None


def test_monotone_anchors(spark):
    a = monotone_anchors(spark.createDataFrame([(1.0, 10.0), (2.0, 5.0), (3.0, 40.0)], "ax double, ay double"))
    assert [r["ay"] for r in a.orderBy("anchor_ord").collect()] == [10.0, 10.0, 40.0]
