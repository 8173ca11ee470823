import pytest
from pyspark.sql import functions as F

from cohortrank.operators.sets import dedup_rows, duplicate_keys
from cohortrank.plans import quality as Q
from cohortrank.session import table

from .conftest import SF_SMALL


def _sup(spark):
    return table(spark, SF_SMALL, "supplier")


def test_compare_with_itself_is_identical(spark):
    a = _sup(spark)
    assert Q.diff_keyed(a, a, ["s_name", "s_nationkey"]).count() == 0
    assert Q.diff_positional(a, a, ["s_suppkey"]).count() == 0
    assert all(r["passed"] for r in Q.shape_checks(a, a).collect())


def test_duplicate_keys_are_reported_not_matched(spark):
    rows = [("M. Schulz", "Münster", 31.0, 1.0), ("M. Schulz", "Münster", 31.0, 2.0),
            ("M. Schulz", "Münster", 30.0, 3.0), ("M. Schulz", "Münster", 22.0, 4.0)]
    a = spark.createDataFrame(rows, "Player string, Team string, Age double, v double")
    b = a.withColumn("v", F.col("v") + 1)
    d = Q.diff_keyed(a, b, ["Player", "Team", "Age"]).collect()
    assert sorted(r["key"] for r in d) == ["M. Schulz | Münster | 22", "M. Schulz | Münster | 30"]
    dup = Q.with_key(a, ["Player", "Team", "Age"])
    assert [r["n"] for r in duplicate_keys(dup, ["key"]).collect()] == [2]


def test_dedup_is_idempotent(spark):
    d = table(spark, SF_SMALL, "documents").select("text")
    once = dedup_rows(d)
    assert sorted(once.collect()) == sorted(dedup_rows(once).collect())


def test_positional_diff_counts_min_rows(spark):
    a = _sup(spark)
    b = a.where(F.col("s_suppkey") <= 5)
    # b is a's first five rows: nothing differs, and only five rows are compared
    assert Q.diff_positional(a, b, ["s_suppkey"]).count() == 0


def test_combine_orders_by_value(spark):
    a = _sup(spark)
    m = Q.combine([a, a.where(F.col("s_suppkey") % 2 == 0)], "s_acctbal", ["s_suppkey"]).collect()
    assert len(m) == a.count()
    vals = [r["s_acctbal"] for r in sorted(m, key=lambda r: r["row_idx"])]
    assert vals == sorted(vals, reverse=True)


def _verdict(df):
    return {r["check_name"]: (r["value_a"], r["value_b"], r["passed"]) for r in df.collect()}


def test_compare_gives_one_verdict(spark):
    cols = "Player string, Team string, Age double, v double"
    a = spark.createDataFrame([("A", "x", 20.0, 1.0), ("A", "x", 20.0, 2.0), ("B", "x", 21.0, 3.0), ("C", "y", 22.0, 4.0)], cols)
    b = spark.createDataFrame([("A", "x", 20.0, 1.0), ("B", "x", 21.0, 9.0), ("D", "y", 22.0, 4.0)], cols)
    v = _verdict(Q.compare(a, b))  # the default key Player, Team, Age
    assert v["key unique"] == ("1", "0", False) and v["rows"] == ("4", "3", False) and v["columns"] == ("4", "4", True)
    assert v["column names"][2] and v["same keys"] == ("1", "1", False)
    assert v["cells"] == ("1", "1", False) and v["result"] == (None, None, False)
    assert _verdict(Q.compare(b, b))["result"][2] and _verdict(Q.compare(b, b, order_by=["Player"]))["result"][2]
    p = _verdict(Q.compare(a, b, order_by=["Player", "v"]))
    assert set(p) == {"rows", "columns", "column names", "cells", "result"} and p["cells"][0] == "12" and not p["cells"][2]
    empty = a.limit(0)
    assert _verdict(Q.compare(empty, empty))["cells"] == ("0", "0", False)
    assert _verdict(Q.compare(empty, empty, order_by=["Player"]))["result"][2]
    rows = Q.cell_tolerance(a, b, ["Player", "Team", "Age"], "v").collect()
    assert [(r["key"], r["close"]) for r in rows] == [("B | x | 21", False)]
    assert {r["column_name"]: r["rows_compared"] for r in Q.diff_summary(a, b, ["Player", "Team", "Age"]).collect()} == {"v": 1}


def test_key_choice(spark):
    a = spark.createDataFrame([("A", 20.0, 1.0)], "Player string, Age double, v double")
    assert Q.pick_key(a, a) == ["Player", "Age"]
    assert Q.pick_key(a, a.drop("Age")) == ["Player"]
    assert Q.pick_key(a.drop("Player"), a) == ["Age"]
    assert Q.pick_key(a, a, ["v"]) == ["v"]
    with pytest.raises(ValueError):
        Q.pick_key(a, a, ["Team"])
    with pytest.raises(ValueError):
        Q.pick_key(a.select("v"), a.select("Age"))
