"""Q4 combine and Q6 compare.

The cell comparison joins the two tables once on the key (or on the row
index) and explodes only the cells that differ; the tables are never
unpivoted before the shuffle, so the exchanged volume is the two tables, not
rows x columns.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import to_number
from ..functions.text import cells_close, cells_equal, composite_key
from ..operators.rank import row_index
from ..operators.sets import dedup_rows, duplicate_keys, union_exports
from ..spec import DEFAULT_KEYS, MAX_LISTED, PREVIEW_N


def with_key(df: DataFrame, key_cols: Sequence[str], out: str = "key") -> DataFrame:
    """Add the composite text key."""
    numeric = [c for c in key_cols if isinstance(df.schema[c].dataType, T.NumericType)]
    return df.withColumn(out, composite_key(list(key_cols), numeric=numeric))


def pick_key(a: DataFrame, b: DataFrame, key_cols: Sequence[str] | None = None,
             defaults: Sequence[Sequence[str]] = DEFAULT_KEYS) -> list[str]:
    """The stated key, else the first default set that both tables have, else their first shared column."""
    shared = [c for c in a.columns if c in set(b.columns)]
    if key_cols:
        missing = [c for c in key_cols if c not in shared]
        if missing:
            raise ValueError(f"key columns not in both tables: {missing}")
        return list(key_cols)
    if not shared:
        raise ValueError("the tables share no column")
    return next((list(cols) for cols in defaults if set(cols) <= set(shared)), shared[:1])


def _unique_sides(a: DataFrame, b: DataFrame, key_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with their key, without the keys that either holds more than once."""
    ka, kb = with_key(a, key_cols), with_key(b, key_cols)
    dups = duplicate_keys(ka, ["key"]).select("key").unionByName(
        duplicate_keys(kb, ["key"]).select("key")).distinct()
    return ka.join(dups, "key", "left_anti"), kb.join(dups, "key", "left_anti")


def _side(df: DataFrame, cols: Sequence[str], tag: str) -> DataFrame:
    return df.select("key", *[F.col(f"`{c}`").alias(f"{tag}{i}") for i, c in enumerate(cols)])


def _cell_diffs(joined: DataFrame, cols: Sequence[str], label) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.col(f"a{i}").cast("string").alias("value_a"),
                               F.col(f"b{i}").cast("string").alias("value_b"),
                               cells_equal(F.col(f"a{i}"), F.col(f"b{i}")).alias("same"))
                      for i, c in enumerate(cols)])
    x = joined.select(label.alias("key"), F.explode(F.filter(cells, lambda s: ~s["same"])).alias("d"))
    return x.select("key", "d.column_name", "d.value_a", "d.value_b")


def diff_keyed(a: DataFrame, b: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Differing cells of rows matched by composite key; duplicated keys left out.

    Output: one row per differing cell ``(key, column, value_a, value_b)``.
    """
    shared = [c for c in a.columns if c in set(b.columns) and c not in key_cols]
    ka, kb = _unique_sides(a, b, key_cols)
    joined = _side(ka, shared, "a").join(_side(kb, shared, "b"), "key", "inner")
    return _cell_diffs(joined, shared, F.col("key"))


def diff_positional(a: DataFrame, b: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Row i of a vs row i of b under a stated total order; first min(n, m) rows.

    Row numbers come from the distributed row-index operator (W7), no
    single-partition window.
    """
    shared = [c for c in a.columns if c in set(b.columns)]
    ia = row_index(a, order_by, out="_row").drop("_n_rows")
    ib = row_index(b, order_by, out="_row").drop("_n_rows")
    sa = ia.select(F.col("_row").alias("key"), *[F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(shared)])
    sb = ib.select(F.col("_row").alias("key"), *[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(shared)])
    joined = sa.join(sb, "key", "inner")
    return _cell_diffs(joined, shared, F.concat(F.lit("row "), F.col("key").cast("string")))


def key_membership(a: DataFrame, b: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Each distinct key with 'both', 'only_a' or 'only_b'."""
    ka = with_key(a, key_cols).select("key").distinct().withColumn("_a", F.lit(True))
    kb = with_key(b, key_cols).select("key").distinct().withColumn("_b", F.lit(True))
    j = ka.join(kb, "key", "full_outer")
    return j.select("key", F.when(F.col("_a") & F.col("_b"), "both")
                    .when(F.col("_a"), "only_a").otherwise("only_b").alias("membership"))


def shape_checks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row count, column count, names-and-order checks as rows (check, a, b, passed)."""
    counts = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    ca, cb = a.columns, b.columns
    meta = [("columns", str(len(ca)), str(len(cb)), len(ca) == len(cb)),
            ("column names", ",".join(ca), ",".join(cb), ca == cb)]
    rows = counts.select(F.lit("rows").alias("check_name"), F.col("na").cast("string").alias("value_a"),
                         F.col("nb").cast("string").alias("value_b"), (F.col("na") == F.col("nb")).alias("passed"))
    schema = T.StructType([T.StructField("check_name", T.StringType()), T.StructField("value_a", T.StringType()),
                           T.StructField("value_b", T.StringType()), T.StructField("passed", T.BooleanType())])
    return rows.unionByName(a.sparkSession.createDataFrame(meta, schema))


def diff_summary(a: DataFrame, b: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Per compared column: differing cells, rows compared, share different."""
    shared = [c for c in a.columns if c in set(b.columns) and c not in key_cols]
    ka, kb = _unique_sides(a, b, key_cols)
    common = ka.select("key").join(kb.select("key"), "key", "inner").agg(F.count(F.lit(1)).alias("rows_compared"))
    diffs = diff_keyed(a, b, key_cols).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_different"))
    cols = a.sparkSession.createDataFrame([(c,) for c in shared], "column_name string")
    j = cols.join(diffs, "column_name", "left").crossJoin(common)
    return j.select("column_name", F.coalesce("n_different", F.lit(0)).cast("long").alias("n_different"),
                    "rows_compared",
                    (F.coalesce("n_different", F.lit(0)) / F.col("rows_compared")).alias("share_different"))


def _verdict(one: DataFrame, checks: Sequence[tuple[str, object, object, Column]]) -> DataFrame:
    """One row per check (check_name, value_a, value_b, passed) of a one-row table, then the overall result."""
    row = lambda name, x, y, ok: F.struct(F.lit(name).alias("check_name"), x.cast("string").alias("value_a"),
                                          y.cast("string").alias("value_b"), ok.alias("passed"))
    none = F.lit(None)
    result = row("result", none, none, reduce(lambda p, q: p & q, [ok for _, _, _, ok in checks]))
    return one.select(F.explode(F.array(*[row(*c) for c in checks], result)).alias("c")).select("c.*")


def compare(a: DataFrame, b: DataFrame, key_cols: Sequence[str] | None = None, order_by: Sequence[str] | None = None,
            defaults: Sequence[Sequence[str]] = DEFAULT_KEYS) -> DataFrame:
    """Q6: the verdict of a comparison, one row per check and a last row ``result``.

    With ``order_by`` row i meets row i; else rows meet by key (``pick_key``),
    keys that a side holds twice are counted and not compared. Values: duplicated
    keys, rows, columns and column names per side, keys on one side only, and
    cells compared and cells that differ. A keyed comparison of no cells fails;
    a positional one of two empty tables passes.
    """
    ca, cb = a.columns, b.columns
    shared = [c for c in ca if c in set(cb)]
    names = [("columns", F.lit(len(ca)), F.lit(len(cb)), F.lit(len(ca) == len(cb))),
             ("column names", F.lit(",".join(ca)), F.lit(",".join(cb)), F.lit(ca == cb))]
    n_rows = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    same_rows = ("rows", F.col("na"), F.col("nb"), F.col("na") == F.col("nb"))
    if order_by:
        one = n_rows(a, "na").crossJoin(n_rows(b, "nb")).crossJoin(n_rows(diff_positional(a, b, order_by), "n_diff"))
        cells = F.least("na", "nb") * F.lit(len(shared))
        return _verdict(one, [same_rows, *names, ("cells", cells, F.col("n_diff"), (F.col("n_diff") == 0) & same_rows[3])])
    key = pick_key(a, b, key_cols, defaults)
    count = lambda df, name: with_key(df, key).groupBy("key").agg(F.count(F.lit(1)).alias(name))
    both = count(a, "a").join(count(b, "b"), "key", "full_outer")
    one = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("b"), F.lit(0)).alias("nb"),
                   F.count_if(F.col("a") > 1).alias("dup_a"), F.count_if(F.col("b") > 1).alias("dup_b"),
                   F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
                   F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_common"))
    one = one.crossJoin(n_rows(diff_keyed(a, b, key), "n_diff"))
    cells = F.col("n_common") * F.lit(len([c for c in shared if c not in key]))
    none = lambda x, y: (F.col(x) == 0) & (F.col(y) == 0)
    return _verdict(one, [("key unique", F.col("dup_a"), F.col("dup_b"), none("dup_a", "dup_b")), same_rows, *names,
                          ("same keys", F.col("only_a"), F.col("only_b"), none("only_a", "only_b")),
                          ("cells", cells, F.col("n_diff"), (F.col("n_diff") == 0) & (cells > 0))])


def diff_listing(diffs: DataFrame, max_listed: int = MAX_LISTED) -> DataFrame:
    """K8: the first ``max_listed`` differences in (key, column) order, plus the total count."""
    total = diffs.agg(F.count(F.lit(1)).alias("n_total"))
    listed = diffs.orderBy("key", "column_name").limit(max_listed)
    return listed.crossJoin(total)


def preview(df: DataFrame, key_cols: Sequence[str], value_col: str, n: int = PREVIEW_N,
            side: str = "a") -> DataFrame:
    """K4: top ``n`` rows by a coerced number, descending, NULLs last (key tie-breaker)."""
    k = with_key(df, key_cols)
    return (k.withColumn("_v", to_number(F.col(value_col)))
             .orderBy(F.col("_v").desc_nulls_last(), F.col("key"))
             .limit(n)
             .select(F.lit(side).alias("side"), "key", F.col("_v").alias("value")))


def cell_tolerance(a: DataFrame, b: DataFrame, key_cols: Sequence[str], col: str,
                   tol: float = 1e-9) -> DataFrame:
    """Per matched key, whether ``col`` agrees within an absolute tolerance; duplicated keys left out."""
    ka, kb = _unique_sides(a, b, key_cols)
    j = ka.select("key", F.col(col).alias("value_a")).join(kb.select("key", F.col(col).alias("value_b")), "key", "inner")
    return j.withColumn("close", cells_close(F.col("value_a"), F.col("value_b"), tol))


def combine(parts: Sequence[DataFrame], sort_col: str, tie_breakers: Sequence[str]) -> DataFrame:
    """Q4: union the parts, drop exact duplicate rows, order by a coerced value (K3).

    The order is returned as an explicit 0-based ``row_idx`` (distributed
    row numbering), because a sorted DataFrame has no order once written.
    """
    merged = dedup_rows(union_exports(list(parts)))
    merged = merged.withColumn("_v", to_number(F.col(sort_col)))
    # NULL values last, then value descending, then the tie-breakers (all non-NULL keys)
    x = (merged.withColumn("_nv", F.col("_v").isNull().cast("int"))
               .withColumn("_v_desc", F.coalesce(-F.col("_v"), F.lit(0.0))))
    x = row_index(x, ["_nv", "_v_desc", *tie_breakers], out="row_idx")
    return x.drop("_v", "_nv", "_v_desc", "_n_rows")
