"""Prefix scans over a total order, and the as-of join built on them.

A window without a partition, or over a hot one, puts all its rows into one task.
Here the rows are cut by range of (group, order) instead:

1. ``repartitionByRange`` cuts the sequence into contiguous partitions, which are
   written, so both later passes see the same cut;
2. inside each (partition, group) chunk a window gives the local running value;
3. the chunks' totals (one row per partition and group) are scanned in turn and give
   what each chunk inherits from those before it (or after it);
4. the two are put together, row by row.

Step 3 sees at most one row per partition of a group, never the data.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .rank import _cols, _join_back, join_null_safe

KINDS = ("sum", "max", "min", "last", "next")


def prefix_scan(df: DataFrame, order_cols, aggs: Mapping[str, tuple[str, str]], group_cols=None,
                n_parts: int | None = None) -> DataFrame:
    """``df`` plus running values along ``order_cols`` (a total order up to equal rows), within groups.

    ``aggs``: name -> (kind, column). ``sum``, ``max`` and ``min`` run over all rows up to
    and with this one; ``last`` is the last non-NULL value up to this row, ``next``
    the first non-NULL one from this row on. NULLs count as nothing.
    """
    g, o = _cols(group_cols), _cols(order_cols)
    unknown = {k for k, _ in aggs.values()} - set(KINDS)
    if unknown or not o:
        raise ValueError(f"unknown kinds {sorted(unknown)}" if unknown else "order_cols is required")
    n = n_parts or shuffle_partitions(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in [*g, *o]]
    cut = materialize(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()), "scan")
    local = Window.partitionBy("_pid", *g).orderBy(*[F.col(c).asc_nulls_first() for c in o])
    before, after = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(0, Window.unboundedFollowing)
    across = Window.partitionBy(*g).orderBy("_pid")
    earlier, later = across.rowsBetween(Window.unboundedPreceding, -1), across.rowsBetween(1, Window.unboundedFollowing)
    place = F.struct(*o)
    run, total, carry, both = {}, [], [], {}
    for i, (name, (kind, col)) in enumerate(aggs.items()):
        c, t, x = F.col(col), f"_t{i}", f"_x{i}"
        if kind in ("last", "next"):
            pick = F.max_by if kind == "last" else F.min_by
            run[name] = F.last(c, ignorenulls=True).over(before) if kind == "last" else F.first(c, ignorenulls=True).over(after)
            total.append(pick(c, F.when(c.isNotNull(), place)).alias(t))
            carry.append((F.last(t, ignorenulls=True).over(earlier) if kind == "last" else F.first(t, ignorenulls=True).over(later)).alias(x))
            both[name] = F.coalesce(F.col(name), F.col(x))
        else:
            f = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
            run[name] = f(c).over(before)
            total.append(f(c).alias(t))
            carry.append(f(t).over(earlier).alias(x))
            zero = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(x), F.lit(0))
            both[name] = zero if kind == "sum" else (F.greatest if kind == "max" else F.least)(F.col(name), F.col(x))
    chunks = cut.groupBy("_pid", *g).agg(*total).select("_pid", *g, *carry)
    joined = join_null_safe(cut.withColumns(run), chunks, ["_pid", *g], how="inner")
    return joined.withColumns(both).drop("_pid", *[f"_x{i}" for i in range(len(aggs))])


def asof_neighbours(xs: DataFrame, x_col: str, right: DataFrame, right_x: str, values: Sequence[str],
                    tie_cols: Sequence[str] = (), group_cols=None) -> DataFrame:
    """Per distinct non-NULL (group, ``x_col``) of ``xs``: its neighbours in ``right``.

    ``prev``: a struct of ``values`` of the last row of ``right`` at or before it (of
    equal ones the last by ``tie_cols``); ``next``: of the first row after it. Both
    sides lie in one sequence and are scanned once; nothing is broadcast.
    """
    g = _cols(group_cols)
    ties = list(tie_cols)
    keys = xs.where(F.col(x_col).isNotNull()).select(*g, F.col(x_col).alias("_x")).distinct()
    none = lambda c: F.lit(None).cast(right.schema[c].dataType)
    left = keys.select(*g, "_x", F.lit(1).alias("_side"), *[none(c).alias(f"_o{i}") for i, c in enumerate(ties)],
                       F.lit(None).cast(_struct_type(right, values)).alias("_v"))
    own = right.where(F.col(right_x).isNotNull()).select(*g, F.col(right_x).alias("_x"), F.lit(0).alias("_side"),
                                                         *[F.col(c).alias(f"_o{i}") for i, c in enumerate(ties)], F.struct(*values).alias("_v"))
    seq = own.unionByName(left)
    found = prefix_scan(seq, ["_x", "_side", *[f"_o{i}" for i in range(len(ties))]], {"prev": ("last", "_v"), "next": ("next", "_v")}, g)
    return found.where(F.col("_side") == 1).select(*g, F.col("_x").alias(x_col), "prev", "next")


def _struct_type(df: DataFrame, cols: Sequence[str]):
    """Type of a struct of these columns."""
    return df.select(F.struct(*cols).alias("s")).schema["s"].dataType


def asof_join(df: DataFrame, x_col: str, right: DataFrame, right_x: str, values: Sequence[str], tie_cols: Sequence[str] = (), group_cols=None) -> DataFrame:
    """``df`` plus ``prev`` and ``next`` of ``asof_neighbours``; NULL for a NULL ``x_col``.

    Equal values of ``df`` meet ``right`` once and take the answer by an equality join, so a hot one is no hot task.
    """
    near = asof_neighbours(df, x_col, right, right_x, values, tie_cols, group_cols)
    return _join_back(df, near, _cols(group_cols), [x_col])
