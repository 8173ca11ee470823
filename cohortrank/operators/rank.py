"""Ranks, percentiles, row numbers and exact quantiles that survive skew.

A window ``PARTITION BY g ORDER BY v`` puts a whole group into one task. When
one group holds a large share of the rows that task sorts it alone. The
operators here never do that:

1. ``groupBy(g, v).count()`` collapses equal values (map-side combine, so a
   value shared by millions of rows is one row after the partial aggregate);
2. ``repartitionByRange(g, v)`` cuts the distinct values of a big group into
   several contiguous partitions;
3. inside each (partition, group) chunk a running count gives the local
   position; the chunk totals (one row per partition and group, a table that
   grows with the partition count, not with the data) give each chunk's
   offset;
4. the result ``(g, v, below, ties, n)`` is joined back on ``(g, v)``. AQE
   turns that join into a broadcast when the positions table is small and
   splits skewed partitions otherwise.

``below`` = non-NULL rows of the group with a smaller key, ``ties`` = rows with
the same key, ``n`` = non-NULL rows of the group. Every rank flavour is a
column expression over these three numbers.

One path serves every size; nothing depends on how many rows there are.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import is_written, materialize, shuffle_partitions

def _cols(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def value_positions(df: DataFrame, group_cols=None, order_cols=None,
                    n_parts: int | None = None, descending: bool = False) -> DataFrame:
    """Distinct non-NULL ``(group, order)`` keys with ``below``, ``ties``, ``n``.

    ``descending=True`` counts ``below`` from the largest key down.
    """
    g, o = _cols(group_cols), _cols(order_cols)
    if not o:
        raise ValueError("order_cols is required")
    keyed = df.select(*g, *o)
    for c in o:
        keyed = keyed.where(F.col(c).isNotNull())
    vc = keyed.groupBy(*g, *o).agg(F.count(F.lit(1)).alias("_ties"))
    okeys = [F.col(c).desc() if descending else F.col(c).asc() for c in o]
    n = n_parts or shuffle_partitions(df.sparkSession)
    # The partition id is data: both the local running counts and the chunk
    # offsets must see the same range cut. The cut is computed once and
    # written, so the result never depends on exchange reuse, and a lost
    # executor re-reads it instead of re-sampling the range bounds.
    rp = materialize(vc.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in g], *okeys)
                       .withColumn("_pid", F.spark_partition_id()), "ranges")
    w_local = (Window.partitionBy("_pid", *g).orderBy(*okeys)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = rp.withColumn("_lbelow", F.coalesce(F.sum("_ties").over(w_local), F.lit(0)))
    chunks = rp.groupBy("_pid", *g).agg(F.sum("_ties").alias("_chunk"))
    w_off = Window.partitionBy(*g).orderBy("_pid")
    offs = chunks.select(
        "_pid", *g,
        F.coalesce(F.sum("_chunk").over(w_off.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_chunk").over(Window.partitionBy(*g)).alias("_n"))
    joined = join_null_safe(local, offs, ["_pid", *g], how="inner")
    return joined.select(*g, *o,
                         (F.col("_lbelow") + F.col("_off")).cast("long").alias("below"),
                         F.col("_ties").cast("long").alias("ties"),
                         F.col("_n").cast("long").alias("n"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner", null_safe: Sequence[str] | None = None) -> DataFrame:
    """Equi-join on ``keys`` where the ``null_safe`` keys (default: all) match NULL to NULL."""
    keys = list(keys)
    ns = set(keys if null_safe is None else null_safe)
    r = right
    ren = {}
    for k in keys:
        ren[k] = f"__r_{k}"
        r = r.withColumnRenamed(k, ren[k])
    cond = None
    for k in keys:
        c = (left[k].eqNullSafe(r[ren[k]]) if k in ns else left[k] == r[ren[k]])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*ren.values())


def _join_back(df: DataFrame, pos: DataFrame, g: list, o: list) -> DataFrame:
    """``df`` left-joined to one row per (group, key).

    Rows with a NULL key match nothing; a hash of the row as a further join key
    spreads them over the tasks instead of sending all of a group to one.
    """
    valid = F.lit(True)
    for c in o:
        valid = valid & F.col(c).isNotNull()
    plain = [F.col(f"`{n}`") for n, t in df.dtypes if "map<" not in t and "variant" not in t]
    spread = df.withColumn("_spread", F.when(valid, F.lit(0).cast("long")).otherwise(F.xxhash64(*plain)))
    pos = pos.withColumn("_spread", F.lit(0).cast("long"))
    return join_null_safe(spread, pos, [*g, *o, "_spread"], how="left", null_safe=g).drop("_spread")


def attach_positions(df: DataFrame, group_cols=None, order_cols=None,
                     descending: bool = False, n_parts: int | None = None, reread: bool = False) -> DataFrame:
    """``df`` plus ``_below``, ``_ties``, ``_n`` for its own key (NULL key -> NULL).

    ``df`` is read by the positions build and by the join back, so it is written
    once, if it isn't yet. ``reread`` leaves that out: for rows that are a plain
    projection of a written table, and larger than it.
    """
    g, o = _cols(group_cols), _cols(order_cols)
    if not reread and not is_written(df):
        df = materialize(df)
    pos = (value_positions(df, g, o, n_parts=n_parts, descending=descending)
           .withColumnRenamed("below", "_below").withColumnRenamed("ties", "_ties")
           .withColumnRenamed("n", "_n"))
    return _join_back(df, pos, g, o)


def stacked_positions(df: DataFrame, ranks: Mapping[str, tuple[Sequence[str], str]],
                      descending: bool = False) -> DataFrame:
    """Positions of several numeric columns of ``df``, each in its own groups, by one range cut.

    ``ranks``: name -> (group columns, value column). Returns (group, value, below,
    ties, n); ``group`` is an array of the name and the group values as text.
    """
    stack = F.array(*[F.struct(_group_key(name, g).alias("group"), F.col(v).cast("double").alias("value"))
                      for name, (g, v) in ranks.items()])
    return value_positions(df.select(F.explode(stack).alias("s")).select("s.*"), ["group"], ["value"],
                           descending=descending)


def _group_key(name: str, group_cols: Sequence[str]) -> Column:
    return F.array(F.lit(name), *[F.col(c).cast("string") for c in group_cols])


def attach_stacked(df: DataFrame, ranks: Mapping[str, tuple[Sequence[str], str]], value: Column,
                   descending: bool = False, id_col: str | None = None) -> DataFrame:
    """``df`` plus one column per rank: ``value``, an expression over below, ties and n (NULL for a NULL key).

    With a unique ``id_col`` only ids, groups and values meet the positions; the ranks of
    a row come together by its id, and the whole row joins once, on a key without ties.
    """
    if not is_written(df):
        df = materialize(df)
    pos = stacked_positions(df, ranks, descending)
    if id_col is not None:
        stack = F.array(*[F.struct(_group_key(name, g).alias("group"), F.col(v).cast("double").alias("value"))
                          for name, (g, v) in ranks.items()])
        rows = df.select(F.col(id_col).alias("_id"), F.explode(stack).alias("s")).select("_id", "s.*")
        own = _join_back(rows, pos, ["group"], ["value"]).groupBy(F.col("_id").alias(id_col)).agg(
            *[F.max(F.when(F.col("group")[0] == name, value)).alias(name) for name in ranks])
        return join_null_safe(df, own, [id_col], how="left")
    for name, (g, v) in ranks.items():
        own = pos.where(F.col("group")[0] == name).select(
            F.col("group").alias("_group"), F.col("value").alias("_value"), value.alias(name))
        keyed = df.withColumn("_group", _group_key(name, g)).withColumn("_value", F.col(v).cast("double"))
        df = _join_back(keyed, own, ["_group"], ["_value"]).drop("_group", "_value")
    return df


def avg_rank_pct_expr() -> Column:
    """W1 value: average-tie rank divided by the non-NULL count of the group."""
    return (F.col("_below") + (F.col("_ties") + F.lit(1)) / F.lit(2.0)) / F.col("_n")


def pct_rank_avg(df: DataFrame, group_cols, value_col: str, out: str = "pct") -> DataFrame:
    """W1 (and W2 with no group): pandas ``rank(pct=True)`` inside a group.

    Average ties, NULL stays NULL and is not counted. Not ``percent_rank``.
    """
    return (attach_positions(df, group_cols, [value_col])
            .withColumn(out, avg_rank_pct_expr())
            .drop("_below", "_ties", "_n"))


def pct_rank_global(df: DataFrame, value_col: str, out: str = "pct") -> DataFrame:
    """Percentile rank over the whole table, without a one-partition window."""
    return pct_rank_avg(df, None, value_col, out)


def rank_min_desc(df: DataFrame, group_cols, value_col: str, out: str = "rank") -> DataFrame:
    """``rank(ascending=False, method='min')``; NULL value gets NULL rank."""
    return (attach_positions(df, group_cols, [value_col], descending=True)
            .withColumn(out, (F.col("_below") + F.lit(1)).cast("long"))
            .drop("_below", "_ties", "_n"))


def ranks_min_desc(df: DataFrame, ranks: Mapping[str, tuple[Sequence[str], str]], id_col: str | None = None) -> DataFrame:
    """W4 for several columns at once: ``ranks`` is name -> (group columns, value column)."""
    return attach_stacked(df, ranks, (F.col("below") + F.lit(1)).cast("long"), descending=True, id_col=id_col)


def row_index(df: DataFrame, order_cols, group_cols=None, out: str = "row_idx",
              descending: bool = False) -> DataFrame:
    """0-based row number under ``order_cols`` (must be a total order).

    Rows that share a full key get the same number, so callers pass a unique
    tie-breaker as the last order column.
    """
    return (attach_positions(df, group_cols, order_cols, descending=descending)
            .withColumn(out, F.col("_below"))
            .withColumn("_n_rows", F.col("_n"))
            .drop("_below", "_ties", "_n"))


def floor_ntile(df: DataFrame, order_cols, k: int = 5, out: str = "slice") -> DataFrame:
    """Slice i holds sorted rows ``[floor(n*i/k), floor(n*(i+1)/k))``.

    ``ceil(k*rn/n) - 1`` with a 1-based row number. ``ntile`` differs: it puts
    the larger slices first.
    """
    x = row_index(df, order_cols, out="_rn0")
    return (x.withColumn(out, (F.ceil(F.lit(k) * (F.col("_rn0") + 1) / F.col("_n_rows")) - 1)
                         .cast("int"))
             .drop("_rn0", "_n_rows"))


def group_quantile(df: DataFrame, group_cols, value_col: str, q: float,
                   out: str = "quantile") -> DataFrame:
    """Exact quantile with linear interpolation, one row per group.

    Only the one or two order statistics around ``(n-1)*q`` are picked from
    the positions table, so no group is ever collected into memory (unlike
    ``percentile``/``median``, which buffer every value of a group).
    Interpolation is ``lo + frac*(hi-lo)``.
    """
    g = _cols(group_cols)
    pos = value_positions(df, g, [value_col])
    h = (F.col("n") - 1) * F.lit(float(q))
    lo, hi = F.floor(h), F.ceil(h)
    end = F.col("below") + F.col("ties")
    picked = (pos.withColumn("_h", h)
                 .withColumn("_is_lo", (F.col("below") <= lo) & (lo < end))
                 .withColumn("_is_hi", (F.col("below") <= hi) & (hi < end))
                 .where(F.col("_is_lo") | F.col("_is_hi")))
    agg = picked.groupBy(*g).agg(
        F.max(F.when(F.col("_is_lo"), F.col(value_col))).alias("_vlo"),
        F.max(F.when(F.col("_is_hi"), F.col(value_col))).alias("_vhi"),
        F.max("_h").alias("_h"), F.max("n").alias("n"))
    frac = F.col("_h") - F.floor(F.col("_h"))
    return agg.select(*g, (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).alias(out),
                      F.col("n").alias(f"{out}_n"))


def with_group_median(df: DataFrame, group_cols, value_col: str, out: str = "group_median") -> DataFrame:
    """Group median attached to every row (median of non-NULL values)."""
    g = _cols(group_cols)
    med = group_quantile(df, g, value_col, 0.5, out=out).drop(f"{out}_n")
    return join_null_safe(df, med, g, how="left")


def top_per_group(df: DataFrame, group_cols, order: Sequence[Column], k: int,
                  out: str = "rank_in_group") -> DataFrame:
    """K5: first ``k`` rows of each group under ``order`` (a total order).

    ``row_number() <= k`` lets Spark insert a WindowGroupLimit before the
    shuffle, so each map task forwards at most ``k`` rows per group and a big
    group never reaches one task whole.
    """
    w = Window.partitionBy(*_cols(group_cols)).orderBy(*order)
    return (df.withColumn(out, F.row_number().over(w).cast("long"))
              .where(F.col(out) <= k))


def latest_per_key(df: DataFrame, key_cols, order_key: Column, out: str = "latest") -> DataFrame:
    """Per key, the row with the smallest ``order_key`` (a struct sorts field by field).

    One ``min_by`` aggregate: partial per map task, so a key with millions
    of rows costs one candidate row per task.
    """
    keys = _cols(key_cols)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_key).alias(out))
    return agg.select(*keys, *[F.col(f"{out}.{c}").alias(c) for c in rest])
