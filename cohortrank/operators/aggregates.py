"""Aggregations and diagnostics.

All of them are declarative aggregates with map-side partial aggregation
(counts, sums, co-moments), so a hot group costs one partial row per map
task. Exact quantiles and ranks go through ``operators.rank``; nothing here
buffers a whole group (no ``collect_list`` of a group, no ``percentile``).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r9, round_half_even
from ..session import materialize
from .rank import attach_stacked, group_quantile, join_null_safe, row_index


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- counts and shares ----------------------------------------------------
def group_size(df: DataFrame, group_cols, out: str = "n") -> DataFrame:
    """A4: rows per group (order by ``n`` descending when displaying)."""
    return df.groupBy(*([group_cols] if isinstance(group_cols, str) else group_cols)) \
             .agg(F.count(F.lit(1)).alias(out))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """A5: value counts and their share of all rows (NULL counted as its own value)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
                  .withColumn("share", F.col("n") / F.col("_total")).drop("_total"))


def value_concentration(df: DataFrame, col: str, k: int) -> DataFrame:
    """Distinct non-NULL values and the share of rows held by the ``k`` most common.

    The value counts are ranked by the distributed row-number operator (count
    descending, value as tie-breaker), so no single task sorts all values.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ranked = row_index(counts.withColumn("_neg", -F.col("n")), ["_neg", col], out="_pos")
    return ranked.agg(F.count(F.lit(1)).alias("n_distinct"),
                      F.sum("n").alias("n_rows"),
                      F.sum(F.when(F.col("_pos") < k, F.col("n"))).alias("n_top")) \
                 .withColumn("share_top", F.col("n_top") / F.col("n_rows"))


def rate_by(df: DataFrame, group_col, flag) -> DataFrame:
    """Share of rows with ``flag`` true per group (NULL flag counts as false)."""
    f = F.coalesce(_c(flag).cast("boolean"), F.lit(False)).cast("double")
    return df.groupBy(_c(group_col).alias("group")).agg(F.count(F.lit(1)).alias("n"),
                                                          F.avg(f).alias("rate"))


def rate_range(df: DataFrame, group_col, flag) -> DataFrame:
    """Min and max over groups of the per-group share (two-level aggregate)."""
    r = rate_by(df, group_col, flag)
    return r.agg(F.count(F.lit(1)).alias("n_groups"), F.min("rate").alias("min_rate"),
                 F.max("rate").alias("max_rate"))


# ---- correlation ----------------------------------------------------------
def safe_corr(x, y) -> Column:
    """Pearson correlation over pairwise-complete rows; NULL when a side is constant.

    ``corr`` raises DIVIDE_BY_ZERO on a constant column when ANSI mode is on,
    so the coefficient is built from the population covariance and standard
    deviations (all streaming, numerically stable aggregates) with a guarded
    division.
    """
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    den = F.stddev_pop(xx) * F.stddev_pop(yy)
    return F.when(den > 0, F.covar_pop(xx, yy) / den)


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n pairs, r)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.agg(F.count_if(both).alias("n"), r9(safe_corr(x, y)).alias("r"))


def spearman(df: DataFrame, x: str, y: str, id_col: str) -> DataFrame:
    """A10: drop incomplete pairs, average-rank both sides over the whole table, Pearson.

    The ranks come from the skew-safe positions operator (no one-partition window).
    """
    pairs = materialize(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(id_col, x, y))
    ranked = attach_stacked(pairs, {"_rx": ([], x), "_ry": ([], y)}, F.col("below") + (F.col("ties") + 1) / 2.0)
    return ranked.agg(F.count(F.lit(1)).alias("n"), r9(safe_corr("_rx", "_ry")).alias("rho"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All k x k pairwise-complete correlations in one aggregate, as long rows (a, b, r).

    Only one triangle is computed; a column has 1 with itself, or NULL if it is constant.
    """
    wide = df.agg(*[F.when(F.stddev_pop(f"`{a}`") > 0, F.lit(1.0)).alias(f"c{i}_{i}") for i, a in enumerate(cols)],
                  *[r9(safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`"))).alias(f"c{i}_{i + j}")
                    for i, a in enumerate(cols) for j, b in enumerate(cols[i + 1:], 1)])
    stack = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                         F.col(f"c{min(i, j)}_{max(i, j)}").alias("r"))
                                for i, a in enumerate(cols) for j, b in enumerate(cols)]))
    return wide.select(stack.alias("s")).select("s.a", "s.b", "s.r")


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, mx, my, sxx, syy, sxy) of every pair i <= j of columns over the rows that have both.

    Counts, means and co-moments of a block of rows are matrix products over its values
    and its mask of non-NULLs; a task merges its blocks as it goes and gives one row per
    pair, and those of all tasks merge by the same rule, which keeps the digits that
    sums of squares lose. k columns cost k x k numbers per task, not k x k expressions.
    NaN counts as NULL.
    """
    k, names = len(cols), [f"c{i}" for i in range(len(cols))]

    def run(it):
        import numpy as np
        import pyarrow as pa
        held = None
        for b in it:
            if not len(b):
                continue
            x = np.stack([np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.float64) for i in range(k)], axis=1)
            m = ~np.isnan(x)
            base = np.where(m.any(axis=0), x[m.argmax(axis=0), np.arange(k)], 0.0)  # a constant column keeps deviations of exactly 0
            mask, v = m.astype(np.float64), np.where(m, x - base, 0.0)
            n = mask.T @ mask
            some = np.maximum(n, 1)
            sx = v.T @ mask  # sum of column i over the rows that have j too
            mx = sx / some
            sxx = np.maximum((v * v).T @ mask - sx * mx, 0)
            part = n, mx + base[:, None], sxx, v.T @ v - mx * mx.T * n
            if held is None:
                held = part
                continue
            (n1, m1, s1, c1), (n2, m2, s2, c2) = held, part
            total = np.maximum(n1 + n2, 1)
            d = np.where(n1 * n2 > 0, m2 - m1, 0.0)
            mean = np.where(n1 > 0, m1, m2) + d * n2 / total
            held = n1 + n2, mean, s1 + s2 + d * d * n1 * n2 / total, c1 + c2 + d * d.T * n1 * n2 / total
        if held is not None:
            n, mx, sxx, sxy = held
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i.astype(np.int32), j.astype(np.int32), n[i, j].astype(np.int64), mx[i, j], mx[j, i], sxx[i, j], sxx[j, i], sxy[i, j])],
                                             names=["i", "j", "n", "mx", "my", "sxx", "syy", "sxy"])
    ddl = "i int, j int, n long, mx double, my double, sxx double, syy double, sxy double"
    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names, strict=True)]).mapInArrow(run, ddl)
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("mx", "my", "sxx", "syy", "sxy")])

    def merge(p, q):
        total = F.greatest(p["n"] + q["n"], F.lit(1))
        both = (p["n"] > 0) & (q["n"] > 0)
        w = p["n"] * q["n"] / total
        dx, dy = F.when(both, q["mx"] - p["mx"]).otherwise(0.0), F.when(both, q["my"] - p["my"]).otherwise(0.0)
        mean = lambda c, d: F.when(p["n"] > 0, p[c]).otherwise(q[c]) + d * q["n"] / total
        return F.struct((p["n"] + q["n"]).alias("n"), mean("mx", dx).alias("mx"), mean("my", dy).alias("my"), (p["sxx"] + q["sxx"] + dx * dx * w).alias("sxx"),
                        (p["syy"] + q["syy"] + dy * dy * w).alias("syy"), (p["sxy"] + q["sxy"] + dx * dy * w).alias("sxy"))
    # one row per task and pair, in an order of its own, so that the result doesn't depend on arrival
    lists = parts.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("n", "mx", "my", "sxx", "syy", "sxy"))).alias("ps"))
    return lists.select("i", "j", F.aggregate("ps", zero, merge).alias("p")).select("i", "j", "p.*")


def corr_matrix_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A11 for many columns: the result of ``corr_matrix`` (a, b, r), from one mergeable block aggregate."""
    names = F.array(*[F.lit(c) for c in cols])
    spread = F.sqrt("sxx") * F.sqrt("syy")
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("sxx") > 0, F.lit(1.0))).otherwise(F.when(spread > 0, r9(F.col("sxy") / spread)))
    one = pair_moments(df, cols).select("i", "j", r.alias("r"))
    both = one.unionByName(one.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return both.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "r")


def corr_with(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Correlation of each column with ``y`` (one aggregate), long rows (column, r)."""
    wide = df.agg(*[r9(safe_corr(F.col(f"`{c}`"), F.col(f"`{y}`"))).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("r"))
                                for i, c in enumerate(cols)]))
    return wide.select(stack.alias("s")).select("s.column_name", "s.r")


def pca_variance(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """PCA explained-variance shares after mean imputation and z-scoring (ddof = 1).

    The deviation is that of the filled column (NULLs at the mean add nothing to
    the squares but count as rows). A constant or empty column has no deviation
    and is 0 everywhere. Means and deviations are one aggregate; the covariance of the
    standardised columns and its eigen-decomposition are done by
    ``pyspark.ml.feature.PCA`` (distributed Gram matrix, k x k solve).
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    stats = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)],
                   *[(F.stddev_samp(f"`{c}`") * F.sqrt(F.try_divide(F.count(f"`{c}`") - 1, F.count(F.lit(1)) - 1))).alias(f"s{i}")
                     for i, c in enumerate(cols)])
    x = df.crossJoin(F.broadcast(stats))
    z = [F.try_divide(F.coalesce(F.col(f"`{c}`"), F.col(f"m{i}")) - F.col(f"m{i}"), F.col(f"s{i}")).alias(f"z{i}")
         for i, c in enumerate(cols)]
    zdf = x.select(*z).na.fill(0.0)
    vec = VectorAssembler(inputCols=[f"z{i}" for i in range(len(cols))], outputCol="v").transform(zdf)
    model = PCA(k=k or len(cols), inputCol="v", outputCol="p").fit(vec)
    ev = [float(v) for v in model.explainedVariance.toArray()]
    rows = [(i + 1, v, float(sum(ev[: i + 1]))) for i, v in enumerate(ev)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


# ---- quantiles and tests --------------------------------------------------
def quantile_cut(df: DataFrame, v: str, q: float) -> DataFrame:
    """Exact linear-interpolation quantile and the rows at or above it."""
    cut = group_quantile(df, None, v, q, out="cut").drop("cut_n")
    return (df.crossJoin(F.broadcast(cut))
              .withColumn("top", F.col(v) >= F.col("cut")))


def normal_sf_two_sided(z) -> Column:
    """Two-sided normal tail ``2*(1 - Phi(|z|)) = erfc(|z|/sqrt 2)`` as column math.

    Chebyshev-fitted ``erfc`` with fractional error below 1.2e-7 everywhere;
    neither Spark nor DuckDB has ``erf``.
    """
    # FIXED VALUES: coefficients of the erfc approximation
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = F.abs(_c(z)) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def two_proportion(x1, n1, x2, n2) -> tuple[Column, Column]:
    """Pooled two-proportion z and two-sided p; NULL if a group is empty or SE = 0."""
    x1, n1, x2, n2 = (_c(a).cast("double") for a in (x1, n1, x2, n2))
    p1, p2 = x1 / n1, x2 / n2
    pool = (x1 + x2) / (n1 + n2)
    se = F.sqrt(pool * (F.lit(1.0) - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    ok = (n1 > 0) & (n2 > 0)
    z = F.when(ok & (se > 0), (p1 - p2) / se)
    return z, F.when(z.isNotNull(), normal_sf_two_sided(z))


# ---- top-k overlap and rank zip -------------------------------------------
def top_fraction(df: DataFrame, id_col: str, v: str, k_col: str, out: str = "_in_top") -> DataFrame:
    """Rows whose position under (v desc, id) is below ``k_col`` (a column with k)."""
    x = df.withColumn("_nv", F.col(v).isNull().cast("int")).withColumn("_vd", F.coalesce(-F.col(v), F.lit(0.0)))
    x = row_index(x, ["_nv", "_vd", id_col], out="_pos").drop("_n_rows")
    return x.withColumn(out, (F.col("_pos") < F.col(k_col)) & F.col(v).isNotNull()).drop("_nv", "_vd", "_pos")


def retention(df: DataFrame, id_col: str, a: str, b: str, frac: float) -> DataFrame:
    """Share of the top ``floor(n*frac)`` by ``b`` that is also in the top by ``a``.

    ``k`` grows with the data, so the top sets come from distributed row
    numbers, not from a single-task ``orderBy().limit(k)``. Ties are broken by
    ``id_col``; NULL values never enter a top set.
    """
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    x = df.select(id_col, a, b).crossJoin(F.broadcast(n)) \
          .withColumn("k", F.floor(F.col("n_rows") * F.lit(float(frac))).cast("long"))
    x = top_fraction(x, id_col, a, "k", "_top_a")
    x = top_fraction(x, id_col, b, "k", "_top_b")
    return x.agg(F.max("n_rows").alias("n"), F.max("k").alias("k"),
                 F.count_if(F.col("_top_a") & F.col("_top_b")).alias("overlap"),
                 F.count_if("_top_b").alias("n_top_b")) \
            .withColumn("retention", F.try_divide(F.col("overlap"), F.col("n_top_b")))


def rank_zip(a_top: DataFrame, b_top: DataFrame, rank_col: str = "rank") -> DataFrame:
    """Two top-N lists side by side, aligned by their 1-based position."""
    return a_top.join(b_top, rank_col, "full_outer")


def role_profile(df: DataFrame, group: str = "role", mean_cols: Sequence[str] = ("age", "minutes"),
                 digits: int = 0) -> DataFrame:
    """A3: rows per group and rounded means (half-to-even) of the given columns."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("players"),
        *[round_half_even(F.avg(c), digits).alias(f"mean_{c}") for c in mean_cols])


def run_summary(scored: DataFrame, league: str = "league_code", role: str = "role",
                priced: str = "priced") -> DataFrame:
    """One row with rows, distinct leagues and roles, priced and unpriced counts."""
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(league).alias("n_leagues"),
                      F.count_distinct(role).alias("n_roles"), F.count_if(priced).alias("n_priced"),
                      F.count_if(~F.col(priced)).alias("n_unpriced"))
