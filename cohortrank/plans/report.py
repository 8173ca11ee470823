"""Q7 concept index + diagnostics, Q8 candidate report, Q10 indicator vs price.

Everything the report page computed in the browser (top 15 per group,
concentration, quintiles, profiles) is a Spark query here, and the payload
is a set of bounded rows: players as JSON lines, one header row.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null, r9, round_half_even
from ..functions.text import money_label
from ..operators import aggregates as A
from ..operators.rank import attach_positions, attach_stacked, avg_rank_pct_expr, floor_ntile, top_per_group
from ..session import materialize


# ---- Q7 ---------------------------------------------------------------------
def metric_percentiles(df: DataFrame, id_col: str, metrics: Sequence[str], group_col: str | None = None,
                       age_col: str | None = None) -> DataFrame:
    """W1/W2 for many metrics at once: one long table, one positions pass.

    Returns one row per id with ``pct`` = map(metric -> average-tie
    percentile), over the whole table (or within ``group_col``).
    """
    cols = list(metrics) + ([age_col] if age_col else [])
    g = [group_col] if group_col else []
    long = df.select(id_col, *g, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), nan_to_null(F.col(f"`{m}`").cast("double")).alias("value"))
        for m in cols])).alias("s")).select(id_col, *g, "s.metric", "s.value")
    ranked = (attach_positions(long, [*g, "metric"], ["value"])
              .withColumn("pct", avg_rank_pct_expr()))
    return ranked.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "pct"))).alias("pct"))


def _mean_skip_null(values: Sequence[Column]) -> Column:
    total = None
    cnt = None
    for v in values:
        t = F.coalesce(v, F.lit(0.0))
        c = v.isNotNull().cast("int")
        total = t if total is None else total + t
        cnt = c if cnt is None else cnt + c
    return F.when(cnt > 0, total / cnt)


def _mean_null_zero(values: Sequence[Column]) -> Column:
    total = None
    for v in values:
        t = F.coalesce(v, F.lit(0.0))
        total = t if total is None else total + t
    return total / F.lit(float(len(values)))


def concept_scores(df: DataFrame, id_col: str, concepts: Mapping[str, Sequence[str] | None],
                   age_col: str = "age", group_col: str | None = None) -> DataFrame:
    """A24 level 1: mean percentile of each concept's metrics (NULL skipped); age inverted."""
    metrics = list(dict.fromkeys(m for ms in concepts.values() if ms for m in ms))
    p = metric_percentiles(df, id_col, metrics, group_col, age_col)
    out = [F.col(id_col)]
    for name, ms in concepts.items():
        if ms:
            out.append(_mean_skip_null([F.col("pct")[m] for m in ms]).alias(name))
        else:
            out.append((F.lit(1.0) - F.col("pct")[age_col]).alias(name))
    return p.select(*out)


def flat_index(names: Sequence[str]) -> Column:
    """Mean of the columns with NULL as zero, times 100."""
    return _mean_null_zero([F.col(f"`{n}`") for n in names]) * F.lit(100.0)


def block_scores(scores: DataFrame, id_col: str, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """A24 level 2: mean of concept scores per block (NULL skipped)."""
    return scores.select(id_col, *[_mean_skip_null([F.col(f"`{c}`") for c in cs]).alias(b)
                                   for b, cs in blocks.items()])


# ---- Q8 ---------------------------------------------------------------------
def candidates(scored: DataFrame, max_age: float) -> DataFrame:
    """P11 + P8 + P9: candidate pool with the report index and club flags."""
    c = scored.where((F.col("age") <= F.lit(float(max_age))) & F.col("minutes").isNotNull())
    return (c.withColumn("idx", F.coalesce(F.col("perf_adjusted"), F.col("perf_league")))
             .withColumn("moved", club_moved(F.col("club_season"), F.col("club_now")))
             .withColumn("free", club_free(F.col("club_now"))))


def club_moved(past, now) -> Column:
    """The current club is known and is not the season's club (NULL aware)."""
    return now.isNotNull() & ~past.eqNullSafe(now)


def club_free(now) -> Column:
    """No current club (NULL or blank)."""
    return now.isNull() | (F.trim(now) == "")


def _tail_counts() -> list[Column]:
    return [F.count_if("top").alias("n_top"), F.count_if(F.col("top") & F.col("moved")).alias("moved_top"),
            F.count_if(~F.col("top")).alias("n_rest"), F.count_if(~F.col("top") & F.col("moved")).alias("moved_rest")]


def top_decile_test(cand: DataFrame, q: float = 0.90) -> DataFrame:
    """A14 + A15: moved share in the top of the index vs the rest, with a z-test."""
    agg = A.quantile_cut(cand, "idx", q).agg(F.max("cut").alias("cut"), *_tail_counts())
    z, p = A.two_proportion("moved_top", "n_top", "moved_rest", "n_rest")
    return agg.withColumn("z", r9(z)).withColumn("p_value", r9(p))


def validation(cand: DataFrame, q: float = 0.90, id_col: str = "player_id") -> DataFrame:
    """The report's validation record (one row); ``id_col`` is unique.

    The candidates are read once, for six narrow columns. One stacked pass over these gives the
    positions behind the cut and behind both ranks of the correlation, and one
    aggregate beside the cut every figure.
    """
    both = F.col("priced") & F.col("idx").isNotNull() & F.col("market_value").isNotNull()
    rows = materialize(cand.select(id_col, "idx", "moved", "priced", F.when(both, F.col("idx")).alias("_x"),
                                   F.when(both, F.col("market_value")).alias("_y")), "validation")
    placed = materialize(attach_stacked(rows, {"_all": ([], "idx"), "_px": ([], "_x"), "_py": ([], "_y")},
                                        F.struct("below", "ties", "n"), id_col=id_col), "validation")
    h = (F.col("_all.n") - 1) * F.lit(float(q))
    at = lambda i: F.max(F.when((F.col("_all.below") <= i) & (i < F.col("_all.below") + F.col("_all.ties")), F.col("idx")))
    cut = placed.agg(at(F.floor(h)).alias("_lo"), at(F.ceil(h)).alias("_hi"), F.max(h - F.floor(h)).alias("_frac")).select(
        (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias("cut"))
    mean_rank = lambda c: F.col(f"{c}.below") + (F.col(f"{c}.ties") + 1) / 2.0
    j = placed.crossJoin(F.broadcast(cut)).withColumn("top", F.col("idx") >= F.col("cut")).agg(
        *_tail_counts(), r9(A.safe_corr(mean_rank("_px"), mean_rank("_py"))).alias("_rho"),
        F.count_if("priced").alias("nWithMv"), F.count(F.lit(1)).alias("_n"))
    _, p = A.two_proportion("moved_top", "n_top", "moved_rest", "n_rest")
    j = j.withColumn("p_value", r9(p))
    pct = lambda a, b: F.when(F.col(b) > 0, round_half_even(F.lit(100.0) * F.col(a) / F.col(b), 1))
    return j.select(
        F.col("n_top").alias("nTop"),
        pct("moved_top", "n_top").alias("movedTop"),
        pct("moved_rest", "n_rest").alias("movedRest"),
        round_half_even(F.col("p_value"), 3).alias("pValue"),
        round_half_even(F.col("_rho"), 2).alias("mvCorr"),
        F.col("nWithMv"),
        round_half_even(F.lit(100.0) * (F.col("_n") - F.col("nWithMv")) / F.col("_n"), 1).alias("pctNoMv"))


def quintile_rate(cand: DataFrame, k: int = 5, id_col: str = "player_id") -> DataFrame:
    """A27 + W8: share moved per floor slice of the index (ascending, id tie-breaker)."""
    s = floor_ntile(cand, ["idx", id_col], k, out="slice")
    return s.groupBy("slice").agg(F.count(F.lit(1)).alias("n"),
                                  (F.lit(100.0) * F.count_if("moved") / F.count(F.lit(1))).alias("pct_moved"))


def top_by_group(cand: DataFrame, k: int = 15, group: str = "role", id_col: str = "player_id") -> DataFrame:
    """K5: the first ``k`` of each group by index (descending, id tie-breaker)."""
    return top_per_group(cand, [group], [F.col("idx").desc_nulls_last(), F.col(id_col)], k, out="rank")


def concentration_alert(cand: DataFrame, k: int = 15, group: str = "role", id_col: str = "player_id",
                        threshold: float = 20.0) -> DataFrame:
    """Per group, the most common country of its top ``k`` vs its share of the pool.

    ``got`` and ``expect`` are rounded half up to whole percent; alert when
    ``got - expect >= threshold``.
    """
    top = top_by_group(cand, k, group, id_col)
    counts = top.groupBy(group, "country").agg(F.count(F.lit(1)).alias("n_country"))
    sizes = top.groupBy(group).agg(F.count(F.lit(1)).alias("n_top"))
    best = counts.groupBy(group).agg(
        F.min_by(F.struct("country", "n_country"), F.struct(-F.col("n_country"), F.col("country"))).alias("b"))
    pool = cand.groupBy("country").agg(F.count(F.lit(1)).alias("n_pool"))
    total = cand.agg(F.count(F.lit(1)).alias("n_all"))
    j = (best.select(group, "b.country", "b.n_country").join(sizes, group)
             .join(pool, "country", "left").crossJoin(F.broadcast(total)))
    half_up = lambda x: F.floor(x + F.lit(0.5)).cast("long")
    return j.select(group, "country", "n_country", "n_top",
                    half_up(F.lit(100.0) * F.col("n_country") / F.col("n_top")).alias("got"),
                    half_up(F.lit(100.0) * F.col("n_pool") / F.col("n_all")).alias("expect")) \
            .withColumn("alert", (F.col("got") - F.col("expect")) >= F.lit(threshold))


def payload_players(cand: DataFrame) -> DataFrame:
    """S10 players part, flat (one row per candidate; JSON lines via ``payload_json``)."""
    return cand.select(
        "player_id",
        F.col("player").alias("name"), F.col("club_season").alias("team"),
        F.col("club_now").alias("clubNow"), "moved", "free", "league", "country",
        F.col("role").alias("group"), F.col("role").alias("pos"),
        F.col("age").cast("int").alias("age"), F.col("minutes").cast("int").alias("min"),
        F.col("market_value").alias("mv"), round_half_even(F.col("idx"), 1).alias("idx"), "radar")


def payload_json(cand: DataFrame, meta: Mapping, groups: DataFrame, valid: DataFrame,
                 scanned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(header row JSON with meta, groups, validation; players as JSON lines).

    ``groups``: (role, label, metrics, n) - one row per role (X22 labels and
    directions from the spec, ``n`` candidates). The players array is never
    collected into one row: it is written as JSON lines, the header is one
    small row.
    """
    players = payload_players(cand).select(F.to_json(F.struct(F.col("*"))).alias("json"))
    # leagues (a bounded dimension) and pool sizes are one-row aggregates
    pool = cand.agg(F.array_sort(F.collect_set(F.struct(F.col("league").alias("name"),
                                                        F.col("country").alias("code")))).alias("leagues"),
                    F.count(F.lit(1)).alias("totalPool"))
    if scanned is not None:
        pool = pool.crossJoin(scanned.agg(F.count(F.lit(1)).alias("totalScanned")))
    meta_col = F.struct("leagues", *[F.lit(v).alias(k) for k, v in meta.items()], "totalPool",
                        *(["totalScanned"] if scanned is not None else []))
    g = groups.agg(F.map_from_entries(F.collect_list(
        F.struct("role", F.struct(F.col("label"), F.col("metrics"), F.col("n"))))).alias("groups"))
    header = g.crossJoin(valid.select(F.struct(F.col("*")).alias("validation"))).crossJoin(pool) \
              .select(F.to_json(F.struct(meta_col.alias("meta"), "groups", "validation")).alias("json"))
    return header, players


def money_labels(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """X21 applied to a column."""
    return df.select(id_col, F.col(value_col).alias("value"), money_label(F.col(value_col)).alias("label"))
