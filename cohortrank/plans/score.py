"""Q1 peer-group score and Q2 shortlist.

Physical shape: one join to the league dimension, one aggregate for cell
sizes, and the eligible players written once, a row each. The metric spec (a
literal) folds the role's metrics into long rows that carry the player's id, its
cell and what the percentile needs, nothing else; they are read from the written
rows by the skew-safe percentile operator on (cell, metric) and by its join back.
One aggregate gives an array per player (at most one entry per metric of the
role, so never a big group), which joins the player's row once. Two skew-safe
ranks follow.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import (attempts, blend, bucketize, evidence, flip, nan_to_null,
                                 null_if_nonpositive, round_half_even, shrink)
from ..operators.rank import attach_positions, avg_rank_pct_expr, join_null_safe, ranks_min_desc
from ..session import materialize
from ..spec import MetricSpec, ScoreParams

DIM_COLS = ["league_code", "league", "country", "priority", "priority_rank", "division", "strength"]


def with_league(players: DataFrame, league_map: DataFrame, key: str = "league_key") -> DataFrame:
    """Left join to the league dimension (one row per league; broadcast below the session's threshold)."""
    dims = [c for c in DIM_COLS if c in league_map.columns and c not in players.columns]
    return players.join(league_map.select(key, *dims), key, "left")


def eligible(df: DataFrame, min_minutes: float, minutes: str = "minutes", role: str = "role") -> DataFrame:
    """Enough minutes and a known role (NULL minutes drop out)."""
    return df.where((F.col(minutes) >= F.lit(float(min_minutes))) & F.col(role).isNotNull()
                    & (F.col(role) != "NA"))


def with_cells(df: DataFrame, params: ScoreParams) -> DataFrame:
    """P6 + W3: strength band, league x role cell, thin cells pooled by band.

    Cell sizes come from an aggregate joined back (one row per cell, so AQE
    broadcasts it), not from a window that would put a big cell in one task.
    """
    band = bucketize(F.col("strength"), list(params.band_edges), list(params.band_labels), "nan")
    df = (df.withColumn("band", band)
            .withColumn("cell", F.concat(F.coalesce(F.col("league_code"), F.lit("nan")),
                                         F.lit("|"), F.col("role"))))
    sizes = df.groupBy("cell").agg(F.count(F.lit(1)).alias("cell_n"))
    df = df.join(sizes, "cell", "left")
    pooled = F.concat(F.lit("band:"), F.col("band"), F.lit("|"), F.col("role"))
    return (df.withColumn("thin", F.col("cell_n") < F.lit(params.min_cell))
              .withColumn("league_cell", F.col("cell"))
              .withColumn("cell", F.when(F.col("thin"), pooled).otherwise(F.col("cell"))))


def metric_long(df: DataFrame, spec: MetricSpec, metric_cols: Sequence[str]) -> DataFrame:
    """Fold the role's metrics into rows: (player, ordinal, metric, value, volume).

    The spec is a fixed, small literal: role -> array of (ordinal, metric,
    direction, volume metric), exploded per row. No join and no broadcast
    stage; a role without a spec yields no rows (inner semantics).
    """
    have = set(metric_cols)
    entries = []
    for role, metrics in spec.role_metrics.items():
        items = [F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("metric"),
                          F.lit(m in spec.lower_is_better).alias("lower_is_better"),
                          F.lit(spec.volume_of.get(m)).cast("string").alias("volume_metric"))
                 for i, m in enumerate(metrics) if m in have]
        if items:
            entries += [F.lit(role), F.array(*items)]
    spec_map = F.create_map(*entries)
    mmap = F.create_map(*[x for m in metric_cols for x in (F.lit(m), F.col(f"`{m}`").cast("double"))])
    x = (df.withColumn("_metrics", mmap)
           .withColumn("_s", F.explode(F.try_element_at(spec_map, F.col("role"))))
           .select("*", "_s.ordinal", "_s.metric", "_s.lower_is_better", "_s.volume_metric")
           .drop("_s"))
    return (x.withColumn("value", nan_to_null(F.try_element_at(F.col("_metrics"), F.col("metric"))))
             .withColumn("volume", F.when(F.col("volume_metric").isNotNull(),
                                          nan_to_null(F.try_element_at(F.col("_metrics"),
                                                                       F.col("volume_metric")))))
             .drop("_metrics", *[m for m in metric_cols if m in df.columns]))


def role_percentiles(elig: DataFrame, spec: MetricSpec, metric_cols: Sequence[str],
                     params: ScoreParams, reread: bool = False) -> DataFrame:
    """W1 + X7 + X8 + X10 per (player, metric): percentile in the cell, flipped, shrunk.

    ``reread``: ``elig`` is written, so its long rows are folded again where they are needed again.
    """
    long = metric_long(elig, spec, metric_cols)
    if params.pool == "all":
        # thin rows are ranked against every row of their band|role pool
        long = long.withColumn("_pool", F.concat(F.lit("band:"), F.col("band"), F.lit("|"), F.col("role")))
        a = attach_positions(long, ["league_cell", "metric"], ["value"], reread=reread)
        a = (a.withColumn("_p_cell", avg_rank_pct_expr()).drop("_below", "_ties", "_n"))
        a = attach_positions(a, ["_pool", "metric"], ["value"])
        ranked = (a.withColumn("_p", F.when(F.col("thin"), avg_rank_pct_expr()).otherwise(F.col("_p_cell")))
                   .drop("_below", "_ties", "_n", "_p_cell", "_pool"))
    else:
        ranked = (attach_positions(long, ["cell", "metric"], ["value"], reread=reread)
                  .withColumn("_p", avg_rank_pct_expr()).drop("_below", "_ties", "_n"))
    p = flip(F.col("_p"), F.col("lower_is_better"))
    w = attempts(F.col("volume"), F.col("minutes")) / F.lit(float(params.min_attempts))
    p = F.when(F.col("volume_metric").isNotNull(), shrink(p, w, 0.5)).otherwise(p)
    return ranked.withColumn("pct", p).drop("_p")


def score(players: DataFrame, league_map: DataFrame, spec: MetricSpec,
          params: ScoreParams = ScoreParams(), key: str = "league_key",
          id_col: str = "player_id", roles: Sequence[str] | None = None) -> DataFrame:
    """Q1: one row per eligible player with perf_league, perf_adjusted, ranks, pct map, radar.

    ``id_col`` is unique. A player whose role has no metrics in the spec is left out.
    ``roles`` scores players of these roles only. A role is part of every peer
    group and of every rank, so the figures are those of the full score.
    """
    metric_cols = [m for m in spec.metrics() if m in players.columns]
    if roles is not None:
        players = players.where(F.col("role").isin(list(roles)))
    x = with_league(players, league_map, key)
    elig = materialize(with_cells(eligible(x, params.min_minutes), params), "eligible")
    cells = ["cell", "league_cell", "band", "thin"] if params.pool == "all" else ["cell"]
    pct = role_percentiles(elig.select(id_col, "role", "minutes", *cells, *[f"`{m}`" for m in metric_cols]),
                           spec, metric_cols, params, reread=True)
    pcts = pct.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ordinal", "metric", "pct"))).alias("_pcts"))
    per = join_null_safe(elig.drop(*metric_cols), pcts, [id_col])
    known = F.filter("_pcts", lambda s: s["pct"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, s: acc + s["pct"])
    raw = F.when(F.size(known) > 0, total / F.size(known))
    ev = evidence(F.col("minutes"), params.full_season)
    scored = (per.withColumn("raw", raw)
                 .withColumn("evidence", ev)
                 .withColumn("perf_league",
                             round_half_even(shrink(F.col("raw"), F.col("evidence"), 0.5) * F.lit(100.0), 1))
                 .withColumn("perf_adjusted",
                             round_half_even(blend(F.col("perf_league"), F.col("strength"),
                                                   params.league_weight), 1))
                 .withColumn("pct_map", F.map_from_entries(F.transform(
                     "_pcts", lambda s: F.struct(s["metric"], round_half_even(s["pct"] * F.lit(100.0), 1)))))
                 .withColumn("radar", F.transform("_pcts", lambda s: round_half_even(s["pct"] * F.lit(100.0), 1)))
                 .drop("_pcts"))
    if "market_value" in scored.columns:
        scored = (scored.withColumn("market_value", null_if_nonpositive(F.col("market_value")))
                        .withColumn("priced", F.col("market_value").isNotNull()))
    scored = ranks_min_desc(materialize(scored, "scored"), {
        "rank_in_league": (["league_code", "role"], "perf_league"), "rank_overall": (["role"], "perf_adjusted")}, id_col=id_col)
    return scored.withColumn("rank_in_league", F.when(F.col("league_code").isNotNull(), F.col("rank_in_league")))


def shortlist(scored: DataFrame, role: str | None = None, league: str | None = None,
              max_age: float | None = None, top: int = 15, priority=None,
              columns: Sequence[str] = ("player_id", "player", "club_season", "league", "age", "minutes",
                                        "market_value", "perf_league", "perf_adjusted", "evidence"),
              tie_breaker: str = "player_id") -> DataFrame:
    """Q2 (P10 + K1 + P14): filters, then the top rows by a data-dependent column.

    The sort column is ``perf_adjusted`` if any remaining row has it, else
    ``perf_league``. The rows that pass the filters are written once, with the columns
    shown only, so neither the flag nor the sort runs the ranks again.
    """
    d = scored
    if role:
        d = d.where(F.col("role") == role)
    if league:
        d = d.where(F.coalesce(F.col("league").rlike("(?i)" + league), F.lit(False)))
    if max_age:
        d = d.where(F.col("age") <= F.lit(float(max_age)))
    if priority is not None:
        if isinstance(priority, (int, float)):
            d = d.where(F.col("priority_rank") <= F.lit(priority))
        else:
            bands = [priority] if isinstance(priority, str) else list(priority)
            d = d.where(F.col("priority").isin(bands))
    d = materialize(d.select(*dict.fromkeys([*columns, "perf_adjusted", "perf_league", tie_breaker])), "shortlist")
    flag = d.agg(F.max(F.col("perf_adjusted").isNotNull().cast("int")).alias("_has_adj"))
    d = d.crossJoin(F.broadcast(flag))
    key = F.when(F.col("_has_adj") == 1, F.col("perf_adjusted")).otherwise(F.col("perf_league"))
    return (d.withColumn("_sort", key)
             .orderBy(F.col("_sort").desc_nulls_last(), F.col(tie_breaker).asc())
             .limit(top)
             .select(*columns))
