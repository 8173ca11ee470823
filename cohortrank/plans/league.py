"""Q3 league-map build and its pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r9, round_half_even
from ..functions.text import league_code
from ..operators.rank import group_quantile, join_null_safe
from ..operators.scan import asof_join, prefix_scan
from ..session import materialize
from ..spec import DIVISION_FACTOR, MIN_MEDIAN_SUPPORT, PRIORITY_RANK


def supported_median(df: DataFrame, group_cols, value_col: str, min_n: int = MIN_MEDIAN_SUPPORT,
                     out: str = "mv_median") -> DataFrame:
    """A2: median of positive values if at least ``min_n`` of them, else NULL; coverage %.

    The median is exact and computed by the skew-safe quantile operator.
    """
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    v = F.col(value_col)
    counts = df.groupBy(*g).agg(F.count(F.lit(1)).alias("n_rows"),
                                F.count_if(v > 0).alias("n_positive"))
    med = group_quantile(df.where(v > 0), g, value_col, 0.5, out="_median").drop("_median_n")
    j = join_null_safe(counts, med, g, how="left")
    return j.select(*g, "n_rows", "n_positive",
                    F.when(F.col("n_positive") >= min_n, r9(F.col("_median"))).alias(out),
                    (F.lit(100.0) * F.col("n_positive") / F.col("n_rows")).alias("coverage"))


def monotone_anchors(anchors: DataFrame, x: str = "ax", y: str = "ay", group_cols=None) -> DataFrame:
    """Anchors sorted by (x, y), within groups, with y replaced by its running maximum."""
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols or [])
    own = anchors.select(*g, F.col(x).alias("ax"), F.col(y).alias("_y"), F.lit(1).cast("long").alias("_one"))
    run = prefix_scan(own, ["ax", "_y"], {"ay": ("max", "_y"), "anchor_ord": ("sum", "_one")}, g)
    return run.select(*g, "ax", "ay", "anchor_ord")


def interpolate(df: DataFrame, x_col: str, anchors: DataFrame, out: str = "interp") -> DataFrame:
    """Linear interpolation over anchors ``(ax, ay, anchor_ord)``, clamped at both ends.

    Half-open intervals ``[ax_i, ax_{i+1})`` in (ax, ay) order, so a tied anchor x
    gives the last tied y (like ``np.interp``). A merge: the distinct values and the
    anchors lie in one sequence, whose scan gives each value the anchors on either side.
    """
    j = asof_join(df, x_col, anchors, "ax", ["ax", "ay"], ["anchor_ord"])
    x, a, b = F.col(x_col), F.col("prev"), F.col("next")
    lin = (b["ay"] - a["ay"]) / (b["ax"] - a["ax"]) * (x - a["ax"]) + a["ay"]
    val = F.when(a.isNull(), b["ay"]).when(b.isNull(), a["ay"]).otherwise(lin)
    return j.withColumn(out, F.when(x.isNotNull(), val).cast("double")).drop("prev", "next")


def _factor_expr(division_col: str):
    m = F.create_map(*[x for k, v in DIVISION_FACTOR.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.try_element_at(m, F.col(division_col))


def strength_inputs(players: DataFrame, leagues: DataFrame, key: str = "league_key",
                    min_n: int = MIN_MEDIAN_SUPPORT, club: str = "club_season") -> DataFrame:
    """Leagues with profile, supported median and raw European strength.

    Profile (A1) and the positive-value counts of A2 are one aggregation over
    the players; the exact median adds the positions pass.
    """
    v = F.col("market_value")
    counts = players.groupBy(key).agg(F.count(F.lit(1)).alias("n_players"),
                                      F.count_distinct(club).alias("n_teams"),
                                      F.count_if(v > 0).alias("n_positive"))
    med = group_quantile(players.where(v > 0), [key], "market_value", 0.5, out="_median").drop("_median_n")
    lm = leagues.join(counts.join(med, key, "left"), key, "left")
    return (lm.withColumn("mv_median", F.when(F.col("n_positive") >= min_n, r9(F.col("_median"))))
              .withColumn("coverage", F.lit(100.0) * F.col("n_positive") / F.col("n_players"))
              .withColumn("uefa_raw", F.col("coefficient") * _factor_expr("division"))
              .drop("_median"))


def anchors_of(inputs: DataFrame) -> DataFrame:
    a = inputs.where(F.col("uefa_raw").isNotNull() & F.col("mv_median").isNotNull()
                     & (F.col("mv_median") != 0))
    return monotone_anchors(a.select(F.col("mv_median").alias("ax"), F.col("uefa_raw").alias("ay")))


def raw_strength(inputs: DataFrame) -> DataFrame:
    """European route where a coefficient exists, else interpolated from the median."""
    x = F.when(F.col("uefa_raw").isNull() & (F.col("mv_median") != 0), F.col("mv_median"))
    both = interpolate(inputs.withColumn("_x", x), "_x", anchors_of(inputs)).drop("_x")
    return both.withColumn("raw", F.coalesce("uefa_raw", "interp"))


def build_league_map(players: DataFrame, leagues: DataFrame, key: str = "league_key",
                     season: str | None = None, calendar_year=(), apertura=(),
                     groups: dict | None = None, seasons: DataFrame | None = None) -> DataFrame:
    """Q3: one row per league with profile, priority, division and a 0-100 strength.

    ``seasons``: (key, latest_season), the newest season of each league, where they differ.
    """
    # one row per league, written once: the anchors, the interpolation and the rescale read it
    raw = materialize(raw_strength(materialize(strength_inputs(players, leagues, key), "league_inputs")), "league_raw")
    if seasons is not None:
        raw = raw.join(seasons.select(key, F.col("latest_season").alias("_season")), key, "left")
    top = raw.agg(F.max(F.when(F.col("raw") != 0, F.col("raw"))).alias("_top"))
    top = top.select(F.when(F.coalesce(F.col("_top"), F.lit(0.0)) != 0, F.col("_top"))
                      .otherwise(F.lit(1.0)).alias("_top"))
    j = raw.crossJoin(F.broadcast(top))
    truthy = F.col("raw").isNotNull() & (F.col("raw") != 0)
    strength = F.when(truthy, round_half_even(F.lit(100.0) * F.col("raw") / F.col("_top"), 1))
    cov = F.rint(F.coalesce(F.col("coverage"), F.lit(0.0))).cast("long").cast("string")
    source = (F.when(F.col("uefa_raw").isNotNull(), F.lit("provisional_uefa_x_division"))
               .when(F.col("interp").isNotNull(),
                     F.concat(F.lit("provisional_marketvalue_interp (coverage "), cov, F.lit("%)")))
               .otherwise(F.lit("MISSING - fill by hand")))
    prank = F.create_map(*[x for k, v in PRIORITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    cal = (F.when(F.col("country").isin(list(apertura) or [""]), F.lit("apertura-clausura"))
            .when(F.col("country").isin(list(calendar_year) or [""]), F.lit("calendar"))
            .otherwise(F.lit("autumn-spring")))
    grp = F.lit(None).cast("int")
    if groups:
        gm = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.lit(v))])
        grp = F.try_element_at(gm, F.col(key))
    n_players = F.coalesce(F.col("n_players"), F.lit(0)).cast("long")
    out = j.select(
        F.col(key),
        league_code(F.col("country"), F.col("league")).alias("league_code"),
        "folder", "country", "league", "priority",
        F.try_element_at(prank, F.col("priority")).alias("priority_rank"),
        "division",
        strength.alias("strength"),
        source.alias("strength_source"),
        (F.lit(season) if seasons is None else F.col("_season")).cast("string").alias("latest_season"),
        F.coalesce(F.col("n_teams"), F.lit(0)).cast("long").alias("n_teams"),
        n_players.alias("n_players"),
        grp.alias("groups"),
        cal.alias("calendar"),
        F.when(n_players > 0, F.lit("")).otherwise(F.lit("no CSV exported yet")).alias("notes"),
    )
    # a dimension read by every score plan: written once, then broadcast from the files
    return materialize(out, "league_map")
