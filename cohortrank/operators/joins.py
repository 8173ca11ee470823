"""Catalogue resolution, suggestions and status joins.

All are equality joins and left to Catalyst and AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_scope


# FIXED VALUES: time frames that are no season names
TIMEFRAME_WORDS = ("current_season", "last_season", "last_5", "default")


def resolve_scope(scopes: DataFrame, catalogue: DataFrame, timeframe: str,
                  scope_col: str = "scope") -> DataFrame:
    """``"Area. League"`` -> competition: name + area match, else name only, else none.

    ``catalogue``: (area, name, id, cat_ord, seasons map<string, long>). The
    best candidate per scope is the best match quality, then catalogue order.
    Season: the timeframe's id from the competition's seasons. ``season_status``:
    ``season`` (its id found), ``keyword`` (a time frame word the caller passes
    through, no id needed), ``no season`` (the competition lacks it: no hit, both
    ids NULL) or NULL without a competition.
    """
    area, league = split_scope(F.col(scope_col))
    s = scopes.select(scope_col, area.alias("_area"), league.alias("_league"))
    cat = catalogue.select(F.col("area").alias("_carea"), F.col("name").alias("_cname"),
                           F.col("id").alias("_cid"), "cat_ord", "seasons")
    j = s.join(cat, F.lower(F.col("_cname")) == F.lower(F.col("_league")), "left")
    quality = (F.when(F.col("_cid").isNull(), F.lit(0))
                .when(F.instr(F.lower(F.coalesce(F.col("_carea"), F.lit(""))), F.lower(F.col("_area"))) > 0,
                      F.lit(2))
                .otherwise(F.lit(1)))
    w = Window.partitionBy(scope_col).orderBy(F.col("_q").desc(), F.col("cat_ord").asc_nulls_last())
    best = (j.withColumn("_q", quality).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1))
    season = F.try_element_at(F.col("seasons"), F.lit(timeframe))
    status = F.when(F.col("_cid").isNotNull(), F.when(season.isNotNull(), "season").when(F.lit(timeframe in TIMEFRAME_WORDS), "keyword").otherwise("no season"))
    best = best.withColumn("season_status", status)
    return best.select(
        scope_col,
        F.when(F.col("season_status") != "no season", F.col("_cid")).alias("competition_id"),
        F.when(F.col("season_status") == "season", season).alias("season_id"), "season_status",
        F.when(F.col("_q") == 2, "area").when(F.col("_q") == 1, "name").otherwise("none").alias("match"))


def name_grams(text: Column, size: int = 3) -> Column:
    """The different runs of ``size`` characters of a text, in order of first place."""
    last = F.length(text) - (size - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


def suggest(scopes: DataFrame, catalogue: DataFrame, max_n: int = 8, prefix: int = 6,
            scope_col: str = "scope") -> DataFrame:
    """Names that contain the first ``prefix`` letters of the league, first ``max_n``.

    By an index of letter triples: a query looks into the postings of its rarest
    triple only, and the names found there are verified. Queries of fewer than three
    letters are a posting themselves; of those only the first ``max_n`` names are kept,
    since all of them match. ``row_number() <= max_n`` is a per-task group limit.
    """
    _, league = split_scope(F.col(scope_col))
    s = scopes.select(scope_col, F.substring(F.lower(league), 1, prefix).alias("_q")).where(F.col("_q").isNotNull())
    cat = catalogue.where(F.col("name").isNotNull()).select(F.col("area").alias("_carea"), F.col("name").alias("_cname"), F.lower("name").alias("_low"), "cat_ord")
    first = Window.partitionBy("_gram").orderBy("cat_ord")
    short = cat.withColumn("_gram", F.explode(F.concat(F.array(F.lit("")), name_grams(F.col("_low"), 1), name_grams(F.col("_low"), 2)))).withColumn(
        "_rn", F.row_number().over(first)).where(F.col("_rn") <= max_n).drop("_rn")
    postings = cat.withColumn("_gram", F.explode(name_grams(F.col("_low"))))
    few = s.where(F.length("_q") < 3).join(short, F.col("_gram") == F.col("_q"))
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    asked = s.where(F.length("_q") >= 3).withColumn("_gram", F.explode(name_grams(F.col("_q")))).join(counts, "_gram", "left")
    rarest = asked.groupBy(scope_col, "_q").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_gram")).alias("_r")).select(scope_col, "_q", F.col("_r._gram").alias("_gram"))
    many = rarest.join(postings, "_gram").where(F.instr(F.col("_low"), F.col("_q")) > 0)
    found = few.select(scope_col, "_carea", "_cname", "cat_ord").unionByName(many.select(scope_col, "_carea", "_cname", "cat_ord"))
    w = Window.partitionBy(scope_col).orderBy("cat_ord")
    return (found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= max_n)
             .select(scope_col, "rank",
                     F.concat_ws(". ", F.col("_carea"), F.col("_cname")).alias("suggestion")))


def verify_season(registry: DataFrame, found: DataFrame, expected: DataFrame,
                  key: str = "folder") -> DataFrame:
    """Registry x merged-export counts x expected counts -> status and message.

    ``found``: (folder, n_rows, n_parts) - rows of the merged export (NULL if
    there is none) and the number of raw parts; ``expected``: (folder,
    expected, reason). Status: EMPTY (nothing), NO_CSV (parts, no merged
    export), FAIL (no expected count, or a different one), OK.
    """
    j = registry.join(found, key, "left").join(expected, key, "left")
    n, e, parts = F.col("n_rows"), F.col("expected"), F.coalesce(F.col("n_parts"), F.lit(0))
    status = (F.when(n.isNull() & (parts == 0), "EMPTY")
               .when(n.isNull(), "NO_CSV")
               .when(e.isNull(), "FAIL")
               .when(e != n, "FAIL")
               .otherwise("OK"))
    msg = (F.when(n.isNull() & (parts == 0), F.lit("no parts and no merged export - nothing exported yet"))
            .when(n.isNull(), F.format_string("%d parts present but no merged export", parts))
            .when(e.isNull(), F.format_string("%d rows but %s", n, F.coalesce(F.col("reason"),
                                                                              F.lit("no expected count"))))
            .when(e != n, F.format_string("merged export has %d rows, expected %d (%+d)", n, e, n - e))
            .otherwise(F.format_string("%d rows", n)))
    return j.withColumn("status", status).withColumn("message", msg)

