"""Q9 league registry (X16, P12, X17, X1) and the nested competition catalogue."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_folder, safe_name
from ..operators.scan import prefix_scan

TIER_ORDER = {"green": 1, "yellow": 2, "red": 3}


def build_registry(rows: DataFrame, tiers: Sequence[str] = ("green", "yellow", "red")) -> DataFrame:
    """Q9: registry rows (tier, local_name, english_name, code, leagues array, row_ord) ->
    one folder per league, numbered continuously over the selected tiers.

    A row's first number is the running sum of the array sizes before it, a league's
    its place in the array added, so the exploded leagues are never ordered.
    ``row_ord`` is unique within a tier.
    """
    tier_rank = F.create_map(*[x for k, v in TIER_ORDER.items() for x in (F.lit(k), F.lit(v))])
    own = rows.where(F.col("tier").isin(list(tiers))).select(
        "tier", "local_name", "english_name", "code", "row_ord", "leagues",
        F.try_element_at(tier_rank, F.col("tier")).alias("_tier"), F.greatest(F.size("leagues"), F.lit(0)).cast("long").alias("_size"))
    run = prefix_scan(own, ["_tier", "row_ord"], {"_upto": ("sum", "_size")})
    x = run.select("tier", "local_name", "english_name", "code", "row_ord", (F.col("_upto") - F.col("_size")).alias("_before"), F.posexplode("leagues").alias("pos", "league"))
    x = x.withColumn("num", (F.col("_before") + F.col("pos") + 1).cast("int"))
    folder = safe_name(F.format_string("%d - [%s] - (%s)", F.col("num"), F.col("code"), F.col("league")))
    x = x.withColumn("folder", folder)
    n, code, league = parse_folder(F.col("folder"))
    return x.select("num", "folder", "tier", "code", "league",
                    n.alias("parsed_num"), code.alias("parsed_code"), league.alias("parsed_league"))


def code_order(registry: DataFrame) -> DataFrame:
    """Country codes in first-seen order (with the names of their first row)."""
    return registry.groupBy("code").agg(F.min("num").alias("first_num"))


CATALOGUE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("competitions", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("seasons", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    ]))),
])


def flatten_catalogue(docs: DataFrame, json_col: str = "json", order_col: str = "doc_ord") -> DataFrame:
    """Area documents -> one row per competition season (area, competition, season).

    Season nodes are not competitions: they only feed the season columns.
    A competition without seasons keeps one row with NULL season.
    """
    p = docs.select(order_col, F.from_json(F.col(json_col), CATALOGUE_SCHEMA).alias("d"))
    c = p.select(order_col, F.col("d.name").alias("area"),
                 F.posexplode_outer("d.competitions").alias("comp_pos", "c"))
    s = c.select(order_col, "area", "comp_pos", F.col("c.id").alias("competition_id"),
                 F.col("c.name").alias("competition"), F.explode_outer("c.seasons").alias("s"))
    return s.select("area", "competition_id", "competition", F.col("s.id").alias("season_id"),
                    F.col("s.name").alias("season"),
                    F.struct(F.col(order_col).cast("long").alias("doc"), F.col("comp_pos").cast("long").alias("pos")).alias("cat_ord"))


def catalogue_table(flat: DataFrame) -> DataFrame:
    """Competition list for resolution: (area, name, id, cat_ord, seasons map)."""
    return flat.groupBy("area", "competition_id", "competition", "cat_ord").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("season").isNotNull(),
                                                 F.struct("season", "season_id")))).alias("seasons")
    ).select("area", F.col("competition").alias("name"), F.col("competition_id").alias("id"), "cat_ord", "seasons")
