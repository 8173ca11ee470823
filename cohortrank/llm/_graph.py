"""Connected components of an edge table, as iterated DataFrame joins.

Alternating large-star and small-star rounds: each round is two aggregates
(map-side combined, so a hub with a third of all edges is pre-aggregated) and
two joins whose large side Spark may split. No neighbour list is ever gathered.
Every round is written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._steps import step


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) are directed for the star: u's neighbours v hang on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    j = edges.join(least, "u")
    if large:
        return j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.filter("u <> m").select("u", F.col("m").alias("v")))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge; component = smallest id reachable.

    ``edges`` has two columns of one orderable type; direction, repeats, loops
    and rows with a null end do not matter. An empty table gives an empty one.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = step(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).distinct()
        e = step(_star(large, False).distinct(), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
