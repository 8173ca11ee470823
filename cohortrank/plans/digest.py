"""Comparison by digest tree (Q6, J3): only rows of differing buckets meet.

Rows fall into buckets by a hash of their key; a bucket's digest is its row count and
the sums of four 60-bit parts of the SHA-256 of its rows, so it does not depend on
their order and is built by a partial aggregate: one scan, no shuffle of rows. Two
levels, ``groups`` of ``leaves`` buckets: leaves are looked at only in groups that differ.

Equal digests mean equal cells (text by text), so equal buckets hold no difference, and
a key lies in one bucket on both sides, so duplicated keys are judged as in ``diff_keyed``.
``write_digested`` stores a table by group with its digests beside it; a later comparison
of stored tables reads the digests and, by partition pruning, only the groups that differ.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import row_digest
from ..session import materialize
from .quality import diff_keyed, with_key

GROUPS, LEAVES = 256, 64  # at most 16,384 buckets, whatever the size of the tables
PARTS = 4


def _bucketed(df: DataFrame, key_cols: Sequence[str], groups: int, leaves: int) -> DataFrame:
    """``df`` with its bucket: ``_group`` and ``_leaf``."""
    b = F.pmod(F.xxhash64("_key"), F.lit(groups * leaves).cast("long"))
    return with_key(df, key_cols, "_key").withColumn("_leaf", b.cast("int")).withColumn("_group", F.floor(F.col("_leaf") / leaves).cast("int")).drop("_key")


def _sums(parts: Sequence[Column]) -> list[Column]:
    return [F.sum(p).alias(f"d{i}") for i, p in enumerate(parts)]


def _leaf_digests(bucketed: DataFrame, cols: Sequence[str]) -> DataFrame:
    h = row_digest(bucketed.select(*[f"`{c}`" for c in cols]))
    parts = [F.conv(F.substring("_h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)") for i in range(PARTS)]
    return bucketed.withColumn("_h", h).groupBy("_group", "_leaf").agg(F.count(F.lit(1)).alias("n"), *_sums(parts))


def digest_leaves(df: DataFrame, key_cols: Sequence[str], cols: Sequence[str], groups: int = GROUPS, leaves: int = LEAVES) -> DataFrame:
    """(_group, _leaf, n, d0..d3): the lower level of the tree over ``cols``."""
    return _leaf_digests(_bucketed(df, key_cols, groups, leaves), cols)


def _unequal(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of ``on`` whose counts or digests differ, or that one side lacks."""
    figures = ["n", *[f"d{i}" for i in range(PARTS)]]
    x = a.select(*on, F.struct(*figures).alias("_a")).join(b.select(*on, F.struct(*figures).alias("_b")), list(on), "full_outer")
    return x.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*on)


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(_group, _leaf) of the buckets that differ, from the two tables of leaves: groups first, then their leaves."""
    up = lambda t: t.groupBy("_group").agg(F.sum("n").alias("n"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(PARTS)])
    groups = _unequal(up(a), up(b), ["_group"])
    inside = lambda t: t.join(groups, "_group", "left_semi")
    return _unequal(inside(a), inside(b), ["_group", "_leaf"])


def _only(df: DataFrame, buckets: DataFrame) -> DataFrame:
    # the buckets are at most GROUPS x LEAVES pairs of integers
    return df.join(F.broadcast(buckets), ["_group", "_leaf"], "left_semi").drop("_group", "_leaf")


def diff_by_digest(a: DataFrame, b: DataFrame, key_cols: Sequence[str], groups: int = GROUPS, leaves: int = LEAVES) -> DataFrame:
    """``diff_keyed`` of two tables; rows of buckets that agree are neither shuffled nor compared."""
    shared = sorted(c for c in a.columns if c in set(b.columns))
    ba, bb = _bucketed(a, key_cols, groups, leaves), _bucketed(b, key_cols, groups, leaves)
    buckets = materialize(differing_buckets(materialize(_leaf_digests(ba, shared), "digests"), materialize(_leaf_digests(bb, shared), "digests")), "buckets")
    return diff_keyed(_only(ba, buckets), _only(bb, buckets), key_cols)


def write_digested(df: DataFrame, path: str, key_cols: Sequence[str], groups: int = GROUPS, leaves: int = LEAVES) -> None:
    """Store ``df`` under ``path``: rows by group, sorted by leaf, and the digests of all its columns."""
    x = _bucketed(df, key_cols, groups, leaves)
    x.hint("rebalance", "_group").sortWithinPartitions("_group", "_leaf").write.mode("overwrite").partitionBy("_group").parquet(f"{path}/rows")
    stored = spark_rows(df.sparkSession, path)
    _leaf_digests(stored, sorted(df.columns)).write.mode("overwrite").parquet(f"{path}/digests")


def spark_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their buckets."""
    return spark.read.parquet(f"{path}/rows")


def diff_stored(spark: SparkSession, path_a: str, path_b: str, key_cols: Sequence[str]) -> DataFrame:
    """``diff_keyed`` of two stored tables of equal columns; reads the digests, then the groups that differ."""
    digests = [spark.read.parquet(f"{p}/digests") for p in (path_a, path_b)]
    buckets = materialize(differing_buckets(*digests), "buckets").where("_group >= 0")
    return diff_keyed(*[_only(spark_rows(spark, p), buckets) for p in (path_a, path_b)], key_cols)
