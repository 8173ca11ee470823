"""Staged publishing through a manifest, and scans of the newest season (Q3).

A run writes to a folder of its own, counts each league in the written files, compares
with the expected counts and publishes the leagues that agree by one more version of the
manifest, written last. Readers follow the manifest only: rows of an unfinished run, or of
a league held back, are never seen, and a league held back keeps its last published run.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import join_null_safe
from ..session import materialize
from .files import write_merged

# fixed values: states of a league in a run
PUBLISHED, MISMATCH, UNEXPECTED, MISSING = "published", "mismatch", "unexpected", "missing"


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """All versions of the manifest, or None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", f"{root}/manifest").parquet(f"{root}/manifest")


def publish(df: DataFrame, root: str, expected: DataFrame, partition_cols: Sequence[str] = ("season", "league_code")) -> DataFrame:
    """Write ``df``, check it league by league, publish what agrees; the manifest rows of this run.

    ``expected``: the partition columns and ``expected``. Result: the partition columns,
    n_rows (in the written files), expected, status, run.
    """
    spark, cols = df.sparkSession, list(partition_cols)
    run = f"r-{uuid.uuid4().hex}"
    write_merged(df, f"{root}/data/run={run}", cols)
    types = {f.name: f.dataType for f in df.schema}
    # partition columns and footers only
    found = spark.read.parquet(f"{root}/data/run={run}").groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
    found = found.select(*[F.col(c).cast(types[c]).alias(c) for c in cols], "n_rows")
    own = expected.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(cols)], F.col("expected").cast("long").alias("expected"))
    same = [F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(cols)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    j = found.join(own, cond, "full_outer")
    status = (F.when(F.col("n_rows").isNull(), MISSING).when(F.col("expected").isNull(), UNEXPECTED)
               .when(F.col("n_rows") == F.col("expected"), PUBLISHED).otherwise(MISMATCH))
    rows = j.select(*[F.coalesce(c, f"_e{i}").alias(c) for i, c in enumerate(cols)], "n_rows", "expected", status.alias("status"), F.lit(run).alias("run"))
    rows = materialize(rows, "manifest")
    old = manifest(spark, root)
    version = 1 + ((old.agg(F.max("version")).first()[0] or 0) if old is not None else 0)
    rows.write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")
    return rows


def read_published(spark: SparkSession, root: str, partition_cols: Sequence[str] = ("season", "league_code")) -> DataFrame:
    """The published rows: of every league those of the last run that agreed."""
    cols = list(partition_cols)
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"nothing published under {root}")
    last = m.where(F.col("status") == PUBLISHED).groupBy(*cols).agg(F.max_by("run", "version").alias("run"))
    data = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    types = {f.name: f.dataType for f in data.schema}
    last = materialize(last.select(*[F.col(c).cast(types[c]).alias(c) for c in cols], "run"), "published").where("run is not null")
    # a join on partition columns: Spark prunes the folders at run time
    return join_null_safe(data, last, ["run", *cols], how="inner", null_safe=cols).drop("run")


def newest_seasons(counts: DataFrame, league: str = "league_code", season: str = "season") -> DataFrame:
    """Per league its newest season with rows: (league, latest_season, n_rows) from (league, season, n_rows)."""
    return counts.where(F.col("n_rows") > 0).groupBy(league).agg(F.max(season).alias("latest_season"), F.max_by("n_rows", season).alias("n_rows"))


def scan_newest(spark: SparkSession, root: str, league: str = "league_code", season: str = "season") -> tuple[DataFrame, DataFrame]:
    """Rows of every league's newest season with data under ``root`` (folders by season and league), and the choice.

    The choice comes from the folders and the row counts of the files; only the chosen folders are read.
    """
    data = spark.read.parquet(root)
    choice = materialize(newest_seasons(data.groupBy(league, season).agg(F.count(F.lit(1)).alias("n_rows")), league, season), "seasons")
    wanted = choice.where("n_rows > 0").select(F.col(league).alias("_league"), F.col("latest_season").alias("_season"))
    rows = data.join(wanted, (F.col(league) == F.col("_league")) & (F.col(season) == F.col("_season"))).drop("_league", "_season")
    return rows, choice
