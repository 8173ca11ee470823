"""SparkSession settings shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. AQE re-plans joins at run time (a side that
# turns out small becomes a broadcast; a skewed partition is split), which is
# how the library sizes joins against tables whose size it cannot know.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "cohortrank", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster
        conf["spark.driver.memory"] = os.environ.get("COHORTRANK_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, reliable folder and is always
    used as given; a cluster session without it is refused. In local mode a
    fresh folder under the system temp directory is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="cohortrank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shuffle_partitions(spark: SparkSession) -> int:
    v = spark.conf.get("spark.sql.shuffle.partitions", "200")
    try:
        return max(1, int(v))
    except ValueError:  # "auto" on some platforms
        return max(1, spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str):
    """Read one driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder, read it back.

    Used where an operator needs its input more than once (a self-join of a
    derived table). Downstream plans start from the written files, so the
    upstream work runs once (one job, unlike an RDD checkpoint, which runs
    the plan a second time to write it), a lost executor costs a re-read
    instead of a recomputation, plan trees do not multiply through nested
    operators, and the re-read keeps column pruning and filter pushdown.

    ``is_written`` tells such DataFrames from others.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/cohortrank/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cohortrank_written = True
    return out


def is_written(df) -> bool:
    """True for a DataFrame that ``materialize`` returned."""
    return getattr(df, "_cohortrank_written", False)
