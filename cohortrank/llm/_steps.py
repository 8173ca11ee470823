"""Written steps of long operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from ..session import materialize


def step(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back; shuffle files that led to it can then go.

    Spark's cleaner removes the files of a shuffle once the driver has collected
    the objects of the finished plan, which in a short job may be never.
    """
    out = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
