"""Q5 season verification: expected counts from file names (S13), status join (J11),
status rollup (A17) and count reconciliation (S12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import verify_season


def expected_counts(listing: DataFrame) -> DataFrame:
    """Expected row count per folder from the *name* of a ``.txt`` file (``538.txt`` -> 538).

    ``listing``: (folder, file_name), a file listing (``binaryFile`` without
    content, or any table of names). Zero or several numbered files give a
    reason instead of a number.
    """
    txt = listing.where(F.col("file_name").endswith(".txt"))
    stem = F.regexp_replace(F.col("file_name"), r"\.txt$", "")
    x = txt.withColumn("_num", F.regexp_extract(stem, r"(\d+)", 1))
    numbered = F.col("_num") != ""
    agg = x.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_txt"),
        F.count_if(numbered).alias("n_numbered"),
        F.max(F.when(numbered, F.col("_num").cast("long"))).alias("_value"),
        F.array_join(F.array_sort(F.collect_list("file_name")), ", ").alias("_all"),
        F.array_join(F.array_sort(F.collect_list(F.when(numbered, F.col("file_name")))), ", ").alias("_numbered"))
    reason = (F.when(F.col("n_numbered") == 0, F.concat(F.lit("no numbered .txt (found "), F.col("_all"), F.lit(")")))
               .when(F.col("n_numbered") > 1, F.concat(F.lit("several numbered .txt: "), F.col("_numbered"))))
    return agg.select("folder", F.when(F.col("n_numbered") == 1, F.col("_value")).alias("expected"),
                      reason.alias("reason"))


def verify(registry: DataFrame, found: DataFrame, listing: DataFrame) -> DataFrame:
    """Q5: one row per registry folder with status and message."""
    exp = expected_counts(listing)
    exp = exp.select("folder", "expected",
                     F.coalesce("reason", F.lit("no .txt with the expected count")).alias("reason"))
    v = verify_season(registry, found, exp)
    return v.withColumn("reason", F.when(F.col("expected").isNull(), F.col("reason")))


def status_rollup(verified: DataFrame) -> DataFrame:
    """Folders per status and the rows held by OK folders."""
    return verified.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_folders"),
        F.sum(F.when(F.col("status") == "OK", F.col("n_rows")).otherwise(F.lit(0))).cast("long").alias("n_rows_ok"))


def reconcile_counts(found: DataFrame, expected: DataFrame, key: str = "folder") -> DataFrame:
    """Found vs expected per key with the signed difference (NULL where one is missing)."""
    j = found.select(key, "n_rows").join(expected.select(key, "expected"), key, "full_outer")
    return j.withColumn("difference", F.col("n_rows") - F.col("expected"))
