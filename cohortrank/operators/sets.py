"""Set logic: union of exports, full-row dedup, duplicated keys, column-set difference."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def union_exports(parts: Sequence[DataFrame]) -> DataFrame:
    """Union all by column name; columns missing in a part become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def row_digest(df: DataFrame) -> Column:
    """SHA-256 (hex) of all columns of ``df``, each with its length, NULL apart from any text.

    Rows that compare equal have equal digests: 0.0 and -0.0 are one number.
    """
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType):
            c = F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row dedup (NULL equals NULL). Never by a name-like subset of columns.

    Digests are counted first; rows whose digest occurs once are kept as they are and
    rows that share one are compared whole, so a digest proves nothing by itself. The
    repeated digests are joined to the rows: below the session's threshold they are
    broadcast, and unique rows are not shuffled at all. Equal rows meet after a
    map-side partial dedup, so a row repeated a million times costs one row per map task.
    Tables with nested columns are compared whole.
    """
    if any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in df.schema.fields) or not df.columns:
        return df.dropDuplicates()
    marked = df.withColumn("_digest", row_digest(df))
    again = materialize(marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest", F.lit(True).alias("_again")), "digests")
    both = marked.join(again, "_digest", "left").drop("_digest")
    return both.where("_again is null").drop("_again").unionByName(both.where("_again").drop("_again").dropDuplicates())


def removed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after and removed, as one row."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return b.crossJoin(a).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def duplicate_keys(df: DataFrame, key_cols: Sequence[str], out: str = "n") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias(out))
              .where(F.col(out) > 1))


def column_diff(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: per column name: position in a, position in b, and which side has it.

    Schemas are metadata, so this is a small table built on the driver.
    """
    ca, cb = a.columns, b.columns
    names = list(dict.fromkeys(ca + cb))
    rows = []
    for n in names:
        pa = ca.index(n) if n in ca else None
        pb = cb.index(n) if n in cb else None
        side = "both" if pa is not None and pb is not None else ("only_a" if pa is not None else "only_b")
        rows.append((n, pa, pb, side, pa is not None and pa == pb))
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("pos_a", T.IntegerType()),
                           T.StructField("pos_b", T.IntegerType()), T.StructField("side", T.StringType()),
                           T.StructField("same_position", T.BooleanType())])
    return spark.createDataFrame(rows, schema)
