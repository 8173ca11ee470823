"""Scans, header contract and sinks for per-league export files.

Layout: ``<root>/<season>/<n> - [<CODE>] - (<League>)/<file>.csv`` plus a
``<rows>.txt`` whose *name* is the expected count.

The header contract is decided before the data read: Spark reads a CSV with
a declared schema *by position*, so a file with another column order would
be read shifted. The header report (S2) takes the first record of each file;
cells are then read by position and conformed by the name that the header
of their own file gives them (S4).
"""

from __future__ import annotations

import os
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import NULL_WORDS, to_number
from ..functions.text import SEASON_RE, parse_folder
from .headers import read_headers

GLOB_CHARS = "[]*?{}"


def read_header_spec(path: str) -> list[str]:
    """Contract file: one column name per line; blank lines and ``#`` lines ignored."""
    with open(path, encoding="utf-8") as fh:
        return [ln.strip() for ln in fh.read().splitlines() if ln.strip() and not ln.startswith("#")]


def escape_glob(path: str) -> str:
    """Escape Hadoop glob characters (``[GER]`` in a folder name is not a character class)."""
    out = path
    for ch in GLOB_CHARS:
        out = out.replace(ch, "\\" + ch)
    return out


def _decoded_path() -> Column:
    """Path of the file; local ones are written ``file:/`` or ``file:///`` by different readers."""
    return F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), "^file:/+", "file:///")


def _parent_name(path: Column) -> Column:
    """Name of the folder holding the file.

    A Hive-style ``key=value`` folder (as written by ``partitionBy``) gives
    its value with the ``%XX`` escapes undone; ``+`` stays a plus sign.
    """
    parent = F.element_at(F.split(path, "/"), -2)
    hive = parent.rlike(r"^[^=/]+=")
    value = F.regexp_replace(F.regexp_replace(parent, r"^[^=/]+=", ""), r"\+", "%2B")
    return F.when(hive, F.url_decode(value)).otherwise(parent)


def _unescape_folder(name: str) -> str:
    """Python twin of ``_parent_name`` for names listed on the driver."""
    import re
    from urllib.parse import unquote
    if re.match(r"^[^=/]+=", name):
        return unquote(re.sub(r"^[^=/]+=", "", name))
    return name


def header_report(spark: SparkSession, root: str, header_spec: Sequence[str],
                  pattern: str = "*.csv") -> DataFrame:
    """Per file, its header and the missing / unexpected column names.

    Headers come from a data source that stops after the first record of a file
    (``headers.read_headers``). Repeated names are renamed ``name.1``, ``name.2`` as a
    spreadsheet reader does.
    """
    hdr = read_headers(spark, root, pattern)
    spec = F.array(*[F.lit(c) for c in header_spec])
    return (hdr.withColumn("folder", _parent_name(F.col("path")))
               .withColumn("missing", F.array_except(spec, F.col("header")))
               .withColumn("extra", F.array_except(F.col("header"), spec))
               .withColumn("ok", (F.size("missing") == 0) & (F.size("extra") == 0)))


def first_file_per_folder(report: DataFrame) -> DataFrame:
    """One export per folder: the smallest path (a stable choice)."""
    return report.groupBy("folder").agg(F.min("path").alias("path")).join(report, ["folder", "path"])


def apply_contract(df: DataFrame, report: DataFrame, strict: bool = True, path_col: str = "path") -> DataFrame:
    """S3: strict mode drops rows of files that break the contract; lenient keeps them."""
    if not strict:
        return df
    bad = report.where(~F.col("ok")).select(F.col("path").alias(path_col))
    return df.join(bad, path_col, "left_anti")


def conform(df: DataFrame, columns: Sequence[str], types: Mapping[str, str] | None = None,
            keep: Sequence[str] = ()) -> DataFrame:
    """Reorder to the contract; absent columns become typed NULLs; extra columns dropped.

    Text cells that spell a missing value become NULL; numeric contract
    columns are coerced safely (S6).
    """
    types = types or {}
    have = set(df.columns)
    out = []
    for c in columns:
        t = types.get(c, "string")
        if c in have:
            v = F.col(f"`{c}`")
            v = F.when(~F.trim(v.cast("string")).isin(list(NULL_WORDS)), v)
            v = to_number(v) if t == "double" else v.cast(t)
        else:
            v = F.lit(None).cast(t)
        out.append(v.alias(c))
    return df.select(*out, *[F.col(k) for k in keep])


def read_exports(spark: SparkSession, root: str, header_spec: Sequence[str],
                 types: Mapping[str, str] | None = None, season: str | None = None,
                 strict: bool = True, first_only: bool = False,
                 multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 (+S2-S4): scan one season's exports into one table with lineage columns.

    Returns ``(players, report)``. Every file of a folder is read; ``first_only``
    keeps the smallest path of each. Strict mode leaves out files that break
    the contract. All files are read by position into one array of cells, as
    wide as the widest header; the header of the file, joined by path, says
    which cell a contract column is, so a reordered header cannot shift values
    and no list of paths is gathered. Quoted cells may hold line breaks, at the
    price of one task per file; without ``multi_line`` files are split over tasks,
    and such cells break in two.
    """
    base = root.rstrip("/") + (f"/{season}" if season else "")
    report = header_report(spark, base, header_spec)
    chosen = first_file_per_folder(report) if first_only else report
    chosen = apply_contract(chosen, report, strict)
    width = report.agg(F.max(F.size("header"))).first()[0] or 1
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = (spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", multi_line)
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(escape_glob(base))
           .select(F.array(*[f"_c{i}" for i in range(width)]).alias("_cells"), _decoded_path().alias("path")))
    at = raw.join(chosen.select("path", "header"), "path")
    named = at.select("path", *[F.get("_cells", F.array_position("header", c).cast("int") - 1).alias(c) for c in header_spec])
    df = conform(named, header_spec, types, keep=["path"])
    folder = _parent_name(F.col("path"))
    _, code, league = parse_folder(folder)
    df = (df.withColumn("folder", folder).withColumn("country", code).withColumn("league", league)
            .withColumn("season", F.lit(season).cast("string") if season else
                        F.element_at(F.split(F.col("path"), "/"), -3)))
    if not season:
        df = df.where(valid_season(F.col("season")))
    return df, report


def valid_season(c) -> Column:
    """A season folder name is ``YYYY-YYYY``."""
    return c.rlike(SEASON_RE)


def missing_exports(registry: DataFrame, report: DataFrame, key: str = "folder") -> DataFrame:
    """Registry folders with no export file."""
    return registry.join(report.select(key).distinct(), key, "left_anti")


def file_listing(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """S13 input: (folder, file_name, path, length) for every file under ``root``.

    Listed with the Hadoop FileSystem API (metadata only, as Spark's own file
    index does). File scans such as ``binaryFile`` skip zero-length files,
    and the count files (``538.txt``) are usually empty: their name is the
    data.
    """
    import fnmatch
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(root)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    it = fs.listFiles(hpath, True)
    rows = []
    while it.hasNext():
        st = it.next()
        fp = st.getPath()
        name = fp.getName()
        if pattern and not fnmatch.fnmatch(name, pattern):
            continue
        rows.append((_unescape_folder(fp.getParent().getName()), name, fp.toString(), int(st.getLen())))
    schema = T.StructType([T.StructField("folder", T.StringType()), T.StructField("file_name", T.StringType()),
                           T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])
    return spark.createDataFrame(rows, schema)


def part_schema_check(report: DataFrame) -> DataFrame:
    """Folders whose parts do not share one header (distinct headers > 1)."""
    return (report.groupBy("folder").agg(F.count_distinct(F.array_join("header", "\u0001")).alias("n_headers"),
                                         F.count(F.lit(1)).alias("n_files"))
                  .where(F.col("n_headers") > 1))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """``.tsv``/``.txt`` tab-separated, anything else comma-separated; header, text cells."""
    sep = "\t" if os.path.splitext(path)[1].lower() in (".tsv", ".txt") else ","
    return spark.read.option("header", "true").option("sep", sep).option("escape", '"').csv(escape_glob(path))


LEAGUE_MAP_SCHEMA = T.StructType([
    T.StructField("league_code", T.StringType()), T.StructField("folder", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("league", T.StringType()),
    T.StructField("priority", T.StringType()), T.StructField("priority_rank", T.IntegerType()),
    T.StructField("division", T.IntegerType()), T.StructField("strength", T.DoubleType()),
    T.StructField("strength_source", T.StringType()), T.StructField("latest_season", T.StringType()),
    T.StructField("n_teams", T.IntegerType()), T.StructField("n_players", T.IntegerType()),
    T.StructField("groups", T.IntegerType()), T.StructField("calendar", T.StringType()),
    T.StructField("notes", T.StringType()),
])


def load_league_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The league dimension with its declared schema, and the count of leagues without strength."""
    lm = spark.read.schema(LEAGUE_MAP_SCHEMA).option("header", "true").csv(escape_glob(path))
    missing = lm.agg(F.count_if(F.col("strength").isNull()).alias("n_without_strength"))
    return lm, missing


def write_merged(df: DataFrame, root: str, partition_cols: Sequence[str] = ("season", "league_code"),
                 fmt: str = "parquet") -> None:
    """One output folder per league.

    A ``rebalance`` on the partition columns lets AQE split a league that
    holds a large share of the rows over several writer tasks and merge
    small leagues, instead of one task per league.
    """
    cols = list(partition_cols)
    (df.hint("rebalance", *cols).write.mode("overwrite").partitionBy(*cols).format(fmt).save(root))


def write_json_lines(df: DataFrame, path: str, json_col: str = "json") -> None:
    """S10 sink: one JSON document per line."""
    df.select(json_col).write.mode("overwrite").text(path)
