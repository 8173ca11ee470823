"""S2 as a data source: the first record of every CSV file, reading no more than that.

``spark.read.format("csv_headers").load(root)`` gives (path, header, bytes_read). The
files under ``root`` are listed once; a partition is a list of ``filesPerPartition``
files, whose reader takes blocks of ``BLOCK`` bytes until the first record ends, by the
rules of quoted cells (a quoted cell may hold separators, line breaks and doubled
quotes). Files without a byte have no row. Repeated names become ``name.1``, ``name.2``.
"""

from __future__ import annotations

import csv
import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, FILES = 4096, 64


def _open(root: str):
    """(file system, path in it, prefix that makes a path the one that Spark names)."""
    from pyarrow import fs
    if "://" not in root or root.startswith("file:"):
        path = root.removeprefix("file:")
        while path.startswith("//"):
            path = path[1:]
        return fs.LocalFileSystem(), path, "file://"
    system, path = fs.FileSystem.from_uri(root)
    return system, path, root[:len(root) - len(path)] if root.endswith(path) else root.split("://", 1)[0] + "://"


def first_record(stream, block: int = BLOCK) -> tuple[bytes, int]:
    """The first record of a CSV stream, without its line end, and the bytes read for it."""
    held, quoted, at = b"", False, 0
    while True:
        more = stream.read(block)
        held += more
        while at < len(held):
            c = held[at:at + 1]
            if c == b'"':
                quoted = not quoted  # a doubled quote toggles twice
            elif c in b"\r\n" and not quoted:
                return held[:at], len(held)
            at += 1
        if len(more) < block:
            return held, len(held)


def unique_names(cells: list[str]) -> list[str]:
    """Repeated names numbered as a spreadsheet reader does: the k-th repetition of ``a`` is ``a.k``."""
    seen: dict[str, int] = {}
    out = []
    for c in cells:
        k = seen.get(c, 0)
        seen[c] = k + 1
        out.append(f"{c}.{k}" if k else c)
    return out


def parse_header(record: bytes) -> list[str]:
    text = record.decode("utf-8-sig", errors="replace")
    return unique_names(next(csv.reader(io.StringIO(text, newline="")), [""]))


@dataclass
class FileList(InputPartition):
    paths: list[str]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.pattern = options.get("pathglobfilter", options.get("pathGlobFilter", "*.csv"))
        self.size = int(options.get("filesperpartition", options.get("filesPerPartition", FILES)))

    def partitions(self) -> list[FileList]:
        from pyarrow import fs
        system, path, _ = _open(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        # hidden files and folders, which writers use for their own ends, are left out as Spark's readers do
        hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(path):].split("/"))
        files = sorted(f.path for f in found if f.is_file and f.size and fnmatch.fnmatch(f.base_name, self.pattern) and not hidden(f.path))
        return [FileList(files[i:i + self.size]) for i in range(0, len(files), self.size)] or [FileList([])]

    def read(self, partition: FileList) -> Iterator[tuple]:
        system, _, prefix = _open(self.root)
        for p in partition.paths:
            with system.open_input_stream(p, buffer_size=None) as stream:
                record, size = first_record(stream)
            yield prefix + p, parse_header(record), size


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_headers"

    def schema(self) -> str:
        return "path string, header array<string>, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(dict(self.options))


def read_headers(spark: SparkSession, root: str, pattern: str = "*.csv", files_per_partition: int = FILES) -> DataFrame:
    """(path, header, bytes_read) of every CSV file under ``root``."""
    spark.dataSource.register(HeaderSource)
    return spark.read.format("csv_headers").option("pathGlobFilter", pattern).option("filesPerPartition", files_per_partition).load(root)
