"""WARC records in ZIP-packaged archives: written by tasks, read back by ranges.

An archive is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``,
one gzip member per record, and ``indexes/index.cdxj``, one line per record with
its offset and length. Each task writes its own archives under fresh names and
returns their paths; the rows returned are the manifest, so files of lost or
repeated attempts are never read.

The reader takes paths only. It finds the end record in the tail of the file,
follows the ZIP64 locator and record where there is one, parses the central
directory with its ZIP64 fields, reads the local header of a stored member to
find where its bytes start, and turns the lines of the index into byte ranges.
Ranges are dealt over all tasks and read without extracting anything; an archive
without an index is walked record by record.

Of records with equal payloads of at least ``min_bytes``, that of the smallest
page_id is the response and the others are revisits that name it; rows equal in
payload and id are responses alike, and so are all if every id is null. A null
html is an empty payload, a null url or id leaves out its header. Records carry
the whole payload, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, shuffle_partitions
from . import _text as tx

MIN_BYTES, ARCHIVE_BYTES, READ_BYTES = 0, 64 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
# fixed values of the WARC and ZIP formats
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str):
    """(file system, path) of a path or URI."""
    return fs.FileSystem.from_uri(uri)


# -- writing -----------------------------------------------------------------

def with_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, record_type, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_n", F.octet_length("html"))
    same = rows.filter(F.col("_n") >= min_bytes).groupBy("_sha", "_n").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(same, ["_sha", "_n"], "left").select(
        "page_id", "url", "html", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("_first")).alias("refers_to"))


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE),
            ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block)))]
    if url is not None:
        head.insert(3, ("WARC-Target-URI", _line(url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Archive:
    """One ZIP file being written: the data member first, the index at the end."""

    def __init__(self, folder: str):
        self.path = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
        system, path = _open(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.raw = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.index = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, page_id, url, html, refers_to) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        blob = packer.compress(record(page_id, url, html.encode(), refers_to)) + packer.flush()
        self.index.append(f"{_line(url or '-').replace(' ', '%20')} 20240101000000 " + json.dumps({"offset": self.at, "length": len(blob), "filename": DATA.rpartition("/")[2]}))
        self.data.write(blob)
        self.at += len(blob)

    def close(self) -> dict:
        self.data.close()
        self.zip.writestr(INDEX, "".join(x + "\n" for x in self.index))
        self.zip.close()
        self.raw.close()
        return {"path": self.path, "records": len(self.index), "bytes": self.at}


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages; (path, records, bytes) of each archive, itself written so that archives are made once."""
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(it):
        out = None
        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                out = out or _Archive(folder)
                out.add(*row)
                if out.at >= archive_bytes:
                    yield pa.RecordBatch.from_pylist([out.close()], schema=schema)
                    out = None
        if out:
            yield pa.RecordBatch.from_pylist([out.close()], schema=schema)
    return materialize(with_types(pages, min_bytes).mapInArrow(tx.tidy(run), "path string, records long, bytes long"), "archives")


# -- reading -----------------------------------------------------------------

def directory(f, size: int) -> Iterator[dict]:
    """Entries of the central directory: name, method, packed, size, header (offset of the local header)."""
    def at(offset, n):
        f.seek(offset)
        return f.read(n)
    tail_at = max(0, size - 65557)
    tail = at(tail_at, size - tail_at)
    i = tail.rfind(END)
    while i >= 0 and (i + 22 > len(tail) or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
        i = tail.rfind(END, 0, i)
    if i < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, i + 10)
    locator = at(tail_at + i - 20, 20) if tail_at + i >= 20 else b""
    if locator[:4] == LOCATOR64:
        end64 = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("damaged ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    central, p = at(start, length), 0
    for _ in range(n):
        if central[p:p + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", central, p + 10)[0]
        packed, plain, n_name, n_extra, n_note, disk = struct.unpack_from("<IIHHHH", central, p + 20)
        header = struct.unpack_from("<I", central, p + 42)[0]
        name = central[p + 46:p + 46 + n_name].decode()
        extra, q = central[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, m = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # 64-bit values, in this order, of the fields that are full
                wide = list(struct.unpack_from(f"<{m // 8}Q", extra, q + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            q += 4 + m
        yield {"name": name, "method": method, "packed": packed, "size": plain, "header": header}
        p += 46 + n_name + n_extra + n_note


def data_start(f, entry: dict) -> int:
    """Where the bytes of a member start, from its local header."""
    f.seek(entry["header"])
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError("damaged local header")
    return entry["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))


def _walk(f, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of every gzip member or plain record in a range."""
    while start < end:
        f.seek(start)
        if f.read(2) == b"\x1f\x8b":
            un, n = zlib.decompressobj(31), 0
            f.seek(start)
            while not un.eof:
                block = f.read(min(1 << 16, end - start - n))
                if not block:
                    raise ValueError("cut off gzip member")
                un.decompress(block)
                n += len(block) - len(un.unused_data)
        else:
            f.seek(start)
            head = b""
            while b"\r\n\r\n" not in head:
                block = f.read(4096)
                if not block:
                    raise ValueError("cut off record")
                head += block
            n = head.index(b"\r\n\r\n") + 8 + int(headers(head[:head.index(b"\r\n\r\n")])["content-length"])
        yield start, n
        start += n


def ranges(uri: str) -> list[tuple[int, int]]:
    """Byte ranges of all records of an archive, from its indexes, else by walking its stored WARC members."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        entries = [e for e in directory(f, f.size()) if e["method"] == 0]
        data = {e["name"].rpartition("/")[2]: (data_start(f, e), e["size"]) for e in entries if e["name"].endswith((".warc", ".warc.gz"))}
        out, indexed = [], False
        for e in entries:
            if e["name"].startswith("indexes/") and e["name"].endswith(".cdxj"):
                indexed = True
                start = data_start(f, e)
                f.seek(start)
                for line in f.read(e["size"]).decode().split("\n")[:-1]:
                    at = json.loads(line[line.rindex("{"):])
                    out.append((data[at["filename"]][0] + int(at["offset"]), int(at["length"])))
        if not indexed:
            out = [r for start, size in data.values() for r in _walk(f, start, start + size)]
    return out


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(blob: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to of a record."""
    raw = zlib.decompress(blob, 31) if blob[:2] == b"\x1f\x8b" else blob
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = h["warc-payload-digest"].partition(":")[2]
    revisit = h["warc-type"] == "revisit"
    if not revisit and sha1_base32(payload) != digest:
        raise ValueError("payload does not match its digest")

    def page(x):
        return int(x[len("<urn:page:"):-1]) if x.startswith("<urn:page:") else None
    return {"page_id": page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload": None if revisit else payload,
            "payload_bytes": int(headers(http)["content-length"]), "payload_digest": digest, "record_type": h["warc-type"],
            "refers_to": page(h.get("warc-refers-to", ""))}


def locate(archives: DataFrame) -> DataFrame:
    """(path, at, length) of every record of the archives (path)."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())])

    def run(it):
        for b in it:
            for p in b.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist([{"path": p, "at": a, "length": n} for a, n in ranges(p)], schema=schema)
    n = shuffle_partitions(archives.sparkSession)
    return archives.select("path").repartition(n).mapInArrow(tx.tidy(run), "path string, at long, length long")


def read_records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives (path), with the payload as bytes if asked for."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, types[kinds.get(n, "string")]) for n in names])

    def run(it):
        for b in it:
            rows, i = sorted(zip(*(b.column(c).to_pylist() for c in ("path", "at", "length")), strict=True)), 0
            while i < len(rows):  # ranges that follow each other are read at once
                path, start, end, j = rows[i][0], rows[i][1], rows[i][1] + rows[i][2], i + 1
                while j < len(rows) and rows[j][:2] == (path, end) and end - start < READ_BYTES:
                    end += rows[j][2]
                    j += 1
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    f.seek(start)
                    blob = f.read(end - start)
                yield pa.RecordBatch.from_pylist([parse(blob[a - start:a - start + n]) for _, a, n in rows[i:j]], schema=schema)
                i = j
    found = locate(archives)
    parts = shuffle_partitions(archives.sparkSession)
    return found.repartitionByRange(parts, "path", "at").sortWithinPartitions("path", "at").mapInArrow(
        tx.tidy(run), ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
