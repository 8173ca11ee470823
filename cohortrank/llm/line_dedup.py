"""Line dedup: repeated lines, found on range-partitioned hashes, as keep bitmaps.

A text is split at ``\\n`` (null or empty: one empty line). A line's key is the
line without blanks ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case; keys
shorter than ``min_chars`` code points are never dropped.

1. Every text gives a row per different key: (128-bit hash, row, positions),
   already reduced to one row per text, however often it repeats the line.
2. Rows are range-partitioned and sorted by (hash, row), so a line that a third
   of all texts share spreads over several tasks. The sorted rows are written.
3. A first pass over them counts the texts of each hash; only the first and the
   last hash of a task can go on in its neighbours, so two rows per task
   (bounded by the number of tasks, not by the data) settle the edges.
4. A second pass streams the sorted rows and gives out the dropped positions:
   of hashes in at least ``min_docs`` texts, all lines (``keep="none"``) or all
   but the first in (row, position) order (``keep="first"``).
5. Per text they become a compressed keep bitmap, (row, bitmap); text is read
   again only where bitmaps are applied.

Rows are told apart by ``doc_id`` and a hash of the text. Rows equal in both
count as separate texts; under ``keep="first"`` a bitmap then leaves the line in
each of them. Null texts and null ids are ordinary; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from . import _text as tx

MIN_DOCS, MIN_CHARS = 10, 1


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """The row key (_d, _k), doc_id, text and ``more`` of ``docs``."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_d"),
                       F.xxhash64("text").alias("_k"), "doc_id", "text", *more)


def line_ranges(data: np.ndarray, off: np.ndarray):
    """Stripped byte range, text and position of every line of a chunk."""
    cuts = np.flatnonzero(data == 0x0A)
    text_of_cut = np.searchsorted(off, cuts, side="right") - 1
    n = np.bincount(text_of_cut, minlength=len(off) - 1) + 1
    doc = np.repeat(np.arange(len(off) - 1), n)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = np.empty(len(doc), np.int64)
    start[pos == 0] = off[:-1]
    start[pos > 0] = cuts + 1
    end = np.empty(len(doc), np.int64)
    last = np.append(pos[1:] == 0, True)
    end[last] = off[1:]
    end[~last] = cuts
    solid = np.flatnonzero(~tx.SPACE[data])
    if len(solid):
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
        full = b >= a
        s = np.where(full, solid[np.minimum(a, len(solid) - 1)], start)
        e = np.where(full, solid[np.maximum(b, 0)] + 1, s)
    else:
        s = e = start
    return s, e, doc, pos


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, _d, _k, pos[]) per different key of each text."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("_d", pa.int64()), ("_k", pa.int64()), ("pos", pa.list_(pa.int32()))])

    def run(it):
        for b in it:
            d, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, _, data, off in tx.string_chunks(b.column(2)):
                low = tx.LOWER[data]
                s, e, doc, pos = line_ranges(low, off)
                points = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80)))
                use = points[e] - points[s] >= max(min_chars, 0)
                s, e, doc, pos = s[use], e[use], doc[use], pos[use]
                if not len(s):
                    continue
                h1, h2 = tx.digests(low, s, e)
                order = np.lexsort((pos, h2, h1, doc))
                h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
                fresh = np.ones(len(h1), bool)
                fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])
                f = np.flatnonzero(fresh)
                lists = pa.ListArray.from_arrays(pa.array(np.append(f, len(h1)), pa.int32()), pa.array(pos, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(h1[f].view(np.int64)), pa.array(h2[f].view(np.int64)), pa.array(d[a + doc[f]]),
                                                  pa.array(k[a + doc[f]]), lists], schema=schema)
    return rows.select("_d", "_k", "text").mapInArrow(tx.tidy(run), "h1 long, h2 long, _d long, _k long, pos array<int>")


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    f = np.ones(len(h1), bool)
    f[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return np.flatnonzero(f)


def _edges(ordered: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{hash: (texts, row key of the first text)} for the first and last hash of every sorted part."""
    schema = pa.schema([(x, pa.int64()) for x in ("part", "which", "h1", "h2", "n", "d", "k")])

    def run(it):
        first = last = None
        for b in it:
            h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
            if not len(h1):
                continue
            f = _runs(h1, h2)
            n = np.diff(np.append(f, len(h1)))
            for i in dict.fromkeys((0, len(f) - 1)):
                at = int(f[i])
                if last is not None and (last["h1"], last["h2"]) == (h1[at], h2[at]):
                    last["n"] += int(n[i])
                else:
                    last = {"part": b.column("part")[0].as_py(), "h1": int(h1[at]), "h2": int(h2[at]), "n": int(n[i]),
                            "d": b.column("_d")[at].as_py(), "k": b.column("_k")[at].as_py()}
                    first = first or last
        if last is not None:
            ends = [first] if last is first else [first, last]
            yield pa.RecordBatch.from_pylist([e | {"which": w} for w, e in enumerate(ends)], schema=schema)
    got = ordered.select("part", "h1", "h2", "_d", "_k").mapInArrow(tx.tidy(run), ", ".join(f"{x} long" for x in schema.names)).collect()
    out: dict = {}
    for r in sorted(tuple(x) for x in got):
        n, d, k = out.get(r[2:4], (0, r[5], r[6]))
        out[r[2:4]] = (n + r[4], d, k)
    return out


def dropped_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """(_d, _k, pos[]): positions of the dropped lines, a row per text and repeated key. ``rows``: from ``keyed``."""
    if keep not in ("none", "first") or min_docs < 1:
        raise ValueError("keep must be 'none' or 'first', min_docs at least 1")
    order = ["h1", "h2", "_d", "_k"]
    ordered = _keys(rows, min_chars).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id().cast("long")).checkpoint()  # parts and their order stay as they are
    edges = _edges(ordered)
    whole = keep == "none"

    def run(it):
        held, seen, key, head = None, 0, None, None  # rows of the open run, texts already given out of it, its hash and first row key

        def give(t, ends):
            """Rows to drop of ``t``; ``ends``: no more rows follow. What stays open goes to ``held``."""
            nonlocal held, seen, key, head
            h1, h2, d, k = (t.column(c).to_numpy() for c in order)
            f = _runs(h1, h2)
            n = np.diff(np.append(f, len(h1)))
            total, first_d, first_k = n.copy(), d[f].copy(), k[f].copy()
            if key == (h1[0], h2[0]):
                total[0] += seen
                first_d[0], first_k[0] = head
            key, head = (h1[-1], h2[-1]), (first_d[-1], first_k[-1])
            for i in dict.fromkeys((0, len(f) - 1)):
                if (e := edges.get((int(h1[f[i]]), int(h2[f[i]])))) is not None:
                    total[i], first_d[i], first_k[i] = e
            drop = total >= min_docs
            open_ = not ends and not drop[-1]
            held = t.slice(int(f[-1])) if open_ else None
            seen = 0 if open_ else int(total[-1])
            at = np.flatnonzero(np.repeat(drop, n))
            run_of = np.repeat(np.arange(len(f)), n)[at]
            lead = (d[at] == first_d[run_of]) & (k[at] == first_k[run_of])
            out = t.select(["_d", "_k", "pos"]).take(pa.array(at))
            if whole or not lead.any():
                return out
            lists = [p[1:] if x else p for p, x in zip(out.column("pos").to_pylist(), lead, strict=True)]
            return pa.table({"_d": out.column("_d"), "_k": out.column("_k"), "pos": pa.array(lists, pa.list_(pa.int32()))})
        for b in it:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if len(t):
                yield from give(t, False).to_batches()
        if held is not None:
            yield from give(held, True).to_batches()
    return ordered.select(*order, "pos").mapInArrow(tx.tidy(run), "_d long, _k long, pos array<int>")


def keep_bitmaps(rows: DataFrame, **options) -> DataFrame:
    """(_d, _k, n_dropped, bitmap) of the texts that lose lines.

    The bitmap is zlib-compressed, a bit per line up to the last dropped one
    (1: keep); later lines are kept.
    """
    lists = dropped_lines(rows, **options).groupBy("_d", "_k").agg(F.array_distinct(F.flatten(F.collect_set("pos"))).alias("pos")).filter(F.size("pos") > 0)

    def run(it):
        schema = pa.schema([("_d", pa.int64()), ("_k", pa.int64()), ("n_dropped", pa.int64()), ("bitmap", pa.binary())])
        for b in it:
            maps, n = [], []
            for p in b.column("pos").to_pylist():
                keep = np.ones((max(p) // 8 + 1) * 8, bool)
                keep[p] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
                n.append(len(p))
            yield tx.batches({"_d": b.column("_d"), "_k": b.column("_k"), "n_dropped": n, "bitmap": maps}, schema)
    return lists.mapInArrow(tx.tidy(run), "_d long, _k long, n_dropped long, bitmap binary")


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, str]:
    """Lines of the text before dropping, and the text of the lines that stay."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return len(lines), "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: every text without its repeated lines."""
    rows = keyed(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])

    def run(it):
        for b in it:
            got = [kept_text(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("bitmap").to_pylist(), strict=True)]
            yield tx.batches({"doc_id": b.column("doc_id"), "n_lines": [g[0] for g in got],
                              "n_dropped": b.column("n_dropped").fill_null(0), "kept_text": [g[1] for g in got]}, schema)
    return rows.join(keep_bitmaps(rows, **options), ["_d", "_k"], "left").select(
        F.col("doc_id").cast("long"), "text", "n_dropped", "bitmap").mapInArrow(tx.tidy(run), "doc_id long, n_lines long, n_dropped long, kept_text string")


def drop_lines(docs: DataFrame, drop_emptied: bool = False, **options) -> DataFrame:
    """``docs``, all columns, with the shortened texts (and their ``n_chars``, if there is such a column).

    ``drop_emptied`` leaves out rows that lost all their words.
    """
    from pyspark.sql.types import StringType
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = keyed(docs.select(own, "doc_id", "text"), "row")
    bitmaps = keep_bitmaps(rows, **options).select("_d", "_k", "bitmap")

    @F.pandas_udf(StringType())
    def shorten(text, bitmap):
        out = text.combine(bitmap, lambda t, b: kept_text(t, b)[1])
        tx.trim()
        return out
    # the text travels once, inside the row
    cut = rows.select("_d", "_k", "row").join(bitmaps, ["_d", "_k"], "left").select("row", "bitmap", F.col("row.text").alias("t"))
    cut = cut.select("row", F.when(F.col("bitmap").isNull(), F.col("t")).otherwise(shorten("t", "bitmap")).alias("text"), F.col("bitmap").isNotNull().alias("new"))
    if drop_emptied:
        cut = cut.filter(~F.col("new") | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    fields = {"text": F.col("text"), "n_chars": F.when(F.col("new"), F.length("text")).otherwise(F.col("row.n_chars"))
              .cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return cut.select(*(fields[c].alias(c) if c in fields else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
