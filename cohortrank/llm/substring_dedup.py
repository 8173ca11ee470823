"""Substring dedup: windows of words that also start elsewhere, by super-k-mers.

Every window of ``size`` consecutive words has a minimiser, the least hash among
its runs of ``seed_words`` words (leftmost on ties). Consecutive windows with the
same minimiser position form a super-k-mer: it holds one occurrence of its
minimiser and so at most ``2 * size - seed_words`` words. Equal windows have
equal minimisers, so a window can repeat only where the minimiser's hash does.

1. ``super_refs``: (minimiser hash, hash of the words, row key, first window,
   windows), numbers only. Minimisers seen once are dropped (a count, combined
   before the shuffle).
2. Super-k-mers equal in both 64-bit hashes are one kind with a count, so a
   passage copied a million times is one row. If a minimiser has one kind only,
   all windows of that kind repeat.
3. Where a minimiser has several kinds, each travels as one packed string (its
   words joined by one space) to the bucket of the minimiser. There the windows
   are cut out of the strings and sorted; a window is repeated if its counts add
   up to two or more. Strings are compared, not hashes. A bucket of more than
   ``hot`` kinds is dealt out window by window instead (an aggregate on the
   window text, combined before the shuffle, and a join that Spark may split),
   with the same result.
4. The repeated windows return to their rows as (first window, bit mask).

Rows are told apart by ``doc_id`` and a hash of the text; rows equal in both
are separate occurrences with equal results. Null and empty texts have no
words; texts shorter than ``size`` words have no window and stay whole; a null
``doc_id`` is an id like any other. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._steps import step

SIZE, SEED_WORDS, HOT = 35, 8, 1000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_d"),
                       F.xxhash64("text").alias("_k"), "text")


def _supers(words: np.ndarray, first: np.ndarray, size: int, seed_words: int):
    """Super-k-mers of a chunk: (text, first window in the text, windows, minimiser hash, hash of the words)."""
    seeds = len(words) - seed_words + 1
    start, doc = tx.windows(first, size)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    at = np.arange(seeds)
    h = tx.run_hash(words, at, at + seed_words)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span, width = size - seed_words + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    f = np.flatnonzero(fresh)
    n = np.diff(np.append(f, len(start)))
    return doc[f], start[f] - first[:-1][doc[f]], n, h[place[f]], tx.run_hash(words, start[f], start[f] + n + size - 1, 1)


def super_refs(docs: DataFrame, size: int = SIZE, seed_words: int = SEED_WORDS) -> DataFrame:
    """(key, pid, _d, _k, start, n) per super-k-mer of ``docs`` (columns _d, _k, text)."""
    schema = pa.schema([("key", pa.int64()), ("pid", pa.int64()), ("_d", pa.int64()), ("_k", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(it):
        for b in it:
            d, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, _, data, off in tx.string_chunks(b.column(2)):
                ws, we, first = tx.tokens(data, off)
                if len(ws) >= size:
                    doc, start, n, key, pid = _supers(tx.word_hashes(data, ws, we), first, size, seed_words)
                    yield tx.batches({"key": key.view(np.int64), "pid": pid.view(np.int64), "_d": d[a + doc], "_k": k[a + doc], "start": start, "n": n}, schema)
    return docs.select("_d", "_k", "text").mapInArrow(tx.tidy(run), "key long, pid long, _d long, _k long, start int, n int")


def _bucket_rows(rows, size: int) -> dict[int, int]:
    """Strings of one bucket -> {index: mask of the windows counted twice or more}.

    ``rows`` has (index, string, count). Windows are (string, index, bit), sorted.
    """
    if sum(c for _, _, c in rows) < 2:
        return {}
    found = []
    for i, text, count in rows:
        w = text.split(b" ")
        found += [(b" ".join(w[j:j + size]), i, j, count) for j in range(len(w) - size + 1)]
    found.sort()
    masks: dict[int, int] = {}
    a = 0
    while a < len(found):
        b, total = a, 0
        while b < len(found) and found[b][0] == found[a][0]:
            total += found[b][3]
            b += 1
        if total > 1:
            for _, i, j, _ in found[a:b]:
                masks[i] = masks.get(i, 0) | 1 << j
        a = b
    return masks


def repeated_windows(docs: DataFrame, size: int = SIZE, seed_words: int = SEED_WORDS, hot: int = HOT) -> DataFrame:
    """(_d, _k, start, mask): bit j set means that window start + j of the row also starts elsewhere."""
    if not 0 < seed_words <= size or size - seed_words >= 62:
        raise ValueError("seed_words must lie in 1..size, and size - seed_words below 62 (masks are longs)")
    refs = super_refs(docs, size, seed_words)
    twice = step(refs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "keys")
    refs = step(refs.join(twice, "key", "left_semi"), "supers")
    kinds = step(refs.groupBy("key", "pid").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_d", "_k", "start", "n")).alias("at")), "kinds")
    contested = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    open_ = kinds.join(contested, "key").select("at._d", "at._k", F.struct("at.start", "at.n", "key", "pid", "c", "kinds").alias("ref"))
    lists = open_.groupBy("_d", "_k").agg(F.collect_list("ref").alias("refs"))

    def pack(it):
        schema = pa.schema([("key", pa.int64()), ("pid", pa.int64()), ("c", pa.int64()), ("kinds", pa.int64()), ("packed", pa.binary())])
        for b in it:
            out: dict[str, list] = {n: [] for n in schema.names}
            for text, refs_ in zip(b.column("text").to_pylist(), b.column("refs").to_pylist(), strict=True):
                w = text.encode().split()
                for r in refs_:
                    for n in ("key", "pid", "c", "kinds"):
                        out[n].append(r[n])
                    out["packed"].append(b" ".join(w[r["start"]:r["start"] + r["n"] + size - 1]))
            yield tx.batches(out, schema)
    # rows equal in id and text would each bring the string; one is enough, the count has them all
    packed = step(docs.join(lists, ["_d", "_k"]).select("text", "refs").mapInArrow(
        tx.tidy(pack), "key long, pid long, c long, kinds long, packed binary"), "packed")

    def count(it):
        schema = pa.schema([("key", pa.int64()), ("pid", pa.int64()), ("mask", pa.int64())])
        key, rows = None, []
        out: dict[str, list] = {"key": [], "pid": [], "mask": []}

        def close():
            for i, mask in _bucket_rows([(i, t, c) for i, (_, t, c) in enumerate(rows)], size).items():
                for name, v in (("key", key), ("pid", rows[i][0]), ("mask", mask)):
                    out[name].append(v)
        for b in it:
            for k, p, t, c in zip(*(b.column(c).to_pylist() for c in ("key", "pid", "packed", "c")), strict=True):
                if k != key:
                    close()
                    key, rows = k, []
                if not rows or rows[-1][0] != p:
                    rows.append((p, t, c))
            yield tx.batches(out, schema)
            for v in out.values():
                v.clear()
        close()
        yield tx.batches(out, schema)
    once = ["key", "pid"]
    plain = packed.filter(F.col("kinds") <= hot).repartition("key").sortWithinPartitions("key", "pid").select(
        "key", "pid", "packed", "c").mapInArrow(tx.tidy(count), "key long, pid long, mask long")
    words = F.split(F.decode("packed", "UTF-8"), " ")
    each = packed.filter(F.col("kinds") > hot).dropDuplicates(once).select("key", "pid", "c", words.alias("w")).select(
        "key", "pid", "c", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("j", "window"))
    many = each.groupBy("key", "window").agg(F.sum("c").alias("total")).filter("total > 1").select("key", "window")
    dealt = each.join(many, ["key", "window"], "left_semi").groupBy(*once).agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    alone = kinds.filter("c > 1").join(contested, "key", "left_anti").select("key", "pid", F.expr("shiftleft(1L, at.n) - 1").alias("mask"))
    masks = plain.unionByName(dealt).unionByName(alone)
    return step(refs.select("_d", "_k", "start", *once).join(masks, once).select("_d", "_k", "start", "mask"), "repeats")


def remove_repeats(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each text without the words of repeated windows.

    Kept words are joined by one space. Windows are judged on the input.
    """
    keyed = _keyed(docs)
    spans = step(repeated_windows(keyed, size, **options).groupBy("_d", "_k").agg(F.collect_set(F.struct("start", "mask")).alias("spans")), "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(it):
        for b in it:
            out: dict[str, list] = {"doc_id": b.column("doc_id"), "n_words": [], "n_removed": [], "kept_text": []}
            for text, spans_ in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept = words
                if spans_:
                    change = np.zeros(len(words) + 1, np.int64)
                    for s in spans_:
                        at = s["start"] + np.flatnonzero([s["mask"] >> j & 1 for j in range(s["mask"].bit_length())])
                        change[at] += 1
                        change[at + size] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode())
            yield tx.batches(out, schema)
    return keyed.join(spans, ["_d", "_k"], "left").select("doc_id", "text", "spans").mapInArrow(
        tx.tidy(run), "doc_id long, n_words long, n_removed long, kept_text string")
