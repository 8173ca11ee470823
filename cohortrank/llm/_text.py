"""Words, windows and hashes of Arrow string batches, vectorised with numpy.

A batch is cut into chunks of about a MB of whole texts. All texts of a chunk lie
in one byte buffer; words and lines are byte ranges of it. Ranges of bytes are
hashed by content with BLAKE2b, once per different range of a chunk (Arrow's
dictionary tells them apart by content). Runs of words are hashed from the words'
hashes by doubling: a non-linear join of two halves, then of four, and so on, so
no rule of the text (alternating or reversed blocks, say) makes two runs equal.
Memory is about 60 bytes per byte of the chunk, so it is bounded by the longest
single text.

Words are ``[^\\x20\\x09-\\x0D]+``; only these six ASCII bytes separate.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective bit mixer on uint64 (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence (a, b) from the hashes of its halves; not linear, not symmetric."""
    return mix(a * U64(BASES[0]) + b * U64(BASES[1]))


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` (hashes themselves) for every run; equal contents, equal hashes.

    A run of n values is covered by two runs of the largest power of two up to n,
    one from its start and one to its end; those are hashed by doubling.
    """
    out = np.zeros(len(start), U64)
    n = (end - start).astype(np.int64)
    level = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    t, width = mix(values.astype(U64) + U64(BASES[seed])), 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero((level == k) & (n > 0))
        if len(at):
            out[at] = join(t[start[at]], t[end[at] - width]) + n[at].astype(U64) * U64(BASES[2])
        t = join(t[:-width], t[width:])
        width *= 2
    return mix(out ^ U64(BASES[(seed + 1) % 3]))


def kinds(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Byte ranges by content: (code of each range, the content of each code)."""
    n = (end - start).astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(n)))
    own = data[np.arange(cuts[-1]) + np.repeat(start - cuts[:-1], n)]
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(own)]).dictionary_encode()
    return parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.dictionary


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit BLAKE2b digest of every byte range."""
    code, content = kinds(data, start, end)
    blake = hashlib.blake2b
    each = np.frombuffer(b"".join([blake(x, digest_size=16).digest() for x in content.to_pylist()]), "<u8").reshape(-1, 2)
    return each[code, 0], each[code, 1]


#: One for each length of short words. They differ in their highest bytes, and from the last in a way that no UTF-8 text has there.
_SHORT = np.array([(0x9E3779B97F4A7C15 * (i + 1) & 0x00FFFFFFFFFFFFFF) | (0xF8 + i if i < 8 else 0x07) << 56 for i in range(9)], U64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word (byte range): words of up to 8 bytes one to one, longer ones by BLAKE2b."""
    n = end - start
    out = np.zeros(len(n), U64)
    short = n <= 8
    at = np.flatnonzero(short)
    if len(at):
        # eight bytes from each start, of which the word's own stay
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)[start[at]]
        own = np.ascontiguousarray(eight).view("<u8")[:, 0]
        keep = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)[n[at]]
        out[at] = mix((own & keep) ^ _SHORT[n[at]])
    at = np.flatnonzero(~short)
    if len(at):
        out[at] = digests(data, start[at], end[at])[0]
    return out


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def trim() -> None:
    """Give free memory of this process back; idle Python workers stay beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow; memory is given back at the end of the task."""
    @functools.wraps(run)
    def inner(batches_):
        try:
            yield from run(batches_)
        finally:
            trim()
    return inner


def string_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into chunks: (first row, rows, bytes, offsets of length rows + 1).

    Null texts have no bytes. A text longer than the chunk size is a chunk alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, ob, db = column.buffers()
    off = np.frombuffer(ob, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(off, off[a] + CHUNK_BYTES, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b - a, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def tokens(data: np.ndarray, off: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words: (start, end, first word of every text plus the total)."""
    word = ~blank[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = word[ends]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    return ws, we, np.searchsorted(ws, off)


def owner(first: np.ndarray) -> np.ndarray:
    """Index of the text that owns each word, from ``first`` of ``tokens``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``size`` words inside one text, and the text of each."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    return np.arange(int(n.sum())) - begin[doc] + first[:-1][doc], doc


def batches(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of ``schema`` from a dict of lists or numpy arrays."""
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
