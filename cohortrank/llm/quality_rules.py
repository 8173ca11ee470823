"""Quality rules: base counts, and a learned verdict from hashed n-grams.

Base counts per text: words, code points in words, symbols, repeated lines and
words in repeated windows; a text fails them with too few words or too many
repeated ones. The verdict of the method is a logistic regression on hashed
word n-grams (one and two words) and character n-grams (``CHAR_N`` bytes), each
family as relative frequencies, so texts of any length are on one scale. It is
trained on labelled quality rows, its probability is calibrated (Platt) on rows
kept out of the fit, and texts are scored in Arrow batches against a fixed
threshold.

The fit sees at most ``max_rows`` labelled rows (by hash of the id: a fixed,
documented bound, which is what fits in one task); scoring sees every text.
With no labelled rows, or labels of one class only, the verdict is "keep".

Null and empty texts have no words and fail the base rule. Repeated rows are
counted one by one. Ids may be null. Labels join on ``doc_id``; several labels
of one id count as their least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import _text as tx
from .line_dedup import line_ranges

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
BITS, CHAR_N, MAX_ROWS, THRESHOLD = 18, 4, 4000, 0.3
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def base_counts(data: np.ndarray, off: np.ndarray, ws, we, first, words: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The base counts of every text of a chunk."""
    n_docs = len(off) - 1
    points = _sums(((data & 0xC0) != 0x80) & ~tx.SPACE[data], off)
    # lines that hold a word and equal an earlier line of the text
    s, e, doc, pos = line_ranges(data, off)
    cuts = np.flatnonzero(data == 0x0A)
    n = np.bincount(doc, minlength=n_docs)
    begin = np.empty(len(doc), np.int64)
    begin[pos == 0], begin[pos > 0] = off[:-1], cuts + 1
    end = np.empty(len(doc), np.int64)
    last = np.cumsum(n) - 1
    end[last] = off[1:]
    inner = np.ones(len(doc), bool)
    inner[last] = False
    end[inner] = cuts
    full = e > s
    h, d = tx.kinds(data, begin[full], end[full])[0], doc[full]  # codes by content
    order = np.lexsort((h, d))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    # words covered by windows that occur twice or more in the text
    start, wdoc = tx.windows(first, WINDOW)
    repeated = np.zeros(n_docs, np.int64)
    if len(start):
        wh = tx.run_hash(tx.word_hashes(data, ws, we) if words is None else words, start, start + WINDOW)
        o = np.lexsort((wh, wdoc))
        same = (wh[o][1:] == wh[o][:-1]) & (wdoc[o][1:] == wdoc[o][:-1])
        twice = np.zeros(len(start), bool)
        twice[o[1:][same]] = twice[o[:-1][same]] = True
        cover = np.zeros(len(ws) + 1, np.int64)
        np.add.at(cover, start[twice], 1)
        np.add.at(cover, start[twice] + WINDOW, -1)
        repeated = _sums(np.cumsum(cover[:-1]) > 0, first)
    return {"n_words": np.diff(first), "word_chars": points, "n_symbols": _sums(SYMBOL[data], off),
            "n_dup_lines": np.bincount(d[order][again], minlength=n_docs), "n_repeat_words": repeated}


def word_features(data: np.ndarray, ws, we, first, bits: int = BITS, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of one and two words: (feature ids, offsets per text)."""
    mask = np.uint64((1 << bits) - 1)
    words = tx.word_hashes(data, ws, we) if words is None else words
    pairs, pdoc = tx.windows(first, 2)
    ph = tx.mix(words[pairs] * np.uint64(3) + words[pairs + 1])
    # a word after itself: the feature is how often it has come in a row (up to 8), whatever the word
    same = words[pairs] == words[pairs + 1]
    idx = np.arange(len(pairs))
    run = idx - np.maximum.accumulate(np.where(same & np.append(False, (pairs[1:] == pairs[:-1] + 1) & same[:-1]), -1, idx)) if len(pairs) else idx
    ph = np.where(same, np.minimum(run + 1, 7).astype(np.uint64), ph)
    one, two = words & mask, ph & mask
    # per text: its words, then its pairs
    n1, n2 = np.diff(first), np.bincount(pdoc, minlength=len(first) - 1)
    w_off = np.concatenate(([0], np.cumsum(n1 + n2)))
    ids = np.empty(w_off[-1], np.uint32)
    ids[np.arange(len(one)) + np.repeat(w_off[:-1] - first[:-1], n1)] = one
    p_first = np.concatenate(([0], np.cumsum(n2)))
    ids[np.arange(len(two)) + np.repeat(w_off[:-1] + n1 - p_first[:-1], n2)] = two
    return ids, w_off


def char_features(data: np.ndarray, off: np.ndarray, size: int = CHAR_N, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of ``size`` (up to 4) bytes inside one text: (feature ids, offsets per text)."""
    n_c = np.maximum(np.diff(off) - size + 1, 0)
    c_off = np.concatenate(([0], np.cumsum(n_c)))
    code = np.zeros(max(len(data) - size + 1, 0), np.uint32)
    for i in range(size):
        code |= data[i:i + len(code)].astype(np.uint32) << np.uint32(8 * i)
    code = code * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
    return code[np.arange(c_off[-1]) + np.repeat(off[:-1] - c_off[:-1], n_c)], c_off


def features(data: np.ndarray, off: np.ndarray, ws, we, first, bits: int = BITS, words: np.ndarray | None = None) -> list:
    """Both families; the ids of the characters follow those of the words."""
    chars, c_off = char_features(data, off, bits=bits)
    return [word_features(data, ws, we, first, bits, words), (chars | np.uint32(1 << bits), c_off)]


def margins(weights: np.ndarray, fams) -> np.ndarray:
    """Sum over the families of the mean weight of the text's n-grams."""
    out = np.zeros(len(fams[0][1]) - 1)
    for ids, off in fams:
        out += _means(weights[ids], off)
    return out


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of every stretch of ``x``; it depends on the stretch alone, not on its neighbours."""
    out = np.zeros(len(off) - 1)
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, off[:-1][some], dtype=np.float64)
    return out


def _means(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    return sums(x, off) / np.maximum(np.diff(off), 1)


@dataclass
class Model:
    """Weights of the hashed n-grams and the calibration of their margin."""

    weights: np.ndarray
    scale: float
    shift: float

    def probability(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * m + self.shift, -30, 30)))


def platt(m: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Scale and shift of a logistic curve through margins and smoothed labels (Newton steps)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = max(float(np.std(m)), 1e-12)
    x = np.stack([m / unit, np.ones_like(m)], 1)
    b = np.array([1.0, float(np.log((n1 + 1) / (n0 + 1)))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-6 * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / unit), float(b[1])


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, epochs: int = 20, rate: float = 2.0, l2: float = 1e-6) -> Model:
    """Fit on four fifths of the rows (AdaGrad on the class-balanced log loss), calibrate on the last fifth."""
    col = pa.array(texts, pa.large_string())
    parts = []
    for a, n, data, off in tx.string_chunks(col):
        ws, we, first = tx.tokens(data, off)
        parts.append((np.arange(a, a + n), features(data, off, ws, we, first, bits)))
    y = np.asarray(labels, float)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    share = np.where(y > 0, 0.5 / max(1, ((y > 0) & ~held).sum()), 0.5 / max(1, ((y == 0) & ~held).sum())) * ~held * max(1, (~held).sum())
    w, g2 = np.zeros(2 << bits), np.full(2 << bits, 1e-8)
    shift = 0.0
    for _ in range(epochs):
        for rows, fams in parts:
            m = margins(w, fams) + shift
            err = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[rows]) * share[rows]
            g = np.zeros_like(w)
            for ids, off in fams:
                n = np.diff(off)
                g += np.bincount(ids, np.repeat(err / np.maximum(n, 1), n), len(w))
            hit = g != 0
            g2[hit] += g[hit] ** 2
            w[hit] -= rate * (g[hit] / np.sqrt(g2[hit]) + l2 * w[hit])
            shift -= 0.01 * err.mean()
    m = np.concatenate([margins(w, f) for _, f in parts])
    use = held if held.any() else np.ones(len(y), bool)
    scale, add = platt(m[use], y[use])
    return Model(w.astype(np.float32), scale, add)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "quality") -> DataFrame:
    """At most ``max_rows`` labelled (doc_id, text, y), chosen and ordered by a hash of the id.

    Rows with ``crc32(doc_id as text) mod 5 = 0`` are never learned from. Of several
    texts of one id, the least by hash is taken.
    """
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    own = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    chosen = own.filter(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(
        F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("doc_id", "least.text", "y")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Model | None:
    """The model of the labelled rows; None if both classes aren't there."""
    rows = training_rows(docs, labels, max_rows).withColumn("o", F.xxhash64("doc_id"))

    def run(it):
        t = pa.Table.from_batches(list(it)).sort_by([("o", "ascending"), ("doc_id", "ascending")])
        y = t.column("y").to_numpy()
        if len(set(y.tolist())) == 2:
            m = fit([x or "" for x in t.column("text").to_pylist()], y, **options)
            yield pa.RecordBatch.from_pylist([{"w": m.weights.tobytes(), "a": m.scale, "b": m.shift}])
    got = rows.select("o", "doc_id", F.col("y").cast("int"), "text").repartition(1).mapInArrow(tx.tidy(run), "w binary, a double, b double").collect()
    return Model(np.frombuffer(got[0]["w"], np.float32), got[0]["a"], got[0]["b"]) if got else None


def _verdicts(texts: pa.Array, m: Model | None, threshold: float):
    """(first row, rows, counts and verdicts) of the chunks of a column."""
    for a, n, data, off in tx.string_chunks(texts):
        ws, we, first = tx.tokens(data, off)
        words = tx.word_hashes(data, ws, we)
        out = base_counts(data, off, ws, we, first, words)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
        p = np.ones(n) if m is None else m.probability(margins(m.weights, features(data, off, ws, we, first, words=words)))
        out["kept"] = ~out["base_failed"] & (p >= threshold)
        out["probability"] = pa.array(p, mask=(out["n_words"] == 0) | (m is None))
        yield a, n, out


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, probability (null without a model or words) and kept."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 MB, fixed by BITS
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    schema = pa.schema([(n, pa.bool_() if n in ("base_failed", "kept") else pa.float64() if n == "probability" else pa.int64()) for n in names])

    def run(it):
        for b in it:
            for a, n, out in _verdicts(b.column("text"), shared.value, threshold):
                yield tx.batches(out | {"doc_id": b.column("doc_id").slice(a, n)}, schema)
    ddl = ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'double' if n == 'probability' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tx.tidy(run), ddl)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text is kept. Only texts go to Python, and one boolean each comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def verdict(text: pa.Array) -> pa.Array:
        got = [out["kept"] for _, _, out in _verdicts(text, shared.value, threshold)]
        tx.trim()
        return pa.array(np.concatenate(got) if got else np.zeros(0, bool))
    return docs.filter(F.arrow_udf(verdict, BooleanType())(F.col("text")))
