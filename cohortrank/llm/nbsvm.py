"""Quality classifier: naive Bayes support vectors.

A text is the set of its hashed n-grams (one and two words, ``CHAR_N`` bytes).
Each indicator is scaled by the log-count ratio of its n-gram between the two
classes, the vector is brought to length one, and a linear hinge-loss model is
fitted by dual coordinate descent (one dual variable per row, boxed by a class-
balanced cost). The margin becomes a probability by a logistic curve fitted on
rows that the descent has not seen.

The fit sees at most ``max_rows`` labelled rows, chosen by a hash of the id (a
fixed, documented bound); scoring sees every text whole. Rows with
``crc32(doc_id as text) mod 5 = 0`` are never learned from. Label, language,
source and id are never part of a vector.

Null and empty texts have no n-gram; their score is that of margin 0. Without
labels of both classes every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from .quality_rules import BITS, char_features, platt, sums, training_rows, word_features

MAX_ROWS, THRESHOLD, COST, EPOCHS = 4000, 0.3, 10.0, 12
CHAR_N, CHAR_BITS = 3, 16


def indicators(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Different n-gram ids of every text of a chunk, ascending, and their offsets.

    Words are made distinct by sorting; characters, which have ``1 << CHAR_BITS``
    ids only, by marking a bit map of some texts at a time.
    """
    n, shift = len(off) - 1, np.uint64(40)
    ids, o = word_features(data, *tx.tokens(data, off), bits)
    keys = [np.unique(ids.astype(np.uint64) | (np.repeat(np.arange(n, dtype=np.uint64), np.diff(o)) << shift))]
    chars, o = char_features(data, off, CHAR_N, CHAR_BITS)
    doc = np.repeat(np.arange(n), np.diff(o))
    for a in range(0, n, 64):
        b = min(n, a + 64)
        seen = np.zeros((b - a) << CHAR_BITS, bool)
        seen[(doc[o[a]:o[b]] - a) << CHAR_BITS | chars[o[a]:o[b]]] = True
        hit = np.flatnonzero(seen).astype(np.uint64)
        keys.append(((hit >> np.uint64(CHAR_BITS)) + np.uint64(a)) << shift | (hit & np.uint64((1 << CHAR_BITS) - 1)) | np.uint64(1 << bits))
    keys = np.sort(np.concatenate(keys), kind="stable")
    return (keys & np.uint64((2 << bits) - 1)).astype(np.int64), np.searchsorted(keys >> shift, np.arange(n + 1, dtype=np.uint64))


def log_count_ratio(ids: np.ndarray, off: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """log of the smoothed share of each n-gram in class 1 over that in class 0."""
    per = np.repeat(y > 0, np.diff(off))
    p = 1.0 + np.bincount(ids[per], minlength=size)
    q = 1.0 + np.bincount(ids[~per], minlength=size)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(ids: np.ndarray, off: np.ndarray, value: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int,
                 epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum cost_i max(0, 1 - y_i w.x_i), y in {-1, 1}; the last weight is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    spans = [(ids[a:b], value[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    square = np.array([float(v @ v) + 1.0 for _, v in spans])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = spans[i]
            slope = y[i] * (float(w[at] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * v
                w[-1] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


@dataclass
class Model:
    """ratio: log-count ratios; weights: of the scaled indicators, the bias last; then the logistic curve."""

    ratio: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float

    def margins(self, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        r = self.ratio[ids]
        dot, square = sums(r * self.weights[ids], off), sums(r.astype(np.float64) ** 2, off)
        return dot / np.sqrt(np.maximum(square, 1e-12)) + float(self.weights[-1])

    def probability(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * m + self.shift, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, bits: int = BITS, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """Ratios and descent on four fifths of the rows, the logistic curve on the last fifth."""
    ids, counts = [], []
    for _, _, data, off in tx.string_chunks(pa.array(texts, pa.large_string())):
        i, o = indicators(data, off, bits)
        ids.append(i.astype(np.int32))
        counts.append(np.diff(o))
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    off = np.concatenate(([0], np.cumsum(counts)))
    y, size = np.asarray(labels) > 0, 2 << bits
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    use = np.repeat(~held, counts)
    t_ids, t_off, t_y = ids[use], np.concatenate(([0], np.cumsum(counts[~held]))), y[~held]
    ratio = log_count_ratio(t_ids, t_off, t_y, size)
    value = ratio[t_ids]
    norm = np.sqrt(np.maximum(np.add.reduceat(np.append(value ** 2, 0.0), t_off[:-1]) * (np.diff(t_off) > 0), 1e-12))
    value /= np.repeat(norm, np.diff(t_off))
    each = cost * len(t_y) / (2 * np.where(t_y, max(1, t_y.sum()), max(1, (~t_y).sum())))
    w = dual_descent(t_ids, t_off, value, np.where(t_y, 1.0, -1.0), each, size, epochs)
    model = Model(ratio.astype(np.float32), w.astype(np.float32), 1.0, 0.0)
    part = held if held.any() else np.ones(len(y), bool)
    p_ids, p_off = ids[np.repeat(part, counts)], np.concatenate(([0], np.cumsum(counts[part])))
    model.scale, model.shift = platt(model.margins(p_ids, p_off), y[part].astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Model | None:
    """The model of the labelled rows, fitted in one task; None if both classes aren't there."""
    rows = training_rows(docs, labels, max_rows).withColumn("o", F.xxhash64("doc_id"))

    def run(it):
        t = pa.Table.from_batches(list(it)).sort_by([("o", "ascending"), ("doc_id", "ascending")])
        y = t.column("y").to_numpy()
        if len(set(y.tolist())) == 2:
            m = fit([x or "" for x in t.column("text").to_pylist()], y, **options)
            yield pa.RecordBatch.from_pylist([{"r": m.ratio.tobytes(), "w": m.weights.tobytes(), "a": m.scale, "b": m.shift}])
    got = rows.select("o", "doc_id", F.col("y").cast("int"), "text").repartition(1).mapInArrow(tx.tidy(run), "r binary, w binary, a double, b double").collect()
    return Model(*(np.frombuffer(got[0][c], np.float32) for c in "rw"), got[0]["a"], got[0]["b"]) if got else None


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every text, in Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, fixed by BITS
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it):
        m = shared.value
        for b in it:
            for a, n, data, off in tx.string_chunks(b.column("text")):
                p = np.full(n, 0.5) if m is None else m.probability(m.margins(*indicators(data, off)))
                yield tx.batches({"doc_id": b.column("doc_id").slice(a, n), "score": p}, schema)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tx.tidy(run), "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
