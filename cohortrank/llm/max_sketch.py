"""Ranked lexical search: hashed max-sketches bound every score, exact scores follow in descending order of the bound.

Terms are the maximal runs of ASCII letters and digits and of non-ASCII characters, only
A-Z lower-cased. A term's weight falls with the number of documents that hold it, its
impact in a document grows with its occurrences and falls with the document's length;
a document's score is the sum of weight times impact over the query's different terms,
all in integers (``weight``, ``impacts``).

1. ``corpus_counts``: one pass over the texts counts documents with terms, all terms,
   and the documents of each term of the queries; counts leave a task, not terms.
2. ``search``: a second pass. The impacts of a document fold into a sketch of
   coordinates, a power of two at least ``SPARE`` times its different terms: a term falls
   on the coordinate of its hash, a coordinate keeps the greatest impact. A batch of
   queries is looked up in the sketches of a block of documents at once: the sum of
   weight times the coordinate of each query term is never below the score.
3. Documents of the block are scored exactly in descending order of the bound, until
   the bound falls below the query's k-th best so far (or equals it, for a document
   that would lose the tie). A task gives its k best documents of each query.
4. The k best of all tasks: first by slices of tasks, then over the slices.

Sketches never leave the task, so their width costs no shuffle, and texts are read
whole. Queries are handled in batches of about ``BATCH_TERMS`` terms, each with two
passes, so what is sent to the tasks is bounded whatever the number of queries.

Null and empty texts have no terms: they count for nothing and are found by nothing;
queries without terms find nothing. Repeated documents are documents of their own.
Null document ids come last among equal scores. Queries equal in id and text are one;
of different queries with one id each gives its own ranks. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._steps import step

TOP, BATCH_TERMS, SPARE, LEAST_WIDTH, MOST_WIDTH = 10, 8192, 8, 64, 1 << 16
BLOCK_CELLS, STEP, SLICES = 1 << 21, 32, 64
_LAST = (1 << 63) - 1  # stands for a null id
BLANK = np.zeros(256, bool)
BLANK[:128] = [not chr(b).isalnum() for b in range(128)]


def terms_of(text: str | None) -> list[bytes]:
    """The different terms of a text, sorted."""
    low = tx.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = tx.tokens(low, np.array([0, len(low)]), BLANK)
    return sorted({low[s:e].tobytes() for s, e in zip(start, end, strict=True)})


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times among the ``length`` terms of a document."""
    m = 100 - 90 + 90 * length * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Counted:
    """Terms of a chunk: terms per document, and (document, code, occurrences) of its different terms."""

    length: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    content: list[bytes]


def count_terms(data: np.ndarray, off: np.ndarray) -> Counted:
    low = tx.LOWER[data]
    start, end, first = tx.tokens(low, off, BLANK)
    code, content = tx.kinds(low, start, end)
    size = max(len(content), 1)
    pair, tf = np.unique(tx.owner(first) * size + code, return_counts=True)
    return Counted(np.diff(first), pair // size, pair % size, tf, content.to_pylist())


@dataclass
class Batch:
    """A batch of queries: their numbers, the vocabulary, and all (query, term) pairs, by query."""

    queries: list[int]
    vocabulary: dict[bytes, int]
    term: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, list[bytes]]]) -> Batch:
        vocabulary: dict[bytes, int] = {}
        term = np.array([vocabulary.setdefault(t, len(vocabulary)) for _, ts in rows for t in ts], np.int64)
        return cls([q for q, _ in rows], vocabulary, term, np.cumsum([0, *(len(ts) for _, ts in rows)]))


def corpus_counts(docs: DataFrame, batch: Batch) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the number of documents of every term of the batch."""
    shared = docs.sparkSession.sparkContext.broadcast(batch.vocabulary)

    def run(it):
        known = shared.value
        found, n_docs, n_terms = np.zeros(len(known), np.int64), 0, 0
        for b in it:
            for _, _, data, off in tx.string_chunks(b.column("text")):
                c = count_terms(data, off)
                n_docs += int((c.length > 0).sum())
                n_terms += int(c.length.sum())
                at = np.array([known.get(x, -1) for x in c.content], np.int64)[c.code] if len(c.code) else c.code
                found += np.bincount(at[at >= 0], minlength=len(known))
        hit = np.flatnonzero(found)
        yield tx.batches({"term": np.concatenate(([-2, -1], hit)), "n": np.concatenate(([n_docs, n_terms], found[hit]))},
                         pa.schema([("term", pa.int64()), ("n", pa.int64())]))
    parts = docs.select("text").mapInArrow(tx.tidy(run), "term long, n long")
    got = {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per term of the batch
    df = np.zeros(len(batch.vocabulary), np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return got.get(-2, 0), got.get(-1, 0), df


class Best:
    """The ``k`` best (score, document id) of every query so far; equal scores by ascending id."""

    def __init__(self, queries: int, k: int):
        self.score = np.zeros((queries, k), np.int64)
        self.id = np.full((queries, k), _LAST, np.int64)

    def beaten(self, q: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of the documents would come before the last one kept."""
        last, at = self.score[q, -1], self.id[q, -1]
        # where fewer than k are kept, any score above 0 is one; a null id ties with the filling, so it needs a score above it
        return (score > last) | ((score == last) & (ids < at) & (score > 0))

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[q], score)), np.concatenate((self.id[q], ids))
        o = np.lexsort((i, -s))[:self.score.shape[1]]
        self.score[q], self.id[q] = s[o], i[o]


def sketch_bounds(c: Counted, impact: np.ndarray, docs: np.ndarray, width: int, place: np.ndarray, hashes: np.ndarray,
                  query_hash: np.ndarray, query_weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(queries, documents) upper bounds for ``docs``, whose sketches have ``width`` coordinates.

    ``place`` numbers these documents from 0 (-1: another one); ``hashes`` are those of the codes.
    """
    use = place[c.doc] >= 0
    sketch = np.zeros((width, len(docs)), np.int64)
    np.maximum.at(sketch, (hashes[c.code[use]] & (width - 1), place[c.doc[use]]), impact[use])
    return np.add.reduceat(sketch[query_hash & (width - 1)] * query_weight[:, None], starts, axis=0)


def exact_scores(keys: np.ndarray, impact: np.ndarray, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, vocabulary: int) -> np.ndarray:
    """Scores of ``docs`` for one query; ``keys`` are document * vocabulary + term, ascending, with their impacts."""
    want = docs[:, None] * vocabulary + terms[None, :]
    at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
    return (np.where(keys[at] == want, impact[at], 0) * weights).sum(axis=1) if len(keys) else np.zeros(len(docs), np.int64)


def rank_chunk(best: Best, batch: Batch, weights: np.ndarray, query_hash: np.ndarray, c: Counted, ids: np.ndarray, n_docs: int, n_terms: int) -> int:
    """Take the documents of a chunk into ``best``; the number of exact scores it took."""
    size = len(batch.vocabulary)
    if not size or not len(c.doc):
        return 0
    impact = impacts(c.tf, c.length[c.doc], n_docs, n_terms)
    hashes = np.array([zlib.crc32(x) for x in c.content], np.int64)
    known = np.array([batch.vocabulary.get(x, -1) for x in c.content], np.int64)[c.code]
    hit = known >= 0
    keys = c.doc[hit] * size + known[hit]
    o = np.argsort(keys)
    keys, exact = keys[o], impact[hit][o]
    distinct = np.bincount(c.doc, minlength=len(c.length))
    width = np.clip(1 << np.ceil(np.log2(np.maximum(SPARE * distinct, 1))).astype(np.int64), LEAST_WIDTH, MOST_WIDTH)
    full = np.flatnonzero(np.diff(batch.off))  # queries with terms
    starts, query_weight = batch.off[full], weights[batch.term]
    block, scored = max(1, BLOCK_CELLS // len(batch.term)), 0
    holds = np.flatnonzero(np.bincount(keys // size, minlength=len(c.length)))  # documents with a term of the batch
    for w in np.unique(width[holds]):
        mine = holds[width[holds] == w]
        for a in range(0, len(mine), block):
            docs = mine[a:a + block]
            place = np.full(len(c.length), -1)
            place[docs] = np.arange(len(docs))
            bounds = sketch_bounds(c, impact, docs, int(w), place, hashes, query_hash, query_weight, starts)
            for i in np.flatnonzero(bounds.max(axis=1) >= np.maximum(best.score[full, -1], 1)):
                q, bound = int(full[i]), bounds[i]
                terms = batch.term[batch.off[q]:batch.off[q + 1]]
                order = np.argsort(-bound, kind="stable")
                for at in range(0, len(order), STEP):
                    part = order[at:at + STEP]
                    part = part[best.beaten(q, bound[part], ids[docs[part]])]
                    if not len(part):
                        if bound[order[at]] < best.score[q, -1]:
                            break
                        continue
                    score = exact_scores(keys, exact, docs[part], terms, weights[terms], size)
                    scored += len(part)
                    good = score > 0
                    best.add(q, score[good], ids[docs[part[good]]])
    return scored


def search(docs: DataFrame, batch: Batch, top: int = TOP) -> DataFrame:
    """(query, doc_id, score) of the ``top`` documents of every query of the batch, and their rank."""
    n_docs, n_terms, df = corpus_counts(docs, batch)
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((batch, weights))
    schema = pa.schema([(x, pa.int64()) for x in ("part", "query", "doc_id", "score")])

    def run(it):
        from pyspark import TaskContext
        batch_, weights_ = shared.value
        best = Best(len(batch_.queries), top)
        by_term = np.array([zlib.crc32(x) for x in batch_.vocabulary], np.int64)
        query_hash = by_term[batch_.term] if len(batch_.term) else batch_.term
        for b in it:
            ids = b.column("doc_id").fill_null(_LAST).to_numpy()
            for a, n, data, off in tx.string_chunks(b.column("text")):
                rank_chunk(best, batch_, weights_, query_hash, count_terms(data, off), ids[a:a + n], n_docs, n_terms)
        q, j = np.nonzero(best.score)
        yield tx.batches({"part": np.full(len(q), TaskContext.get().partitionId()), "query": np.array(batch_.queries, np.int64)[q],
                          "doc_id": best.id[q, j], "score": best.score[q, j]}, schema)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tx.tidy(run), "part long, query long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    # two steps, so that no task gets a row of every task for a query
    some = found.withColumn("slice", F.pmod("part", F.lit(SLICES))).withColumn(
        "r", F.row_number().over(Window.partitionBy("query", "slice").orderBy(*order))).filter(F.col("r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("query", "rank", F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents with a score above 0 of every row of ``items`` (item_id, text)."""
    def run(it):
        schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([terms_of(t) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))], schema=schema)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    queries = step(rows.mapInArrow(tx.tidy(run), "item_id long, terms array<binary>").filter(F.size("terms") > 0).withColumn(
        "query", F.monotonically_increasing_id()), "queries")
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = math.ceil(total / batch_terms)
    queries = queries.withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(max(n, 1))))
    out = None
    for i in range(n):
        batch = Batch.of([(r["query"], [bytes(t) for t in r["terms"]]) for r in queries.filter(F.col("batch") == i).orderBy("query").collect()])
        found = step(search(docs, batch, top), "ranked")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.join(queries.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
