"""Ranked lexical search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortrank.llm import max_sketch as ms
from cohortrank.llm import queries

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """[(item, rank, doc, score)] from [(doc_id, text)] and [(item_id, text)]."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            if not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "ÀB", "x1", "ñandú", "漢字", "A", "a"]
    sep = [" ", "-", "\n", "_", "...", "é "]
    texts = ["".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)]
    return texts + texts[:50] + [None, "", "...", "w1 " * 3000]


def tables(spark, path, docs, items):
    spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, item_id string").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int").write.parquet(f"{path}/benchmark.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_matches_brute_force(spark, tmp_path):
    texts = corpus(3)
    docs = [*enumerate(texts), (None, "w3 w4 w5"), (7, texts[7]), (7, texts[7])]
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice((texts[rng.randrange(400)] or "w2").split() or ["w9"]) for _ in range(12))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "unseen words only"), (103, "w1 W1 w1"), (104, "A é"), (None, "w7 w8"), (105, " ".join(f"w{i}" for i in range(300)))]
    tables(spark, tmp_path, docs, items)
    got = rows(queries.op12_ranked_search(spark, str(tmp_path)))
    assert got == brute(docs, items)


def test_batches_ties_and_hot_terms(spark):
    docs = [(i, "same words here") for i in range(300)] + [(1000 + i, f"same word{i}") for i in range(200)]
    items = [(0, "same"), (1, "here"), (2, "word3 word4 same"), (3, "same words here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for batch_terms in (1, 4, 10_000):
        assert rows(ms.rank_documents(d, q.union(q), batch_terms=batch_terms)) == want
    assert rows(ms.rank_documents(d, q, top=3)) == brute(docs, items, 3)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ms.rank_documents(d.limit(0), q).count() == 0
    assert ms.rank_documents(d, q.limit(0)).count() == 0
    assert ms.rank_documents(d, q).count() == 1


@pytest.mark.parametrize("spare", [1, 8])
def test_bounds_are_never_below_scores_and_prune(monkeypatch, spare):
    monkeypatch.setattr(ms, "SPARE", spare)
    monkeypatch.setattr(ms, "LEAST_WIDTH", 4)
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 120))) for _ in range(600)]
    data, off = np.frombuffer(" ".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts)])
    off[-1] = len(data)
    c = ms.count_terms(data, off)
    batch = ms.Batch.of([(i, ms.terms_of(" ".join(rng.choice(texts).split()[:8]))) for i in range(20)])
    n_docs, n_terms = int((c.length > 0).sum()), int(c.length.sum())
    df = Counter(t for t in texts for t in set(terms(t)))
    weights = np.array([ms.weight(n_docs, df[t.decode()]) for t in batch.vocabulary], np.int64)
    query_hash = np.array([zlib.crc32(x) for x in batch.vocabulary], np.int64)[batch.term]
    best = ms.Best(20, 10)
    scored = ms.rank_chunk(best, batch, weights, query_hash, c, np.arange(600), n_docs, n_terms)
    full = ms.Best(20, 600)
    ms.rank_chunk(full, batch, weights, query_hash, c, np.arange(600), n_docs, n_terms)
    assert (best.score == full.score[:, :10]).all() and (best.id == full.id[:, :10]).all()
    if spare == 8:
        assert scored < 20 * 600 / 3  # two thirds of the documents are never scored
