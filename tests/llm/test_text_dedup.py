"""Substring dedup, line dedup and MinHash near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortrank.llm import _graph, dart_minhash, line_dedup, substring_dedup

from .conftest import BLANK, documents

WORD = re.compile(BLANK)


def words(text):
    return WORD.findall(text or "")


def brute_windows(texts, size):
    counts = Counter(tuple(w[i:i + size]) for w in map(words, texts) for i in range(len(w) - size + 1))
    out = []
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(seed, n=40, vocabulary=30):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(vocabulary)) for _ in range(rng.randrange(5, 30))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice([" ", "\n", "\t"]).join(parts))
    return texts + texts[:3] + ["z " * 50, None, ""]


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_matches_brute_force(spark, hot):
    texts = passages(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(documents(spark, texts), size=12, seed_words=4, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts, 12)


def test_substring_odd_rows(spark, odd_documents):
    rows = substring_dedup.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_words == 0 and by_id[0].kept_text == ""
    assert by_id[6].n_removed == 60  # repeats inside itself and in the repeated row
    assert by_id[None].kept_text == "no id here"
    assert substring_dedup.remove_repeats(odd_documents.limit(0)).count() == 0


def line_key(line):
    return line.strip(" \t\n\r\x0b\f").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines_match_brute_force(spark, keep):
    rng = random.Random(5)
    pool = ["Home", " home ", "É", "é", "", "  ", "All rights reserved.", "x" * 300] + [f"line {i}" for i in range(40)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs, min_docs=4, keep=keep).collect()}
    found = Counter(k for t in texts for k in {line_key(x) for x in t.split("\n")})
    # the first text of a key is the least by the row key of the operator
    keys = {r.doc_id: (r._d, r._k) for r in line_dedup.keyed(docs).collect()}
    first = {}
    for i, t in enumerate(texts):
        for k in {line_key(x) for x in t.split("\n")}:
            first[k] = min(first.get(k, i), i, key=keys.get)
    for i, t in enumerate(texts):
        seen, kept = set(), []
        for x in t.split("\n"):
            k = line_key(x)
            lead = keep == "first" and first[k] == i and k not in seen
            seen.add(k)
            if not k or found[k] < 4 or lead:
                kept.append(x)
        assert got[i] == (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept)), i


def test_hot_line_over_many_parts(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "concat('same\\n', id) text")
    assert {(r.n_dropped, r.kept_text == str(r.doc_id)) for r in line_dedup.dedup_lines(docs).collect()} == {(1, True)}


def test_lines_odd_rows(spark, odd_documents):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(odd_documents).collect()}
    assert rows[0].n_lines == 1 and rows[3].n_lines == 3 and rows[8].kept_text == "😀 tab\tnew\r\nline   still"
    assert line_dedup.dedup_lines(odd_documents.limit(0)).count() == 0
    out = line_dedup.drop_lines(odd_documents, min_docs=2)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    assert {r.text for r in out.filter("doc_id = 5").collect()} == {""}


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    n = 3000
    a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
    b = a.copy()
    b[:500] = rng.integers(0, 2 ** 63, 500)
    w = rng.uniform(0.2, 2.8, n)
    sig = dart_minhash.dart_signatures(np.concatenate((a, b)), np.repeat([0, 1], n), np.concatenate((w, w)), 2)
    true = w[500:].sum() / (w.sum() + w[:500].sum())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    one = dart_minhash.dart_signatures(a[:1], np.zeros(1, int), np.ones(1), 2)
    assert (one[0] != dart_minhash.EMPTY).all() and (one[1] == dart_minhash.EMPTY).all()


def weight(run):
    return min(max(sum(len(w.encode()) for w in run), dart_minhash.LIGHT), dart_minhash.HEAVY)


def weighted_jaccard(x, y):
    return sum(map(weight, x & y)) / sum(map(weight, x | y))


def brute_groups(texts, similarity=0.8):
    """Components by weighted or plain Jaccard similarity of the sets of runs."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x & y and (weighted_jaccard(x, y) >= similarity - 1e-12 or len(x & y) >= similarity * len(x | y))]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice([6, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(8):  # edits of the original, farther from each other than from it
            w = list(base)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(w))
    texts += ["a b", "a b", "a c", None, "", " "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i].class_id for i in range(len(texts))] == brute_groups(texts)
    assert all(got[i].kept == (got[i].class_id == i) for i in got)


def test_near_duplicates_of_repeated_passages(spark):
    rng = random.Random(12)
    texts = []
    for g in range(8):  # a passage against itself many times over: nearly the same set of runs
        base = " ".join(f"g{g}w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([80, 200])))
        texts += [base, " ".join([base] * (8, 20)[g % 2]), " ".join([base] * 50)]
    texts += ["y " * 6 + "z", "y " * 400 + "z"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i].class_id for i in range(len(texts))] == brute_groups(texts)


def test_near_duplicates_by_weight(spark):
    """Pairs on different sides of 0.8 by plain and by weighted similarity: either one links."""
    rng = random.Random(4)
    texts, sides = [], set()
    for g in range(40):
        base = [f"g{g}" + "abcdefgh"[:rng.randrange(7)] + str(rng.randrange(10, 99)) for _ in range(120)]
        edits = [list(base), list(base)]
        for k, w in enumerate(edits):  # both edits keep to one end, so that what differs is all short or all long
            for i in range(rng.randrange(11, 16)):
                w[60 * k + i] = "o" * rng.choice([1, 1, 12]) + f"{g}{k}{i}"
        texts += [" ".join(w) for w in (base, *edits)]
    runs = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in map(words, texts)]
    for i in range(0, len(texts), 3):
        for j in (i + 1, i + 2):
            sides.add((len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j]), weighted_jaccard(runs[i], runs[j]) >= 0.8))
    assert len(sides) > 2 and {(True, True), (False, False)} < sides
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_block_links_match_brute_force():
    rng = np.random.default_rng(3)
    sets, all_of = [], rng.integers(0, 2 ** 63, 400).astype(np.uint64) << np.uint64(5) | rng.integers(0, 13, 400).astype(np.uint64)
    for _ in range(30):
        own = rng.integers(0, 2 ** 63, 40).astype(np.uint64) << np.uint64(5)
        sets.append(np.unique(np.concatenate((rng.choice(all_of, 360, replace=False), own[:rng.integers(0, 40)]))))
    heavy, number = dart_minhash._common(sets)
    for i in range(30):
        for j in range(30):
            both = np.intersect1d(sets[i], sets[j])
            assert i == j or (heavy[i, j], number[i, j]) == (dart_minhash.weights(both).sum(), len(both))


def test_near_duplicates_odd_rows(spark, odd_documents):
    rows = dart_minhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r.doc_id: r.group_size for r in rows}[5] == 2
    assert all(r.kept for r in rows if r.doc_id in (0, 1, 2, 3, None))
    assert dart_minhash.near_duplicates(odd_documents.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in _graph.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmaps_are_small():
    import zlib
    bits = np.ones(80_000, bool)
    bits[5] = False
    blob = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
    text = "\n".join(str(i) for i in range(80_000))
    n, kept = line_dedup.kept_text(text, blob)
    assert len(blob) < 300 and n == 80_000 and hashlib.sha256(kept.encode()).digest() == hashlib.sha256(text.replace("\n5\n", "\n", 1).encode()).digest()
