"""Quality rules, the naive Bayes classifier and the secret scan."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cohortrank.llm import _text as tx
from cohortrank.llm import nbsvm, quality_rules, secret_scan

from .conftest import BLANK, ODD, documents

WORD = re.compile(BLANK)


def brute_counts(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    gone = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(gone)


def corpus(seed, n=300):
    """Plain prose (label 1) and three kinds of junk (label 0)."""
    rng = random.Random(seed)
    syllables = ["an", "the", "or", "ing", "st", "re", "ou", "ed", "la", "mi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(25, 120))]
        kind = i % 6
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w = [x for x in w for _ in range(12)]
        texts.append(" ".join(w))
        labels.append(int(kind > 1))
    return texts, labels


def test_base_counts_match_brute_force():
    texts, _ = corpus(1, 60)
    texts += [t or "" for t in ODD] + ["a\n\na\n a\n", "x y z\n" * 9, "#|<é>"]
    got = []
    for _, _, data, off in tx.string_chunks(pa.array(texts)):
        c = quality_rules.base_counts(data, off, *tx.tokens(data, off))
        got += list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute_counts(t) for t in texts]


def test_chunks_do_not_change_words(monkeypatch):
    texts = ["ab cd", "", "ef", None, " gh　ij k"] * 5
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(tx, "CHUNK_BYTES", size)
        words = []
        for _, _, data, off in tx.string_chunks(pa.array(texts)):
            ws, we, first = tx.tokens(data, off)
            words += [[bytes(data[s:e]).decode() for s, e in zip(ws[a:b], we[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
        assert words == [WORD.findall(t or "") for t in texts]


def test_hashes_are_of_the_content():
    data = np.frombuffer(b"abc abc ab bc", np.uint8)
    start, end = np.array([0, 4, 8, 11]), np.array([3, 7, 10, 13])
    for h in (*tx.digests(data, start, end), tx.word_hashes(data, start, end)):
        assert h[0] == h[1] and len(set(h.tolist())) == 3
    assert tx.kinds(data, start[:0], end[:0])[0].tolist() == [] == tx.word_hashes(data, start[:0], end[:0]).tolist()
    # words of up to 8 bytes are told apart for sure, by length too
    short = [bytes(w) for n in range(1, 9) for w in ([97] * n, [98] * n, [97] * (n - 1) + [98], [0] * n)] + [b"x" * n for n in range(9, 20)]
    cuts = np.cumsum([0, *(len(w) for w in short)])
    h = tx.word_hashes(np.frombuffer(b"".join(short), np.uint8), cuts[:-1], cuts[1:]).tolist()
    assert len(set(h)) == len(set(short)) and all(h[i] == h[short.index(w)] for i, w in enumerate(short))
    values = tx.word_hashes(data, start, end)[[0, 2, 3, 0, 2, 3, 0, 2, 0]]
    runs = [(a, b) for a in range(9) for b in range(a, 10)]
    for seed in (0, 1, 2):
        h = tx.run_hash(values, *(np.array(x) for x in zip(*runs, strict=True)), seed)
        by_content = {}
        for (a, b), x in zip(runs, h.tolist(), strict=True):
            assert by_content.setdefault(tuple(values[a:b].tolist()), x) == x
        assert len(set(by_content.values())) == len(by_content)


def test_models_learn_held_out_rows(spark):
    texts, labels = corpus(4, 400)
    docs = documents(spark, texts)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    scored = nbsvm.score(docs, nbsvm.train(docs, marks)).collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in scored)
    kept = quality_rules.score(docs, quality_rules.train(docs, marks)).collect()
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in kept]) > 0.95


def test_scores_of_odd_rows_and_without_labels(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.train(odd_documents, none) is None and nbsvm.train(odd_documents, none) is None
    rows = quality_rules.score(odd_documents, None).collect()
    assert len(rows) == odd_documents.count() and all(r.kept == (not r.base_failed) for r in rows)
    assert {r.score for r in nbsvm.score(odd_documents, None).collect()} == {0.5}
    texts, labels = corpus(4, 100)
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (3, None)], "doc_id long, quality int")
    model = nbsvm.train(documents(spark, texts), marks)
    by_id = {r.doc_id: r for r in nbsvm.score(odd_documents, model).collect()}
    assert by_id[0].score == by_id[1].score and by_id[None].held_out is False
    assert quality_rules.keep_good(odd_documents, None).columns == odd_documents.columns
    assert nbsvm.score(odd_documents.limit(0), model).count() == 0 and quality_rules.score(odd_documents.limit(0), None).count() == 0


def test_dual_descent_separates():
    ids = np.array([0, 1, 0, 2, 1, 3, 2, 3])
    off = np.array([0, 2, 4, 6, 8])
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w = nbsvm.dual_descent(ids, off, np.ones(8), y, np.full(4, 10.0), 4, epochs=200)
    assert all(np.sign(w[ids[a:b]].sum() + w[-1]) == s for a, b, s in zip(off[:-1], off[1:], y, strict=True))


ASSIGN = re.compile("(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute_spans(t):
    t = t or ""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(found, key=lambda x: (x[0], order.index(x[1]))))


def test_base_spans_match_brute_force(spark):
    rng = random.Random(6)
    bits = ["password=", "API_KEY: ", "token: token: abcdefgh", "'secret' = 'x1y2z3q'", "AKIA" + "Z9" * 8, "AKIAshort", "0123456789abcdef" * 2, "é😀 ", " \n", "abc", "apikey:short", "passwd==k9k9k9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(200)] + ODD
    got = documents(spark, texts).select("doc_id", secret_scan.joined(secret_scan.base_spans(__import__("pyspark").sql.functions.coalesce("text", __import__("pyspark").sql.functions.lit("")))).alias("s"))
    assert {r.doc_id: r.s for r in got.collect()} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_markov_finds_random_strings_and_leaves_identifiers(spark):
    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda n: "".join(rng.choice(chars) for _ in range(n))
    plain = ["user", "account", "balance", "update", "window", "current", "value", "handler", "request", "total"]
    samples = [(secret(24), 1) for _ in range(200)] + [("_".join(rng.choices(plain, k=3)), 0) for _ in range(200)] + [("".join(x.title() for x in rng.choices(plain, k=3)), 0) for _ in range(200)]
    model = secret_scan.train(spark.createDataFrame([*samples, (None, 1), ("", 0)], "text string, label int"))
    keys = [secret(32) for _ in range(30)]
    texts = [f"é value {k} end" for k in keys] + [f"the update_window_handler2_total and UserAccountBalance7Request {i}" for i in range(30)]
    rows = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts), model).collect()}
    assert sum([(s.start, s.end) for s in rows[i].spans] == [(8, 40)] for i in range(30)) >= 28
    assert not any(rows[i].spans for i in range(30, 60))


def test_markov_finds_random_strings_without_digits(spark):
    rng = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    held = lambda n, chars=chars: "".join(rng.choice(chars) for _ in range(n))
    plain = ["user", "account", "balance", "update", "window", "current", "value", "handler", "request", "total"]
    samples = [(held(24, chars + "0123456789"), 1) for _ in range(300)] + [("_".join(rng.choices(plain, k=3)), 0) for _ in range(300)] + [("".join(x.title() for x in rng.choices(plain, k=3)), 0) for _ in range(300)]
    model = secret_scan.train(spark.createDataFrame(samples, "text string, label int"))
    texts = [held(n) for n in (16, 20, 32) for _ in range(40)] + ["-" * 40, "=" * 20, "4465758382889437", "update_window_handler_total", "UserAccountBalanceRequest"]
    found = [len(r.spans) for r in secret_scan.scan(documents(spark, texts), model).orderBy("doc_id").collect()]
    assert sum(found[:120]) >= 114 and not any(found[120:])
    # the letter asked for loses none of the strings over the whole alphabet
    assert all(re.search("[A-Za-z]", held(16, secret_scan.ALPHABET)) for _ in range(20000))


def test_models_count_all_texts(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdeXYZ") for _ in range(rng.randrange(1, 15)))
    texts = [" ".join(word() for _ in range(rng.randrange(9))) for _ in range(600)] + ["é aB9 cd_ef gh", "single"] + ODD
    texts += [f"password={word()}{i} and hEX {'%024x' % i} AKIA{'Q7' * 9}" for i in range(2100)]
    samples = []
    for t in texts:
        t = t or ""
        if any(re.search(p, t) for p in (ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}")):
            values = [v for v in ASSIGN.findall(t) if len(v) >= 6] + re.findall("AKIA[A-Z0-9]{16,}", t) + re.findall("[0-9a-f]{24,}", t)
            samples += [(v, 1) for v in values]
        else:
            w = re.findall("(?<![A-Za-z0-9])[A-Za-z]{2,12}(?![A-Za-z0-9])", t)
            for a, b in zip(w, [*w, ""][1:], strict=True):
                samples += [(a, 0), (a + b.capitalize(), 0), (f"{a}_{b}".lower(), 0)]
    every = secret_scan.train(spark.createDataFrame(samples, "text string, label int"))
    assert secret_scan.train(secret_scan.document_samples(documents(spark, texts))) == every


def test_scan_odd_rows(spark, odd_documents):
    model = secret_scan.train(secret_scan.document_samples(odd_documents))
    rows = secret_scan.scan(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and not any(r.spans for r in rows)
    assert secret_scan.scan(odd_documents.limit(0), model).count() == 0


def test_secret_spans_of_many_matches(spark):
    """Spans of texts with thousands of matches, against a scan by Python's patterns; base and markov spans never overlap."""
    import time
    strings = [f"key{i % 7} token=abcdef{i} x9{i}Qz7Lk2Wp4Vt8Rn1Ys{i} " for i in range(6000)]
    texts = ["".join(strings[:n]) for n in (0, 1, 63, 64, 65, 4095, 4097)] + ["token=abcdef " * 20_000]
    model = secret_scan.train(secret_scan.document_samples(documents(spark, ["password = 'aB3dE9fGh2KlM8nP'", "some ordinary words of a text " * 20])))
    started = time.time()
    got = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts), model).collect()}
    assert time.time() - started < 120
    for i, t in enumerate(texts):
        want = sorted((m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, t) if len(m.group(1)) >= 6)
        assert [tuple(s) for s in got[i].base] == want
        markov = [tuple(s) for s in got[i].spans if s["kind"] == 3]
        runs = {(m.start(), 3, m.end()) for m in re.finditer(secret_scan.RUN, t)}
        assert set(markov) <= runs
        ends = sorted(want)
        assert not any(a < e and s < b for a, _, b in markov[:50] for s, _, e in ends[:80])
    assert len([s for s in got[6].spans if s["kind"] == 3]) > 3000
