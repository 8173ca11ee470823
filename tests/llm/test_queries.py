"""Registered queries without SQL, and the pipeline, on one small fixture: every column of the contract against brute force.

What a model learns isn't worked out again: op2's table of ratios is taken from its operator, and the verdicts of op4 and op5
are held against labels they have not seen.
"""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cohortrank.llm import secret_scan
from cohortrank.llm.queries import QUERIES, TOKENIZER

from .conftest import ODD
from .test_filters import brute_counts, brute_spans, corpus
from .test_text_dedup import brute_groups, words

LABELLED = 240
BLANKS = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Folder, texts and sources by id, and labels of the first rows; with near and exact copies, a shared line and secrets."""
    rng = random.Random(21)
    any_of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    texts, labels = corpus(20, LABELLED)
    good = [i for i, y in enumerate(labels) if y]
    copies = []
    for n, i in enumerate(good[:40]):  # one word in the middle differs: on both sides of the bound, by length
        w = texts[i].split(" ")
        copies.append(" ".join([*w[:len(w) // 2], f"other{n}", *w[len(w) // 2 + 1:]]))
    texts += copies + [texts[good[50]]] * 12
    for n, i in enumerate(good[60:75]):
        texts[i] += "\n" + ("SUBSCRIBE now", "\tsubscribe NOW ")[n % 2] + f"\nend {any_of('abcdef', 9)}"
    for i in good[80:90]:
        texts[i] += f" password: {any_of('abcXYZ789', 14)} é AKIA{any_of('QRSTUV12345', 18)} {any_of('0123456789abcdef', 30)}"
        texts[i] += f" 😀 {any_of('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', 32)} the_update_window_handler"
    texts += ODD
    sources = [f"src{i % 3}" if i % 7 else None for i in range(len(texts))]
    root = str(tmp_path_factory.mktemp("small"))
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, texts, sources, labels


def by_id(spark, name, data):
    rows = QUERIES[name](spark, data[0]).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got)
    return got


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op2(spark, data):
    docs = spark.read.parquet(f"{data[0]}/documents.parquet")
    model, n = secret_scan.train(secret_scan.document_samples(docs)), len(secret_scan.ALPHABET)
    got, found = by_id(spark, "op2_secret_scan", data), 0
    assert len(got) == len(data[1])
    for i, t in enumerate(data[1]):
        base = brute_spans(t)
        spans = [(int(a), secret_scan.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
        kinds = Counter(k for _, k, _ in spans)
        more = []
        for m in re.finditer(secret_scan.RUN, t or ""):
            c = [secret_scan.ALPHABET.index(x) for x in m[0]]
            ratio = sum(model[a * n + b] for a, b in zip(c, c[1:], strict=False))
            if (ratio >= secret_scan.TOTAL and ratio >= secret_scan.MEAN * (len(c) - 1) and re.search("[A-Za-z]", m[0])
                    and not any(a < m.end() and m.start() < b for a, _, b in spans)):
                more.append((m.start(), 3, m.end()))
        found += len(more)
        want = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans + more))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (kinds[0], kinds[1], kinds[2], sha(base), want)
    assert found >= 8


def test_op4(spark, data):
    got, labels = by_id(spark, "op4_quality_classifier", data), data[3]
    assert len(got) == len(data[1])
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    unseen = [i for i in range(LABELLED) if held_out(i)]
    assert np.mean([got[i].predicted == labels[i] for i in unseen]) >= 0.95


def test_op5(spark, data):
    got, labels = by_id(spark, "op5_quality_rules", data), data[3]
    assert len(got) == len(data[1])
    for i, t in enumerate(data[1]):
        r, want = got[i], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    unseen = [i for i in range(LABELLED) if held_out(i)]
    assert np.mean([got[i].kept == bool(labels[i]) for i in unseen]) >= 0.95


def library_row(text):
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(TOKENIZER))
    ids = own.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(own.decode(ids))


def test_op6(spark, data):
    got = by_id(spark, "op6_sentencepiece", data)
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in got.items()} == {i: library_row(t) for i, t in enumerate(data[1])}


def brute_targets(sizes):
    """Targets by source: those above 3 times their size are held there, what is over goes to the rest, until none is above."""
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped = set()
    while True:
        rest, parts = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / parts for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def hold_mix(texts, sources, repeats):
    """Repeats by id: whole ones and at most one more, and each source's words within half of its longest text of the target."""
    size = {i: len(words(t)) for i, t in texts.items()}
    total = Counter()
    for i, n in size.items():
        total[sources[i]] += n
    target = brute_targets(dict(total))
    for s in total:
        epochs = target[s] / total[s]
        own = [i for i in texts if sources[i] == s]
        assert all(math.floor(epochs) <= repeats[i] <= min(3, math.floor(epochs) + 1) for i in own if size[i])
        assert abs(sum(size[i] * repeats[i] for i in own) - target[s]) <= max(size[i] for i in own) / 2 + 1
    return size, total, target


def test_op8(spark, data):
    _, texts, sources, _ = data
    got = by_id(spark, "op8_source_mix", data)
    assert {i: r.taken for i, r in by_id(spark, "op8_source_mix", data).items()} == {i: r.taken for i, r in got.items()}
    assert all(r.taken % r.size == 0 if r.size else r.taken == 0 for r in got.values())
    size, total, target = hold_mix(dict(enumerate(texts)), sources, {i: r.taken // r.size if r.size else 0 for i, r in got.items()})
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], total[sources[i]]) and r.target == pytest.approx(target[sources[i]])


def test_op10(spark, data):
    got = by_id(spark, "op10_minhash_near_dedup", data)
    want = brute_groups(data[1])
    assert [got[i].class_id for i in range(len(want))] == want and len(set(want)) < len(want) - 30
    assert all(r.kept == (r.class_id == i) and r.group_size == want.count(r.class_id) for i, r in got.items())


def test_pipeline(spark, data):
    import corpus_pipeline as cp
    root, texts, sources, _ = data
    rules = by_id(spark, "op5_quality_rules", data)
    here = {i: t for i, t in enumerate(texts) if rules[i].kept}
    assert len(here) < len(texts) - 60

    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    spread = Counter(k for t in here.values() for k in {key(x) for x in t.split("\n")} if k)
    seen, cut = set(), {}
    for i, t in sorted(here.items()):
        stay = []
        for line in t.split("\n"):
            k = key(line)
            if not k or spread[k] < 10 or k not in seen:
                stay.append(line)
            seen.add(k)
        if words("\n".join(stay)):
            cut[i] = "\n".join(stay)
    assert len(cut) == len(here) - 12 and sum(cut[i] != here[i] for i in cut) >= 10  # twelve copies go, and most footers

    ids = sorted(cut)
    groups = brute_groups([cut[i] for i in ids])
    heads = {i: cut[i] for n, i in enumerate(ids) if groups[n] == n}
    assert len(heads) < len(cut) - 20
    rows = QUERIES["pipeline"](spark, root).collect()
    repeats = Counter(r.doc_id for r in rows)
    assert set(repeats) <= set(heads)
    hold_mix(heads, sources, repeats)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == library_row(heads[r.doc_id])
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mix", "sentencepiece"]
