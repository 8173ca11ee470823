"""Texts made to collide in polynomial hashes (Thue-Morse strings and their complements) are told apart."""

import hashlib

from cohortrank.llm import dart_minhash, line_dedup, quality_rules, substring_dedup

from .conftest import documents


def thue_morse(n, a="a", b="b"):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


A, B = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))


def test_lines(spark):
    out = line_dedup.dedup_lines(documents(spark, [A] * 9 + [B]), min_docs=10).collect()
    assert {r.n_dropped for r in out} == {0}
    out = line_dedup.dedup_lines(documents(spark, [A] * 10 + [B]), min_docs=10).collect()
    assert sorted(r.n_dropped for r in out) == [0] + [1] * 10


def test_repeated_lines_of_one_text(spark):
    got = quality_rules.score(documents(spark, [f"{A}\n{B}", f"{A}\n{A}"]), None).collect()
    assert {r.doc_id: r.n_dup_lines for r in got} == {0: 0, 1: 1}


def test_near_duplicates(spark):
    words = [" ".join(thue_morse(2048, "x", "y")), " ".join(thue_morse(2048, "y", "x"))]
    got = dart_minhash.near_duplicates(documents(spark, [A, B, A, *words[:1]])).collect()
    assert {r.doc_id: r.class_id for r in got} == {0: 0, 1: 1, 2: 0, 3: 3}


def test_windows(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    out = substring_dedup.remove_repeats(documents(spark, [f"{A} {rest}", f"{B} {rest}"])).collect()
    assert {r.n_removed for r in out} == {0}
    out = substring_dedup.remove_repeats(documents(spark, [f"{A} {rest}", f"{A} {rest}", f"{B} {rest}"])).collect()
    assert {r.doc_id: r.n_removed for r in out} == {0: 35, 1: 35, 2: 0}
    # runs of words in Thue-Morse order, and their complements
    t = [" ".join(thue_morse(64, "x", "y")[:35]), " ".join(thue_morse(64, "y", "x")[:35])]
    out = substring_dedup.remove_repeats(documents(spark, t)).collect()
    assert {(r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out} == {(0, hashlib.sha256(x.encode()).hexdigest()) for x in t}
