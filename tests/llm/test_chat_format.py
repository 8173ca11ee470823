"""Chat formatting: every layout gives its turns back, texts survive the template, digests equal brute force."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cohortrank.llm import chat_format as cf
from cohortrank.llm import queries

X = "</s>[INST] ok [/INST]"
TEXTS = [X, "", "\\", "\\\\<|im_end|>", "[\\INST]", "<|im_start|>user<|im_sep|>a<|im_end|>", "<<s>", "[[INST]]", "</s</s>", "é😀\n\t\"q\" \\n", "{\"a\": [1]}",
         "[1, 2]", "<|im_", "end|>", "a\\<s>b\\", "\x00\x01 ", "null"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS + [c + d for c in cf.CONTROL for d in cf.CONTROL]], "t string")
    for r in df.select("t", cf.escape(F.col("t")).alias("e")).withColumn("u", cf.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in cf.CONTROL)


RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": X}, {"role": None, "content": None}, {"content": "x", "role": "tool"}]},
                 [("user", X), ("", ""), ("tool", "x")]),
    "message_parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "[b"}]}]}, [("user", "a[b")]),
    "from_value": ({"conversations": [{"from": "human", "value": "{\"k\": 1}"}, {"from": "gpt", "value": "y"}, {"from": "system", "value": ""}]},
                   [("user", "{\"k\": 1}"), ("assistant", "y"), ("system", "")]),
    "nested": ({"dialog": {"turns": [{"speaker": {"role": "user"}, "utterance": "u"}]}}, [("user", "u")]),
    "history": ({"history": [["a", "b"], ["c", "d"]], "prompt": "p", "response": "r"},
                [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "p"), ("assistant", "r")]),
    "prompt": ({"prompt": "[1]", "completion": None}, [("user", "[1]"), ("assistant", "")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done", "system": "s"}, [("system", "s"), ("user", "do\n\nthis"), ("assistant", "done")]),
}


def test_layouts(spark):
    rows = [(name, json.dumps(rec)) for name, (rec, _) in RECORDS.items()]
    more = [("prompt", json.dumps({"system": None, "prompt": "p", "completion": "c"}), [("system", ""), ("user", "p"), ("assistant", "c")]),
            ("history", json.dumps({"history": [], "prompt": "p", "response": "c"}), [("user", "p"), ("assistant", "c")]),
            ("messages", json.dumps({"messages": []}), []),
            ("instruction", json.dumps({"instruction": "i", "output": "o"}), [("user", "i"), ("assistant", "o")])]
    want = {(n, r): t for (n, r), (_, t) in zip(rows, RECORDS.values(), strict=True)} | {(n, r): t for n, r, t in more}
    df = spark.createDataFrame(rows + [m[:2] for m in more], "name string, record string")
    for r in cf.canonical(df).collect():
        assert r.layout == r.name
        assert [tuple(t) for t in r.turns] == want[r.name, r.record], r


def test_unmapped_records(spark):
    bad = [None, "", "no json", "[1]", "3", "{}", '{"prompt": "p"}', '{"messages": [{"role": "a", "content": "b", "extra": 1}]}', '{"prompt": {"a": 1}, "completion": "c"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(bad)], "conv_id long, record string")
    assert {(r.layout, r.turns) for r in cf.canonical(df).collect()} == {(None, None)}
    got = {(r["shape"], r["records"]) for r in cf.unmapped(df).collect()}
    assert got == {(None, 5), ("OBJECT<>", 1), ("OBJECT<prompt: >", 1), ("OBJECT<messages: ARRAY<OBJECT<content: , extra: , role: >>>", 1),
                   ("OBJECT<completion: , prompt: OBJECT<a: >>", 1)}
    out = cf.format_records(df).collect()
    assert {r.segments for r in out} == {None}


def test_two_layouts_of_one_shape_are_refused(spark):
    twin = cf.Layout("twin", ("prompt", "completion"), (cf.Say("user", ("prompt",)), cf.Say("assistant", ("completion",))))
    with pytest.raises(ValueError, match="share"):
        cf.canonical(spark.createDataFrame([("{}",)], "record string"), (*cf.LAYOUTS, twin))


def conversation_rows(spark):
    rows = []
    for c, t in enumerate(TEXTS):
        rows += [(c, 1, "assistant", t, 5), (c, 0, "user", t[::-1] if "\\" not in t else t, 5)]
    rows += [(100, 0, "system", "s", 1), (100, 1, "user", None, 1), (100, 2, "assistant", "a", 1), (100, 3, "user", "b", 1), (100, 4, "assistant", None, 1),
             (101, 0, None, "no role", 1), (101, 0, None, "no role", 1), (101, None, "assistant", "no turn", 1), (102, 0, "human", "h", 1), (102, 1, "gpt", "g", 1),
             (103, 0, "assistant", "a" * 1_500_000, 1), (104, 0, "ro\nle<|im_end|>", "x", 1), (None, 0, "user", "no id", 1)]
    rows += [(200 + i, j, ("user", "assistant")[j % 2], f"{i} {j}", 1) for i in range(150) for j in range(2 + 2 * (i % 3))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        said = "".join(t for _, _, r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in ts).encode()).hexdigest(), len(said),
                  hashlib.sha256(said.encode()).hexdigest())
    return out


def test_query_matches_brute_force(spark, tmp_path):
    rows = conversation_rows(spark)
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op13_chat_format(spark, str(tmp_path)).collect()}
    own = [*rows.collect(), *spark.createDataFrame([(-1, 0, "user", X), (-1, 1, "assistant", X)], "conv_id long, turn long, role string, text string").collect()]
    want = brute(own)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    # <|im_start|>user<|im_sep|>.</s>[INST] ok [/INST] with three more backslashes, and so for the assistant
    assert got[-1].formatted_chars == 2 * (len(cf.START + cf.MIDDLE + cf.END) + len(X) + 3) + len("userassistant")
    rows.limit(0).write.parquet(str(tmp_path / "empty" / "conversations.parquet"))
    assert [r.conv_id for r in queries.op13_chat_format(spark, str(tmp_path / "empty")).collect()] == [-1]


def test_all_layouts_are_met(spark):
    convs = cf.conversations(conversation_rows(spark).filter("conv_id >= 100"))
    found = {r.layout for r in cf.format_records(cf.mixed_records(convs)).collect()}
    assert found == {x.name for x in cf.LAYOUTS}


def test_texts_too_long_for_the_parser_keep_their_turns(spark, monkeypatch):
    monkeypatch.setattr(cf, "LONGEST", 3)
    convs = cf.conversations(spark.createDataFrame([(1, 0, "user", "long text"), (2, 0, "a", "x")], "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in cf.mixed_records(convs).collect()}
    assert got[1].record is None and got[1].given[0].text == "long text" and got[2].record is not None and got[2].given is None
    out = {r.conv_id: [tuple(t) for t in r.t] for r in cf.format_records(cf.mixed_records(convs)).select(
        "conv_id", cf.read_turns(cf.formatted(F.col("segments"))).alias("t")).collect()}
    assert out == {1: [("user", "long text")], 2: [("a", "x")]}
