"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

Records come as JSON objects in many layouts (a prompt and a completion, an
instruction and its output, lists of messages, ...). The nested field paths of a
record, without the types and contents of its leaves, are hashed; that fingerprint
picks one ``Layout``, a declaration of where turns, roles and texts lie. New layouts
are added by declaring them, no code looks at a record's contents to guess.

1. ``shape``: the paths of a record as text, from ``schema_of_variant`` with the leaf
   types taken out, e.g. ``OBJECT<messages: ARRAY<OBJECT<content: , role: >>>``; paths
   of all elements of a list are merged. The fingerprint is its SHA-256.
2. ``canonical``: layout and turns (array of role, text) of a record. The
   fingerprints of a layout are those of its paths with every subset of its optional
   paths, and with its lists empty.
3. ``segments``: the formatted turns as pieces (text, loss). Their texts put together
   are the formatted conversation; pieces with ``loss`` are what a model learns from,
   the texts of the assistant. Control strings inside roles and texts are escaped by
   a backslash after their first character, backslashes are doubled, so the marks of
   the template occur as marks only and ``unescape`` gives the text back.

Everything is a DataFrame expression; there is no Python worker.

Defined cases: a JSON null or an absent optional text of a layout with a fixed role
gives an empty text or no turn; a null role or text in a list is empty. Records that
are null, not JSON, no object, or of no declared layout have no layout and null
turns; ``unmapped`` counts them by fingerprint. Spark's JSON parser takes strings of
up to 20 million characters; ``mixed_records`` therefore keeps longer ones as turns.
A conversation is one row, so it must fit in one row (2 GB), as its format must.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
LONGEST = 16_000_000  # characters of one string that are sure to pass the JSON parser

# fixed values: marks of the template, and control strings of common templates, which no text may contain as such
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>",
           "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>")


@dataclass(frozen=True)
class Say:
    """One turn of a fixed role: the texts at ``paths``, non-empty ones joined by ``glue``."""

    role: str
    paths: tuple[str, ...]
    glue: str = "\n\n"


@dataclass(frozen=True)
class Each:
    """A turn per element of the list at ``path``; ``role`` and ``text`` are paths inside an element.

    ``names`` gives the canonical names of roles, others stay. ``parts``: the text is
    a list of objects whose ``parts`` field is put together.
    """

    path: str
    role: str
    text: str
    names: Mapping[str, str] = field(default_factory=dict)
    parts: str | None = None


@dataclass(frozen=True)
class Pairs:
    """Turns of alternating roles from a list of lists of texts."""

    path: str
    roles: tuple[str, str] = ("user", "assistant")


@dataclass(frozen=True)
class Layout:
    """A declared layout: its leaf paths (``[]`` marks a list), those that may be absent, and its turns in order."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Say | Each | Pairs, ...]
    optional: tuple[str, ...] = ()


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (Each("messages", "role", "content"),)),
    Layout("message_parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"),
           (Each("messages", "role", "content", parts="text"),)),
    Layout("from_value", ("conversations[].from", "conversations[].value"),
           (Each("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),)),
    Layout("nested", ("dialog.turns[].speaker.role", "dialog.turns[].utterance"), (Each("dialog.turns", "speaker.role", "utterance"),)),
    Layout("history", ("history[][]", "system", "prompt", "response"),
           (Say("system", ("system",)), Pairs("history"), Say("user", ("prompt",)), Say("assistant", ("response",))), ("system",)),
    Layout("prompt", ("system", "prompt", "completion"),
           (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("completion",))), ("system",)),
    Layout("instruction", ("system", "instruction", "input", "output"),
           (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",))), ("system", "input")),
)


# ---- fingerprints -------------------------------------------------------------

def shape_of(paths: Sequence[str], empty: Sequence[str] = ()) -> str:
    """The shape of a record with these leaf paths; lists at the paths ``empty`` have no element."""
    root: dict = {}
    for path in sorted(paths):
        node, at = root, ""
        for part in path.split("."):
            name = part.rstrip("[]")
            lists = part.count("[]")
            at = f"{at}.{name}" if at else name
            node = node.setdefault((name, lists, at), {})

    def text(fields: dict) -> str:
        if not fields:
            return ""
        out = []
        for (name, lists, at), inner in sorted(fields.items()):
            body = text(inner)
            if lists and at in empty:
                body, lists = "", 1
            out.append(f"{name if re.fullmatch('[A-Za-z_][A-Za-z0-9_]*', name) else '`' + name + '`'}: {'ARRAY<' * lists}{body}{'>' * lists}")
        return f"OBJECT<{', '.join(out)}>"
    return text(root)


def layout_shapes(layout: Layout) -> list[str]:
    """All shapes of a layout: every subset of its optional paths, every subset of its lists empty."""
    lists = [t.path for t in layout.turns if isinstance(t, (Each, Pairs))]
    out = []
    for n in range(len(layout.optional) + 1):
        for gone in itertools.combinations(layout.optional, n):
            paths = [p for p in layout.paths if p not in gone]
            out += [shape_of(paths, empty) for k in range(len(lists) + 1) for empty in itertools.combinations(lists, k)]
    return out


def shape(record: Column) -> Column:
    """Nested field paths of a variant as text; types of leaves are left out, quoted names stay."""
    names = "(`[^`]*+(?:``[^`]*+)*+`)"
    return F.regexp_replace(F.schema_of_variant(record), names + r"|\b[A-Z]+(?:\(\d+, ?\d+\))?(?=[,>]|$)", "$1")


# ---- mappings -----------------------------------------------------------------

def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _each(record: Column, t: Each) -> Column:
    def ddl(path: str, leaf: str) -> str:
        head, _, rest = path.partition(".")
        return f"{head}:{'struct<' + ddl(rest, leaf) + '>' if rest else leaf}"

    def dig(x: Column, path: str) -> Column:
        for part in path.split("."):
            x = x[part]
        return x
    leaf = f"array<struct<{t.parts}:string>>" if t.parts else "string"
    items = F.try_variant_get(record, f"$.{t.path}", f"array<struct<{ddl(t.role, 'string')},{ddl(t.text, leaf)}>>")
    names = F.create_map(*[F.lit(x) for kv in t.names.items() for x in kv]) if t.names else None

    def one(x: Column) -> Column:
        role, text = dig(x, t.role), dig(x, t.text)
        if t.parts:
            text = F.array_join(F.transform(text, lambda p: F.coalesce(p[t.parts], F.lit(""))), "")
        return _turn(role if names is None else F.coalesce(F.try_element_at(names, F.coalesce(role, F.lit(""))), role), text)
    return F.transform(items, one)


def _turns(record: Column, layout: Layout) -> Column:
    found = []
    for t in layout.turns:
        if isinstance(t, Each):
            found.append(_each(record, t))
        elif isinstance(t, Pairs):
            texts = F.flatten(F.transform(F.try_variant_get(record, f"$.{t.path}", "array<array<string>>"), lambda p: F.transform(
                p, lambda x, i: _turn(F.when(i % 2 == 0, F.lit(t.roles[0])).otherwise(F.lit(t.roles[1])), x))))
            found.append(texts)
        else:
            texts = [F.try_variant_get(record, f"$.{p}", "string") for p in t.paths]
            text = texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda x: x != ""), t.glue)
            turn = F.array(_turn(F.lit(t.role), text))
            if set(t.paths) <= set(layout.optional):  # no turn where all its paths are absent
                there = [F.try_variant_get(record, f"$.{p}", "variant").isNotNull() for p in t.paths]
                turn = F.when(functools.reduce(lambda p, q: p | q, there), turn).otherwise(F.array().cast(TURNS))
            found.append(turn)
    return F.concat(*found) if len(found) > 1 else found[0]


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, column: str = "record") -> DataFrame:
    """``records`` with fingerprint, layout and turns, from the JSON text in ``column``."""
    owner: dict[str, int] = {}
    for i, x in enumerate(layouts):
        for s in layout_shapes(x):
            if owner.setdefault(s, i) != i and "ARRAY<>" not in s:
                raise ValueError(f"two layouts share the shape {s}")
    prints = {i: [hashlib.sha256(s.encode()).hexdigest() for s, j in owner.items() if j == i] for i in range(len(layouts))}
    v = F.col("_variant")
    out = records.withColumn("_variant", F.try_parse_json(column)).withColumn("_shape", shape(v)).withColumn(
        "fingerprint", F.when(F.col("_shape").startswith("OBJECT<"), F.sha2(F.col("_shape").cast("binary"), 256)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for i, x in reversed(list(enumerate(layouts))):
        mine = F.col("fingerprint").isin(prints[i])
        layout = F.when(mine, F.lit(x.name)).otherwise(layout)
        turns = F.when(mine, _turns(v, x)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("_variant", "_shape")


def unmapped(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, column: str = "record") -> DataFrame:
    """(fingerprint, shape, records): what no layout covers, for new declarations; both are null for what is no JSON object."""
    out = canonical(records, layouts, column).filter("layout is null")
    paths = F.when(F.col("fingerprint").isNotNull(), shape(F.try_parse_json(column)))
    return out.select("fingerprint", paths.alias("shape")).groupBy("fingerprint", "shape").agg(F.count(F.lit(1)).alias("records"))


# ---- template -----------------------------------------------------------------

def escape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    """Text without control strings: backslashes doubled, one more after the first character of a control string."""
    heads = "".join(sorted({"\\" + c[0] for c in control}))
    tails = "|".join("(?<=" + re.escape(c[0]) + ")" + re.escape(c[1:]) for c in control)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"([{heads}])(?=(?:{tails}))", r"$1\\")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def segments(turns: Column, learn: str = "assistant", control: Sequence[str] = CONTROL) -> Column:
    """array<struct<text, loss>>: per turn its head, its escaped text (loss for the role ``learn``) and its end mark."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.flatten(F.transform(turns, lambda t: F.array(
        piece(F.concat(F.lit(START), escape(t["role"], control), F.lit(MIDDLE)), F.lit(False)),
        piece(escape(t["text"], control), t["role"] == learn), piece(F.lit(END), F.lit(False)))))


def formatted(pieces: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(pieces, lambda s: s["text"]), "")


def read_turns(text: Column) -> Column:
    """Turns read back from a formatted conversation."""
    heads = F.split(text, re.escape(END), -1)
    found = F.transform(F.slice(heads, F.lit(1), F.size(heads) - 1), lambda h: F.split(F.substring(h, len(START) + 1, 1 << 30), re.escape(MIDDLE), -1))
    return F.transform(found, lambda p: _turn(unescape(p[0]), unescape(p[1])))


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


# ---- tables of turns ----------------------------------------------------------

def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from a table of (conv_id, turn, role, text), by turn, then role and text; null roles and texts are empty."""
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", own.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _body(turns: Column) -> tuple[Column, Column]:
    """Whether the first turn is the system's, and the turns after it."""
    lead = F.coalesce(F.get(turns, F.lit(0))["role"] == "system", F.lit(False))
    return lead, F.when(lead, F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def able(turns: Column, layout: Layout) -> Column:
    """Whether a record of this layout (one of ``LAYOUTS``) gives back exactly these turns."""
    _, body = _body(turns)
    talk = (F.size(body) >= 2) & (F.size(body) % 2 == 0) & F.forall(
        F.transform(body, lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    return {"message_parts": F.size(turns) > 0, "from_value": ~F.exists(turns, lambda t: t["role"].isin("human", "gpt")), "history": talk,
            "prompt": talk & (F.size(body) == 2), "instruction": talk & (F.size(body) == 2)}.get(layout.name, F.lit(True))


def render(turns: Column, layout: Layout) -> Column:
    """A JSON record of these turns in one of ``LAYOUTS``, for turns that it is ``able`` to hold."""
    lead, body = _body(turns)
    at = lambda i: F.try_element_at(body, F.lit(i))["text"]
    json = lambda **fields: F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})

    def led(**fields: Column) -> Column:
        return F.when(lead, json(system=F.get(turns, F.lit(0))["text"], **fields)).otherwise(json(**fields))

    def each(**fields) -> Column:
        return F.transform(turns, lambda t: F.struct(*[f(t).alias(k) for k, f in fields.items()]))
    role, text = lambda t: t["role"], lambda t: t["text"]
    if layout.name == "messages":
        return json(messages=each(role=role, content=text))
    if layout.name == "message_parts":
        return json(messages=each(role=role, content=lambda t: F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text")))))
    if layout.name == "from_value":
        named = lambda t: F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
        return json(conversations=each(**{"from": named, "value": text}))
    if layout.name == "nested":
        return json(dialog=F.struct(each(speaker=lambda t: F.struct(t["role"].alias("role")), utterance=text).alias("turns")))
    if layout.name == "history":
        first = F.filter(F.transform(body, lambda t, i: F.when((i % 2 == 0) & (i < F.size(body) - 2), F.array(t["text"], F.get(body, i + 1)["text"]))),
                         lambda x: x.isNotNull())
        return led(history=first, prompt=at(-2), response=at(-1))
    if layout.name == "prompt":
        return led(prompt=at(1), completion=at(2))
    if layout.name == "instruction":
        return led(instruction=at(1), input=F.lit(""), output=at(2))
    raise ValueError(f"no rendering of {layout.name}")


def mixed_records(convs: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, record, given): each conversation as a JSON record in one of the layouts that can hold it, by a hash of its id.

    Conversations with a text too long for the JSON parser have no record; they keep their turns in ``given``.
    """
    fits = ~F.exists("turns", lambda t: (F.length(t["text"]) > LONGEST) | (F.length(t["role"]) > LONGEST))
    can = F.filter(F.array(*[F.when(able(F.col("turns"), x), F.lit(i)) for i, x in enumerate(layouts)]), lambda i: i.isNotNull())
    out = convs.select("conv_id", "turns", fits.alias("fits"), can.alias("can")).withColumn(
        "pick", F.when(F.col("fits"), F.get("can", F.pmod(F.xxhash64("conv_id"), F.size("can")).cast("int"))))
    record = F.lit(None).cast("string")
    for i, x in enumerate(layouts):
        record = F.when(F.col("pick") == i, render(F.col("turns"), x)).otherwise(record)
    return out.select("conv_id", record.alias("record"), F.when(F.col("pick").isNull(), F.col("turns")).alias("given"))


def format_records(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, learn: str = "assistant") -> DataFrame:
    """conv_id, layout and segments of JSON records (conv_id, record[, given]); ``given`` turns are taken where there is no record."""
    out = canonical(records, layouts)
    turns = F.coalesce("turns", "given") if "given" in records.columns else F.col("turns")
    return out.select("conv_id", "layout", segments(turns, learn).alias("segments"))
