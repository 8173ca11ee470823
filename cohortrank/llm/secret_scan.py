"""Secret scans: fixed patterns, and character Markov models of random strings.

Base kinds, leftmost and non-overlapping, as spans of code points (end exclusive):
``assign`` (a keyword, a separator, a value of 6 or more characters), ``access``
(``AKIA`` and capitals or digits, 20 or more) and ``hex`` (24 or more digits).

The method adds ``markov`` spans: every maximal run of ``LEAST`` or more
characters of the alphabet is scored by two first-order Markov models, one of
random strings and one of ordinary identifiers, as the sum of log-likelihood
ratios of its transitions. A run is a secret if the sum is at least ``TOTAL``
and the mean per transition at least ``MEAN`` (in thousandths of a nat), it has a
letter, and no base span overlaps it. The letter keeps out numbers and rules of one
character, which neither model has seen; a random string of 16 characters has none
with a probability of (15/67)^16, 4e-11.

The models are transition counts of labelled samples (text, label): 1 for random
strings, 0 for identifiers. ``document_samples`` labels strings of a corpus: the
values of base matches of all texts, against the words of all texts outside of base
matches and their snake_case and camelCase pairs. Counts are summed before the
shuffle; the model itself is a table of alphabet squared, whatever the corpus.
Without samples a model is uniform.

Everything on the main path is a DataFrame expression. Null texts count as
empty; repeated rows and ids are scanned row by row; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed patterns; the letters of the keywords match in either case
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST, TOTAL, MEAN = 16, 12_000, 600
RUN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"


def _spans(text: Column, pattern: str, kind: str, value: Column | None = None, least: int = 0) -> Column:
    """array<struct(start, kind, end)> of the matches; those with a value shorter than ``least`` are dropped.

    Matches and what lies between them alternate, so starts are running sums of lengths.
    """
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(1)) if value is not None else hits
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    k = F.lit(KINDS.index(kind))

    # lengths first, so that no lambda looks at the text again
    length = lambda array: F.transform(array, lambda x: F.length(x))
    steps = F.zip_with(F.slice(length(between), F.lit(1), F.size(hits)), F.zip_with(length(hits), length(values), lambda h, v: F.struct(h.alias("hit"), v.alias("value"))),
                       lambda g, x: F.struct(g.alias("gap"), x["hit"].alias("hit"), x["value"].alias("value")))
    own = lambda x, end: F.when(x["value"] >= least, F.struct((end - x["hit"]).alias("start"), k.alias("kind"), end.alias("end")))
    found = _let(steps, lambda xs: F.filter(F.zip_with(xs, _running(F.transform(xs, lambda x: x["gap"] + x["hit"])), own), lambda x: x.isNotNull()))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(array: Column, size: int) -> Column:
    """The array cut into arrays of ``size``; ``array`` must be a lambda's variable, since it is used once per piece."""
    n = F.ceil(F.size(array) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(array, i * size + 1, F.lit(size)))).otherwise(F.array(F.slice(array, 1, 0)))


def _fold(array: Column, start: Column) -> Column:
    """Running sums of a short array, from ``start``; each step copies what there is so far."""
    return F.aggregate(array, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
                       lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")), lambda s: s["out"])


def _running(array: Column, size: int = 64) -> Column:
    """Running sums, by pieces of ``size`` and the pieces' own running sums, so that long arrays don't take the square of their length."""
    def over(pieces: Column) -> Column:
        sums = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return _let(_let(sums, lambda t: F.flatten(_let(_pieces(t, size), lambda tt: F.zip_with(
            tt, _let(F.transform(tt, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), lambda u: F.zip_with(_fold(u, F.lit(0)), u, lambda e, x: e - x)),
            _fold)))), lambda ends: F.flatten(F.zip_with(pieces, F.zip_with(ends, sums, lambda e, x: e - x), _fold)))
    return _let(array, lambda xs: _let(_pieces(xs, size), over))


def _clear(hits: Column, base: Column, sizes: tuple[int, ...] = (4096, 64)) -> Column:
    """Those of ``hits`` (by start, apart from each other) that no span of ``base`` overlaps.

    Pieces of the hits meet only the base spans within their reach, and so do pieces of the pieces.
    """
    apart = lambda h, b: (b["start"] >= h["end"]) | (b["end"] <= h["start"])
    if not sizes:
        return F.filter(hits, lambda h: F.forall(base, lambda b: apart(h, b)))

    def piece(c: Column) -> Column:
        low, high = F.get(c, F.lit(0))["start"], F.element_at(c, -1)["end"]
        return _let(F.struct(low.alias("start"), high.alias("end")), lambda r: _let(F.filter(base, lambda b: ~apart(r, b)), lambda near: _clear(c, near, sizes[1:])))
    return F.when(F.size(hits) > 0, F.flatten(F.transform(_pieces(hits, sizes[0]), piece))).otherwise(hits)


def base_spans(text: Column) -> Column:
    """Base spans of a text, by start and kind."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", text, MIN_VALUE), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def document_samples(docs: DataFrame) -> DataFrame:
    """(text, label, times): values of base matches as random strings, words and joined words as identifiers.

    Identifiers are a word, the word with the next one in camelCase and in
    snake_case (the last word with nothing). They are given as pieces with the same
    transitions in sum, so that only different words leave a task: each word by
    its cases, and the two characters at each joint.
    """
    own = docs.select(F.coalesce("text", F.lit("")).alias("t"))
    own = own.withColumn("hit", F.col("t").rlike(ASSIGN) | F.col("t").rlike(ACCESS) | F.col("t").rlike(HEX))
    values = F.concat(F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= MIN_VALUE),
                      F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    rest = F.when(F.col("hit"), F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")).otherwise(F.col("t"))
    words = F.regexp_extract_all(rest, F.lit("(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])"), F.lit(0))
    own = own.select(F.when(F.col("hit"), values).otherwise(F.array().cast("array<string>")).alias("v"), words.alias("w"))
    marked = lambda array, kind: F.transform(array, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("s")))
    joints = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, 1 << 30),
                        lambda a, b: F.concat(F.right(a, F.lit(1)), F.left(b, F.lit(1))))
    pieces = F.concat(marked("v", "value"), marked("w", "word"), marked(F.slice("w", 1, 1), "first"), marked(joints, "joint"))
    counted = own.select(F.explode(pieces).alias("x")).select(
        F.when(F.col("x.kind") == "first", "word").otherwise(F.col("x.kind")).alias("kind"), F.col("x.s").alias("s"),
        (F.col("x.kind") != "first").cast("long").alias("n"), (F.col("x.kind") == "first").cast("long").alias("f")).groupBy("kind", "s").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"))
    s, n, later = F.col("s"), F.col("n"), F.col("n") - F.col("f")  # later: has a word before it in its text
    sample = lambda text, label, times: F.struct(text.alias("text"), F.lit(label).alias("label"), times.alias("times"))
    low = F.lower(s)
    parts = F.when(F.col("kind") == "value", F.array(sample(s, 1, n))).when(
        F.col("kind") == "joint", F.array(sample(F.concat(F.left(s, F.lit(1)), F.upper(F.right(s, F.lit(1)))), 0, n))).otherwise(F.array(
            sample(s, 0, 2 * n), sample(F.initcap(s), 0, later), sample(low, 0, n + later),
            sample(F.concat(F.right(low, F.lit(1)), F.lit("_")), 0, n), sample(F.concat(F.lit("_"), F.left(low, F.lit(1))), 0, later)))
    return counted.select(F.explode(parts).alias("x")).select("x.*").filter("times > 0")


def _codes(token: Column) -> Column:
    """Places of a token's characters in the alphabet, from 1; other characters are left out."""
    return F.filter(F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))), lambda i: i > 0)


def train(samples: DataFrame, smoothing: float = 0.5, backing: float = 8.0) -> list[int]:
    """Log-likelihood ratios of all transitions, row by row, in thousandths of a nat (random over ordinary).

    A transition's probability is its share among those from the same character,
    drawn towards the share of the next character alone with a weight of ``backing``
    observations; that share is smoothed by ``smoothing``. A sample counts ``times`` times,
    if there is such a column.
    """
    n = len(ALPHABET)
    times = F.col("times") if "times" in samples.columns else F.lit(1)
    codes = samples.filter("text is not null and label in (0, 1)").select("label", times.alias("times"), _codes(F.col("text")).alias("c")).filter(F.size("c") > 1)
    steps = codes.select("label", "times", F.explode(F.zip_with("c", F.slice("c", 2, 1 << 30), lambda a, b: (a - 1) * n + b - 1)).alias("step")).filter("step is not null")
    counts = {0: [0] * (n * n), 1: [0] * (n * n)}
    for label, step, count in steps.groupBy("label", "step").agg(F.sum("times")).collect():  # alphabet squared rows at most, for each label
        counts[label][step] = count
    logs = {}
    for k, c in counts.items():
        following = [sum(c[b::n]) + smoothing for b in range(n)]
        share = [x / sum(following) for x in following]
        logs[k] = [math.log((c[a * n + b] + backing * share[b]) / (sum(c[a * n:a * n + n]) + backing)) for a in range(n) for b in range(n)]
    return [round(1000 * (x - y)) for x, y in zip(logs[1], logs[0], strict=True)]


def markov_spans(text: Column, base: Column, model: list[int], total: int = TOTAL, mean: int = MEAN) -> Column:
    """Spans of random-looking runs that no base span overlaps."""
    n = len(ALPHABET)
    table = F.expr(f"cast(split('{','.join(map(str, model))}', ',') as array<int>)")
    hits = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    spans = _spans(text, RUN, "markov")
    ratio = F.transform(hits, lambda h: F.aggregate(
        _codes(h), F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] == 0, 0).otherwise(F.get(table, (s["last"] - 1) * n + c - 1))).alias("sum")),
        lambda s: s["sum"]))
    ratio = F.zip_with(hits, ratio, lambda h, r: F.when(h.rlike("[A-Za-z]"), r))
    marked = F.zip_with(spans, ratio, lambda s, r: F.struct(s.alias("s"), ((r >= total) & (r >= mean * (s["end"] - s["start"] - 1))).alias("hit")))
    good = F.transform(F.filter(marked, lambda m: m["hit"]), lambda m: m["s"])
    return _let(good, lambda hits: F.when(F.size(hits) > 0, _let(base, lambda b: _clear(hits, b))).otherwise(hits))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[int]) -> DataFrame:
    """doc_id, base and spans (array<struct(start, kind, end)>, by start and kind; ``KINDS`` names the kinds)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", markov_spans(F.col("t"), F.col("base"), model))).alias("spans"))
