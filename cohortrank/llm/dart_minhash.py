"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its runs of ``SHINGLE`` words (a shorter text is one
run). A run weighs the bytes of its words, held between ``LIGHT`` and ``HEAVY``,
over ``HEAVY``: runs of short words say less of a text than runs of long ones. The
weight depends on the run alone, not on how often a text repeats it. Signatures
estimate the weighted Jaccard similarity: weight of the common runs over weight of
all runs. A pair is linked if the weighted similarity is ``SIMILARITY`` or more, and
also if the plain one is (number of common runs over number of all), so that no pair
is lost to the weights. At a plain similarity of 0.8 the weighted one is mostly
within 0.01; it can't be below 0.71, which takes light common runs and heavy others.
Darts are thrown
at the plane (weight x rank) of every run: a Poisson process of one dart per
unit of area, made from the run's hash, so equal runs of different texts get
equal darts. A dart hits if its weight lies below the run's weight; it carries
one of ``K`` coordinates, and each coordinate keeps the hit of least rank.
Two texts agree in a coordinate with the probability of their similarity. Ranks up to (K ln K + 2 K) / total weight are thrown first; texts
with an empty coordinate go on to twice the rank, and so on.

1. ``signatures``: one pass over the text. Equal word sequences form a class,
   and only one of each class goes on.
2. Banding: ``BANDS`` bands of ``ROWS`` coordinates; buckets with one class go.
3. Each bucket has a centre, its most popular class (most bucket mates over all
   bands, which is the original of a group of edited copies). A class is paired
   with the most popular of its centres only, so a group of copies gives one
   pair per class. Pairs whose signatures agree in fewer than
   ``LEAST_AGREEMENT`` are dropped, the others are checked exactly.
4. Components of the links found. In buckets that still hold several
   components, every pair across components is compared by signature and, if it
   agrees, exactly, in blocks of ``BLOCK`` classes. A pair of blocks gives a
   forest of links, not the pairs.
5. Every text gets the smallest doc_id of its component.

A bucket, centre or class with a third of all texts is split: counts and maxima
are pre-aggregated, stars are dealt out by (centre, slice of its members) and
blocks by (bucket, pair of blocks). At 0.8 similarity a pair shares no bucket
with probability 7e-5, and agrees too little with about 2e-5.

Null and empty texts have no run and stay alone. Rows with a null id join
groups but name them only if no other row does. Repeated rows are exact copies of each other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._graph import components
from ._steps import step

SHINGLE, SIMILARITY = 5, 0.8
LIGHT, HEAVY = 20, 32
_LOW = np.uint64(31)  # the lowest bits of a run's code, its weight less LIGHT
BANDS, ROWS = 24, 5
K = BANDS * ROWS
LEAST_AGREEMENT, BLOCK, BLOCK_BYTES, STAR = 0.65, 256, 8 << 20, 256
RANK_BITS = 20
_TOP = (1 << 12) - 1
_LAST = (1 << 63) - 1  # stands for a null id, behind all others
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def weights(codes: np.ndarray) -> np.ndarray:
    """Weights of runs, LIGHT to HEAVY, from their codes."""
    return (codes & _LOW).astype(np.int64) + LIGHT


def _near(common, one, other, similarity: float):
    """Whether a common measure (weight or number of runs) is a share of at least ``similarity`` in that of the union."""
    return common >= similarity * (one + other - common) - 1e-9


def shingles(words: np.ndarray, lengths: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Different runs of every text: (code, text), by text and code. A code is a 59-bit hash of the words' hashes, and the weight."""
    n = np.diff(first)
    start, doc = tx.windows(first, size)
    short = np.flatnonzero((n > 0) & (n < size))
    start = np.concatenate((start, first[:-1][short]))
    end = np.concatenate((start[:len(doc)] + size, first[1:][short]))
    doc = np.concatenate((doc, short))
    total = np.concatenate(([0], np.cumsum(lengths)))
    weight = np.clip(total[end] - total[start], LIGHT, HEAVY) - LIGHT
    h = (tx.run_hash(words, start, end, 1) & ~_LOW) | weight.astype(np.uint64)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], doc[fresh]


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the index of each copy, and its number among the copies."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def throw(sig: np.ndarray, h: np.ndarray, weight: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Throw the darts of ranks low <= rank < high (per text) and keep the earliest in ``sig`` (texts, K)."""
    c1, c2, c3 = (np.uint64(b) for b in tx.BASES)
    strip_of, strip = _expand(np.ceil(weight).astype(np.int64))
    base = tx.mix(h[strip_of] ^ (strip.astype(np.uint64) * c1))
    first_cell = np.floor(low).astype(np.int64)
    cells = (np.ceil(high).astype(np.int64) - first_cell)[doc[strip_of]]
    at, cell = _expand(cells)
    cell += first_cell[doc[strip_of[at]]]
    area = tx.mix(base[at] + cell.astype(np.uint64) * c2)
    darts = np.searchsorted(_POISSON, (area >> np.uint64(11)).astype(np.float64) / 2.0 ** 53, side="right")
    i, nth = _expand(darts)
    g = tx.mix(area[i] + (nth + 1).astype(np.uint64) * c3)
    rank = (cell[i].astype(np.uint64) << np.uint64(RANK_BITS)) | (g >> np.uint64(64 - RANK_BITS))
    run = strip_of[at[i]]
    d = doc[run]
    hit = strip[at[i]] + ((g >> np.uint64(24)) & np.uint64(0xFFFFF)).astype(np.float64) / 2.0 ** 20 < weight[run]
    hit &= (rank < (high[d] * (1 << RANK_BITS)).astype(np.uint64)) & (rank >= (low[d] * (1 << RANK_BITS)).astype(np.uint64))
    g, d, rank = g[hit], d[hit], rank[hit]
    slot = (g & np.uint64(0xFFFFFF)) * np.uint64(K) >> np.uint64(24)
    value = (rank << np.uint64(32)) | (tx.mix(g) & np.uint64(0xFFFFFFFF))
    np.minimum.at(sig, (d, slot.astype(np.int64)), value)


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def dart_signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(texts, K) signatures of weighted sets; rows of texts without runs stay empty."""
    sig = np.full((n_docs, K), EMPTY, np.uint64)
    total = np.bincount(doc, weight, n_docs)
    todo = total > 0
    low = np.zeros(n_docs)
    high = np.where(todo, (K * math.log(K) + 2 * K) / np.maximum(total, 1e-9), 0.0).clip(0, _TOP)
    while todo.any():
        # a text at a time gets at most some hundred thousand cells; texts go in groups of that much work
        work = np.cumsum(np.where(todo, np.ceil(high - np.floor(low)) * np.bincount(doc, np.ceil(weight), n_docs), 0))
        for part in range(int(work[-1] // 400_000) + 1):
            here = todo & (work // 400_000 == part)
            use = here[doc]
            if use.any():
                throw(sig, h[use], weight[use], doc[use], low, high)
        todo = todo & (sig == EMPTY).any(axis=1) & (high < _TOP)
        low, high = np.where(todo, high, low), np.where(todo, (2 * high).clip(0, _TOP), high)
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hash of each band, the band's number included."""
    cells = sig.reshape(-1, ROWS)
    h = tx.mix(cells[:, 0])
    for i in range(1, ROWS):
        h = tx.join(h, cells[:, i])
    return tx.mix(h + np.tile(np.arange(BANDS, dtype=np.uint64), len(sig)) * np.uint64(tx.BASES[0])).reshape(len(sig), BANDS)


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, _d, _k, h1, h2, bands, sig) per row; h1, h2 (of the words), bands and sig are null without words."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "_d", "_k", "h1", "h2")] + [("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(it):
        for b in it:
            for a, n, data, off in tx.string_chunks(b.column("text")):
                ws, we, first = tx.tokens(data, off)
                h, doc = shingles(tx.word_hashes(data, ws, we), we - ws, first)
                sig = dart_signatures(h, doc, weights(h) / HEAVY, n)
                some = np.diff(first) > 0
                prints = [hashlib.blake2b(b" ".join(data[off[i]:off[i + 1]].tobytes().split()), digest_size=16).digest() for i in range(n)]
                ids = [pa.array(np.ascontiguousarray(x).view(np.int64), mask=~some) for x in np.frombuffer(b"".join(prints), "<u8").reshape(n, 2).T]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands_of(sig).reshape(-1).view(np.int64)), mask=pa.array(~some))
                prints = (tx.mix(sig) & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(a, n) for c in ("doc_id", "_d", "_k")] + ids + [
                    bands, pa.array([p.tobytes() if s else None for p, s in zip(prints, some, strict=True)], pa.binary())], schema=schema)
    return rows.select("doc_id", "_d", "_k", "text").mapInArrow(
        tx.tidy(run), "doc_id long, _d long, _k long, h1 long, h2 long, bands array<long>, sig binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: float = LEAST_AGREEMENT) -> DataFrame:
    """Those pairs (a, b) whose signatures agree in at least that share of the coordinates."""
    j = pairs.join(sigs.select(F.col("nid").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("nid").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(it):
        for t in it:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sa", "sb"))
            keep = (x == y).mean(axis=1) >= least if len(t) else np.zeros(0, bool)
            yield t.select(["a", "b"]).filter(pa.array(keep))
    return j.mapInArrow(tx.tidy(run), "a long, b long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, runs): ascending codes of the different runs, of the wanted (_d, _k, nid)."""
    def run(it):
        schema = pa.schema([("nid", pa.int64()), ("runs", pa.binary())])
        for b in it:
            for a, n, data, off in tx.string_chunks(b.column("text")):
                ws, we, first = tx.tokens(data, off)
                h, doc = shingles(tx.word_hashes(data, ws, we), we - ws, first)
                o = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([b.column("nid").slice(a, n), pa.array([h[o[i]:o[i + 1]].tobytes() for i in range(n)], pa.binary())], schema=schema)
    return rows.join(wanted, ["_d", "_k"]).select("nid", "text").mapInArrow(tx.tidy(run), "nid long, runs binary")


def _exact(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sets have a weighted or plain Jaccard similarity >= similarity. ``a`` is shipped once per slice of STAR partners."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("slices"))
    dealt = pairs.join(slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")))
    heads = slices.join(sets.withColumnRenamed("nid", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("b"), "runs")
    tails = dealt.join(sets.withColumnRenamed("nid", "b"), "b").select("a", "slice", "b", "runs")
    order = ["a", "slice", F.col("b").asc_nulls_first()]
    both = heads.unionByName(tails).repartition("a", "slice").sortWithinPartitions(*order)

    def run(it):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        head, heavy = None, 0
        for t in it:
            out: dict[str, list] = {"a": [], "b": []}
            for a, b, runs in zip(*(t.column(c).to_pylist() for c in ("a", "b", "runs")), strict=True):
                x = np.frombuffer(runs, np.uint64)
                if b is None:
                    head, heavy = x, int(weights(x).sum())
                    continue
                small, large = (x, head) if len(x) < len(head) else (head, x)
                at = np.searchsorted(large, small)
                common = small[large[np.minimum(at, len(large) - 1)] == small]
                if _near(weights(common).sum(), weights(x).sum(), heavy, similarity) or _near(len(common), len(x), len(head), similarity):
                    out["a"].append(a)
                    out["b"].append(b)
            yield tx.batches(out, schema)
    return both.select("a", "b", "runs").mapInArrow(tx.tidy(run), "a long, b long").distinct()


def _common(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and sizes of all pairwise intersections, by matrix products over the runs that occur twice."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    runs, at, times = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    use = times[at] > 1
    owner, at = owner[use], place[at[use]]
    weight = weights(runs)[times > 1].astype(np.float32)
    heavy, number = np.zeros((len(sets), len(sets))), np.zeros((len(sets), len(sets)))
    for low in range(0, int((times > 1).sum()), 8192):
        here = (at >= low) & (at < low + 8192)
        x = np.zeros((len(sets), 8192), np.float32)
        x[owner[here], at[here] - low] = 1
        own = np.zeros(8192, np.float32)
        own[:len(weight[low:low + 8192])] = weight[low:low + 8192]
        heavy += (x * own) @ x.T  # whole numbers below 2^24
        number += x @ x.T
    return heavy, number


def block_links(nid: np.ndarray, comp: np.ndarray, mine: np.ndarray, sig: np.ndarray, bands: np.ndarray, sets: list[np.ndarray],
                bucket: int, alone: bool, similarity: float) -> list[tuple[int, int]]:
    """Links of a forest over the components in one pair of blocks of a bucket (``alone``: a block with itself).

    A pair is looked at in the first bucket that both of its classes lie in.
    """
    pairs_i, pairs_j = [], []
    for i in range(len(nid) - 1):
        far = (comp[i + 1:] != comp[i]) & (alone | (mine[i + 1:] != mine[i]))
        j = np.flatnonzero(far) + i + 1
        if len(j):
            j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == bucket]
            j = j[(sig[j] == sig[i]).mean(axis=1) >= LEAST_AGREEMENT]
            pairs_i += [i] * len(j)
            pairs_j += j.tolist()
    if not pairs_i:
        return []
    i, j = np.array(pairs_i), np.array(pairs_j)
    weight, size = (np.array([f(x) for x in sets]) for f in (lambda x: int(weights(x).sum()), len))
    heavy, number = _common(sets)
    near = _near(heavy[i, j], weight[i], weight[j], similarity) | _near(number[i, j], size[i], size[j], similarity)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    out = []
    for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
        x, y = root(int(comp[a])), root(int(comp[b]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(nid[a]), int(nid[b])))
    return out


def _across(buckets: DataFrame, kinds: DataFrame, sets: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket and lie in different components, a forest per pair of blocks."""
    own = buckets.select("v", "nid").join(groups.withColumnRenamed("id", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    per = own.groupBy("v", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("v").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).filter("groups > 1")
    full = own.join(per.select("v", "n"), "v").join(kinds.select("nid", "sig", "bands"), "nid").join(sets.dropDuplicates(["nid"]), "nid")
    left = step(full, "contested")
    size = left.groupBy("v").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("runs")) / BLOCK_BYTES)).alias("blocks"))
    left = left.join(size, "v").withColumn("mine", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("p"), F.greatest("mine", o).alias("q")))
    columns = ["mine", "nid", "component", "sig", "bands", "runs"]
    dealt = left.select("v", *columns, F.explode(every).alias("pq")).select("v", "pq.p", "pq.q", *columns).repartition("v", "p", "q").sortWithinPartitions("v", "p", "q", "nid")

    def run(it):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, rows = None, []
        links: list = []

        def close():
            if len(rows) > 1:
                mine, nid, comp, sig, bands, runs = zip(*rows, strict=True)
                links.extend(block_links(np.array(nid), np.array(comp), np.array(mine), np.frombuffer(b"".join(sig), np.uint8).reshape(-1, K), np.array(bands),
                                         [np.frombuffer(r, np.uint64) for r in runs], key[0], key[1] == key[2], similarity))
        for t in it:
            for v, p, q, *row in zip(*(t.column(c).to_pylist() for c in ("v", "p", "q", *columns)), strict=True):
                if (v, p, q) != key:
                    close()
                    key, rows = (v, p, q), []
                rows.append(row)
            yield tx.batches({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema)
            links.clear()
        close()
        yield tx.batches({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema)
    return dealt.mapInArrow(tx.tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, class_id (smallest doc_id of the group), group_size, kept; a row per row of ``docs``.

    ``kept`` marks one row of each group, the first by id and ``text_hash``
    (xxhash64 of the text); rows equal in both are kept together.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_d"),
                       F.xxhash64("text").alias("_k"), "text")
    signed = step(signatures(rows), "darts")
    kinds = step(signed.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("_d", "_k")).alias("row"), F.any_value("bands").alias("bands"),
        F.any_value("sig").alias("sig")).withColumn("nid", F.monotonically_increasing_id()), "kinds")
    members = kinds.select("nid", F.explode("bands").alias("v"))
    shared = members.groupBy("v").agg(F.count(F.lit(1)).alias("shared")).filter("shared > 1")
    buckets = step(members.join(shared, "v"), "buckets")
    popular = buckets.groupBy("nid").agg(F.sum("shared").alias("mates"))
    ranked = buckets.join(popular, "nid")
    centre = ranked.groupBy("v").agg(F.max(F.struct("mates", (-F.col("nid")).alias("nid"))).alias("c"))
    best = buckets.join(centre, "v").filter(F.col("nid") != -F.col("c.nid")).groupBy("nid").agg(F.max("c").alias("c"))
    star = step(_agreeing(best.select((-F.col("c.nid")).alias("a"), F.col("nid").alias("b")), kinds), "star")

    wanted = popular.join(kinds.select("nid", "row"), "nid").select("nid", F.col("row._d").alias("_d"), F.col("row._k").alias("_k"))
    sets = step(_sets(rows, wanted), "sets")
    links = step(_exact(star, sets, similarity), "links")
    links = links.union(_across(buckets, kinds, sets, components(links), similarity))
    group = components(links)
    named = kinds.select("h1", "h2", "nid", "row", "copies").join(group.withColumnRenamed("id", "nid"), "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    names = named.groupBy("component").agg(F.min("row").alias("head"), F.sum("copies").alias("group_size"))
    named = named.join(names, "component").select("h1", "h2", "head", "group_size")
    out = signed.select("doc_id", "_d", "_k", "h1", "h2").join(named, ["h1", "h2"], "left")
    own = F.coalesce((F.col("head._d") == F.col("_d")) & (F.col("head._k") == F.col("_k")), F.lit(True))
    return out.select("doc_id", F.col("_k").alias("text_hash"), F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(
        F.nullif(F.col("head._d"), F.lit(_LAST))).alias("class_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), own.alias("kept"))
