"""Embedding near-dedup: similarity join in epsilon grid order.

Two vectors of length one have cosine >= t where their distance is at most
``eps = sqrt(2 - 2 t)``. Vectors are rotated to leading principal axes (fitted
on a bounded sample; any axes give right results, good ones prune better), cut
into grid cells of side eps, and sorted by cell, axis by axis. The sequence is
cut into blocks of ``BLOCK`` vectors; intervals of blocks are joined
recursively, level by level: a pair of intervals whose bounding boxes on the
leading axes are more than eps apart is skipped, else its children are paired.
The length of what lies off the axes is one more coordinate of the boxes. Pairs of
blocks that stay are joined by the same recursion down to ``LEAF`` vectors and then
by matrix products in double precision; a task takes the pairs between two intervals
of ``FAN`` blocks, so a block travels once to each interval it meets, not to each block.

Equal vectors are one row with a count before the join, so a vector that a
third of all rows share costs one row. Pairs are never listed: a block pair
gives a count of links per vector and a spanning forest (less than one edge per
vector); components follow from the forests. No pair above the threshold is
lost: boxes on some axes never overstate a distance.

Null or zero vectors and vectors with a null or non-finite component link with
nothing and are components of their own. Vectors of different lengths never
link. Rows with a null id count as vectors; they name a component only if all
its ids are null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from . import _text as tx
from ._graph import components
from ._steps import step

THRESHOLD, AXES, BLOCK, LEAF, FAN, SAMPLE = 0.9, 8, 2048, 128, 8, 4096
BLOCK_BYTES = 8 << 20
SLACK = 1e-9  # on the squared distance, for rounding in the boxes


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows brought to length one in double precision."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(blobs: list[bytes], kind: str = "f8") -> np.ndarray:
    """Stored vectors as doubles, shorter ones filled up with zeros."""
    rows = [np.frombuffer(b, f"<{kind}") for b in blobs]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def principal_axes(sample: list[bytes], axes: int = AXES) -> np.ndarray:
    """(axes, dims) leading right singular vectors of the centred unit rows."""
    x = unit_rows(_matrix(sample))
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:axes]


def _project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows on the axes, and the length of what lies off them as one more coordinate.

    Both lengths being known, two such remainders are at least their difference apart.
    A vector longer or shorter than the axes is cut or filled up with zeros.
    """
    n = min(x.shape[1], axes.shape[1])
    p = x[:, :n] @ axes[:, :n].T
    return np.concatenate((p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1, keepdims=True)))), axis=1)


def _forest(parent: dict[int, int], edges) -> None:
    def root(i):
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i
    for i, j in edges:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)


def _span(mask: np.ndarray):
    """A spanning forest of a bipartite mask, as (row, column) pairs along least labels."""
    n, m = mask.shape
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    sub = mask[np.ix_(rows, cols)]
    seen_r, seen_c = np.zeros(len(rows), bool), np.zeros(len(cols), bool)
    for start in range(len(rows)):
        if seen_r[start]:
            continue
        seen_r[start] = True
        front = np.array([start])
        while len(front):
            fresh = sub[front].any(axis=0) & ~seen_c
            at = np.flatnonzero(fresh)
            seen_c |= fresh
            yield from zip(rows[front[sub[np.ix_(front, at)].argmax(axis=0)]].tolist(), cols[at].tolist(), strict=True)
            more = sub[:, at].any(axis=1) & ~seen_r if len(at) else np.zeros(len(rows), bool)
            new = np.flatnonzero(more)
            if len(new):
                yield from zip(rows[new].tolist(), cols[at[sub[np.ix_(new, at)].argmax(axis=1)]].tolist(), strict=True)
            seen_r |= more
            front = new


def join_blocks(a: dict, b: dict | None, threshold: float, leaf: int = LEAF):
    """Links between two blocks, or inside one (b is None).

    A block: x (unit rows), p (on the axes), dim, n (copies of each), all in
    grid order. Returns (links of a's rows, links of b's rows, forest edges as
    row numbers, b's shifted by the size of a).
    """
    reach = 2 - 2 * threshold + SLACK
    inner = b is None
    b = a if inner else b
    na = len(a["n"])
    links_a, links_b = np.zeros(na, np.int64), np.zeros(len(b["n"]), np.int64)
    parent: dict[int, int] = {}
    shift = 0 if inner else na
    width = min(a["x"].shape[1], b["x"].shape[1])
    todo = [(0, na, 0, len(b["n"]))]
    boxes: dict = {}

    def box(side, lo, hi):
        if (side, lo, hi) not in boxes:
            p = (a if side == 0 else b)["p"][lo:hi]
            boxes[side, lo, hi] = p.min(axis=0), p.max(axis=0)
        return boxes[side, lo, hi]
    while todo:
        al, ah, bl, bh = todo.pop()
        if al == ah or bl == bh or inner and bh <= al:
            continue
        (lo1, hi1), (lo2, hi2) = box(0, al, ah), box(0 if inner else 1, bl, bh)
        gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
        if (gap * gap).sum() > reach:
            continue
        if ah - al > leaf or bh - bl > leaf:
            # halves at multiples of the leaf, so that both sides of an inner join are cut alike
            def halves(lo, hi):
                mid = lo + max(leaf, (hi - lo) // 2 // leaf * leaf)
                return [(lo, hi)] if hi - lo <= leaf else [(lo, mid), (mid, hi)]
            todo += [(*p, *q) for p in halves(al, ah) for q in halves(bl, bh) if not inner or q[0] >= p[0]]
            continue
        # blocks of other widths: what is cut off belongs to lengths that one side lacks
        mask = (a["x"][al:ah, :width] @ b["x"][bl:bh, :width].T >= threshold) & (a["dim"][al:ah, None] == b["dim"][None, bl:bh])
        same = inner and al == bl
        if same:
            np.fill_diagonal(mask, False)
        if not mask.any():
            continue
        links_a[al:ah] += mask @ b["n"][bl:bh]
        if not same:
            links_b[bl:bh] += a["n"][al:ah] @ mask
        _forest(parent, ((al + i, shift + bl + j) for i, j in _span(mask)))
    if inner:
        links_a += links_b
    edges = [(i, p) for i, p in parent.items() if p != i]
    return links_a, links_b, edges


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, and two hashes of it (null where the vector links with nothing)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                    & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return rows.withColumn("e1", F.when(ok, F.xxhash64("embedding"))).withColumn("e2", F.when(ok, F.xxhash64(F.lit("second"), "embedding")))


def _blocks(kinds: DataFrame, axes: np.ndarray, threshold: float, block: int, kind: str = "f8") -> DataFrame:
    """The sorted sequence in blocks: (part, chunk, lo, hi, nids, ns, dims, v). Vectors are stored as ``kind`` (f4 or f8)."""
    side = math.sqrt(2 - 2 * threshold + SLACK)
    n_axes, width = len(axes) + 1, int(kind[1])

    def cells(it):
        for b in it:
            blobs = [np.asarray(x, f"<{kind}").tobytes() for x in b.column("embedding").to_pylist()]
            p = _project(unit_rows(_matrix(blobs, kind)), axes) if len(b) else np.zeros((0, n_axes))
            cell = np.floor(p / side).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("nid"), b.column("n"), pa.array([len(x) // width for x in blobs], pa.int32()), pa.array(blobs, pa.binary()),
                                              *(pa.array(cell[:, i]) for i in range(n_axes))], names=["nid", "n", "dim", "v", *(f"c{i}" for i in range(n_axes))])
    order = [f"c{i}" for i in range(n_axes)] + ["nid"]
    ddl = "nid long, n long, dim int, v binary, " + ", ".join(f"c{i} int" for i in range(n_axes))
    parts = shuffle_partitions(kinds.sparkSession)
    ordered = kinds.select("nid", "n", "embedding").mapInArrow(tx.tidy(cells), ddl).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(it):
        from pyspark import TaskContext
        part, chunk, held = TaskContext.get().partitionId(), 0, None
        schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
                            ("nids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("v", pa.list_(pa.binary()))])

        def give(t):
            p = _project(unit_rows(_matrix(t.column("v").to_pylist(), kind)), axes)
            return pa.RecordBatch.from_pylist([{"part": part, "chunk": chunk, "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist(),
                                                "nids": t.column("nid").to_pylist(), "ns": t.column("n").to_pylist(), "v": t.column("v").to_pylist()}], schema=schema)
        for b in it:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held) >= block:
                yield give(held.slice(0, block))
                held, chunk = held.slice(block), chunk + 1
        if held is not None and len(held):
            yield give(held)
    return ordered.select("nid", "n", "v").mapInArrow(
        tx.tidy(pack), "part long, chunk long, lo array<double>, hi array<double>, nids array<long>, ns array<long>, v array<binary>")


def _block_pairs(boxes: DataFrame, n_blocks: int, axes: int, threshold: float) -> DataFrame:
    """(i, j), i <= j: pairs of blocks whose boxes are near, by recursion over intervals of the sequence."""
    spark = boxes.sparkSession
    levels = max(1, math.ceil(math.log(max(n_blocks, 2), FAN) - 1e-9))
    pairs = spark.createDataFrame([(0, 0)], "i long, j long")
    near = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.l{k}") - F.col(f"b.h{k}"), F.col(f"b.l{k}") - F.col(f"a.h{k}")), 2) for k in range(axes)), F.lit(0.0)) <= 2 - 2 * threshold + SLACK
    for level in range(levels - 1, -1, -1):
        span = FAN ** level
        at = boxes.groupBy(F.floor(F.col("num") / span).cast("long").alias("g")).agg(
            *(F.min(F.col("lo")[k]).alias(f"l{k}") for k in range(axes)), *(F.max(F.col("hi")[k]).alias(f"h{k}") for k in range(axes)))
        kids = F.sequence(F.lit(0), F.lit(FAN - 1))
        child = pairs.select((F.col("i") * FAN).alias("i0"), (F.col("j") * FAN).alias("j0"), F.explode(kids).alias("x")).select(
            (F.col("i0") + F.col("x")).alias("i"), "j0", F.explode(kids).alias("y")).select("i", (F.col("j0") + F.col("y")).alias("j")).filter("i <= j")
        pairs = step(child.join(at.alias("a"), F.col("i") == F.col("a.g")).join(at.alias("b"), F.col("j") == F.col("b.g")).filter(near).select("i", "j"), "ego")
    return pairs


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = _keyed(vectors)
    kinds = step(rows.filter("e1 is not null").groupBy("e1", "e2").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"), F.any_value("embedding").alias("embedding")).withColumn(
        "nid", F.monotonically_increasing_id()), "vectors")
    dims = kinds.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    found = None
    if dims is not None:
        sample = kinds.filter(F.size("embedding") == dims["d"]).orderBy(F.xxhash64("e1"), "e1", "e2").limit(SAMPLE).select("embedding").collect()
        axes = principal_axes([np.asarray(r[0], np.float64).tobytes() for r in sample])
        # float vectors stay floats on the way; every product is one of doubles
        kind = "f4" if "float" in dict(vectors.dtypes)["embedding"] else "f8"
        block = max(1, min(block, BLOCK_BYTES // (8 * max(dims["d"], 1))))
        blocks = step(_blocks(kinds, axes, threshold, block, kind), "blocks")
        offsets, total = {}, 0
        for part, n in sorted(tuple(r) for r in blocks.groupBy("part").count().collect()):  # a row per task
            offsets[part], total = total, total + n
        number = F.element_at(F.create_map(*[F.lit(int(x)) for kv in offsets.items() for x in kv]), F.col("part")) + F.col("chunk")
        blocks = blocks.withColumn("num", number.cast("long"))
        pairs = _block_pairs(blocks.select("num", "lo", "hi"), total, len(axes) + 1, threshold)
        # a unit of work is a pair of intervals of FAN blocks: each block travels once to it, and its pairs are joined there
        at = lambda c: F.floor(F.col(c) / FAN).cast("long")
        units = pairs.select(at("i").alias("ui"), at("j").alias("uj"), "i", "j")
        lists = units.groupBy("ui", "uj").agg(F.collect_list(F.struct("i", "j")).alias("pairs"))  # FAN x FAN at most
        needs = units.select("ui", "uj", F.explode(F.array("i", "j")).alias("num")).distinct()
        rows_ = needs.join(blocks.select("num", "nids", "ns", "v"), "num").select("ui", "uj", "num", F.lit(None).cast("array<struct<i:long,j:long>>").alias("pairs"), "nids", "ns", "v")
        heads = lists.select("ui", "uj", F.lit(-1).cast("long").alias("num"), "pairs", *[F.lit(None).cast(t).alias(c) for c, t in (("nids", "array<long>"), ("ns", "array<long>"), ("v", "array<binary>"))])
        work = heads.unionByName(rows_).repartition(max(2 * shuffle_partitions(vectors.sparkSession), 1), "ui", "uj").sortWithinPartitions("ui", "uj", "num")
        schema = pa.schema([("kind", pa.int32()), ("nid", pa.int64()), ("value", pa.int64())])

        def load(nids, ns, v):
            x = unit_rows(_matrix(v, kind))
            return {"x": x, "p": _project(x, axes), "dim": np.array([len(b) for b in v]), "n": np.array(ns, np.int64), "ids": np.array(nids, np.int64)}

        def join(todo, held):
            for pair in todo:
                a, b = held[pair["i"]], held[pair["j"]] if pair["j"] != pair["i"] else None
                la, lb, edges = join_blocks(a, b, threshold)
                ids, links = (a["ids"], la) if b is None else (np.concatenate((a["ids"], b["ids"])), np.concatenate((la, lb)))
                hit = np.flatnonzero(links)
                e = np.array(edges, np.int64).reshape(-1, 2)
                yield tx.batches({"kind": np.repeat([0, 1], [len(hit), len(e)]), "nid": np.concatenate((ids[hit], ids[e[:, 0]])),
                                  "value": np.concatenate((links[hit], ids[e[:, 1]]))}, schema)

        def run(it):
            key, todo, held = None, [], {}
            for t in it:
                for i in range(len(t)):
                    r = {c: t.column(c)[i].as_py() for c in t.schema.names}
                    if (r["ui"], r["uj"]) != key:
                        yield from join(todo, held)
                        key, todo, held = (r["ui"], r["uj"]), [], {}
                    if r["num"] < 0:
                        todo = r["pairs"]
                    else:
                        held[r["num"]] = load(r["nids"], r["ns"], r["v"])
            yield from join(todo, held)
        found = step(work.mapInArrow(tx.tidy(run), "kind int, nid long, value long"), "found")
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "kind int, nid long, value long")
    links = found.filter("kind = 0").groupBy("nid").agg(F.sum("value").alias("others"))
    group = components(found.filter("kind = 1").select("nid", "value"))
    named = kinds.select("e1", "e2", "nid", "n", "rep").join(links, "nid", "left").join(group.withColumnRenamed("id", "nid"), "nid", "left").withColumn(
        "component", F.coalesce("component", "nid"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "component").select("e1", "e2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    return rows.select("vec_id", "e1", "e2").join(named, ["e1", "e2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
