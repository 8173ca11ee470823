"""Hard-negative mining over an STR-packed R-tree.

Vectors are scaled to integers (``floor(scale * x)``); a score is the integer inner
product with the anchor. An anchor's positives are its ``positives`` best rows of the
same label; for each, its negatives are the ``negatives`` best rows of other labels
whose score lies between ``low`` and ``high`` per cent of the positive's. Higher scores
come first, equal ones by smaller id. The result is exact.

1. ``tiles``: sort-tile-recursive packing. Rows are cut into slabs by the coordinate
   that spreads most (a range partitioning, ties cut by id), each slab is sorted by the
   second and cut into tiles, and inside a tile the next coordinates are sorted and cut
   in turn down to leaves of ``LEAF`` rows. Consecutive leaves form nodes of ``FAN``,
   and so on. Coordinates are chosen on a sample of ``SAMPLE`` rows; any choice gives
   the same result.
2. A minimum bounding box gives an interval of the inner product: per coordinate, the
   anchor's value times the lower or upper side. ``plan`` meets blocks of anchors with
   blocks of tile boxes and names the tiles an anchor has to look into: those whose
   interval meets a score window and does not end below the k-th best known
   (or with it, if all ids of the tile are greater).
3. ``visit``: in a tile a best-first queue opens nodes by descending upper bound under
   the same rule, so it ends when no open node can change the result.
4. Each search is two rounds: every anchor looks into its most promising tile, whose
   k-th best score then limits the tiles of the second round. Positives first, then
   negatives, for all positives of an anchor in one descent.

Rows with a null id, label or vector, or a null or non-finite component take no part, nor
do vectors whose scaled squares sum up to 2**55 or more (windows need not fit in 64 bits).
Of several rows of one id the least by label and vector stands for the id. Vectors of
different lengths have no score with each other. Empty tables give an empty result.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from . import _text as tx
from ._steps import step

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
TILE, TILE_BYTES, LEAF, FAN, SAMPLE = 4096, 4 << 20, 128, 8, 4096
BLOCK, SLICE = 256, 512
LEAST, MOST = -(1 << 62), 1 << 62
_TARGETS = "array<struct<num:int,low:long,high:long,score:long,id:long>>"


# ---- the tree -----------------------------------------------------------------

def pack(x: np.ndarray, axes: list[int], leaf: int = LEAF) -> np.ndarray:
    """Order of the rows by sort-tile-recursive packing over ``axes``: leaves are runs of ``leaf`` rows."""
    def cut(rows: np.ndarray, axes_: list[int]) -> list[np.ndarray]:
        leaves = math.ceil(len(rows) / leaf)
        if not axes_ or leaves < 2:
            return [rows]
        rows = rows[np.argsort(x[rows, axes_[0]], kind="stable")]
        slabs = math.ceil(leaves ** (1 / len(axes_)))
        size = math.ceil(leaves / slabs) * leaf
        return [r for a in range(0, len(rows), size) for r in cut(rows[a:a + size], axes_[1:])]
    return np.concatenate(cut(np.arange(len(x)), axes)) if len(x) else np.zeros(0, np.int64)


class Tree:
    """Boxes over packed rows: level 0 are leaves, the last level is the root. Rows stay in the order of ``pack``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.x, self.ids, self.labels, self.leaf, self.fan = x, ids, labels, leaf, fan
        low, high, first, l0, l1 = x, x, ids, labels, labels
        self.levels = []
        size = leaf
        while True:
            at = np.arange(0, len(first), size)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, l0, l1 = np.minimum.reduceat(first, at), np.minimum.reduceat(l0, at), np.maximum.reduceat(l1, at)
            self.levels.append((low.astype(np.float64), high.astype(np.float64), first, l0, l1))
            if len(at) == 1:
                break
            size = fan
        self.most = float(np.abs(x).max(initial=0))


def interval(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of anchors (rows of ``q``) with points of boxes, as (anchors, boxes).

    In double precision; where sums may lose digits they are widened by more than that.
    """
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    least, greatest = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < 2.0 ** 52, 0.0, size * (q.shape[1] + 2) * 2.0 ** -52)
    return least - slack, greatest + slack


def products(x: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer rows with an integer anchor."""
    if x.shape[1] * most * float(np.abs(q).max(initial=0)) < 2.0 ** 52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def _useful(targets, least, greatest, first):
    """Whether a box (or boxes) may hold a row that changes the result of a target (num, low, high, score, id)."""
    out = False
    for _, low, high, score, at in targets:
        reach = np.minimum(greatest, high)
        out = out | ((greatest >= low) & (least <= high) & ((reach > score) | ((reach == score) & (first < at))))
    return out


def descend(tree: Tree, anchor: int, label: int, q: np.ndarray, targets: list, k: int, same: bool) -> list[tuple[int, int, int]]:
    """(target, id, score) of the ``k`` best rows of a tree in every target's window that beat its score and id so far."""
    wide = q.astype(np.float64)[None, :]
    targets = [list(t) for t in targets]
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in targets]
    queue: list[tuple[float, int, int]] = []

    def offer(level: int, a: int, b: int) -> None:
        low, high, first, l0, l1 = (v[a:b] for v in tree.levels[level])
        least, greatest = (v[0] for v in interval(wide, low, high))
        ok = _useful(targets, least, greatest, first)
        ok = ok & ((l0 <= label) & (label <= l1) if same else (l0 != label) | (l1 != label))
        for i in np.flatnonzero(ok):
            heapq.heappush(queue, (-float(greatest[i]), level, a + int(i), float(least[i]), int(first[i])))

    offer(len(tree.levels) - 1, 0, 1)
    while queue:
        greatest, level, i, least, first = heapq.heappop(queue)
        if not _useful(targets, least, -greatest, first):
            continue
        if level:
            offer(level - 1, i * tree.fan, min((i + 1) * tree.fan, len(tree.levels[level - 1][2])))
            continue
        rows = slice(i * tree.leaf, (i + 1) * tree.leaf)
        ids, labels = tree.ids[rows], tree.labels[rows]
        fit = (labels == label if same else labels != label) & (ids != anchor)
        score = products(tree.x[rows], q, tree.most)
        for j, t in enumerate(targets):
            hit = fit & (score >= t[1]) & (score <= t[2]) & ((score > t[3]) | ((score == t[3]) & (ids < t[4])))
            if hit.any():
                s, m = np.concatenate((best[j][0], score[hit])), np.concatenate((best[j][1], ids[hit]))
                o = np.lexsort((m, -s))[:k]
                best[j] = s[o], m[o]
                if len(o) == k:
                    t[3], t[4] = int(s[o[-1]]), int(m[o[-1]])
    return [(targets[j][0], int(m), int(s)) for j, (ss, ms) in enumerate(best) for s, m in zip(ss, ms, strict=True)]


# ---- tables -------------------------------------------------------------------

def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q array<int>) of the rows that take part, one per id."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding"))
    sound = x.isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v).cast("double"))
    # the scaled values stay doubles until their squares are known to be small
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    small = F.aggregate(F.transform("embedding", lambda v: F.pow(F.lit(float(scale)) * v, 2)), F.lit(0.0), lambda a, v: a + v) < 2.0 ** 55
    rows = rows.filter(small).select("vec_id", "label", F.when(small, scaled).cast("array<int>").alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int32)


def tiles(rows: DataFrame, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """(tile, dim, low, high, first, l0, l1, n, x, ids, labels): the packed tiles, with their own boxes."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["q"]), []).append(r["q"])
    most = max(by_dim.values(), key=len, default=[[]])
    spread = np.argsort(-np.var(np.array(most, np.float64).reshape(len(most), -1), axis=0), kind="stable").tolist()
    at = lambda i: F.coalesce(F.get("q", F.lit(spread[i])), F.lit(0)) if i < len(spread) else F.lit(0)
    cut = rows.select("vec_id", "label", "q", F.size("q").alias("dim"), at(0).alias("c0"), at(1).alias("c1"))
    slabs = cut.repartitionByRange(shuffle_partitions(rows.sparkSession), "dim", "c0", "vec_id").sortWithinPartitions("dim", "c1", "vec_id")
    names = ["tile", "dim", "low", "high", "first", "l0", "l1", "n", "x", "ids", "labels"]

    def run(it):
        from pyspark import TaskContext
        number, held = TaskContext.get().partitionId() << 32, None

        def give(t: pa.Table):
            nonlocal number
            t = t.combine_chunks()
            x, ids, labels = _matrix(t.column("q").chunk(0)), t.column("vec_id").to_numpy(), t.column("label").to_numpy()
            o = pack(x, [a for a in spread[2:8] if a < x.shape[1]], leaf)
            x, ids, labels = x[o], ids[o], labels[o]
            number += 1
            return pa.RecordBatch.from_pylist([{
                "tile": number, "dim": x.shape[1], "low": x.min(axis=0).tolist(), "high": x.max(axis=0).tolist(), "first": int(ids.min()), "l0": int(labels.min()),
                "l1": int(labels.max()), "n": len(x), "x": x.astype("<i4").tobytes(), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes()}],
                schema=pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), *((c, pa.int64()) for c in ("first", "l0", "l1", "n")),
                                  *((c, pa.binary()) for c in ("x", "ids", "labels"))]))
        for b in it:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held):
                dim = held.column("dim")[0].as_py()
                most = max(1, min(tile, TILE_BYTES // (4 * max(dim, 1))))
                n = int(np.searchsorted(held.column("dim").to_numpy(), dim, side="right"))
                if n == len(held) and n < most:
                    break  # the tile may go on in the next batch
                n = min(n, most)
                yield give(held.slice(0, n))
                held = held.slice(n)
        if held is not None and len(held):
            yield give(held)
    ddl = "tile long, dim int, low array<int>, high array<int>, first long, l0 long, l1 long, n long, x binary, ids binary, labels binary"
    return step(slabs.select("vec_id", "label", "q", "dim").mapInArrow(tx.tidy(run), ddl).select(*names), "tiles")


def plan(anchors: DataFrame, boxes: DataFrame, same: bool, seeds: bool) -> DataFrame:
    """(aid, tile, reach): tiles that can change an anchor's result; with ``seeds`` the most promising of each block of boxes.

    ``anchors``: aid, label, q, targets, and ``seen``, a tile that was looked into already.
    """
    spark = anchors.sparkSession
    n_blocks = math.ceil(max(boxes.count(), 1) / BLOCK)
    groups = boxes.select("tile", "dim", "low", "high", "first", "l0", "l1").withColumn("g", F.pmod(F.xxhash64("tile"), F.lit(n_blocks)))
    groups = groups.groupBy("g").agg(F.collect_list(F.struct("tile", "dim", "low", "high", "first", "l0", "l1")).alias("boxes"))  # about BLOCK each
    n_anchors = math.ceil(max(anchors.count(), 1) / BLOCK)
    asked = anchors.withColumn("a", F.pmod(F.xxhash64("aid"), F.lit(n_anchors))).groupBy("a").agg(
        F.collect_list(F.struct("aid", "label", "q", "targets", "seen")).alias("anchors"))
    pairs = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(groups, "g")
    schema = pa.schema([("aid", pa.int64()), ("tile", pa.int64()), ("reach", pa.float64())])

    def run(it):
        for b in it:
            for who, what in zip(b.column("anchors").to_pylist(), b.column("boxes").to_pylist(), strict=True):
                out: dict[str, list] = {"aid": [], "tile": [], "reach": []}
                for dim in {x["dim"] for x in what}:
                    near = [x for x in what if x["dim"] == dim]
                    mine = [a for a in who if len(a["q"]) == dim]
                    if not mine:
                        continue
                    low, high = (np.array([x[c] for x in near], np.float64).reshape(len(near), dim) for c in ("low", "high"))
                    first, l0, l1, tile = (np.array([x[c] for x in near], np.int64) for c in ("first", "l0", "l1", "tile"))
                    least, greatest = interval(np.array([a["q"] for a in mine], np.float64).reshape(len(mine), dim), low, high)
                    for i, a in enumerate(mine):
                        targets = [tuple(t.values()) for t in a["targets"]]
                        ok = _useful(targets, least[i], greatest[i], first) & (tile != a["seen"])
                        ok = ok & ((l0 <= a["label"]) & (a["label"] <= l1) if same else (l0 != a["label"]) | (l1 != a["label"]))
                        at = np.flatnonzero(ok)
                        if seeds and len(at):
                            reach = np.minimum(greatest[i, at], max(t[2] for t in targets))
                            at = at[[np.lexsort((tile[at], -reach))[0]]]
                        out["aid"] += [a["aid"]] * len(at)
                        out["tile"] += tile[at].tolist()
                        out["reach"] += greatest[i, at].tolist()
                yield tx.batches(out, schema)
    found = pairs.repartition(max(1, min(n_blocks * n_anchors, 4 * shuffle_partitions(spark)))).select("anchors", "boxes").mapInArrow(
        tx.tidy(run), "aid long, tile long, reach double")
    if seeds:
        found = found.groupBy("aid").agg(F.max(F.struct("reach", "tile")).alias("m")).select("aid", F.col("m.tile").alias("tile"), F.col("m.reach").alias("reach"))
    return step(found, "visits")


def visit(visits: DataFrame, anchors: DataFrame, packed: DataFrame, k: int, same: bool, leaf: int = LEAF) -> DataFrame:
    """(aid, num, id, score): the ``k`` best of each visited tile for every target of the anchors that visit it."""
    spark = visits.sparkSession
    n = math.ceil(max(anchors.count(), 1) / SLICE)
    who = visits.select("aid", "tile").join(anchors.select("aid", "label", "q", "targets"), "aid").withColumn("slice", F.pmod(F.xxhash64("aid"), F.lit(n)))
    who = who.groupBy("tile", "slice").agg(F.collect_list(F.struct("aid", "label", "q", "targets")).alias("anchors"))  # about SLICE at most
    work = who.join(packed.select("tile", "dim", "n", "x", "ids", "labels"), "tile").select("anchors", "dim", "n", "x", "ids", "labels")
    schema = pa.schema([("aid", pa.int64()), ("num", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(it):
        for b in it:
            for i in range(len(b)):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                tree = Tree(np.frombuffer(r["x"], "<i4").reshape(r["n"], r["dim"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), leaf)
                found = [(a["aid"], *hit) for a in r["anchors"]
                         for hit in descend(tree, a["aid"], a["label"], np.array(a["q"], np.int64), [tuple(t.values()) for t in a["targets"]], k, same)]
                yield tx.batches(dict(zip(schema.names, zip(*found, strict=True), strict=True)) if found else {c: [] for c in schema.names}, schema)
    out = work.repartition(max(1, 4 * shuffle_partitions(spark))).mapInArrow(tx.tidy(run), "aid long, num int, id long, score long")
    return step(out, "found")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("aid", "num").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(anchors: DataFrame, packed: DataFrame, k: int, same: bool, leaf: int = LEAF) -> DataFrame:
    """(aid, num, rank, id, score): the ``k`` best rows of every target of ``anchors`` (aid, label, q, targets), in two rounds."""
    boxes = packed.select("tile", "dim", "low", "high", "first", "l0", "l1")
    fresh = anchors.withColumn("seen", F.lit(-1).cast("long"))
    seeds = plan(fresh, boxes, same, True)
    first = visit(seeds, anchors, packed, k, same, leaf)
    # the k-th best of the first tile; fewer than k limit nothing
    known = _best(first, k).filter(F.col("rank") == k).groupBy("aid").agg(
        F.map_from_entries(F.collect_list(F.struct("num", F.struct("score", "id")))).alias("known"))
    bound = lambda t: F.try_element_at("known", t["num"])
    tight = anchors.join(known, "aid", "left").join(seeds.select("aid", F.col("tile").alias("seen")), "aid", "left").select(
        "aid", "label", "q", F.coalesce("seen", F.lit(-1).cast("long")).alias("seen"),
        F.transform("targets", lambda t: F.struct(t["num"].alias("num"), t["low"].alias("low"), t["high"].alias("high"), F.coalesce(bound(t)["score"], t["score"]).alias("score"),
                                                  F.coalesce(bound(t)["id"], t["id"]).alias("id"))).alias("targets"))
    tight = step(tight, "anchors")
    rest = visit(plan(tight, boxes, same, False), tight, packed, k, same, leaf)
    return _best(first.unionByName(rest), k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of ``vectors`` for which ``anchors`` holds."""
    rows = step(integer_rows(vectors, scale), "vectors")
    packed = tiles(rows, tile, leaf)
    target = lambda num, lo, hi: F.struct(num.alias("num"), lo.alias("low"), hi.alias("high"), F.lit(LEAST).alias("score"), F.lit(MOST).alias("id"))
    asked = step(rows.filter(anchors).select(F.col("vec_id").alias("aid"), "label", "q", F.array(
        target(F.lit(0), F.lit(LEAST), F.lit(MOST))).cast(_TARGETS).alias("targets")), "anchors")
    best = step(nearest(asked, packed, positives, True, leaf), "positives")
    # whole numbers: score * high / 100 rounded down, score * low / 100 rounded up
    down = lambda percent: F.expr(f"(score * {percent} - pmod(score * {percent}, 100)) div 100")
    wanted = best.select("aid", target(F.col("rank"), -down(-low), down(high)).alias("t")).filter("t.low <= t.high")
    again = step(asked.select("aid", "label", "q").join(wanted.groupBy("aid").agg(F.collect_list("t").cast(_TARGETS).alias("targets")), "aid"), "anchors")
    found = nearest(again, packed, negatives, False, leaf)
    pos = best.select("aid", F.col("rank").alias("num"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pos, ["aid", "num"]).select(F.col("aid").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                                                  F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
