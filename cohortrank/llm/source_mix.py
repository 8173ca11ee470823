"""Mixing sources to target weights: capped water-filling, seeded repetitions.

Targets: sources (by code point, null last) weigh ``weights`` in turn and share
``budget`` times all words. No target exceeds ``max_epochs`` times its source's
size; the excess is shared among the rest by weight until none is above. That
fixed point is found directly: with sources ordered by cap / weight the capped
ones come first, so running sums over one row per source give the water level.

Sampling: a source of ``e = target / size`` epochs takes each text
``floor(e)`` times whole, and the rest of the words by one more repetition of
texts in the order of a seeded hash until the rest is used up. The cut is found
without a global sort: sizes are summed by ``BUCKETS`` slices of the hash,
slices below the cut are taken whole, and only the one slice per source in
which the cut lies is ordered. The last text is taken if that comes closer to
the target; then, ``SWAPS`` times, the one text of the source that brings it
closest is taken or left after all. A source so misses its target by less than
half of one text (or of a group of rows equal in id and text, which share one
hash). A swap never takes a text beyond ``max_epochs``: where the rest is 0
nothing is missing.

All columns of the input stay apart from those that clash with the new ones,
which are replaced. Null and empty texts have size 0 and take 0 words. The
result depends on ids, texts, sources and the seed alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLANKS = "[\\x20\\x09-\\x0D]+"
BUCKETS, SWAPS = 4096, 3
WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3.0, 20240607


def n_words(text: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.array_remove(F.split(c, BLANKS, -1), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, budget: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The windows without a partition see one row per source, no texts.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.alias("_w")).withColumn("_cap", max_epochs * F.col("source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_total", budget * F.sum("source_size").over(everything)).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the first source, in order of cap / weight, that stays under its cap sets the level; none does if all are capped
    level = F.first(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.select("source", "source_size", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and repeats (how often the mix takes the text)."""
    added = ["size", "source_size", "target", "repeats"]
    whole = [c for c in docs.columns if c not in added]
    hash_ = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))
    rows = docs.select(*whole, n_words("text").alias("size"), hash_.alias("_h")).withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(BUCKETS)).cast("int"))
    narrow = materialize(rows.groupBy("source", "_b", "_h").agg(F.sum("size").alias("size")), "mix")
    slices = narrow.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    goal = targets(slices.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, max_epochs, budget)
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = materialize(goal.select(F.col("source").alias("_src"), "source_size", "target", F.floor("_epochs").alias("_whole"),
                                   (F.col("target") - F.floor("_epochs") * F.col("source_size")).alias("_rest")), "mix")
    same = F.col("source").eqNullSafe(F.col("_src"))
    upto = F.sum("_s").over(Window.partitionBy("source").orderBy("_b"))
    cut = slices.withColumn("_upto", upto).join(goal, same).filter((F.col("_rest") > 0) & (F.col("_upto") >= F.col("_rest"))).groupBy("_src").agg(
        F.min(F.struct("_b", (F.col("_rest") - (F.col("_upto") - F.col("_s"))).alias("_left"))).alias("_c")).select(
        "_src", F.col("_c._b").alias("_at"), F.col("_c._left").alias("_left"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = narrow.join(cut, same).filter("_b = _at").withColumn("_run", running).filter(
        # the text on the cut is taken if at least half of it lies before the cut
        F.col("_run") - F.col("size") / 2.0 <= F.col("_left")).groupBy("_src").agg(F.max("_h").alias("_last"))
    plan = goal.join(cut.select(F.col("_src").alias("_s1"), "_at"), F.col("_src").eqNullSafe(F.col("_s1")), "left").join(
        last.select(F.col("_src").alias("_s2"), "_last"), F.col("_src").eqNullSafe(F.col("_s2")), "left").select(
        "_src", "source_size", "target", "_whole", "_rest", "_at", "_last")
    plan = materialize(plan, "mix")
    more = F.coalesce(F.when(F.col("_b") == F.col("_at"), F.col("_h") <= F.col("_last")).otherwise(F.col("_b") < F.col("_at")), F.lit(False))
    # what is missing (or too much) is evened out by single texts: each round, the one whose change brings the source closest
    drawn, taken = narrow.join(plan, same).select("_src", "_rest", "size", "_h", more.alias("_more")), more
    for i in range(SWAPS):
        drawn = materialize(drawn, "mix")
        miss = drawn.groupBy("_src").agg((F.first("_rest") - F.sum(F.when(F.col("_more"), F.col("size")).otherwise(0))).alias("_miss")).withColumnRenamed("_src", "_s2")
        change = F.when(F.col("_more"), -F.col("size")).otherwise(F.col("size"))
        swap = materialize(drawn.join(miss, F.col("_src").eqNullSafe(F.col("_s2"))).withColumn("_off", F.abs(F.col("_miss") - change)).filter(
            (F.col("size") > 0) & (F.col("_off") < F.abs("_miss"))).groupBy("_s2").agg(F.min(F.struct("_off", "_h")).alias("_s")).select(
            F.col("_s2").alias("_s3"), F.col("_s._h").alias(f"_swap{i}")), "mix")
        plan = plan.join(swap, F.col("_src").eqNullSafe(F.col("_s3")), "left").drop("_s3")
        turned = F.coalesce(F.col("_h") == F.col(f"_swap{i}"), F.lit(False))
        drawn = drawn.join(swap, F.col("_src").eqNullSafe(F.col("_s3")), "left").select("_src", "_rest", "size", "_h", (F.col("_more") != turned).alias("_more"))
        taken = taken != turned
    return rows.join(materialize(plan, "mix"), same, "left").select(*whole, "size", "source_size", "target", (F.col("_whole") + taken.cast("long")).cast("long").alias("repeats"))


def repeat(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every text as often as it is taken, with ``columns``."""
    return mixed.filter("repeats > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*columns)
