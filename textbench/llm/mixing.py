"""Mixing sources to target weights by weighted fair queueing (operator 4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.shared import staged

#: Words are runs of other code points than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A source's queue is cut into 16 ** DIGITS ranges of its shuffle hash; virtual time into TICKS ranges.
DIGITS, TICKS = 4, 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Target words of each source from (source, source_size): the water level at which the capped shares add up.

    Works on one row per source, the only rows that its windows hold. A source's cap is `most` times its size; sources are
    filled in the order of cap over weight, and from the first that stays below its cap all get level times weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    steps = F.array(*[F.lit(float(w)) for w in weights])
    x = sizes.withColumn("weight", F.element_at(steps, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    x = x.select(
        "*",
        F.row_number().over(by_fill).alias("turn"),
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    x = x.withColumn("level", F.col("left") / F.col("open"))
    level = F.min_by("level", F.when(F.col("level") <= F.col("fill"), F.col("turn"))).over(everything)
    return x.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, seed: str = "", carry: list[str] | None = None) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target and taken, the words that the mix takes of it, and `carry`,
    further columns of it (short ones, as a key: they travel with the queue).

    Each source queues its documents in the order of an MD5 shuffle, then once more (as often as `most` allows). A document's
    virtual finish time is the words its source has sent up to its end, over the source's target; all sources are merged by
    finish time and cut where the next document would pass the budget, the sum of the targets. Whole documents are taken.

    Queues are cut into fixed ranges of the shuffle hash and virtual time into fixed ticks: running sums come from one sum for
    each range, so no task holds a source. Defined cases: null text has size 0; a null source is a source of its own, last;
    repeated doc_ids queue by size too; size-0 documents take 0; an empty table gives an empty result.
    """
    weights = weights or [5, 2, 1]
    carry = carry or []
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.struct(F.lit(0).alias("_"), *carry).alias("more"))
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("o", order).withColumn("cut", F.conv(F.substring("o", 1, DIGITS), 16, 10).cast("int"))
    cuts = rows.groupBy("source", "cut").agg(F.sum("size").alias("cut_size"))
    sizes = cuts.groupBy("source").agg(F.sum("cut_size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    per_source = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("sent", F.coalesce(F.sum("cut_size").over(per_source), F.lit(0))).drop("cut_size")
    cuts = cuts.join(goal, cuts.source.eqNullSafe(goal.source)).select(cuts.source, "cut", "sent", "source_size", "target")
    queue = Window.partitionBy("r.source", "r.cut").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    r, c = rows.alias("r"), cuts.alias("c")
    one = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cut") == F.col("c.cut")))
    one = one.select(
        "doc_id", "more", "size", "source_size", "target", F.col("r.source").alias("source"), F.col("r.cut").alias("cut"), "o",
        F.row_number().over(Window.partitionBy("r.source", "r.cut").orderBy("o", "doc_id", "size")).alias("place"),
        (F.sum("size").over(queue) + F.col("sent")).alias("sent"),
    )
    one = staged(one)
    turns = one.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    v = F.when(F.col("target") > 0, (F.col("sent") + F.col("turn") * F.col("source_size")) / F.col("target")).otherwise(F.lit(float(TICKS)))
    turns = turns.withColumn("v", v).withColumn("tick", F.least(F.floor(F.col("v") * (TICKS // 2)), F.lit(2 * TICKS)))
    ticks = turns.groupBy("tick").agg(F.sum("size").alias("n"))
    upto = ticks.withColumn("upto", F.sum("n").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)))
    budget = one.select("source", "target").distinct().agg(F.sum("target")).first()[0] or 0.0
    edge, before = upto.filter(F.col("upto") > budget).agg(F.min("tick"), F.min_by(F.col("upto") - F.col("n"), "tick")).first()
    edge, before = (4 * TICKS, 0) if edge is None else (edge, before)
    last = Window.partitionBy("tick").orderBy("v", "source", "o", "doc_id", "size", "turn").rowsBetween(Window.unboundedPreceding, 0)
    clear = turns.filter(F.col("tick") != edge).withColumn("take", F.col("tick") < edge)
    at_edge = turns.filter(F.col("tick") == edge).withColumn("take", F.sum("size").over(last) + before <= budget)
    per = F.sum(F.when(F.col("take"), F.col("size")).otherwise(F.lit(0)))
    done = clear.unionByName(at_edge).groupBy("source", "cut", "place", "doc_id", "more", "size", "source_size", "target").agg(per.alias("taken"))
    return done.select("doc_id", "size", "source_size", "target", "taken", *(F.col("more")[c].alias(c) for c in carry))
