"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.shared import spread_join, staged

#: A vertex with more neighbours is a hub.
HUB = 10_000


def _hung(both: DataFrame, most: int) -> DataFrame:
    """`both` (a, b) with m, the least of a and its neighbours. The neighbours of a hub are spread over tasks."""
    if most <= HUB:
        return both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    least = staged(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("m")))
    return spread_join(both, least.select("a", F.least("a", "least").alias("least")), least, ["a"], ["b"]).withColumnRenamed("least", "m")


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One half round: each neighbour of u that is larger (large) or not larger (small) is hung on the least of u and its neighbours.
    most: the neighbours of the vertex that has most of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hung = _hung(both, most)
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Is this a forest (each vertex hangs on one other at most, and none of those on another)? And the most edges of a vertex."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"), F.count("*").alias("n"))
    other, most = each.agg(F.bool_or(F.expr("up > 1 OR (up > 0 AND down > 0)")), F.max("n")).first()
    return not other, most or 0


def components(links: DataFrame) -> DataFrame:
    """(k, c): for each vertex of the links (a, b) that is not the least of its component, that least vertex.

    Neighbours meet in partial aggregates and joins, never as a group, and a hub's are spread over tasks; each round is a table in
    the shared folder, and the rounds end when every vertex hangs on the least one. Loops and repeated links are fine; no links
    give an empty table.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    done, most = _shape(edges)
    while not done:
        edges = staged(_star(_star(edges, True, most), False, most))
        done, most = _shape(edges)
    out = edges.select(F.col("a").alias("k"), F.col("b").alias("c"))
    out.seen_when_staged = edges.seen_when_staged
    return out
