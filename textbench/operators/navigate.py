"""Navigation tables: sparse line anchors, and lookups between lines and byte offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_ANCHORS = 250_000


def anchor_step(lines: int, least: int = 1000) -> int:
    """Lines between anchors: `least`, or more so that there are at most 250,000 anchors."""
    return max(least, -(-lines // MAX_ANCHORS))


def anchors(lines: DataFrame, step: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, line_no, offset) of every `step`-th line; keep: `file`, where there are several."""
    return lines.filter((F.col("line_no") - 1) % step == 0).select(*keep, "line_no", "offset")


def floor_lookup(queries: DataFrame, table: DataFrame, key: str, carry: list[str], group: list[str] | None = None) -> DataFrame:
    """Each query with `carry` of the last row of `table` whose key is not above its own (an as-of join within `group`).

    Both sides go through one sort by (group, key); the last known values are carried down. Without a group, ranges of the key
    stand in for it, and each range starts with the last table row before it.
    """
    group = group or []
    if not group:
        return _ranged_lookup(queries, table, key, carry)
    w = Window.partitionBy(*group).orderBy(key, "_query").rowsBetween(Window.unboundedPreceding, 0)
    a = table.select(*group, key, F.struct(*carry).alias("_found"), F.lit(0).alias("_query"))
    b = queries.select("*", F.lit(None).cast(a.schema["_found"].dataType).alias("_found"), F.lit(1).alias("_query"))
    both = b.unionByName(a, allowMissingColumns=True)
    out = both.withColumn("_found", F.last("_found", True).over(w)).filter("_query = 1")
    return out.withColumns({c: F.col("_found")[c] for c in carry}).drop("_found", "_query")


def _ranged_lookup(queries: DataFrame, table: DataFrame, key: str, carry: list[str]) -> DataFrame:
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted(set(table.agg(F.percentile_approx(key, [i / parts for i in range(parts)], 10 * parts)).first()[0] or [0]))
    bounds = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    at = F.size(F.filter(bounds, lambda e: e <= F.col(key)))
    rows = table.withColumn("_part", at)
    last = rows.groupBy("_part").agg(F.max_by(F.struct(key, *[c for c in carry if c != key]), key).alias("r"))
    seeds = last.select((F.col("_part") + 1).alias("_from"), "r")
    fill = Window.orderBy("_part")
    spread = queries.sparkSession.range(len(edges) + 2).select(F.col("id").cast("int").alias("_part")).join(seeds, F.col("_part") == F.col("_from"), "left")
    spread = spread.select("_part", F.last("r", True).over(fill).alias("r")).filter("r IS NOT NULL").select("_part", "r.*")
    return floor_lookup(queries.withColumn("_part", at), rows.select("_part", key, *[c for c in carry if c != key]).unionByName(spread.select("_part", key, *[c for c in carry if c != key])), key, carry, ["_part"]).drop("_part")


def line_to_offset(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """The exact byte offset of each line number asked for."""
    return queries.join(lines.select("line_no", "offset"), "line_no", "left")


def offset_to_line(queries: DataFrame, sparse: DataFrame, bytes_per_line: float) -> DataFrame:
    """About which line each offset is in: the anchor at or before it, and the mean line length from there."""
    table = sparse.select(F.col("offset").alias("at"), F.col("offset").alias("anchor"), F.col("line_no").alias("anchor_line"))
    found = floor_lookup(queries.withColumn("at", F.col("offset")), table, "at", ["anchor", "anchor_line"])
    guess = F.col("anchor_line") + F.floor((F.col("offset") - F.col("anchor")) / bytes_per_line)
    return found.withColumn("line_no", F.coalesce(guess, F.lit(1)).cast("long")).drop("at", "anchor", "anchor_line")
