"""Dense row numbers and running totals without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_range(df: DataFrame, key: str, coarse: int = 256, least: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """`df` with `_range`, which grows with the whole-number column `key`: quantiles, each cut evenly, about `least` ranges, by
    default four for each shuffle partition. Null keys have a range of their own, before all. of: what to take the quantiles of,
    where reading `df` for them would cost much."""
    fine = -(-(least or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // coarse)
    found = (of or df).agg(F.percentile_approx(key, [i / coarse for i in range(coarse + 1)], 10 * coarse)).first()[0] or [0]
    edges = F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(found))])
    at = F.greatest(F.size(F.filter(edges, lambda e: e <= F.col(key))), F.lit(1))
    lo = F.get(edges, at - 1).cast("double")
    hi = F.coalesce(F.get(edges, at).cast("double"), lo + 1)
    part = F.greatest(F.least(F.floor((F.col(key) - lo) / F.greatest(hi - lo, F.lit(1.0)) * fine), F.lit(fine - 1)), F.lit(0))
    return df.withColumn("_range", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(at * fine + part).cast("long"))


def with_running(df: DataFrame, key: str, value: Column, name: str, ties: list[str] | None = None) -> DataFrame:
    """`df` with `name`: the sum of `value` over this row and all before it in the order of `key`, then `ties`."""
    return with_totals(df, key, {name: value}, ties)


def with_totals(df: DataFrame, key: str, values: dict[str, Column], ties: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """with_running() of several values at once, by the names of their columns; of: see with_range().

    Only the sums of the ranges, a few for each shuffle partition, meet in one place; rows are ordered within their range.
    """
    added = {name: (f"_value{i}", f"_before{i}") for i, name in enumerate(values)}
    ranged = with_range(df, key, of=of).withColumns({added[name][0]: value for name, value in values.items()})
    sums = ranged.groupBy("_range").agg(*[F.sum(value).alias(value) for value, _ in added.values()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *[F.coalesce(F.sum(value).over(before), F.lit(0)).alias(upto) for value, upto in added.values()])
    own = Window.partitionBy("_range").orderBy(key, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({name: F.sum(value).over(own) for name, (value, _) in added.items()}).join(sums, "_range")
    return out.withColumns({name: F.col(name) + F.col(upto) for name, (_, upto) in added.items()}).drop("_range", *[c for pair in added.values() for c in pair])


def with_row_number(df: DataFrame, key: str, name: str = "record_no", ties: list[str] | None = None) -> DataFrame:
    """`df` with a dense number from 1 in the order of `key`."""
    return with_running(df, key, F.lit(1).cast("long"), name, ties)
