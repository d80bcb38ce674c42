"""Record operators: project, add, filter, dedupe, sample and mask.

Two tiers: typed columns, and ragged records in a column `fields ARRAY<STRING>`, where a short record lacks cells.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.exprs import hmac_sha256, is_blank, number, text

MAX_FIELDS = 1024


# --- projection -------------------------------------------------------------------------------------------------------


def project(df: DataFrame, columns: list[int | str]) -> DataFrame:
    """The named columns, or those at the zero-based places, in that order; each at most once."""
    names = [df.columns[c] if isinstance(c, int) else c for c in columns]
    if not names or len(set(names)) != len(names):
        raise ValueError("columns must be given, each at most once")
    return df.select(*[F.col(f"`{n}`") for n in names])


def project_fields(df: DataFrame, columns: list[int], missing: str | None = None) -> DataFrame:
    """The same for ragged records: a cell that a short record lacks is `missing`, or an error without it."""
    if not columns or len(set(columns)) != len(columns) or min(columns) < 0:
        raise ValueError("columns must be given, each at most once")
    lack = F.raise_error(F.lit("a record is too short for the projection")).cast("string") if missing is None else F.lit(missing)
    cells = [F.when(F.size("fields") > c, F.get("fields", F.lit(c))).otherwise(lack) for c in columns]
    return df.withColumn("fields", F.array(*cells))


def preview(df: DataFrame, order_by: str, rows: int = 20) -> DataFrame:
    """The first rows in record order."""
    return df.orderBy(order_by).limit(rows)


def bounded_prefix(df: DataFrame, order_by: str, size: Column, rows: int = 200, most_bytes: int = 4 << 20) -> DataFrame:
    """The first rows in record order, at most `rows` and at most `most_bytes` of `size` together, with `truncated`: are there more?

    Only rows + 1 rows leave the scan; the running size is taken over those.
    """
    few = df.orderBy(order_by).limit(rows + 1).withColumn("_size", size)
    upto = Window.orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumns({"_upto": F.sum("_size").over(upto), "_place": F.row_number().over(Window.orderBy(order_by))})
    kept = (F.col("_upto") <= most_bytes) & (F.col("_place") <= rows)
    few = few.withColumn("truncated", F.min(kept).over(Window.partitionBy()) == F.lit(False))
    return few.filter(kept).drop("_size", "_upto", "_place")


def page(df: DataFrame, key: str, after, rows: int = 500) -> DataFrame:
    """The next rows behind a cursor (keyset paging: the filter reaches the scan)."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(rows)


def add_column(df: DataFrame, position: int, name: str, value: str) -> DataFrame:
    """A constant column at a place; at most 1,024 columns."""
    if not 0 <= position <= len(df.columns) or len(df.columns) >= MAX_FIELDS:
        raise ValueError("no such place for a column")
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*cols[:position], F.lit(value).alias(name), *cols[position:])


def add_field(df: DataFrame, position: int, value: str, fill: str = "") -> DataFrame:
    """The same for ragged records: shorter ones are first filled up to the place."""
    short = F.greatest(F.lit(position) - F.size("fields"), F.lit(0))
    return df.withColumn("fields", F.array_insert(F.concat("fields", F.array_repeat(F.lit(fill), short)), position + 1, F.lit(value)))


def column_guide(df: DataFrame, most: int = 500) -> list[tuple[int, str, str]]:
    """(number, name, type) of the first columns of a table: what an export by number needs to name."""
    return [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1) if i <= most]


def normalised_names(names: list[str]) -> list[str]:
    """Trimmed; blank ones become column_N; of names equal but for case, later ones get _2, _3, ... that no other name has."""
    names = [n.strip() or f"column_{i}" for i, n in enumerate(names, 1)]
    if any(len(n) > 64 for n in names):
        raise ValueError("a column name has more than 64 characters")
    later, out, used = {n.casefold() for n in names}, [], set()
    for name in names:
        own, i = name, 2
        while own.casefold() in used or (i > 2 and own.casefold() in later):
            own, i = f"{name}_{i}", i + 1
        used.add(own.casefold())
        out.append(own)
    return out


# --- filters ----------------------------------------------------------------------------------------------------------


def matches(c: Column, op: str, value: str = "") -> Column:
    """A test that is never null. gt and lt compare numbers where both sides are numbers, otherwise bytes, row by row."""
    t = text(c)
    if op in ("gt", "lt"):
        n, v = number(c), number(F.lit(value))
        less, more = (n < v) & ~F.isnan(n) & ~F.isnan(v), (n > v) & ~F.isnan(n) & ~F.isnan(v)
        return F.when(n.isNotNull() & v.isNotNull(), more if op == "gt" else less).otherwise(t > F.lit(value) if op == "gt" else t < F.lit(value))
    tests = {"eq": t == value, "ne": t != value, "contains": F.contains(t, F.lit(value)), "empty": is_blank(c), "nonempty": ~is_blank(c)}
    if op not in tests:
        raise ValueError(f"unknown test {op!r}")
    return tests[op]


def filter_rows(df: DataFrame, column: str, op: str, value: str = "", negate: bool = False) -> DataFrame:
    """Rows that pass the test, or those that do not."""
    test = matches(F.col(column), op, value)
    return df.filter(~test if negate else test)


# --- dedupe and sample ------------------------------------------------------------------------------------------------


def dedupe(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key. The rank filter becomes a group limit on the map side, so hot keys shrink before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def dedupe_fields(df: DataFrame, order_by: str, key: int | None = None) -> DataFrame:
    """Ragged records: by all cells, or by one, where an empty and a missing cell differ and records too short for the key are
    compared whole."""
    own = F.col("fields")
    if key is not None:
        own = F.when(F.size("fields") > key, F.struct(F.lit(True).alias("has"), F.array(F.get("fields", F.lit(key))).alias("cells"))).otherwise(
            F.struct(F.lit(False).alias("has"), F.col("fields").alias("cells"))
        )
    return dedupe(df.withColumn("_key", own), ["_key"], [order_by]).drop("_key")


def refuse_many_keys(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """`df`, or an error if it has (by estimate, within 1 %) more than `most` distinct keys. Spark itself needs no such bound."""
    n = df.agg(F.approx_count_distinct(F.struct(*keys), 0.01)).first()[0]
    if n > most * 1.01:
        raise ValueError(f"about {n} distinct keys; the budget is {most}")
    return df


def every_nth(df: DataFrame, record_no: str, n: int = 10) -> DataFrame:
    """Rows 1, 1 + n, 1 + 2n, ... by a dense number."""
    return df.filter((F.col(record_no) - 1) % n == 0)


def first_n_per_group(df: DataFrame, group: list[str], order_by: list[str], n: int = 100) -> DataFrame:
    """The first n rows of each group, with their place in it."""
    w = Window.partitionBy(*group).orderBy(*order_by)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


# --- masking ----------------------------------------------------------------------------------------------------------


def new_key() -> bytes:
    """A fresh key for the hash mask; equal values get equal pseudonyms within one run only."""
    return secrets.token_bytes(32)


def mask(c: Column, mode: str, replacement: str = "REDACTED", key: bytes = b"") -> Column:
    """null: empty; fixed: a constant; email: first character, *** and the part from the last @; hash: 32 hex digits of an HMAC."""
    t = text(c)
    if mode == "null":
        return F.lit("")
    if mode == "fixed":
        return F.lit(replacement)
    if mode == "email":
        domain = F.regexp_extract(t, r"(?s)^.+(@[^@]*)\z", 1)
        return F.when(t == "", "").otherwise(F.concat(F.substring(t, 1, 1), F.lit("***"), domain))
    if mode == "hash":
        if not 32 <= len(key) <= 64:
            raise ValueError("the key needs 32 to 64 bytes")
        return F.when(t == "", "").otherwise(F.substring(hmac_sha256(t, key), 1, 32))
    raise ValueError(f"unknown mask {mode!r}")


def mask_columns(df: DataFrame, modes: dict[str, str], replacement: str = "REDACTED", key: bytes = b"") -> DataFrame:
    """The table with the named columns masked."""
    return df.withColumns({c: mask(F.col(c), mode, replacement, key) for c, mode in modes.items()})


def mask_summary(df: DataFrame, modes: dict[str, str], replacement: str = "REDACTED", key: bytes = b"") -> DataFrame:
    """records_read, records_written and cells_masked, the cells whose text a mask changes."""
    changed = sum(((mask(F.col(c), mode, replacement, key) != text(F.col(c))).cast("long") for c, mode in modes.items()), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("records_read"), F.count("*").alias("records_written"), F.coalesce(F.sum(changed), F.lit(0)).alias("cells_masked"))
