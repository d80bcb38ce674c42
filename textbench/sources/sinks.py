"""Sinks: delimited text, JSON Lines, SQL INSERTs, Markdown, splits with manifests. All refuse an existing target."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.exprs import json_number, json_string, sql_literal, text
from textbench.operators.records import normalised_names
from textbench.sources.files import delimiter

MAX_PARTS = 10_000


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], object] | None = None) -> None:
    """Writes a one-column table as text once `check` has passed; a target that exists is refused."""
    if check:
        check(df)
    df.write.mode("errorifexists").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """Minimal quoting, quotes doubled, blanks kept, LF."""
    df.write.mode("errorifexists").options(sep=delimiter(sep), header=header, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def json_lines(df: DataFrame, number_keys: list[str] | None = None) -> DataFrame:
    """One JSON object for each row, keys sorted, cells as strings; those of `number_keys` that are JSON numbers keep every digit."""
    names = [n if n.strip() else f"col{i}" for i, n in enumerate(df.columns, 1)]
    if len(set(names)) != len(names):
        raise ValueError("column names must differ")
    parts = []
    for name, column in sorted(zip(names, df.columns)):
        c = F.col(f"`{column}`")
        value = F.when(json_number(c), text(c)).otherwise(json_string(c)) if name in (number_keys or []) else json_string(c)
        parts.append(F.concat(json_string(F.lit(name)), F.lit(":"), value))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def insert_tuples(df: DataFrame, nulls: tuple[str, ...] = ("NULL",), types: dict[str, str] | None = None, invalid: str = "fail") -> Column:
    """A row as a SQL tuple: null tokens as NULL, BIGINT and DOUBLE as they are, BOOLEAN as 1 or 0, else a literal."""
    from textbench.functions.exprs import typed_value

    out = []
    for c in df.columns:
        cell = F.col(f"`{c}`")
        kind = (types or {}).get(c, "TEXT")
        value = sql_literal(cell, invalid)
        if kind != "TEXT":
            bad = F.raise_error(F.concat(F.lit(f"no {kind} in column {c}: "), text(cell))).cast("string")
            value = F.coalesce(typed_value(cell, kind), bad)
        out.append(F.when(cell.isNull() | text(cell).isin(list(nulls)), "NULL").otherwise(value))
    return F.concat(F.lit("("), F.concat_ws(", ", *out), F.lit(")"))


def insert_statements(df: DataFrame, table: str, record_no: str, rows: int = 500, verb: str = "INSERT INTO", **options) -> DataFrame:
    """(batch, value): INSERT statements of at most `rows` rows, in record order."""
    if verb not in ("INSERT INTO", "INSERT IGNORE INTO", "REPLACE INTO") or not 1 <= rows <= 10_000:
        raise ValueError("no such statement or batch size")
    data = df.drop(record_no)
    names = normalised_names(data.columns)
    quote = lambda n: "`" + n.replace("`", "``") + "`"
    head = f"{verb} {quote(table)} ({', '.join(map(quote, names))}) VALUES\n"
    tuples = df.select(F.col(record_no).alias("n"), F.floor((F.col(record_no) - 1) / rows).alias("batch"), insert_tuples(data, **options).alias("t"))
    parts = tuples.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("p"))
    return parts.select("batch", F.concat(F.lit(head), F.array_join(F.transform("p", lambda x: x["t"]), ",\n"), F.lit(";")).alias("value"))


def byte_batches(tuples: DataFrame, rows: int, most: int, group: list[str], block: int = 1 << 17) -> DataFrame:
    """`tuples` (group, n, t) with batch: a new one where it would pass `rows` rows or `most` bytes, and at each `block` of n.

    Where a batch ends depends on the one before, so a block of a group streams through one task; a large group has many blocks.
    Batches are numbered in order, from the block's first n on, with gaps between blocks.
    """

    def cut(batches):
        key, batch, n, size = None, 0, 0, 0
        for b in batches:
            out = []
            own = list(zip(*(b.column(b.schema.get_field_index(g)).to_pylist() for g in [*group, "block__"])))
            for k, t in zip(own, b.column(b.schema.get_field_index("t")).to_pylist()):
                length = len(t.encode()) + 2
                if k != key:
                    key, batch, n, size = k, k[-1] * block, 0, 0
                elif n == rows or (n and size + length > most):
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + length
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int64())], [*b.schema.names[:-1], "batch"])

    ordered = tuples.withColumn("block__", F.floor(F.col("n") / block)).repartition(*group, "block__").sortWithinPartitions(*group, "block__", "n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tuples.schema.fields)
    return ordered.mapInArrow(cut, f"{schema}, batch long")


def create_table(table: str, columns: list[tuple[str, str]]) -> str:
    """CREATE TABLE IF NOT EXISTS from names and inferred types."""
    kinds = {"BIGINT": "BIGINT", "DOUBLE": "DOUBLE", "BOOLEAN": "TINYINT(1)", "TEXT": "LONGTEXT"}
    quote = lambda n: "`" + n.replace("`", "``") + "`"
    body = ",\n".join(f"  {quote(n)} {kinds[k]} NULL" for n, k in columns)
    return f"CREATE TABLE IF NOT EXISTS {quote(table)} (\n{body}\n);"


def markdown_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table: bars escaped, line ends as spaces."""
    cell = lambda c: F.regexp_replace(F.replace(text(F.col(f"`{c}`")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value"))


def markdown_header(columns: list[str]) -> list[str]:
    """The two head lines; blank names become colN."""
    names = [(c.strip() or f"col{i}").replace("|", "\\|") for i, c in enumerate(columns, 1)]
    return ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]


# --- splits -----------------------------------------------------------------------------------------------------------


def line_parts(lines: DataFrame, per_part: int) -> DataFrame:
    """`lines` with part: line_no cut into parts of equal size."""
    return lines.withColumn("part", F.floor((F.col("line_no") - 1) / per_part))


def line_manifest(lines: DataFrame, per_part: int) -> DataFrame:
    """part, first_line, last_line, lines and bytes (with LF) of each part."""
    own = line_parts(lines, per_part).groupBy("part")
    return own.agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))


def write_line_parts(lines: DataFrame, path: str, per_part: int) -> None:
    """A folder for each part; at most 10,000 parts."""
    parts = line_parts(lines, per_part)
    if parts.agg(F.max("part")).first()[0] >= MAX_PARTS:
        raise ValueError("more than 10,000 parts")
    parts.repartition("part").sortWithinPartitions("part", "line_no").select("part", F.col("line").alias("value")).write.mode("errorifexists").partitionBy("part").text(path)


def byte_ranges(files: DataFrame, per_part: int, size: str = "length") -> DataFrame:
    """Each file's ranges [start, end) of at most `per_part` bytes."""
    last = F.greatest(F.floor((F.col(size) - 1) / per_part), F.lit(0))
    rows = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumn("start", F.col("part") * per_part).withColumn("end", F.least((F.col("part") + 1) * per_part, F.col(size)))


def read_ranges(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, part, start, end, bytes, sha256): the bytes of each range of `binaryFile` rows. A file meets its ranges once."""
    own = ranges.groupBy("path").agg(F.collect_list(F.struct("part", "start", "end")).alias("ranges"))
    piece = lambda r: F.substring("content", r["start"].cast("int") + 1, (r["end"] - r["start"]).cast("int"))  # noqa: E731  Spark holds files of 2 GB at most
    cut = F.transform("ranges", lambda r: F.struct(r["part"].alias("part"), r["start"].alias("start"), r["end"].alias("end"), piece(r).alias("bytes")))
    rows = files.select("path", "content").join(own, "path").select("path", F.inline(cut))
    return rows.withColumn("sha256", F.sha2("bytes", 256))


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first..last; a `last` behind the end is cut, a `first` behind it is an error for the caller to raise on no rows."""
    if first < 1 or last < first:
        raise ValueError("no such line range")
    return lines.filter(F.col("line_no").between(first, last))


def export_ranges(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records (start, end) that lie in one of a few ordered ranges (range_start, range_end); overlapping ranges are refused.

    The ranges are a caller's list of at most 10,000, sorted on the driver; each record finds the last one that starts at or before
    it by bisection.
    """
    listed = ranges.select("range_start", "range_end").limit(MAX_PARTS + 1).collect()
    if len(listed) > MAX_PARTS:
        raise ValueError("more than 10,000 ranges")
    listed = sorted((r.range_start, r.range_end) for r in listed)
    if any(hi < lo for lo, hi in listed) or any(a[1] > b[0] for a, b in zip(listed, listed[1:])):
        raise ValueError("ranges overlap")
    bounds = np.array(listed, np.int64).reshape(-1, 2)

    @F.arrow_udf("int")
    def within(start: pa.Array, end: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds[:, 0], start.to_numpy(zero_copy_only=False), "right") - 1
        ok = (at >= 0) & (end.to_numpy(zero_copy_only=False) <= bounds[np.maximum(at, 0), 1]) if len(bounds) else np.zeros(len(start), bool)
        return pa.array(at, pa.int32(), mask=~ok)

    named = ranges.withColumn("range_no__", within(F.col("range_start"), F.col("range_start")))
    found = records.withColumn("range_no__", within(F.col("start").cast("long"), F.col("end").cast("long"))).filter("range_no__ IS NOT NULL")
    return found.join(F.broadcast(named), "range_no__").drop("range_no__").orderBy("range_start", "start")


def table_manifest(statements: DataFrame, key: list[str]) -> DataFrame:
    """Bytes, statements, first and last offset of each table's regions."""
    return statements.groupBy(*key).agg(
        F.sum(F.col("end") - F.col("start")).alias("bytes"), F.count("*").alias("regions"), F.min("start").alias("first"), F.max("end").alias("last")
    )


def split_manifest(statements: DataFrame, bucket: int = 4096) -> DataFrame:
    """The manifest of a split by table: database, table, name (portable, unique also without regard to case), bytes, regions,
    first, last, charsets (named in its statements, in lower case and order) and sha256.

    sha256 covers the hashes of the table's statements in order: first of each `bucket` statement numbers, then of those, so a
    table of any size is hashed without being gathered.
    """
    from textbench.functions.exprs import safe_file_name_full
    from textbench.operators.dump import CHARSET, unique_names

    key = ["database", "table"]
    rows = statements.filter("table IS NOT NULL")
    rows = rows.withColumn("names", F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(CHARSET), F.lit(1)), lambda x: F.lower(x))))
    hashed = lambda at, what: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what]), ""), 256)
    parts = rows.withColumn("own", F.sha2("text", 256)).withColumn("bucket", F.floor(F.col("stmt_no") / bucket)).groupBy(*key, "bucket")
    parts = parts.agg(hashed("stmt_no", "own").alias("own"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.count("*").alias("regions"), F.min("start").alias("first"), F.max("end").alias("last"))
    out = parts.groupBy(*key).agg(
        F.sum("bytes").alias("bytes"), F.sum("regions").alias("regions"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("charsets"), hashed("bucket", "own").alias("sha256"),
    )
    name = safe_file_name_full(F.concat_ws(".", F.nullif("database", F.lit("")), "table"))
    return unique_names(out.withColumn("name", name), "name", "first").select(*key, "name", "bytes", "regions", "first", "last", "charsets", "sha256")


def write_by_table(statements: DataFrame, path: str, manifest: DataFrame | None = None) -> None:
    """A folder for each table with its statements in order, named as in `manifest`, by default that of `split_manifest`."""
    names = (split_manifest(statements) if manifest is None else manifest).select("database", "table", "name")
    named = statements.filter("table IS NOT NULL").join(names, ["database", "table"])
    # by ranges of (name, start): a large table is written by many tasks, and its files are in the order of their names
    dealt = named.repartitionByRange("name", "start").sortWithinPartitions("name", "start")
    dealt.select("name", F.col("text").alias("value")).write.mode("errorifexists").partitionBy("name").text(path)
