"""Inference and profiling over whole tables: types, column profiles, delimiter and header guesses, censuses, fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.exprs import text

NULL_TOKENS = ("", "NULL", "null", r"\N")
#: Bits of the kinds of cells.
INT, FLOAT, BOOL, TEXT = 1, 2, 4, 8


def kind_bit(c: Column) -> Column:
    """BIGINT, DOUBLE, BOOLEAN or TEXT as a bit: integers with leading zeros or beyond 64 bits are text."""
    t = text(c)
    whole = t.rlike(r"^[+-]?[0-9]+\z")
    padded = t.rlike(r"^[+-]?0[0-9]")
    decimal = t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z") & ~padded & (F.abs(t.try_cast("double")) < float("inf"))
    out = F.when(whole & ~padded & t.try_cast("bigint").isNotNull(), INT).when(whole, TEXT).when(decimal, FLOAT)
    return out.when(F.lower(t).isin("true", "false"), BOOL).otherwise(TEXT)


def type_name(bits: Column) -> Column:
    return F.when(bits == INT, "BIGINT").when(bits.isin(FLOAT, INT | FLOAT), "DOUBLE").when(bits == BOOL, "BOOLEAN").otherwise("TEXT")


def cells(df: DataFrame) -> DataFrame:
    """(column_no, column, value): each cell of the table as text."""
    pairs = [F.struct(F.lit(i).alias("column_no"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(df.columns, 1)]
    return df.select(F.inline(F.array(*pairs)))


def _known(nulls: tuple[str, ...]) -> Column:
    return F.col("value").isNotNull() & ~F.col("value").isin(list(nulls))


def infer_schema(df: DataFrame, nulls: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """column_no, column, type, non_null and null counts over all rows (no sample), by one aggregate of a few numbers a column;
    no rows for an empty table."""
    sums = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`").cast("string")
        known = c.isNotNull() & ~c.isin(list(nulls))
        sums += [F.bit_or(F.when(known, kind_bit(c)).otherwise(0)).alias(f"b{i}"), F.count_if(known).alias(f"n{i}")]
    one = df.agg(F.count("*").alias("all"), *sums).filter(F.col("all") > 0)
    rows = [F.struct(F.lit(i + 1).alias("column_no"), F.lit(name).alias("column"), type_name(F.col(f"b{i}")).alias("type"), F.col(f"n{i}").alias("non_null"), (F.col("all") - F.col(f"n{i}")).alias("null_count")) for i, name in enumerate(df.columns)]
    return one.select(F.inline(F.array(*rows)))


def top_values(df: DataFrame, k: int = 10, nulls: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """The k most frequent values of each column, ties by value."""
    counts = cells(df).filter(_known(nulls)).groupBy("column_no", "column", "value").count()
    rank = F.row_number().over(Window.partitionBy("column_no").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def profile(df: DataFrame, nulls: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Counts, exact distinct, bytewise min and max, and type of each column.

    Equal values meet first, so what is counted per column is one row for each distinct value.
    """
    known = _known(nulls)
    values = cells(df).groupBy("column_no", "column", "value").agg(F.count("*").alias("n"))
    found = values.groupBy("column_no", "column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(known).alias("distinct_count"),
        F.min(F.when(known, F.col("value"))).alias("min_value"),
        F.max(F.when(known, F.col("value"))).alias("max_value"),
        F.bit_or(F.when(known, kind_bit(F.col("value"))).otherwise(0)).alias("bits"),
    )
    return found.withColumn("type", type_name(F.col("bits"))).drop("bits")


def profile_with_top(df: DataFrame, k: int = 10, nulls: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """`profile` with `top`, an array of the k most frequent values with their counts."""
    top = top_values(df, k, nulls).groupBy("column_no").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("top"))
    return profile(df, nulls).join(top, "column_no", "left").drop("column_no")


def ragged_rows(df: DataFrame, order_by: str) -> DataFrame:
    """How many records are wider or narrower than the first; df: `fields ARRAY<STRING>`."""
    first = df.orderBy(order_by).limit(1).select(F.size("fields").alias("width"))
    return df.join(F.broadcast(first)).agg(F.count_if(F.size("fields") != F.col("width")).alias("ragged_rows"))


#: Delimiters that are tried, by name.
DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}


def delimiter_scores(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """For each file and delimiter: the modal field count of the rows with more than one field, how consistent it is, and the score
    70 * consistency + 20 * min(fields, 64) / 64 + 10 * min(rows, 25) / 25, ranked within the file; lines: a sample of each file."""
    names = F.array(*[F.struct(F.lit(n).alias("delimiter"), F.lit(d).alias("d")) for n, d in DELIMITERS.items()])
    rows = lines.filter(text(F.col(line)) != "").select(F.col(file).alias("file"), F.col(line).alias("line"), F.explode(names).alias("x")).select("file", "line", "x.*")
    rows = rows.withColumn("fields", F.length("line") - F.length(F.replace("line", F.col("d"), F.lit(""))) + 1)
    counts = rows.groupBy("file", "delimiter", "fields").agg(F.count("*").alias("n"))
    per = counts.groupBy("file", "delimiter").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.max(F.when(F.col("fields") > 1, F.struct("n", "fields")))["n"], F.lit(0)).alias("modal_rows"),
        F.coalesce(F.max(F.when(F.col("fields") > 1, F.struct("n", "fields")))["fields"], F.lit(0)).alias("fields"),
    )
    score = 70.0 * F.col("modal_rows") / F.col("total") + 20.0 * F.least("fields", F.lit(64)) / 64.0 + 10.0 * F.least("total", F.lit(25)) / 25.0
    per = per.withColumn("score", F.when(F.col("modal_rows") > 0, F.round(score, 6)).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "delimiter"))
    level = F.when(F.col("score") >= 85, "high").when(F.col("score") >= 60, "medium").when(F.col("score") > 0, "low").otherwise("none")
    return per.select("file", "delimiter", "fields", "modal_rows", "total", "score", rank.alias("rank"), level.alias("confidence"))


def has_header(records: DataFrame, file: str = "file", order_by: str = "record_no") -> DataFrame:
    """(file, header): do the first two non-blank records have one width, the first a text-like cell, and half of the second data?"""
    blank = F.forall("fields", lambda c: F.trim(c) == "")
    two = records.filter(~blank).withColumn("r", F.row_number().over(Window.partitionBy(file).orderBy(order_by))).filter("r <= 2")
    rows = two.groupBy(file).agg(F.max(F.when(F.col("r") == 1, F.col("fields"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("fields"))).alias("b"))
    data = F.size(F.filter("b", lambda c: (kind_bit(c) != TEXT) | (F.trim(c) == "")))
    names = F.size(F.filter("a", lambda c: (kind_bit(c) == TEXT) & c.rlike(r"\p{L}")))
    ok = (F.size("a") == F.size("b")) & (names >= 1) & (data >= F.expr("size(b) div 2"))
    return rows.select(file, F.coalesce(ok, F.lit(False)).alias("header"))


def column_guide(df: DataFrame, most: int = 500) -> DataFrame:
    """(number, name, type) of the first columns by the inferred types: what an export by number needs to name."""
    return infer_schema(df).filter(F.col("column_no") <= most).select(F.col("column_no").alias("number"), F.col("column").alias("name"), "type")


# --- censuses ---------------------------------------------------------------------------------------------------------


def line_ending(c: Column) -> Column:
    """CRLF, LF, CR, mixed or none."""
    both, lf, cr = F.regexp_count(c, F.lit("\r\n")), F.regexp_count(c, F.lit("\n")), F.regexp_count(c, F.lit("\r"))
    kinds = (both > 0).cast("int") + (lf > both).cast("int") + (cr > both).cast("int")
    return F.when(kinds > 1, "mixed").when(both > 0, "CRLF").when(lf > 0, "LF").when(cr > 0, "CR").otherwise("none")


def file_type(path: Column, sample: Column) -> Column:
    """Text by name, then by the shape of a sample; binary with a NUL or more than 3 % control characters."""
    t, head = text(sample), F.ltrim(F.substring(text(sample), 1, 4096))
    controls = F.regexp_count(t, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    binary = F.contains(t, F.lit("\x00")) | (controls * 100 > F.length(t) * 3)
    end = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)\z", 1))
    by_name = F.when(end.isin("txt", "text"), "text").when(end.isin("csv", "tsv", "sql", "json", "yaml", "xml", "log"), end).when(end == "yml", "yaml")
    sql = F.contains(F.upper(head), F.lit("CREATE TABLE")) | F.contains(F.upper(head), F.lit("INSERT INTO"))
    shape = F.when(sql, "sql").when(head.rlike(r"^[{\[]"), "json").when(head.rlike(r"^---") | F.contains(head, F.lit(":\n")), "yaml").otherwise("text")
    return F.when(binary, "binary").otherwise(F.coalesce(by_name, shape))


def detect_encoding(raw: bytes) -> tuple[str, bool, bool]:
    """(encoding, has a byte order mark, is a guess) of a sample."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if raw.startswith(mark):
            return name, True, False
    even, odd = raw[0::2].count(0), raw[1::2].count(0)
    half = max(len(raw) // 2, 1)
    if max(even, odd) * 10 > half * 3:
        return ("Ambiguous UTF-16" if min(even, odd) * 2 > max(even, odd) else "UTF-16LE" if odd > even else "UTF-16BE"), False, True
    for cut in range(min(4, len(raw) + 1)):
        try:
            raw[: len(raw) - cut].decode()
            return "UTF-8", False, False
        except UnicodeDecodeError:
            continue
    cyrillic = sum(0xC0 <= b for b in raw) + raw.count(0xA8) + raw.count(0xB8)
    high = sum(b >= 0x80 for b in raw)
    runs = sum(raw[i] >= 0xC0 and raw[i + 1] >= 0xC0 for i in range(len(raw) - 1))
    return ("Windows-1251" if cyrillic * 10 >= high * 8 and runs * 2 >= high else "Windows-1252"), False, True


def encoding_census(files: DataFrame, sample: int = 65536) -> DataFrame:
    """encoding, bom, guess, files and bytes of a `binaryFile` table, each file judged by its first bytes."""

    @F.pandas_udf("encoding string, bom boolean, guess boolean")
    def detect(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect_encoding(bytes(b)) for b in s], columns=["encoding", "bom", "guess"])

    found = files.select("length", detect(F.substring("content", 1, sample)).alias("e"))
    return found.groupBy("e.encoding", "e.bom", "e.guess").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


# --- fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint_manifest(df: DataFrame, key: str, content: str, chunk: int = 4096) -> DataFrame:
    """(key, chunk_no, bytes, sha256): hashes of fixed chunks of each row's content, made before the chunks become rows."""
    raw = F.col(content).cast("binary")
    last = F.greatest(F.floor((F.octet_length(raw) - 1) / chunk), F.lit(0)).cast("int")

    def hashed(i):
        part = F.substring(raw, i * chunk + 1, F.lit(chunk))
        return F.struct(i.alias("chunk_no"), F.octet_length(part).cast("long").alias("bytes"), F.sha2(part, 256).alias("sha256"))

    return df.select(key, F.inline(F.transform(F.sequence(F.lit(0), last), hashed)))


def manifest_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed chunks between two manifests."""
    a = old.select(*keys, F.col("sha256").alias("was"))
    b = new.select(*keys, F.col("sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).filter("change IS NOT NULL")
