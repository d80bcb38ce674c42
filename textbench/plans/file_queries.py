"""Queries of the file readers: the given tables are written as files, many to a folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.plans.registry import query
from textbench.sources import files as S
from textbench.sources import ranges as R
from textbench.sources import sinks as K
from textbench.sources.work import new_folder


def in_files(rows, least: int):
    """`rows` in the parts they are read in, each of which becomes a file; dealt out only to come to `least` of them, so that no task
    takes a fixed share of the whole table."""
    return rows if rows.rdd.getNumPartitions() >= least else rows.repartition(least)


@query("SELECT doc_id, 'insert' AS kind, source AS table_name, sha256('INSERT INTO `' || source || '` VALUES (' || doc_id || ',''' || replace(replace(text, '''', ''''''), '\\', '\\\\') || ''');') AS text_sha256, strlen('INSERT INTO `' || source || '` VALUES (' || doc_id || ',''' || replace(replace(text, '''', ''''''), '\\', '\\\\') || ''');')::BIGINT AS bytes, true AS closed FROM documents WHERE NOT regexp_matches(text, '\\r')")
def dump_folder_read(table, spark):
    """Documents as INSERT statements in a folder of dumps, line ends and quotes inside the literals; read back, each once."""
    docs = table("documents").filter(~F.contains("text", F.lit("\r")))
    literal = F.concat(F.lit("'"), F.replace(F.replace("text", F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    folder = new_folder(spark, "dump")
    in_files(docs, 8).select(F.concat(F.lit("INSERT INTO `"), "source", F.lit("` VALUES ("), F.col("doc_id").cast("string"), F.lit(","), literal, F.lit(");")).alias("value")).write.text(folder)
    rows = S.read_statements(spark, folder)
    return rows.select(
        F.regexp_extract("text", r"^INSERT INTO `[^`]*` VALUES \((-?\d+),", 1).cast("long").alias("doc_id"),
        "kind",
        F.col("table").alias("table_name"),
        F.sha2("text", 256).alias("text_sha256"),
        (F.col("end") - F.col("start")).alias("bytes"),
        "closed",
    )


def _line_counts(lines):
    return lines.groupBy("line").agg(F.count("*").alias("n")).select(F.sha2("line", 256).alias("line_sha256"), "n")


_LINES = "SELECT sha256(line) AS line_sha256, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) AS line FROM documents) GROUP BY line"


@query(_LINES)
def lines_folder_read(table, spark):
    """The texts as files, one behind the other; all their lines, with what numbers and places are told agreeing for every file."""
    folder = new_folder(spark, "lines")
    in_files(table("documents"), 6).select(F.col("text").alias("value")).write.text(folder)
    return _line_counts(S.read_lines(spark, folder))


@query(_LINES)
def lines_folder_read_utf16(table, spark):
    """The same in UTF-16, where bytes that look like line ends stand inside characters."""
    folder = new_folder(spark, "utf16")
    encoded = F.encode(F.coalesce("text", F.lit("")), "UTF-16LE").cast("string")  # the sink writes the bytes as they are
    in_files(table("documents"), 6).select(encoded.alias("value")).write.options(encoding="UTF-16LE", lineSep="\n").text(folder)
    return _line_counts(S.read_lines(spark, folder, "UTF-16LE"))


@query("SELECT doc_id, sha256(regexp_replace(text, '\\r\\n', chr(10), 'g')) AS text_sha256, source FROM documents WHERE NOT regexp_matches(regexp_replace(text, '\\r\\n', '', 'g'), '\\r')")
def records_folder_read(table, spark):
    """Documents as delimited files, line ends and quotes inside the cells; read back by the strict reader."""
    docs = table("documents").filter(~F.contains(F.replace("text", F.lit("\r\n"), F.lit("")), F.lit("\r")))
    folder = new_folder(spark, "records")
    K.write_delimited(in_files(docs.select("doc_id", "text", "source"), 5), folder, header=False)
    rows = S.read_records(spark, folder)
    cell = lambda i: F.get("fields", F.lit(i))
    return rows.select(cell(0).cast("long").alias("doc_id"), F.sha2(cell(1), 256).alias("text_sha256"), cell(2).alias("source"))


@query("""
SELECT 'the' AS term, sum((strlen(t) - strlen(replace(t, 'the', ''))) // 3)::BIGINT AS n
FROM (SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""")
def search_files(table, spark):
    """Matches of a literal in the bytes of files, read by position in ranges that cut through lines."""
    folder = new_folder(spark, "search")
    in_files(table("documents"), 6).select(F.col("text").alias("value")).write.text(folder)
    found = R.find_in_files(spark, folder, "the", ignore_case=True, per_task=1 << 20, block=1 << 16)
    return found.agg(F.count("*").alias("n")).select(F.lit("the").alias("term"), "n")
