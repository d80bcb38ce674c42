"""SQL-dump operators over a table of statements: inventory, counters, lint, extract, reshape."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.exprs import portable_key

KEY = ["database", "table"]
DATA = ("insert", "replace")


def regions(statements: DataFrame) -> DataFrame:
    """(database, table, kind, start, end): one row for each statement that makes or fills a table."""
    return statements.filter(F.col("kind").isin("create", *DATA)).select(*KEY, "kind", "start", "end")


def inventory(statements: DataFrame) -> DataFrame:
    """For each table of a dump: first offsets of its CREATE and data, bytes, and how many regions it has (see `regions`)."""
    return regions(statements).groupBy(*KEY).agg(
        F.min(F.when(F.col("kind") == "create", F.col("start"))).alias("create_offset"),
        F.min(F.when(F.col("kind").isin(*DATA), F.col("start"))).alias("insert_offset"),
        F.min("start").alias("first_offset"),
        F.sum(F.col("end") - F.col("start")).alias("bytes"),
        F.count("*").alias("regions"),
    )


def counters(statements: DataFrame) -> DataFrame:
    """(name, value): tables created and filled, DEFINER clauses, and whether the dump's header names its tool."""
    text, kind = F.col("text"), F.col("kind")
    got = statements.agg(
        F.count_if(kind == "create").alias("create_tables"),
        F.count_distinct(F.when(kind.isin(*DATA), F.struct(*KEY))).alias("insert_tables"),
        F.coalesce(F.sum(F.regexp_count(text, F.lit(r"(?i)\bDEFINER\s*="))), F.lit(0)).alias("definers"),
        F.count_if(text.rlike(r"(?i)^-- (MySQL|MariaDB) dump")).alias("header"),
    )
    return got.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in got.columns])))


#: How a statement names a charset or a collation.
CHARSET = r"(?i)\b(?:CHARSET|CHARACTER\s+SET)\s*=?\s*([A-Za-z0-9_]+)"
COLLATION = r"(?i)\bCOLLATE\s*=?\s*([A-Za-z0-9_]+)"


def named_settings(statements: DataFrame, what: str) -> DataFrame:
    """(name, n): how often each charset or collation is named, in lower case."""
    pattern = {"charset": CHARSET, "collation": COLLATION}[what]
    names = statements.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    return names.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))


def empty_tables(created: DataFrame, filled: DataFrame, key: list[str]) -> DataFrame:
    """Tables with a CREATE and no data."""
    return created.join(filled, key, "left_anti").select(*key)


def lint(statements: DataFrame) -> DataFrame:
    """(level, finding, detail): empty tables, DEFINER clauses, mixed charsets or collations and the largest tables; one row that says so if there is nothing."""
    made, data = statements.filter("kind = 'create'").select(*KEY).distinct(), statements.filter(F.col("kind").isin(*DATA)).select(*KEY).distinct()
    name = lambda: F.concat_ws(".", F.nullif("database", F.lit("")), "table")


    def listed(names: DataFrame) -> DataFrame:
        """How many names there are, and the first eight of them."""
        first = names.select(F.lit(0).cast("long").alias("n"), "name").orderBy("name").limit(8)
        both = first.unionByName(names.agg(F.count("*").alias("n")).withColumn("name", F.lit(None).cast("string")))
        return both.agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))

    row = lambda df, level, finding, detail, when: df.filter(when).select(F.lit(level).alias("level"), F.lit(finding).alias("finding"), detail.alias("detail"))
    empty = listed(empty_tables(made, data, KEY).select(name().alias("name")))
    definers = counters(statements).filter("name = 'definers'")
    out = row(empty, "warn", "tables without data", F.col("names"), F.col("n") > 0)
    out = out.unionByName(row(definers, "warn", "DEFINER clauses", F.col("value").cast("string"), F.col("value") > 0))
    for what, level in (("charset", "warn"), ("collation", "info")):
        some = listed(named_settings(statements, what).select("name"))
        out = out.unionByName(row(some, level, f"more than one {what}", F.col("names"), F.col("n") > 1))
    none = out.agg(F.count("*").alias("n"))
    largest = inventory(statements).orderBy(F.desc("bytes"), *KEY).limit(3).select(F.lit("info").alias("level"), F.lit("large table").alias("finding"), name().alias("detail"))
    return out.unionByName(row(none, "info", "no issues found", F.lit(""), F.col("n") == 0)).unionByName(largest)


def extract_table(statements: DataFrame, table: str, database: str = "", what: str = "all") -> DataFrame:
    """A table's statements in order: all, only its schema or only its data."""
    kinds = {"all": ("create", *DATA), "schema": ("create",), "data": DATA}[what]
    return statements.filter((F.col("table") == table) & (F.col("database") == database) & F.col("kind").isin(*kinds)).orderBy("start")


def extract_schema(statements: DataFrame) -> DataFrame:
    """The preamble before the first table and all CREATEs."""
    first = statements.filter(F.col("kind").isin("create", *DATA)).agg(F.min("start").alias("first"))
    return statements.join(F.broadcast(first)).filter((F.col("kind") == "create") | (F.col("start") < F.col("first"))).drop("first").orderBy("start")


def overlaps(ranges: DataFrame, group: list[str], order: str = "start") -> DataFrame:
    """Ranges of a group that start before an earlier one ends, or end before they start."""
    before = F.max("end").over(Window.partitionBy(*group).orderBy(order, "end").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("upto", before).filter("upto > start OR end < start")


#: Names of one root can get in each other's way: the numbers that an allocation adds, at the end or cut off by the length, do not
#: count. A root is taken from so many characters.
_ROOT = r"(?:_[0-9]*)+\z"
_ROOTED = 60


def allocate(names: Iterable[tuple[str, str]], most: int = 180) -> Iterator[str]:
    """Names in order, from pairs (name, key): one whose key is taken gets _02, _03, ... from its place among the equal ones on,
    until nothing has that key, whether it was a name or was given."""
    used: dict[str, int] = {}
    for name, key in names:
        used[key] = n = used.get(key, 0) + 1
        while n > 1:
            end = f"_{n:02d}"
            tried = name.encode()[: most - len(end)].decode(errors="ignore") + end
            folded = unicodedata.normalize("NFC", tried).casefold()
            if folded not in used:
                used[folded], name = 1, tried
                break
            n += 1
        yield name


def unique_names(df: DataFrame, name: str, order_by: str, most: int = 180) -> DataFrame:
    """`df` with names (of at most `most` bytes) that differ also in their composed form and without regard to case: an equal one
    gets _02, _03, ... in the order of `order_by`, past all numbers that are names themselves (see allocate()).

    Only names whose root (the name without such numbers) has two equal ones can change; the names of such a root stream in order
    through one task, all others stay where they are.
    """
    rows = df.withColumn("_key", portable_key(F.col(name))).withColumn("_root", F.regexp_replace(F.substring("_key", 1, _ROOTED), _ROOT, ""))
    twice = rows.groupBy("_root", "_key").count().filter("count > 1").select("_root").distinct()
    alone = rows.join(twice, "_root", "left_anti").select(*df.columns)
    shared = rows.join(twice, "_root", "left_semi").repartition("_root").sortWithinPartitions("_root", order_by)
    columns = df.columns
    at, key, root = columns.index(name), len(columns), len(columns) + 1

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sent, given = None, deque(), None
        for batch in batches:
            out = []
            for n, k, r in zip(*(batch.column(i).to_pylist() for i in (at, key, root))):
                if r != last or given is None:
                    last, sent = r, deque()
                    given = allocate(iter(sent.popleft, None), most)
                sent.append((n, k))
                out.append(next(given))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(key)], columns)

    kinds = ", ".join(f"`{f.name}` {'string' if f.name == name else f.dataType.simpleString()}" for f in df.schema.fields)
    return alone.unionByName(shared.select(*df.columns, "_key", "_root").mapInArrow(named, kinds))


# --- reshape ----------------------------------------------------------------------------------------------------------

_INSERT = re.compile(r"(?is)^((?:\s+|--[^\n]*\n|#[^\n]*\n|/\*(?!!).*?\*/)*(?:INSERT|REPLACE)\b(?:[^'\"`(;]|`[^`]*`|\([^()]*\))*?\bVALUES?\s*)(?=\()")
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|[()]|/\*!|--|#", re.S)


def split_tuples(statement: str) -> tuple[str, list[str]]:
    """(head, tuples) of an INSERT or REPLACE with VALUES; anything else behind or between the tuples is refused."""
    m = _INSERT.match(statement)
    if not m or re.search(r"(?i)\bOVERWRITE\b|/\*!", m[1]):
        raise ValueError(f"no plain INSERT: {statement[:60]!r}")
    at, depth, begin, out = m.end(), 0, 0, []
    text = statement.rstrip().removesuffix(";").rstrip()
    while at < len(text):
        t = _TOKEN.search(text, at)
        if not t:
            raise ValueError("an unclosed tuple" if depth else "something follows the tuples")
        if depth == 0 and (t[0] != "(" or text[at : t.start()].strip() not in ("", ",") or (bool(out) != ("," in text[at : t.start()]))):
            raise ValueError("something stands between or behind the tuples")
        if t[0] in ("/*!", "--", "#"):
            raise ValueError("a comment inside the tuples")
        if t[0] == "(":
            begin, depth = (t.start() if depth == 0 else begin), depth + 1
        elif t[0] == ")":
            depth -= 1
            if depth == 0:
                out.append(text[begin : t.end()])
        at = t.end()
    if depth or not out:
        raise ValueError("an unclosed tuple")
    return m[1], out


def explode_inserts(statements: DataFrame) -> DataFrame:
    """Each INSERT or REPLACE as one row for each tuple: the statement's columns, head, tuple_no and tuple."""

    @F.pandas_udf("head string, tuples array<string>")
    def cut(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_tuples(t) for t in s], columns=["head", "tuples"])

    rows = statements.filter(F.col("kind").isin(*DATA)).withColumn("_cut", cut("text"))
    return rows.select("*", F.col("_cut.head").alias("head"), F.posexplode("_cut.tuples").alias("tuple_no", "tuple")).drop("_cut")


def single_inserts(statements: DataFrame) -> DataFrame:
    """The dump with one statement for each tuple; a leading comment stays with the first."""
    rows = explode_inserts(statements)
    bare = F.regexp_replace("head", r"(?s)^(?:\s+|--[^\n]*\n|#[^\n]*\n|/\*(?!!).*?\*/)*", "")
    one = rows.select("stmt_no", F.col("tuple_no").alias("part"), F.concat(F.when(F.col("tuple_no") == 0, F.col("head")).otherwise(bare), F.col("tuple"), F.lit(";")).alias("text"))
    rest = statements.filter(~F.col("kind").isin(*DATA)).select("stmt_no", F.lit(0).alias("part"), "text")
    return one.unionByName(rest).orderBy("stmt_no", "part")


def islands(df: DataFrame, group: list[str], order: list[str], same: str, size: int) -> DataFrame:
    """Consecutive rows of a group with an equal value `same`, cut into batches of at most `size`: island and batch."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("_new", F.when(F.lag(same).over(w).eqNullSafe(F.col(same)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(w)).drop("_new")
    place = F.row_number().over(Window.partitionBy(*group, "island").orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size))


def multi_inserts(statements: DataFrame, size: int = 100, most_bytes: int = 8 << 20, block: int = 1024) -> DataFrame:
    """Consecutive INSERTs with one head regrouped to at most `size` rows and `most_bytes` bytes (or one longer row); any other
    statement or a comment starts anew.

    Runs of equal heads are found in blocks of `block` statements; only the blocks' ends and counts are put in line for a file.
    """
    if not 0 < size <= 10_000:
        raise ValueError("1 to 10,000 rows")
    tuples = explode_inserts(statements).select("file", "stmt_no", "tuple_no", "head", "tuple")
    other = statements.filter(~F.col("kind").isin(*DATA)).select("file", "stmt_no", F.lit(0).alias("tuple_no"), F.concat(F.lit("\0"), F.col("stmt_no").cast("string")).alias("head"), F.col("text").alias("tuple"))
    rows = tuples.unionByName(other).withColumn("block", F.floor(F.col("stmt_no") / block))
    inside = Window.partitionBy("file", "block").orderBy("stmt_no", "tuple_no")
    rows = rows.withColumn("fresh", F.when(F.lag("head").over(inside).eqNullSafe(F.col("head")) | (F.row_number().over(inside) == 1), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(inside))
    at = F.struct("stmt_no", "tuple_no")
    blocks = rows.groupBy("file", "block").agg(F.min_by("head", at).alias("first"), F.max_by("head", at).alias("end"), F.max("run").alias("runs"))
    line = Window.partitionBy("file").orderBy("block")
    fresh = F.when(F.lag("end").over(line).eqNullSafe(F.col("first")), 0).otherwise(1)
    blocks = blocks.withColumn("fresh", fresh).withColumn("base", F.sum(F.col("fresh")).over(line) + F.sum("runs").over(line) - F.col("runs"))
    rows = rows.join(blocks.select("file", "block", "base"), ["file", "block"]).withColumn("island", F.col("base") + F.col("run"))
    counts = rows.groupBy("file", "island", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file", "island").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.select("file", "island", "block", before.alias("before")), ["file", "island", "block"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("file", "island", "block").orderBy("stmt_no", "tuple_no")) - 1
    rows = rows.withColumn("batch", F.floor(place / size))
    parts = rows.groupBy("file", "island", "batch").agg(F.first("head").alias("head"), F.sort_array(F.collect_list(F.struct("stmt_no", "tuple_no", "tuple"))).alias("t"))

    def packed(acc, x):
        n = F.octet_length(x["tuple"]) + 1
        part = F.when(acc["bytes"] + n > most_bytes, acc["part"] + 1).otherwise(acc["part"])
        own = F.struct(part.alias("part"), x["stmt_no"].alias("stmt_no"), x["tuple"].alias("tuple"))
        return F.struct(part.alias("part"), F.when(part > acc["part"], n).otherwise(acc["bytes"] + n).alias("bytes"), F.concat(acc["out"], F.array(own)).alias("out"))

    # A batch has `size` rows at most, so that its parts fit one row; bytes count from the head on.
    start = F.struct(F.lit(0).alias("part"), F.octet_length("head").alias("bytes"), F.array().cast("array<struct<part:int,stmt_no:bigint,tuple:string>>").alias("out"))
    long = F.aggregate(F.transform("t", lambda x: F.octet_length(x["tuple"]) + 1), F.octet_length("head"), lambda a, n: a + n) > most_bytes
    cut = F.when(long, F.aggregate("t", start, packed, lambda a: a["out"])).otherwise(F.transform("t", lambda x: F.struct(F.lit(0).alias("part"), x["stmt_no"].cast("long").alias("stmt_no"), x["tuple"].alias("tuple"))))
    parts = parts.select("file", "island", "batch", "head", F.posexplode(cut).alias("i", "x")).groupBy("file", "island", "batch", F.col("x.part").alias("part"))
    parts = parts.agg(F.min("x.stmt_no").alias("stmt_no"), F.first("head").alias("head"), F.sort_array(F.collect_list(F.struct("i", "x.tuple"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["tuple"]), ",")
    text = F.when(F.startswith("head", F.lit("\0")), joined).otherwise(F.concat("head", joined, F.lit(";")))
    return parts.select("stmt_no", "island", "batch", "part", text.alias("text")).orderBy("stmt_no", "island", "batch", "part")


def sample_fixture(statements: DataFrame, rows_per_table: int = 100) -> DataFrame:
    """Preamble, each table's DDL and its first tuples, one INSERT for each statement they come from; REPLACE is refused."""
    if statements.filter("kind = 'replace'").limit(1).collect():
        raise ValueError("a dump with REPLACE has no first rows")
    tuples = explode_inserts(statements)
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("stmt_no", "tuple_no"))
    kept = tuples.withColumn("place", place).filter(F.col("place") <= rows_per_table)
    parts = kept.groupBy("stmt_no", "head").agg(F.sort_array(F.collect_list(F.struct("tuple_no", "tuple"))).alias("t"))
    data = parts.select("stmt_no", F.concat("head", F.array_join(F.transform("t", lambda x: x["tuple"]), ","), F.lit(";")).alias("text"))
    return data.unionByName(extract_schema(statements).select("stmt_no", "text")).orderBy("stmt_no")


def reshape_summary(batched: DataFrame, statement: str, row_count: str, written: str) -> DataFrame:
    """statements_read, rows_seen and statements_written of a regrouping."""
    return batched.agg(F.count_distinct(statement).alias("statements_read"), F.sum(row_count).cast("long").alias("rows_seen"), F.count_distinct(written).alias("statements_written"))
