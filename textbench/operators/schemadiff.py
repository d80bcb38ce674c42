"""CREATE TABLE statements as rows, and the differences between two sets of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|/\*.*?\*/|--[^\n]*|#[^\n]*", re.S)
_NAME = r"(?:`((?:[^`]|``)+)`|\"([^\"]+)\"|([\w$]+))"
_OPTION = re.compile(r"(?i)\b(ENGINE|AUTO_INCREMENT|(?:DEFAULT\s+)?(?:CHARSET|CHARACTER\s+SET)|(?:DEFAULT\s+)?COLLATE|ROW_FORMAT|COMMENT)\s*=?\s*('(?:[^'\\]|\\.|'')*'|[\w.]+)")
_INDEX = re.compile(r"(?i)^(UNIQUE\s+)?(?:FULLTEXT\s+|SPATIAL\s+)?(?:KEY|INDEX)\b")
_CONSTRAINT = re.compile(r"(?i)^(CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK)\b")
#: Words with a meaning of their own in column types, column clauses and table elements; quoted, they are names.
KEYWORDS = frozenset(
    """
    array as asc auto_increment autoincrement bigint binary bit blob bool boolean by
    cascade case cast char character check collate column comment compression conflict
    constraint create current_date current_time current_timestamp date datetime decimal
    default deferrable delete desc distinct double else end enum exists false first float
    foreign generated identity if in initially int integer interval key last localtime
    localtimestamp long match mediumint national no not null numeric on primary real
    references restrict set smallint spatial stored table text then time timestamp tinyint
    true unique unsigned update using uuid values varchar varying virtual when with without
    zerofill zone precision always rowid engine charset fulltext index temporary temp
    unlogged replace or partition inherits strict tablespace

    bigserial box bytea cidr clob dec geometry geometrycollection inet json jsonb line linestring
    longblob longtext macaddr mediumblob mediumtext money nchar nvarchar point polygon serial
    smallserial tinyblob tinytext varbinary xml year

    day hour minute month second signed to

    column_format encoding invisible srid statistics storage visible

    action btree deferred full hash immediate include inherit nulls parser partial simple where
    """.split()
)
_BARE = re.compile(r"[a-z_][a-z0-9_$]*\Z")
_SPELT = re.compile(r"'(?:[^'\\]|\\.|'')*'|`((?:[^`]|``)*)`|\"((?:[^\"]|\"\")*)\"", re.S)


def identity(quote: str, value: str) -> str:
    """What tells a name from others: a quoted one is the bare one only if it is portable (lower case) and no keyword."""
    if not quote or (_BARE.match(value) and value not in KEYWORDS):
        return value
    return f"{quote}{value}{quote}"


def _named(text: str) -> str:
    """`text` with quoted names that are as good as bare ones without their quotes."""
    bare = lambda m: m[0] if m[0][0] == "'" else identity(m[0][0], (m[1] or "").replace("``", "`") if m[0][0] == "`" else (m[2] or "").replace('""', '"'))
    return _SPELT.sub(bare, text)


PARSED = "columns array<struct<name:string,definition:string,place:int,identity:string>>, constraints array<string>, indexes array<string>, options array<struct<name:string,value:string>>, modifiers string, status string, reason string"


def _canonical(text: str) -> str:
    """White space runs as one space outside quotes; comments go."""
    out, at = [], 0
    for m in _QUOTED.finditer(text):
        out.append(re.sub(r"\s+", " ", text[at : m.start()]))
        out.append(" " if m[0][:2] in ("/*", "--") or m[0][0] == "#" else m[0])
        at = m.end()
    return re.sub(r" ?([(),]) ?", r"\1", "".join([*out, re.sub(r"\s+", " ", text[at:])])).strip()


def _elements(body: str) -> list[str]:
    parts, depth, begin, at = [], 0, 0, 0
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|[(),]", body, re.S):
        at = m.start()
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "," and depth == 0:
            parts.append(body[begin:at].strip())
            begin = m.end()
    return [*parts, body[begin:].strip()]


def parse_table(ddl: str) -> tuple:
    """(columns, constraints, indexes, options, modifiers, status, reason); what cannot be read is `unknown`, with the reason."""
    text = _canonical(ddl).rstrip(";").rstrip()
    head = re.match(rf"(?i)CREATE\s+(TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:{_NAME}\.)?{_NAME}\s*\(", text)
    unknown = lambda why: ([], [], [], [], "", "unknown", why)
    if not head:
        return unknown("no CREATE TABLE with a column list")
    depth, end = 1, None
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|[()]", text[head.end() :], re.S):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            end = head.end() + m.start()
            break
    if end is None:
        return unknown("unclosed column list")
    columns, constraints, indexes = [], [], []
    for part in _elements(text[head.end() : end]):
        if _INDEX.match(part):
            indexes.append(_named(part))
        elif _CONSTRAINT.match(part):
            constraints.append(_named(part))
        elif m := re.match(rf"(?s){_NAME}\s+(.+)", part):
            name = (m[1] or m[2] or m[3]).replace("``", "`")
            quote = part[0] if part[0] in "`\"" else ""
            columns.append({"name": name, "definition": _named(m[4]), "place": len(columns) + 1, "identity": identity(quote, name)})
        else:
            return unknown(f"element {part[:40]!r}")
    tail = text[end + 1 :].strip()
    options = {re.sub(r"(?i)DEFAULT\s+", "", m[1]).upper().replace("CHARACTER SET", "CHARSET"): m[2] for m in _OPTION.finditer(tail)}
    rest = re.sub(r"[\s,]+", " ", _OPTION.sub("", tail)).strip()
    if rest:
        options["OTHER"] = rest
    return columns, constraints, indexes, [{"name": k, "value": v} for k, v in sorted(options.items())], (head[1] or "").strip().upper(), "parsed", ""


def parse_tables(statements: DataFrame) -> DataFrame:
    """(database, table, and the parts) of each CREATE statement."""

    @F.pandas_udf(PARSED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_table(t) for t in s], columns=["columns", "constraints", "indexes", "options", "modifiers", "status", "reason"])

    return statements.filter("kind = 'create'").withColumn("_p", run("text")).select("database", "table", "_p.*")


def column_rows(tables: DataFrame) -> DataFrame:
    return tables.select("database", "table", F.inline("columns"))


def element_rows(tables: DataFrame) -> DataFrame:
    """(database, table, kind, text): constraints and indexes."""
    one = lambda kind, c: tables.select("database", "table", F.lit(kind).alias("kind"), F.explode(c).alias("text"))
    return one("constraint", "constraints").unionByName(one("index", "indexes"))


def option_rows(tables: DataFrame) -> DataFrame:
    """(database, table, name, value): options, and the modifiers under MODIFIERS."""
    return tables.select("database", "table", F.inline("options")).unionByName(tables.select("database", "table", F.lit("MODIFIERS").alias("name"), F.col("modifiers").alias("value")))


def diff_values(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change, old, new) for the keys whose value was added, removed or changed."""
    x = a.select(*keys, F.struct(F.col(value).alias("v")).alias("x"))
    y = b.select(*keys, F.struct(F.col(value).alias("v")).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x.v").eqNullSafe(F.col("y.v")), "changed")
    return x.join(y, keys, "full").withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change", F.col("x.v").alias("old"), F.col("y.v").alias("new"))


def diff_columns(a: DataFrame, b: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Columns added, removed or with another definition. name: the column that tells columns apart, `identity` for those of
    column_rows(), where quotes may make another name of one."""
    return diff_values(a, b, [*keys, name], "definition")


def diff_order(a: DataFrame, b: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Tables with the same columns in another order."""
    names = lambda df, as_: df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(name).alias("name")))), lambda s: s["name"]).alias(as_))
    both = names(a, "old").join(names(b, "new"), keys)
    return both.filter((F.col("old") != F.col("new")) & (F.array_sort("old") == F.array_sort("new")))


def diff_elements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference of equal-shaped rows, with `change`."""
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """(keys, change): added, removed, changed, unchanged, or unknown where an identity is doubled or a side is not parsed.

    Names are case-sensitive. a, b: keys, status and the columns `content`.
    """
    side = lambda df, as_: df.groupBy(*keys).agg(F.count("*").alias(f"n_{as_}"), F.min("status").alias(f"s_{as_}"), F.first(F.struct(*content)).alias(as_))
    both = side(a, "x").join(side(b, "y"), keys, "full")
    doubtful = (F.coalesce("n_x", F.lit(1)) > 1) | (F.coalesce("n_y", F.lit(1)) > 1) | (F.coalesce("s_x", F.lit("parsed")) != "parsed") | (F.coalesce("s_y", F.lit("parsed")) != "parsed")
    doubtful = F.when(doubtful | (F.col("s_x") == "unknown") | (F.col("s_y") == "unknown"), "unknown")
    change = F.when(F.col("n_x").isNull(), "added").when(F.col("n_y").isNull(), "removed").when(F.col("x").eqNullSafe(F.col("y")), "unchanged").otherwise("changed")
    return both.select(*keys, F.coalesce(doubtful, change).alias("change"))


def diff_dumps(a: DataFrame, b: DataFrame) -> DataFrame:
    """`diff_tables` of two statement tables. Columns are the same by identity and definition, whatever their quotes."""
    content = ["columns", "constraints", "indexes", "options", "modifiers"]
    bare = F.transform("columns", lambda c: F.struct(c["identity"].alias("identity"), c["definition"].alias("definition")))
    sides = [parse_tables(x).withColumns({"columns": bare, "constraints": F.array_sort("constraints"), "indexes": F.array_sort("indexes")}) for x in (a, b)]
    return diff_tables(*sides, ["database", "table"], content)
