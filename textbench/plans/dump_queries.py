"""Queries over dump and schema-diff operators, on statement and schema rows made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.operators import dump as D
from textbench.operators import schemadiff as X
from textbench.plans.registry import query
from textbench.sources import files, sinks

_KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'insert' ELSE 'replace' END"
_TEXT = "CASE o_orderkey % 3 WHEN 0 THEN 'CREATE TABLE ' ELSE 'INSERT INTO ' END"


def _statements(table):
    return table("orders").select(
        F.expr(_KIND).alias("kind"), F.col("o_orderstatus").alias("database"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table"),
        (F.col("o_orderkey") * 100).alias("start"), (F.col("o_orderkey") * 100 + 50 + F.col("o_custkey") % 7).alias("end"), F.col("o_orderkey").alias("stmt_no"),
    )


_SQL = f"s AS (SELECT {_KIND} AS kind, o_orderstatus AS \"database\", 't' || o_custkey AS \"table\", o_orderkey * 100 AS \"start\", o_orderkey * 100 + 50 + o_custkey % 7 AS \"end\", o_orderkey AS stmt_no FROM orders)"


@query(f"WITH {_SQL} SELECT \"database\", \"table\", min(\"start\") FILTER (kind = 'create') AS create_offset, min(\"start\") FILTER (kind <> 'create') AS insert_offset, min(\"start\") AS first_offset, sum(\"end\" - \"start\")::BIGINT AS bytes, count(*)::INT AS regions FROM s GROUP BY ALL")
def dump_inventory(table, spark):
    return D.inventory(_statements(table)).withColumn("regions", F.col("regions").cast("int"))


_DDL = "CASE doc_id % 4 WHEN 0 THEN 'CREATE TABLE `t` (a INT) DEFAULT CHARSET=UTF8MB4 COLLATE=utf8mb4_bin' WHEN 1 THEN 'CREATE TABLE t (a INT) CHARACTER SET latin1' WHEN 2 THEN 'insert into t values (1)' ELSE text END"


@query("SELECT name, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'utf8mb4' WHEN 1 THEN 'latin1' END AS name FROM documents) WHERE name IS NOT NULL GROUP BY name")
def dump_charsets(table, spark):
    return D.named_settings(table("documents").select(F.expr(_DDL).alias("text")), "charset")


_SOURCE, _LANG = "coalesce(source, 'none')", "coalesce(lang, 'xx')"
_STATEMENT = f"""CASE doc_id % 4 WHEN 0 THEN concat('CREATE TABLE IF NOT EXISTS `', {_SOURCE}, '` (a INT, b TEXT)') WHEN 1 THEN concat('create table ', {_LANG}, '.`t', doc_id, '` (a INT)')
WHEN 2 THEN concat('INSERT IGNORE INTO ', {_LANG}, ' . `', {_SOURCE}, '` VALUES (', n_chars, ', X', chr(39), 'AB', chr(39), ')') ELSE concat('REPLACE INTO t', n_chars, ' VALUES (', chr(39), replace(text, chr(39), ''), chr(39), ')') END"""


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'create' WHEN doc_id % 4 = 2 THEN 'insert' ELSE 'replace' END AS kind, CASE WHEN doc_id % 4 IN (1, 2) THEN {_LANG} ELSE '' END AS "database",
CASE doc_id % 4 WHEN 1 THEN 't' || doc_id WHEN 3 THEN 't' || n_chars ELSE {_SOURCE} END AS "table" FROM documents""")
def dump_statements(table, spark):
    rows = table("documents").select("doc_id", F.concat(F.lit("-- part;\n/* a */ "), F.expr(_STATEMENT)).alias("text"), F.lit(True).alias("closed"))
    return files.classified(rows).select("doc_id", "kind", "database", "table")


@query("WITH r AS (SELECT l_orderkey, l_partkey AS \"start\", l_partkey + l_suppkey AS \"end\" FROM lineitem) SELECT * FROM (SELECT *, max(\"end\") OVER (PARTITION BY l_orderkey ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r) WHERE upto > \"start\"")
def region_overlaps(table, spark):
    rows = table("lineitem").select("l_orderkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey")).alias("end"))
    return D.overlaps(rows, ["l_orderkey"])


_RANGES = "r AS (SELECT o_custkey, o_orderkey * 10 AS \"start\", o_orderkey * 10 + o_custkey % 200 AS \"end\" FROM orders)"


@query(f"WITH {_RANGES} SELECT * FROM (SELECT *, max(\"end\") OVER (PARTITION BY o_custkey ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r) WHERE upto > \"start\" OR \"end\" < \"start\"")
def range_overlap_check(table, spark):
    rows = table("orders").select("o_custkey", (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + F.col("o_custkey") % 200).alias("end"))
    return D.overlaps(rows, ["o_custkey"])


@query("WITH g AS (SELECT n_nationkey * 20000 AS range_start, n_nationkey * 20000 + 12000 AS range_end FROM nation) SELECT o_orderkey, \"start\", \"end\", range_start, range_end FROM (SELECT o_orderkey, o_orderkey * 10 AS \"start\", o_orderkey * 10 + 10 AS \"end\" FROM orders) JOIN g ON \"start\" >= range_start AND \"end\" <= range_end")
def export_ranges(table, spark):
    records = table("orders").select("o_orderkey", (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 10).alias("end"))
    ranges = table("nation").select((F.col("n_nationkey") * 20000).alias("range_start"), (F.col("n_nationkey") * 20000 + 12000).alias("range_end"))
    return sinks.export_ranges(records, ranges)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def empty_tables(table, spark):
    return D.empty_tables(table("customer"), table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_ISLANDS = """i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM
(SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT DISTINCT FROM o_orderstatus THEN 0 ELSE 1 END AS fresh FROM orders)),
b AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) - 1) // 2 AS batch FROM i)"""


def _islands(table):
    return D.islands(table("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], "o_orderstatus", 2)


@query(f"WITH {_ISLANDS} SELECT o_custkey, o_orderstatus, island::BIGINT AS island, batch, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members FROM b GROUP BY ALL")
def regroup_islands(table, spark):
    rows = _islands(table).groupBy("o_custkey", "o_orderstatus", "island", "batch").agg(F.array_sort(F.collect_list("o_orderkey")).alias("m"))
    return rows.select("o_custkey", "o_orderstatus", "island", "batch", F.concat_ws(",", F.transform("m", lambda x: x.cast("string"))).alias("members"))


@query(f"WITH {_ISLANDS} SELECT count(DISTINCT o_custkey) AS statements_read, count(*) AS rows_seen, count(DISTINCT o_custkey || '/' || island || '/' || batch) AS statements_written FROM b")
def reshape_summary(table, spark):
    rows = _islands(table).withColumn("written", F.struct("o_custkey", "island", "batch")).withColumn("one", F.lit(1))
    return D.reshape_summary(rows, "o_custkey", "one", "written")


@query(f"WITH {_SQL} SELECT \"database\", \"table\", sum(\"end\" - \"start\")::BIGINT AS bytes, count(*) AS regions, min(\"start\") AS first, max(\"end\") AS last FROM s GROUP BY ALL")
def split_manifest(table, spark):
    return sinks.table_manifest(_statements(table), ["database", "table"])


_NOTES = "CASE c_custkey % 3 WHEN 0 THEN 'CREATE TABLE x (a INT) CHARSET=UTF8MB4' WHEN 1 THEN 'CREATE TABLE x (a INT) CHARACTER SET latin1' ELSE c_name END"


@query(f"""WITH s AS (SELECT c_mktsegment AS \"table\", c_custkey AS no, {_NOTES} AS t FROM customer),
h AS (SELECT \"table\", no // 4096 AS b, sha256(string_agg(sha256(t), '' ORDER BY no)) AS own FROM s GROUP BY ALL),
n AS (SELECT \"table\", string_agg(DISTINCT lower(c), ',' ORDER BY lower(c)) AS charsets FROM (SELECT \"table\", unnest(regexp_extract_all(t, '(CHARSET=|CHARACTER SET )(\\w+)', 2)) AS c FROM s) GROUP BY ALL)
SELECT 'db' AS \"database\", s.\"table\", 'db_' || s.\"table\" AS name, (7 * count(*))::BIGINT AS bytes, count(*)::BIGINT AS regions, min(no * 10) AS first, max(no * 10 + 7) AS last, any_value(charsets) AS charsets,
(SELECT sha256(string_agg(own, '' ORDER BY b)) FROM h WHERE h.\"table\" = s.\"table\") AS sha256 FROM s LEFT JOIN n USING (\"table\") GROUP BY s.\"table\" """)
def split_by_table(table, spark):
    rows = table("customer").select(F.lit("db").alias("database"), F.col("c_mktsegment").alias("table"), F.col("c_custkey").alias("stmt_no"), F.expr(_NOTES).alias("text"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + 7).alias("end"))
    return sinks.split_manifest(rows).withColumn("charsets", F.concat_ws(",", "charsets"))


@query("""
WITH s AS (SELECT c_custkey AS no, 'INSERT INTO t' || (c_custkey // 37) % 3 || ' VALUES ' AS head, c_custkey // 37 AS island, '(' || c_custkey || ',''' || c_name || ''')' AS tuple FROM customer),
b AS (SELECT *, (row_number() OVER (PARTITION BY island ORDER BY no) - 1) // 10 AS batch FROM s)
SELECT min(no)::BIGINT AS stmt_no, any_value(head) || string_agg(tuple, ',' ORDER BY no) || ';' AS text FROM b GROUP BY island, batch""")
def insert_batches_regrouped(table, spark):
    """Single INSERTs, whose table changes every 37 of them, regrouped to statements of ten rows."""
    head = F.concat(F.lit("INSERT INTO t"), (F.floor(F.col("c_custkey") / 37) % 3).cast("string"), F.lit(" VALUES "))
    text = F.concat(head, F.lit("("), F.col("c_custkey").cast("string"), F.lit(",'"), F.col("c_name"), F.lit("');"))
    rows = table("customer").select(F.lit("f").alias("file"), F.col("c_custkey").cast("long").alias("stmt_no"), text.alias("text"), F.lit("insert").alias("kind"))
    return D.multi_inserts(rows, 10).select("stmt_no", "text")


# --- schema diff: old and new versions of rows, one table for each part or customer ------------------------------------


def _parts(table):
    rows = table("part").select(F.col("p_brand").alias("table"), F.col("p_partkey").alias("name"), F.col("p_type").alias("definition"), F.col("p_size").alias("size"))
    return rows.filter("name % 10 <> 3"), rows.filter("name % 10 <> 4").withColumn("definition", F.when(F.col("name") % 10 == 5, "changed").otherwise(F.col("definition")))


@query("SELECT p_brand AS \"table\", p_partkey AS name, CASE p_partkey % 10 WHEN 3 THEN 'added' WHEN 4 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN p_partkey % 10 <> 3 THEN p_type END AS old, CASE p_partkey % 10 WHEN 3 THEN p_type WHEN 5 THEN 'changed' END AS new FROM part WHERE p_partkey % 10 IN (3, 4, 5)")
def schema_diff_columns(table, spark):
    return X.diff_columns(*_parts(table), ["table"])


@query("SELECT n_name AS \"table\", CASE WHEN n_nationkey % 5 = 0 THEN 'added' WHEN n_nationkey % 5 = 1 THEN 'removed' WHEN n_nationkey % 5 = 2 THEN 'changed' WHEN n_nationkey % 5 = 3 THEN 'unknown' ELSE 'unchanged' END AS change FROM nation")
def schema_diff_tables(table, spark):
    rows = table("nation").select(F.col("n_name").alias("table"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("body"), F.lit("parsed").alias("status"))
    old = rows.filter("k % 5 <> 0")
    new = rows.filter("k % 5 <> 1").withColumn("body", F.when(F.col("k") % 5 == 2, -1).otherwise(F.col("body"))).withColumn("status", F.when(F.col("k") % 5 == 3, "unknown").otherwise("parsed"))
    return X.diff_tables(old, new, ["table"], ["body"])


@query("WITH o AS (SELECT o_custkey AS \"table\", string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS old, string_agg(o_orderkey::VARCHAR, ',' ORDER BY CASE WHEN o_custkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END) AS new FROM orders GROUP BY o_custkey) SELECT * FROM o WHERE old <> new")
def schema_diff_order(table, spark):
    rows = table("orders").select(F.col("o_custkey").alias("table"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("place"))
    turned = rows.withColumn("place", F.when(F.col("table") % 2 == 0, -F.col("place")).otherwise(F.col("place")))
    out = X.diff_order(rows, turned, ["table"])
    return out.select("table", F.concat_ws(",", "old").alias("old"), F.concat_ws(",", "new").alias("new"))


@query("WITH a AS (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <> 2), b AS (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <> 3) (SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def schema_diff_elements(table, spark):
    rows = table("lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    return X.diff_elements(rows.filter("l_linenumber <> 2").drop("l_linenumber"), rows.filter("l_linenumber <> 3").drop("l_linenumber"))


@query("SELECT s_suppkey AS \"table\", 'COMMENT' AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'added' ELSE 'changed' END AS change, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS old, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_name END AS new FROM supplier WHERE s_suppkey % 4 IN (0, 1)")
def schema_diff_options(table, spark):
    rows = table("supplier").select(F.col("s_suppkey").alias("table"), F.lit("COMMENT").alias("name"), F.col("s_name").alias("value"))
    new = rows.withColumn("value", F.when(F.col("table") % 4 == 1, F.lit(None)).otherwise(F.col("value")))
    return X.diff_values(rows.filter("table % 4 <> 0"), new, ["table", "name"], "value")
