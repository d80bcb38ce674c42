"""Queries over inference and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.operators import profile as P
from textbench.plans.registry import query

_COLUMNS = {
    "l_orderkey": "l_orderkey::VARCHAR", "l_linenumber": "l_linenumber::VARCHAR", "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus",
    "code": "lpad(l_partkey::VARCHAR, 8, '0')", "part": "CASE WHEN l_suppkey % 10 = 0 THEN 'NULL' ELSE l_suppkey || '.5' END",
    "early": "CASE WHEN l_linenumber < 3 THEN 'true' ELSE 'false' END",
}
_CELLS = "c AS (" + " UNION ALL ".join(f"SELECT {i} AS column_no, '{n}' AS \"column\", {e} AS value FROM lineitem" for i, (n, e) in enumerate(_COLUMNS.items(), 1)) + ")"
_KNOWN = "value IS NOT NULL AND value NOT IN ('', 'NULL', 'null', '\\N')"
_TYPES = """CASE "column" WHEN 'l_orderkey' THEN 'BIGINT' WHEN 'l_linenumber' THEN 'BIGINT' WHEN 'part' THEN 'DOUBLE' WHEN 'early' THEN 'BOOLEAN' ELSE 'TEXT' END"""


def _lineitem(table):
    exprs = {n: e.replace("::VARCHAR", "").replace("lpad(l_partkey", "lpad(CAST(l_partkey AS STRING)") for n, e in _COLUMNS.items()}
    return table("lineitem").select(*[F.expr(e).cast("string").alias(n) for n, e in exprs.items()])


@query(f"WITH {_CELLS} SELECT column_no, \"column\", {_TYPES} AS type, count(*) FILTER ({_KNOWN}) AS non_null, count(*) FILTER (NOT ({_KNOWN})) AS null_count FROM c GROUP BY ALL")
def infer_schema(table, spark):
    return P.infer_schema(_lineitem(table))


@query(f"WITH {_CELLS} SELECT DISTINCT column_no AS number, \"column\" AS name, {_TYPES} AS type FROM c")
def column_guide(table, spark):
    return P.column_guide(_lineitem(table))


@query(f"WITH {_CELLS} SELECT column_no, \"column\", count(*) FILTER ({_KNOWN}) AS non_null, count(*) FILTER (NOT ({_KNOWN})) AS null_count, count(DISTINCT value) FILTER ({_KNOWN}) AS distinct_count, min(value) FILTER ({_KNOWN}) AS min_value, max(value) FILTER ({_KNOWN}) AS max_value, {_TYPES} AS type FROM c GROUP BY column_no, \"column\"")
def profile_columns(table, spark):
    return P.profile(_lineitem(table))


@query(f"WITH {_CELLS}, n AS (SELECT column_no, \"column\", value, count(*) AS \"count\" FROM c WHERE {_KNOWN} GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_no ORDER BY \"count\" DESC, value) AS rank FROM n) WHERE rank <= 10")
def profile_top_values(table, spark):
    return P.top_values(_lineitem(table))


_SCORE = """
WITH l AS (SELECT doc_id % 50 AS file, unnest(string_split(text, chr(10))) AS line FROM documents),
d AS (SELECT * FROM (VALUES ('comma', ','), ('tab', chr(9)), ('semicolon', ';'), ('pipe', '|')) t(delimiter, d)),
f AS (SELECT file, delimiter, length(line) - length(replace(line, d, '')) + 1 AS fields, count(*) AS n FROM l, d WHERE line <> '' GROUP BY ALL),
m AS (SELECT file, delimiter, sum(n)::BIGINT AS total FROM f GROUP BY ALL),
b AS (SELECT file, delimiter, fields, n FROM (SELECT *, row_number() OVER (PARTITION BY file, delimiter ORDER BY n DESC, fields DESC) AS r FROM f WHERE fields > 1) WHERE r = 1),
s AS (SELECT file, delimiter, coalesce(fields, 0)::INT AS fields, coalesce(n, 0)::BIGINT AS modal_rows, total,
             CASE WHEN n IS NULL THEN 0.0 ELSE round(70.0::DOUBLE * n / total + 20.0::DOUBLE * least(fields, 64) / 64 + 10.0::DOUBLE * least(total, 25) / 25, 6) END AS score
      FROM m LEFT JOIN b USING (file, delimiter))
SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, delimiter) AS rank,
       CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS confidence FROM s
"""


@query(_SCORE)
def delimiter_scores(table, spark):
    lines = table("documents").select((F.col("doc_id") % 50).alias("file"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return P.delimiter_scores(lines)


_ENDS = "CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13)) WHEN 2 THEN text || chr(13) || chr(10) ELSE text END"


@query(f"""SELECT ending, count(*) AS n FROM (SELECT CASE WHEN (b > 0)::INT + (l > b)::INT + (r > b)::INT > 1 THEN 'mixed' WHEN b > 0 THEN 'CRLF' WHEN l > 0 THEN 'LF' WHEN r > 0 THEN 'CR' ELSE 'none' END AS ending
FROM (SELECT (length(t) - length(replace(t, chr(13) || chr(10), ''))) / 2 AS b, length(t) - length(replace(t, chr(10), '')) AS l, length(t) - length(replace(t, chr(13), '')) AS r FROM (SELECT {_ENDS} AS t FROM documents))) GROUP BY ending""")
def line_ending_census(table, spark):
    return table("documents").select(P.line_ending(F.expr(_ENDS)).alias("ending")).groupBy("ending").agg(F.count("*").alias("n"))


_SHAPES = "CASE doc_id % 5 WHEN 0 THEN '{' || text WHEN 1 THEN '--' || chr(10) || 'create table t' || text WHEN 2 THEN 'key:' || chr(10) || text WHEN 3 THEN text || chr(1) ELSE '[' || chr(0) || text END"


@query(f"""SELECT type, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, CASE WHEN contains(t, chr(0)) OR controls * 100 > length(t) * 3 THEN 'binary' WHEN contains(upper(h), 'CREATE TABLE') OR contains(upper(h), 'INSERT INTO') THEN 'sql'
WHEN h[1] IN ('{{', '[') THEN 'json' WHEN starts_with(h, '---') OR contains(h, ':' || chr(10)) THEN 'yaml' ELSE 'text' END AS type
FROM (SELECT n_chars, t, ltrim(substr(t, 1, 4096)) AS h, (length(t) - length(replace(t, chr(1), ''))) AS controls FROM (SELECT n_chars, {_SHAPES} AS t FROM documents))) GROUP BY type""")
def file_type_census(table, spark):
    kind = P.file_type(F.lit(None).cast("string"), F.expr(_SHAPES))
    return table("documents").select(kind.alias("type"), "n_chars").groupBy("type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _chunks(text: str, where: str = "true") -> str:
    return f"SELECT doc_id, i::INT AS chunk_no, encode(t)[(i * 4096 + 1):(i * 4096 + 4096)] AS c FROM (SELECT doc_id, t, unnest(range(greatest((strlen(t) + 4095) // 4096, 1))) AS i FROM (SELECT doc_id, {text} AS t FROM documents WHERE {where}))"


@query(f"SELECT doc_id, chunk_no, octet_length(c)::BIGINT AS bytes, sha256(c) AS sha256 FROM ({_chunks('text')})")
def content_fingerprint(table, spark):
    return P.fingerprint_manifest(table("documents").select("doc_id", "text"), "doc_id", "text")


@query(f"""WITH a AS ({_chunks('text', 'doc_id % 10 <> 3')}), b AS ({_chunks("CASE doc_id % 10 WHEN 5 THEN text || ' more' ELSE text END", 'doc_id % 10 <> 4')})
SELECT doc_id, chunk_no, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (doc_id, chunk_no) WHERE sha256(a.c) IS DISTINCT FROM sha256(b.c)""")
def fingerprint_diff(table, spark):
    rows = table("documents").select("doc_id", "text")
    old = rows.filter("doc_id % 10 <> 3")
    new = rows.filter("doc_id % 10 <> 4").withColumn("text", F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return P.manifest_diff(*(P.fingerprint_manifest(x, "doc_id", "text") for x in (old, new)), ["doc_id", "chunk_no"])
