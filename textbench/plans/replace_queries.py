"""Queries over replacement and conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.operators import replace as R
from textbench.plans.registry import query


@query("SELECT doc_id, replace(text, 'the', '<T>') AS text, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def replace_plain(table, spark):
    c = F.col("text")
    return table("documents").select("doc_id", R.replace_plain(c, "the", "<T>").alias("text"), R.count_plain(c, "the").cast("long").alias("n"))


@query(r"SELECT doc_id, regexp_replace(text, '([a-z]+)ing ([a-z]+)', '\2 \1ed$', 'g') AS text FROM documents")
def replace_regex(table, spark):
    return table("documents").select("doc_id", R.replace_regex(F.col("text"), "(?P<stem>[a-z]+)ing ([a-z]+)", "${2} ${stem}ed$$").alias("text"))


_RULES = [("and", "AND", 2), ("an", "<an>", 1), ("er", "[er]", 2), ("ere", "[ere]", 2)]


@query("SELECT doc_id, replace(replace(replace(replace(regexp_replace(text, '(an|ere|er)', chr(1) || '\\1' || chr(2), 'g'), chr(1) || 'an' || chr(2), '<an>'), chr(1) || 'ere' || chr(2), '[ere]'), chr(1) || 'er' || chr(2), '[er]'), chr(1), '') AS text FROM documents")
def replace_batch(table, spark):
    return table("documents").select("doc_id", R.replace_batch(F.col("text"), _RULES).alias("text"))


@query()
def replace_batch_conflicts(table, spark):
    got = R.batch_result(F.col("text"), _RULES)
    return table("documents").select("doc_id", got.alias("r")).select("doc_id", "r.matches", "r.conflicts")


_WORDS = r"[\p{L}\p{M}\p{Nd}_]+|[^\p{L}\p{M}\p{Nd}_]+"


@query(f"""
WITH rules AS (SELECT w, row_number() OVER (ORDER BY w) AS i FROM (
    SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(p_name, '[A-Za-z]+')) FROM part)) WHERE length(w) > 3),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORDS}')) AS x, unnest(range(len(regexp_extract_all(text, '{_WORDS}')))) AS pos FROM documents),
r AS (SELECT doc_id, string_agg(CASE WHEN i IS NULL THEN x ELSE '<' || i || '>' END, '' ORDER BY pos) AS text, count(i)::INT AS matches
      FROM t LEFT JOIN rules ON w = translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(matches, 0)::INT AS matches, 0::INT AS conflicts FROM documents d LEFT JOIN r USING (doc_id)""")
def replace_batch_many(table, spark):
    """Every word of the benchmark and of the parts' names is a rule: thousands, in one pass."""
    some = lambda name, c: table(name).select(F.explode(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    words = some("benchmark", "text").unionByName(some("part", "p_name")).select(F.lower("w").alias("w")).filter("length(w) > 3").distinct()
    rules = [(r.w, f"<{i}>", i) for i, r in enumerate(words.orderBy("w").limit(R.MAX_RULES + 1).collect(), 1)]
    return table("documents").select("doc_id", R.batch_result(F.col("text"), rules, ignore_case=True, whole_word=True).alias("r")).select("doc_id", "r.text", "r.matches", "r.conflicts")


@query()
def replace_batch_regex(table, spark):
    rules = [(r"(?P<a>[a-z])\w*ing\b", "${a}-ing", 1), (r"\bth\w+", "TH", 0)]
    got = R.batch_result(F.col("text"), rules, regex=True)
    return table("documents").select("doc_id", got.alias("r")).select("doc_id", "r.text", "r.matches", "r.conflicts")


@query("SELECT c_custkey AS rule_no, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS name, c_name AS find, 'x' || c_custkey AS put, c_custkey % 5 <> 0 AS enabled FROM customer WHERE c_custkey % 4 <> 0")
def rules_parsed(table, spark):
    line = "CASE WHEN c_custkey % 4 = 0 THEN '# ' || c_name ELSE (CASE WHEN c_custkey % 5 = 0 THEN '! ' ELSE '' END) || (CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || ' :: ' END) || c_name || (CASE WHEN c_custkey % 2 = 0 THEN ' -> ' ELSE ' => ' END) || 'x' || c_custkey END"
    return R.parse_rules(table("customer").select(F.col("c_custkey").alias("line_no"), F.expr(line).alias("line")))


@query("""SELECT doc_id, pos::INT AS pos, substr(text, (greatest(pos - 40, 0) + 1)::BIGINT, (pos - greatest(pos - 40, 0))::BIGINT) || 'the' || substr(text, (pos + 4)::BIGINT, 40) AS before,
substr(text, (greatest(pos - 40, 0) + 1)::BIGINT, (pos - greatest(pos - 40, 0))::BIGINT) || 'THE' || substr(text, (pos + 4)::BIGINT, 40) AS after
FROM (SELECT doc_id, text, unnest(list_filter(range(length(text)), lambda i: substr(text, (i + 1)::BIGINT, 3) = 'the')) AS pos FROM documents) ORDER BY doc_id, pos LIMIT 20""")
def replace_preview(table, spark):
    return R.replace_preview(table("documents").select("doc_id", "text"), "text", "the", "THE", ["doc_id"])


@query("SELECT sum(strlen(text))::BIGINT AS bytes, sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS matches, (sum(strlen(text)) + 4 * sum((length(text) - length(replace(text, 'the', ''))) // 3))::BIGINT AS bytes_after FROM documents")
def replace_size_estimate(table, spark):
    return R.size_estimate(table("documents"), "text", "the", "seventh")


@query("SELECT page_id, 'a:1:{s:3:\"url\";s:' || strlen(u) || ':\"' || u || '\";}' AS text, ((length(url) - length(replace(url, 'example', ''))) // 7)::INT AS matches FROM (SELECT page_id, url, replace(url, 'example', 'replaced-host') AS u FROM pages)")
def replace_serialized(table, spark):
    value = F.concat(F.lit('a:1:{s:3:"url";s:'), F.octet_length("url").cast("string"), F.lit(':"'), F.col("url"), F.lit('";}'))
    return table("pages").select("page_id", R.replace_serialized(value, "example", "replaced-host").alias("r")).select("page_id", "r.text", "r.matches")


def _utf16(text: str) -> str:
    """The UTF-16LE bytes of a text in hexadecimal, surrogates included."""
    unit = "lpad(hex(({u}) % 256), 2, '0') || lpad(hex(({u}) // 256), 2, '0')"
    one, high, low = (unit.format(u=u) for u in ("unicode(c)", "(55296 + (unicode(c) - 65536) // 1024)", "(56320 + (unicode(c) - 65536) % 1024)"))
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN '' WHEN unicode(c) < 65536 THEN {one} ELSE {high} || {low} END), '')"


@query(f"SELECT doc_id, 'FFFE' || {_utf16('text')} AS bytes FROM documents")
def encode_utf16(table, spark):
    return table("documents").select("doc_id", F.hex(R.encode_text(F.col("text"), "UTF-16LE")).alias("bytes"))


_WRITTEN = r"replace(replace(replace(replace(replace(text, '\', '\\'), chr(39), chr(39) || chr(39)), chr(10), '\n'), chr(13), '\r'), chr(26), '\Z')"


@query(f"SELECT doc_id, 'INSERT INTO `the` VALUES (' || doc_id || ', ' || chr(39) || replace({_WRITTEN}, 'the', 'THE') || chr(39) || '); -- the' AS text, ((length(text) - length(replace(text, 'the', ''))) // 3)::INT AS matches FROM documents")
def replace_literals(table, spark):
    written = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    row = F.concat(F.lit("INSERT INTO `the` VALUES ("), F.col("doc_id").cast("string"), F.lit(", '"), written, F.lit("'); -- the"))
    return table("documents").select("doc_id", R.replace_in_literals(row, "the", "THE").alias("r")).select("doc_id", "r.text", "r.matches")


@query("SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) AS text, length(text) - length(replace(text, chr(10), '')) AS n FROM documents")
def line_endings_crlf(table, spark):
    return table("documents").select("doc_id", R.convert_line_ends(F.col("text"), "\r\n").alias("text"), R.count_line_ends(F.col("text")).cast("long").alias("n"))


@query("SELECT line_no, hex(encode(line)) AS bytes FROM (SELECT row_number() OVER (ORDER BY doc_id, i) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) WHERE line_no BETWEEN 100 AND 300")
def line_range_utf8(table, spark):
    from textbench.plans.record_queries import lines_numbered

    rows = lines_numbered(table, spark).filter("line_no BETWEEN 100 AND 300")
    return rows.select("line_no", F.hex(R.encode_text(F.col("line"), "UTF-8")).alias("bytes"))


@query(f"SELECT line_no, 'FFFE' || {_utf16('line')} AS bytes FROM (SELECT row_number() OVER (ORDER BY doc_id, i) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) WHERE line_no BETWEEN 100 AND 300")
def line_range_utf16(table, spark):
    from textbench.plans.record_queries import lines_numbered

    rows = lines_numbered(table, spark).filter("line_no BETWEEN 100 AND 300")
    return rows.select("line_no", F.hex(R.encode_text(F.col("line"), "UTF-16LE")).alias("bytes"))
