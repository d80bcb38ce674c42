"""Queries over search and harvest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textbench.operators import search as S
from textbench.operators.replace import encode_text
from textbench.plans.registry import query

_TERM = "the"


def _places(sql_text: str, term: str, where: str = "true") -> str:
    return f"SELECT doc_id, pos FROM (SELECT doc_id, {sql_text} AS t, unnest(list_filter(range(length(text)), lambda i: substr({sql_text}, (i + 1)::BIGINT, {len(term)}) = '{term}')) AS pos FROM documents) WHERE {where}"


def _word(pos: str) -> str:
    return f"NOT coalesce(regexp_matches(nullif(substr(t, {pos}, 1), ''), '^[\\pL\\p{{Nd}}\\pM_]$'), false)"


def _docs(table):
    return table("documents").select("doc_id", "text")


@query(f"SELECT doc_id, pos::INT AS pos, strlen(substr(text, 1, pos::BIGINT))::BIGINT AS \"offset\" FROM ({_places('text', _TERM)}) JOIN documents USING (doc_id)")
def search_plain(table, spark):
    return S.find_plain(_docs(table), "text", _TERM).select("doc_id", "pos", "offset")


@query(f"SELECT doc_id, pos::INT AS pos FROM ({_places('text', _TERM)}) WHERE doc_id < 300 ORDER BY doc_id DESC, pos DESC LIMIT 200")
def search_backward(table, spark):
    return S.before_offset(S.find_plain(_docs(table), "text", _TERM), ["doc_id", "pos"], {"doc_id": 300}, 200).select("doc_id", "pos")


@query(f"SELECT doc_id, pos::INT AS pos FROM ({_places('lower(text)', _TERM)})")
def search_ci(table, spark):
    return S.find_plain(_docs(table), "text", "THE", ignore_case=True).select("doc_id", "pos")


@query(f"SELECT doc_id, pos::INT AS pos FROM ({_places('text', _TERM, '(pos = 0 OR ' + _word('pos::BIGINT') + ') AND ' + _word('(pos + 4)::BIGINT'))})")
def search_whole_word(table, spark):
    return S.find_plain(_docs(table), "text", _TERM, whole_word=True).select("doc_id", "pos")


@query(f"SELECT doc_id, pos::INT AS pos, (2 + 2 * (pos + length(regexp_replace(substr(text, 1, pos::BIGINT), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))))::BIGINT AS \"offset\", 6 AS length FROM ({_places('text', _TERM)}) JOIN documents USING (doc_id)")
def search_encoded(table, spark):
    rows = table("documents").select("doc_id", encode_text(F.col("text"), "UTF-16BE").alias("content"))
    return S.find_encoded(rows, "content", _TERM, "UTF-16BE").select("doc_id", "pos", "offset", "length")


@query("SELECT doc_id, len(regexp_extract_all(text, 'th[a-z]+e')) AS n FROM documents")
def search_regex_counts(table, spark):
    return _docs(table).select("doc_id", S.regex_count(F.col("text"), "th[a-z]+e").alias("n"))


@query("SELECT doc_id, place, match FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS match, unnest(range(len(regexp_extract_all(text, '[0-9]+')))) AS place FROM documents) WHERE doc_id < 500 ORDER BY doc_id DESC, place DESC LIMIT 100")
def search_regex_backward(table, spark):
    found = S.find_regex(_docs(table), "text", "[0-9]+")
    w = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = found.drop("text").withColumn("place", (w - 1).cast("long"))
    return S.before_offset(rows, ["doc_id", "place"], {"doc_id": 500}, 100).select("doc_id", "place", "match")


_LINE = "doc_id * 1000000 + pos"


@query(f"SELECT {_LINE} AS pos FROM ({_places('text', _TERM)}) WHERE {_LINE} >= 77000123 ORDER BY 1 LIMIT 1")
def find_next(table, spark):
    rows = S.find_plain(_docs(table), "text", _TERM).select(F.expr(_LINE).alias("pos"))
    return S.find_next(rows, "pos", 77000123)


@query(f"SELECT {_LINE} AS pos FROM ({_places('text', _TERM)}) WHERE {_LINE} < 77000123 ORDER BY 1 DESC LIMIT 1")
def find_prev(table, spark):
    rows = S.find_plain(_docs(table), "text", _TERM).select(F.expr(_LINE).alias("pos"))
    return S.find_previous(rows, "pos", 77000123)


@query(f"SELECT doc_id, pos::INT AS pos, true AS truncated, len(string_split(substr(text, 1, pos::BIGINT), chr(10)))::INT AS line FROM ({_places('text', _TERM)}) JOIN documents USING (doc_id) ORDER BY doc_id, pos LIMIT 1000")
def search_all_page(table, spark):
    page = S.search_page(S.find_plain(_docs(table), "text", _TERM), ["doc_id", "pos"])
    line = F.size(F.split(F.substring("text", F.lit(1), F.col("pos")), "\n", -1))
    return page.select("doc_id", "pos", "truncated", line.alias("line"))


@query("SELECT doc_id, pos::INT AS pos, trim(regexp_replace(substr(text, (greatest(pos - 40, 0) + 1)::BIGINT, (pos - greatest(pos - 40, 0) + 47)::BIGINT), '\\s+', ' ', 'g')) AS preview FROM (SELECT doc_id, text, unnest(list_filter(range(length(text)), lambda i: substr(text, (i + 1)::BIGINT, 7) = 'Licence' OR substr(text, (i + 1)::BIGINT, 7) = 'License')) AS pos FROM documents)")
def search_preview(table, spark):
    found = S.find_plain(_docs(table), "text", "License").unionByName(S.find_plain(_docs(table), "text", "Licence"))
    return found.select("doc_id", "pos", S.preview(F.col("text"), F.col("pos"), 7, 40).alias("preview"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+')) AS match FROM documents")
def harvest_emails(table, spark):
    rows = _docs(table).filter(F.contains("text", F.lit("@")))
    return S.harvest(rows, "text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+").select("doc_id", "match")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"[^\"]{1,200}\"')) AS match FROM pages")
def harvest_links(table, spark):
    return S.harvest(table("pages").select("page_id", "html"), "html", 'href="[^"]{1,200}"').select("page_id", "match")
