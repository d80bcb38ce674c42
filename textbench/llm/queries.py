"""The queries opN_<name> of the driver contract, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.order_minhash import fingerprints

    out = fingerprints(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("fingerprint", " ").alias("fingerprint"),
        F.array_join("edited_fingerprint", " ").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.ngram_join import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.pii import KINDS, find_personal_data

    out = find_personal_data(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.decontaminate import contamination, covered

    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.language_id import identify_languages

    out = identify_languages(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textbench.llm.packing import pack_sequences

    return pack_sequences(_table(spark, sf_dir, "documents"))


_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(h::VARCHAR, ',' ORDER BY h)) AS g FROM s GROUP BY doc_id),
cls AS (SELECT g, min(doc_id) AS c FROM sig GROUP BY g),
r AS (SELECT s.* FROM s JOIN cls ON s.doc_id = cls.c),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT c AS v, c AS u FROM cls UNION SELECT v, b FROM reach JOIN both_ways ON u = a),
comp AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN sig USING (doc_id) LEFT JOIN cls USING (g) LEFT JOIN comp ON v = c
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM d GROUP BY source),
fill AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fill FROM src),
lev AS (SELECT *, row_number() OVER (ORDER BY fill, source NULLS LAST) AS turn, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
        FROM fill WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size,
                least(cap, coalesce((SELECT level FROM lev WHERE level <= fill ORDER BY turn LIMIT 1) * weight, cap)) AS target FROM lev),
one AS (SELECT d.*, source_size, target, row_number() OVER q AS place, sum(size) OVER q AS sent
        FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
        WINDOW q AS (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING)),
turns AS (SELECT *, CASE WHEN target > 0 THEN (sent + turn * source_size)::DOUBLE / target ELSE 65536.0 END AS v
          FROM one, (VALUES (0), (1)) t(turn)),
cum AS (SELECT *, sum(size) OVER (ORDER BY v, source NULLS FIRST, o, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS upto FROM turns)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN upto <= (SELECT sum(target) FROM goal) THEN size ELSE 0 END)::BIGINT AS taken
FROM cum GROUP BY source, place, doc_id, size, source_size, target
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
own AS (SELECT h, min(doc_id) AS o FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN own USING (h), range(13) r(j) WHERE o < doc_id),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS m,
                CASE WHEN ps IS NULL THEN w ELSE (SELECT coalesce(list(x ORDER BY p), []) FROM
                  (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p) WHERE NOT list_contains(ps, p)) END AS k
         FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

_OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT t, min(page_id) AS f FROM p GROUP BY t),
v AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, (5 * g + 1)::BIGINT, 5))::INT) AS parts FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda n: array_to_string(list_transform([32768, 1024, 32, 1], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n // s) % 32 + 1)::BIGINT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM v JOIN first USING (t)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(10) r(j) WHERE j < n GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


_OP9 = r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i
           FROM documents WHERE text IS NOT NULL),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, p, x, lead(x) OVER (PARTITION BY doc_id ORDER BY p) AS y FROM nb),
late AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, p) AS r FROM w WHERE y IS NOT NULL) WHERE r > 1),
one AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS r FROM nb)
        WHERE r > 1 AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 20),
gone AS (SELECT nb.doc_id, nb.i FROM late JOIN nb ON nb.doc_id = late.doc_id AND nb.p IN (late.p, late.p + 1) UNION SELECT * FROM one),
runs(n, doc_id, p, h) AS (
  SELECT 1, doc_id, p, md5(x) FROM nb QUALIFY count(*) OVER (PARTITION BY x) > 1
  UNION ALL
  SELECT n + 1, r.doc_id, r.p, md5(h || md5(x)) FROM runs r JOIN nb ON nb.doc_id = r.doc_id AND nb.p = r.p + n QUALIFY count(*) OVER (PARTITION BY h, x) > 1),
long AS (SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id),
kept AS (SELECT l.doc_id, count(*) AS n, count(gone.i) AS m, string_agg(CASE WHEN gone.i IS NULL THEN x END, chr(10) ORDER BY l.i) AS t
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(m, 0)::BIGINT AS n_removed, coalesce(longest, 0)::BIGINT AS longest_run,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN long USING (doc_id)
"""

_OP11 = r"""
WITH crc AS (
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda b: ascii(b)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) AS v
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
hs AS (SELECT c, xor(v, 4294967295) % 9 AS h, c - c % 5 AS b FROM crc),
t AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS bytes,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
both_parts AS (
  SELECT hs.c, 0 AS part, i, x, bytes FROM hs JOIN t ON t.c = hs.b AND i <= h
  UNION ALL SELECT hs.c, 1, i, x, bytes FROM hs JOIN t ON t.c = hs.c AND i > h),
r AS (SELECT c, bytes, row_number() OVER w AS depth, string_agg(x, '') OVER (w ROWS UNBOUNDED PRECEDING) AS k, count(*) OVER (PARTITION BY c) AS size
      FROM both_parts WINDOW w AS (PARTITION BY c ORDER BY part, i)
      UNION ALL SELECT c, 0, 0, '', (SELECT count(*) FROM both_parts p WHERE p.c = hs.c) FROM hs),
n AS (SELECT k, min(c) AS conv_id, min(depth) AS depth, min(bytes) AS bytes, count(*) AS n_convs FROM r GROUP BY k),
kids AS (SELECT substr(k, 1, strlen(k) - 32) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
below AS (SELECT r.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * f.bytes)::BIGINT AS saved_tokens
          FROM f JOIN r ON r.c = f.conv_id AND r.depth <= f.depth GROUP BY r.k),
ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS s FROM r WHERE depth = size GROUP BY k)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(s, '')) AS ends_sha256
FROM f LEFT JOIN n p ON f.depth > 0 AND p.k = substr(f.k, 1, strlen(f.k) - 32) LEFT JOIN below ON below.k = f.k LEFT JOIN ends ON ends.k = f.k
"""

_OP12 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m))),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS m, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS g FROM f WHERE m > 1 AND a >= 30),
cut AS (SELECT c.lang, c.phrase, c.m, c.a, k, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.g[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.g[k + 1:], ' ')),
inner_ AS (SELECT lang, array_to_string(g[i:i + s - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT lang, g, a, s, unnest(range(1, m - s + 2)) AS i FROM c, (VALUES (2), (3)) v(s) WHERE s < m) GROUP BY ALL),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inner_ USING (lang, phrase) JOIN n USING (lang) WHERE 100 * coalesce(longer, 0) < 80 * a
QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_order_minhash, op2_ngram_join, op3_quality_classifier, op4_mix_sources, op5_substring_dedup, op6_pii, op7_warc, op8_decontaminate, op9_line_dedup, op10_language_id, op11_prefix_trie, op12_phrases, op13_pack_sequences)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": _OP2, "op4_mix_sources": _OP4, "op5_substring_dedup": _OP5, "op7_warc": _OP7, "op8_decontaminate": _OP8, "op9_line_dedup": _OP9, "op11_prefix_trie": _OP11, "op12_phrases": _OP12}
