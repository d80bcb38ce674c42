"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

1. language_id drops documents without a letter or whose language is not predicted with a mean probability of 0.5.
2. line_dedup deletes later copies of runs of two or more lines, and documents of which nothing is left.
3. ngram_join keeps the smallest doc_id of each group of documents linked by five-word shingles (similarity 0.75).
4. decontaminate drops documents with a window of ten words, or a whole shorter item, of the benchmark.
5. mix keeps the documents that the mix takes, with `taken`, the words taken (repeats counted), and the mix's sizes and targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.llm.decontaminate import contamination
from textbench.llm.language_id import identify_languages
from textbench.llm.line_dedup import dedup_lines
from textbench.llm.mixing import mix_sources
from textbench.llm.ngram_join import similar_groups
from textbench.llm.shared import bounded, row_key, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL can express a trained network and what it keeps.
ORACLE_SQL = None


def _with_key(docs: DataFrame) -> DataFrame:
    """`docs` with the row key k that the operators give them, whatever whole-number type doc_id has."""
    return docs.withColumn("k", row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a mean probability of 0.5 or more; null and letterless texts go."""
    return identify_languages(docs).filter("lang_pred <> 'und' AND lang_score >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; only those that lose all their words go."""
    out = dedup_lines(docs.select(*COLUMNS), longest=False).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_removed") == 0))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; rows that share a doc_id stay or go together."""
    gone = staged(similar_groups(docs).filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = staged(hits.filter(F.size("spans") > 0).select("k").distinct())
    return _with_key(docs).join(bounded(gone), "k", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; of rows that agree in doc_id and text, one stays with what the mix takes of all of them."""
    keyed = _with_key(docs.select(*COLUMNS))
    taken = mix_sources(keyed, carry=["k"]).filter("taken > 0")
    taken = taken.groupBy("k", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return keyed.dropDuplicates(["k"]).join(taken, "k").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
