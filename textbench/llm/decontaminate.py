"""Benchmark decontamination by winnowing (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.flat import ALNUM, Words, anchors, slices, words
from textbench.llm.shared import bitmap, in_bitmap, keyed, spread_join, staged

_ROWS = "k long, doc_id long, n_words long, at array<int>, len array<int>, h array<long>, g array<long>"


def _windows(x: Words, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.ngrams(n)[at].view(np.int64), x.ngrams(n, 1)[at].view(np.int64)


def item_windows(items: DataFrame, span: int, k: int) -> DataFrame:
    """(item_id, len, h, g, a) of each window of each item: its length, two hashes and its fingerprint a.

    A window has `span` words; an item of fewer words, but not none, is one window and its own fingerprint.
    """

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, off in slices(batch.column(1)):
                x = words(buf, off, ALNUM, fold=True)
                size = np.diff(x.first)
                at, _, a = anchors(x, span, k)
                out = [(x.doc[at], np.full(len(at), span), *_windows(x, span, at), a.view(np.int64))]
                for n in np.unique(size[(size > 0) & (size < span)]):
                    at = x.first[:-1][size == n]
                    h, g = _windows(x, int(n), at)
                    out.append((x.doc[at], np.full(len(at), n), h, g, h))
                doc, n, h, g, a = (np.concatenate(c) for c in zip(*out))
                yield pa.record_batch({"item_id": ids[lo + doc], "len": n.astype(np.int32), "h": h, "g": g, "a": a})

    found = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return found.mapInArrow(rows, "item_id long, len int, h long, g long, a long")


def document_windows(docs: DataFrame, span: int, k: int, short: list[int], bits: np.ndarray | None) -> DataFrame:
    """A row for each document with its word count and the windows whose fingerprint the bitmap may hold (all, without one)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches):
        whole = shared.value
        may = (lambda h: np.ones(len(h), bool)) if whole is None else (lambda h: in_bitmap(whole, h))
        for batch in batches:
            for lo, hi, buf, off in slices(batch.column(1)):
                x = words(buf, off, ALNUM, fold=True)
                at, _, a = anchors(x, span, k)
                at = at[may(a)]
                out = [(at, np.full(len(at), span, np.int32), *_windows(x, span, at))]
                for n in short:
                    at = np.flatnonzero(x.valid(n))
                    at = at[may(x.ngrams(n)[at])]
                    out.append((at, np.full(len(at), n, np.int32), *_windows(x, n, at)))
                at, n, h, g = (np.concatenate(c) for c in zip(*out))
                order = np.argsort(x.doc[at], kind="stable")
                at, n, h, g = at[order], n[order], h[order], g[order]
                cut = np.searchsorted(x.doc[at], np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, c) for c in ((at - x.first[x.doc[at]]).astype(np.int32), n, h, g)]
                own = [batch.column(2).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo), np.diff(x.first).astype(np.int64)]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in (*own, *lists)], ["k", "doc_id", "n_words", "at", "len", "h", "g"])

    return docs.mapInArrow(rows, _ROWS)


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 4) -> DataFrame:
    """One row for each document: k, doc_id, n_words, spans (the covered windows) and items, the ids that occur in it.

    Winnowing keeps the smallest k-gram hash of each window of `span` words, so each shared window shares a fingerprint at
    the same place. Document fingerprints are first held against a bitmap of the items' fingerprints (fixed size; left out
    if there are too many), then each hit is extended to its whole window, which is joined by two 64-bit hashes, a window of many documents over several tasks; the ids that
    stand behind a window are those of the benchmark at most.

    Defined cases: null, empty or word-less texts have no words and no hits; items without words or with a null id hit
    nothing; repeated item_ids count once; repeated documents each get a row; an empty benchmark leaves all clean.
    """
    items = staged(item_windows(items, span, k))
    short = sorted(r[0] for r in items.filter(F.col("len") < span).select("len").distinct().collect())
    prints = items.select(F.col("a").alias("h")).distinct()
    rows = staged(document_windows(keyed(docs), span, k, short, bitmap(prints, items.count())))
    cand = rows.filter(F.size("at") > 0).dropDuplicates(["k"])
    cand = cand.select("k", F.explode(F.arrays_zip("at", "len", "h", "g")).alias("w")).select("k", "w.*")
    known = items.groupBy("h", "g", "len").agg(F.collect_set("item_id").alias("ids"))
    often = staged(cand.groupBy("h", "g", "len").agg(F.count("*").alias("m")))
    hits = spread_join(cand, known, often, ["h", "g", "len"], ["k", "at"])
    hits = hits.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"), F.flatten(F.collect_set("ids")).alias("items"))
    hits = hits.withColumn("items", F.array_distinct("items"))
    none = {"spans": "array<struct<at:int,len:int>>", "items": "array<bigint>"}
    both = rows.select("k", "doc_id", "n_words").join(hits, "k", "left")
    return both.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in none.items()})


def covered(spans: Column) -> Column:
    """Words in the union of sorted (at, len) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def step(acc, s):
        end = (s["at"] + s["len"]).cast("long")
        fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["upto"], s["at"].cast("long")))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])
