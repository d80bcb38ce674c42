"""Substring deduplication by seed and extend (operator 5)."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.flat import SPACED, anchors, mix, slices, words
from textbench.llm.shared import bitmap, bounded, in_bitmap, keyed, later_copies, rows_of, staged

#: Anchor hashes are cut to 48 bits for the first count, which may only let too much through.
_CUT = np.uint64(16)
_LAST = (1 << 63) - 1


def seeds(docs: DataFrame, span: int, k: int) -> DataFrame:
    """(k, at, h): each winnowed anchor of each document."""

    def rows(batches):
        for batch in batches:
            for lo, _, buf, off in slices(batch.column(0)):
                x = words(buf, off, SPACED)
                _, a, h = anchors(x, span, k)
                a, one = np.unique(a, return_index=True)
                key = batch.column(1).to_numpy()[lo + x.doc[a]] if len(a) else np.zeros(0, np.int64)
                yield pa.record_batch({"k": key, "at": (a - x.first[x.doc[a]]).astype(np.int32), "h": (h[one] >> _CUT).astype(np.int64)})

    return docs.select("text", "k").mapInArrow(rows, "k long, at int, h long")


def _extended(docs: DataFrame, span: int, k: int, bits: np.ndarray | None) -> DataFrame:
    """(w, d, k, at, done): the windows around shared anchors; done: a smaller id of the same batch has the window too.

    docs: text, k, d (the id to order by) and, without a bitmap, `seeds`, the positions of its shared anchors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches):
        whole = shared.value
        for batch in batches:
            out = []
            keys, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, buf, off in slices(batch.column(0)):
                x = words(buf, off, SPACED)
                at, a, h = anchors(x, span, k)
                if whole is not None:
                    hot = in_bitmap(whole, (h >> _CUT).astype(np.uint64))
                else:
                    own = batch.column(3).slice(lo, hi - lo)
                    n = np.diff(np.asarray(own.offsets))
                    flag = np.zeros(len(x.starts) + 1, bool)
                    flag[np.repeat(x.first[:-1], n) + np.asarray(own.flatten())] = True
                    hot = flag[a]
                at = at[hot]
                out.append((x.ngrams(span)[at], ids[lo + x.doc[at]], keys[lo + x.doc[at]], at - x.first[x.doc[at]]))
            w, d, key, at = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
            order = np.lexsort((d, w.view(np.int64)))
            w, d, key, at = w[order].view(np.int64), d[order], key[order], at[order]
            new = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, bool)
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(w) else d
            done = d > least
            # What the batch has settled is passed on under a name of its own, so a very common window meets others once for a batch and id.
            w = np.where(done, mix(key.view(np.uint64) ^ mix(at.astype(np.uint64) + np.uint64(1))).view(np.int64), w)
            for i in range(0, len(w), 1 << 18):
                s = slice(i, i + (1 << 18))
                yield pa.record_batch({"w": w[s], "d": d[s], "k": key[s], "at": at[s].astype(np.int32), "done": pa.array(done[s])})

    return docs.mapInArrow(rows, "w long, d long, k long, at int, done boolean")


def repeats(docs: DataFrame, span: int = 13, k: int = 5) -> DataFrame:
    """(k, starts): for each document with some, the starts of its windows of `span` words that an earlier document has.

    `docs`: keyed rows. Seed: winnowed k-word anchors that occur twice or more. Extend: each shared anchor to the windows
    around it for which it is the smallest k-gram; windows meet by hash and the smallest doc_id keeps its copy. Overlapping
    windows of a document make up its maximal repeats. Anchors are held against a bitmap of the shared ones, or, beyond its
    bound, joined with them by shuffle.
    """
    docs = docs.withColumn("d", F.coalesce("doc_id", F.lit(_LAST)))
    hashes = seeds(docs, span, k).groupBy("h").count().filter("count > 1").select("h")
    hashes = staged(hashes)
    bits = bitmap(hashes, rows_of(hashes))
    if bits is not None:
        found = _extended(docs.select("text", "k", "d"), span, k, bits)
    else:
        at = seeds(docs, span, k).join(hashes, "h", "left_semi").groupBy("k").agg(F.collect_set("at").alias("seeds"))
        found = _extended(docs.join(at, "k").select("text", "k", "d", "seeds"), span, k, None)
    first = F.min("d").over(Window.partitionBy("w"))
    gone = found.withColumn("first", first).filter("done OR first < d")
    return gone.groupBy("k").agg(F.collect_set("at").alias("starts"))


def _cut(docs: DataFrame, span: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            doc_id, text, copy, starts = (batch.column(i) for i in range(4))
            out = []
            for i in range(batch.num_rows):
                raw = (text[i].as_py() or "").encode().split()
                gone = np.zeros(len(raw) + 1, np.int32)
                if copy[i].as_py():
                    gone[:] = len(raw) >= span
                elif starts[i].is_valid:
                    s = np.asarray(starts[i].values)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + span, -1)
                    gone = np.cumsum(gone)
                gone = gone[: len(raw)] > 0
                kept = list(compress(raw, ~gone)) if gone.any() else raw
                out.append((len(raw), len(raw) - len(kept), b" ".join(kept).decode()))
            n, cut, kept = zip(*out) if out else ((), (), ())
            yield pa.record_batch([doc_id, pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, span: int = 13, k: int = 5) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed and kept, the words left, joined by one space.

    A word goes if a window of `span` words over it also starts in a document with a smaller doc_id. Whole copies are
    settled first, by text hash; the rest goes through `repeats`.

    Defined cases: a null doc_id counts as larger than any; rows of one doc_id keep each other's words; null and empty
    texts have no words; texts under `span` words stay whole; an empty table gives an empty result.
    """
    docs = keyed(docs)
    copies = staged(later_copies(docs)).withColumn("copy", F.lit(True))
    marked = docs.join(bounded(copies), "k", "left")
    gone = repeats(marked.filter("copy IS NULL").select("doc_id", "text", "k"), span, k)
    return _cut(marked.join(gone, "k", "left").select("doc_id", "text", "copy", "starts"), span)
