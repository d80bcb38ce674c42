"""Document quality by a regularised quadratic discriminant (operator 3)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.flat import SPACED, Words, slices, words
from textbench.llm.shared import staged

#: Byte groups whose shares of a text are features.
_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)),
    "digit": b"0123456789",
    "stop": b".,;:",
    "loud": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~",
    "line": b"\n\r",
}
NAMES = ["log_words", "log_word_length", "word_length_spread", "distinct_words", "distinct_triples", "short_words", "odd_ends", *_GROUPS]
_TABLE = np.zeros((len(_GROUPS), 256))
for _i, _g in enumerate(_GROUPS.values()):
    _TABLE[_i, list(_g)] = 1
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), *b".,;:'\")"]] = True


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(doc[new], minlength=n)


def features(x: Words, off: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)): transformed statistics of the whole texts of a slice; all zero for an empty text."""
    n, size, bytes_ = len(off) - 1, np.maximum(np.diff(x.first), 1), np.maximum(np.diff(off), 1)
    length = (x.ends - x.starts).astype(float)
    per = lambda v: np.bincount(x.doc, v, n)
    mean = per(length) / size
    spread = np.sqrt(np.maximum(per(length**2) / size - mean**2, 0))
    triple = np.flatnonzero(x.valid(3))
    triples = np.maximum(np.bincount(x.doc[triple], minlength=n), 1)
    shares = [
        _distinct(x.h, x.doc, n) / size,
        _distinct(x.ngrams(3)[triple], x.doc[triple], n) / triples,
        per(length <= 3) / size,
        per(~_PLAIN_END[x.buf[x.ends - 1]]) / size,
    ]
    text = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(text * 256 + x.buf, minlength=256 * n).reshape(n, 256)
    shares += list((counts @ _TABLE.T / bytes_[:, None]).T)
    out = [np.log1p(np.diff(x.first)), np.log1p(mean), np.log1p(spread), *[np.arcsin(np.sqrt(np.clip(s, 0, 1))) for s in shares]]
    return np.stack(out, 1)


@dataclass
class Discriminant:
    """For classes 0 and 1: means, inverse Cholesky factors of the shrunk covariances, and log determinants; then the scale."""

    means: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log p(x, 1) - log p(x, 0): half the difference of squared Mahalanobis distances, determinants and priors."""
        d = [(((x - m) @ w.T) ** 2).sum(1) for m, w in zip(self.means, self.whiten)]
        return 0.5 * (d[0] - d[1] + self.logdet[0] - self.logdet[1]) + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * np.arcsinh(self.log_ratio(x)) + self.shift, -50, 50)
        return 1 / (1 + np.exp(-z))


def discriminant(n: np.ndarray, total: np.ndarray, outer: np.ndarray, pool: float, ridge: float) -> Discriminant:
    """From each class's row count, sums and sums of outer products; covariances shrink to the pooled one, then to its diagonal."""
    n = np.maximum(n, 1.0)
    means = total / n[:, None]
    cov = outer / n[:, None, None] - means[:, :, None] * means[:, None, :]
    common = (cov * n[:, None, None]).sum(0) / n.sum()
    cov = (1 - pool) * cov + pool * common
    diagonal = np.diag(np.diag(common)) + 1e-4 * np.eye(len(common))
    factors = [np.linalg.cholesky((1 - ridge) * c + ridge * diagonal) for c in cov]
    logdet = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    return Discriminant(means, np.stack([np.linalg.inv(f) for f in factors]), logdet, float(np.log(n[1] / n[0])))


def _calibrated(model: Discriminant, x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Slope and shift of the score by a ridge logistic fit (Newton steps)."""
    z, w = np.stack([np.arcsinh(model.log_ratio(x)), np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), g)
    model.slope, model.shift = max(float(w[0]), 1e-3), float(w[1])
    return model


def _statistics(docs: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            x = [features(words(buf, off, SPACED), off) for _, _, buf, off in slices(batch.column(1))]
            flat = pa.array(np.concatenate(x).ravel() if x else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES)), flat)
            yield pa.record_batch([batch.column(0), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, pool: float = 0.1, ridge: float = 0.05, sample: int = 20_000) -> Discriminant | None:
    """A discriminant from the moments of all labelled rows that are not held out; its score is scaled on about `sample` of
    them, picked by hash (so few reach the driver at any size). None unless both classes occur."""
    learn = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = staged(stats.join(learn.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")), "doc_id").select("doc_id", "x", "y"))
    d = len(NAMES)

    def moments(batches):
        n, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x, y = np.asarray(batch.column(0).flatten()).reshape(-1, d), batch.column(1).to_numpy()
            for c in (0, 1):
                own = x[y == c]
                n[c], total[c], outer[c] = n[c] + len(own), total[c] + own.sum(0), outer[c] + own.T @ own
        flat = np.concatenate([n, total.ravel(), outer.ravel()])
        yield pa.record_batch({"i": np.arange(len(flat), dtype=np.int32), "v": flat})

    parts = rows.select("x", "y").mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for i, v in parts.collect():
        flat[i] = v
    if not flat[:2].all():
        return None
    model = discriminant(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), pool, ridge)
    share = int(min(1.0, sample / flat[:2].sum()) * (1 << 20))
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("x", "y").collect()
    if not some:
        return model
    return _calibrated(model, np.array([r.x for r in some]), np.array([r.y for r in some], float))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score (probability-like, higher: label 1 likelier) and predicted (0.7 up).

    Statistics of whole texts (word and byte shares, repetition, lengths, transformed) are worked out once into a table; class
    moments are summed over all labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    Defined cases: null and empty texts have all statistics zero and get a score too; labels other than 0 and 1 or without a
    doc_id teach nothing, repeated ones count as often; without both classes all scores are 0.5; a null doc_id is not held out.
    """
    stats = staged(_statistics(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    def rows(batches):
        own = model.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
            s = own.score(x) if own else np.full(len(x), 0.5)
            yield pa.record_batch({"doc_id": batch.column(0), "score": s, "predicted": (s >= 0.7).astype(np.int32)})

    out = stats.mapInArrow(rows, "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
