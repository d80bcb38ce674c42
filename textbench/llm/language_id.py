"""Language identification by a byte convolutional network (operator 10)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.flat import slices

#: Bytes go to the network as classes: each ASCII letter regardless of case, digits, white space, other ASCII, and each byte beyond.
CLASSES = 160
_CLASS = np.full(256, 0, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = np.arange(3, 29)
_CLASS[0x80:0x100] = np.arange(29, 157)
#: Bytes of a window, filter widths, and filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16


@dataclass
class Net:
    """langs: the learned values; taps[w][j]: (CLASSES, FILTERS) weights of width w's byte j; bias, out, base: the layers above."""

    langs: list[str]
    taps: list[list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, places): for windows x (n, WINDOW) of byte classes, each filter's largest response and where it is."""
        best, where = [], []
        for w, taps in zip(WIDTHS, self.taps):
            y = taps[0][x[:, : WINDOW - w + 1]]
            for j in range(1, w):
                y += taps[j][x[:, j : WINDOW - w + 1 + j]]
            at = y.argmax(1)
            best.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
            where.append(at)
        return np.concatenate(best, 1) + self.bias, np.concatenate(where, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Softmax over the languages for each window."""
        z = np.maximum(self.pooled(x)[0], 0) @ self.out + self.base
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, first): all fixed-length windows of the texts of a slice, the last of each filled up with class 0, and their offsets."""
    n = -(-np.diff(off) // WINDOW)
    first = np.r_[0, np.cumsum(n)]
    x = np.zeros(first[-1] * WINDOW, np.uint8)
    code = _CLASS[buf]
    for to, lo, hi in zip(first[:-1] * WINDOW, off[:-1], off[1:]):
        x[to : to + hi - lo] = code[lo:hi]
    return x.reshape(-1, WINDOW), first


def train(x: np.ndarray, labels: list[str], epochs: int = 5, rate: float = 0.01, seed: int = 7) -> Net:
    """A network fitted by Adam on windows x of byte classes and their labels."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    at = {lang: i for i, lang in enumerate(langs)}
    y = np.array([at[label] for label in labels])
    k = len(WIDTHS) * FILTERS
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    net = Net(langs, [[small(CLASSES, FILTERS) for _ in range(w)] for w in WIDTHS], np.zeros(k, np.float32), small(k, len(langs)), np.zeros(len(langs), np.float32))
    params = [t for taps in net.taps for t in taps] + [net.bias, net.out, net.base]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 64):
            b = order[lo : lo + 64]
            value, place = net.pooled(x[b])
            a = np.maximum(value, 0)
            z = a @ net.out + net.base
            e = np.exp(z - z.max(1, keepdims=True))
            e /= e.sum(1, keepdims=True)
            e[np.arange(len(b)), y[b]] -= 1
            e /= len(b)
            da = (e @ net.out.T) * (value > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                own, at = da[:, i * FILTERS : (i + 1) * FILTERS], place[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    g = np.zeros((CLASSES, FILTERS), np.float32)
                    np.add.at(g, (x[b][np.arange(len(b))[:, None], at + j], np.arange(FILTERS)[None, :]), own)
                    grads.append(g)
            grads += [da.sum(0), a.T @ e, e.sum(0)]
            step += 1
            for p, g, mi, vi in zip(params, grads, m, v):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from: crc32 of the doc_id as text is 2 modulo 4; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread(most: int):
    """Rows (lang, rank, doc_id, raw) for (lang, rank, doc_id, text): at most `most` windows of each text, evenly spread, as bytes."""

    def rows(batches):
        for batch in batches:
            out = []
            for text in batch.column(3):
                raw = text.as_py().encode()
                n = -(-len(raw) // WINDOW)
                pick = np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))
                out.append(b"".join(raw[i * WINDOW : (i + 1) * WINDOW].ljust(WINDOW, b"\0") for i in pick))
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.binary())], ["lang", "rank", "doc_id", "raw"])

    return rows


def fit(docs: DataFrame, sample: int = 2000, windows_of_text: int = 40, most_langs: int = 1000) -> Net | None:
    """A network learned from about `sample` texts (twice that at most), as many for each language as it has, up to an even
    share; picked by hash among the rows that are not held out, with a text and a language. None without any.

    The `most_langs` languages with most rows are learned, so that a column of anything does not fill the driver. Only windows reach it: `windows_of_text` of 256 bytes of each text at most, evenly spread over it.
    """
    rows = docs.filter(F.col("text").isNotNull() & (F.col("text") != "") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    rank = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20))
    share = F.create_map(*[c for lang, n in counts.items() for c in (F.lit(lang), F.lit(int(min(1.0, sample / len(counts) / n) * (1 << 20))))])
    picked = rows.select("lang", rank.alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("rank") < F.try_element_at(share, F.col("lang")))
    cut = picked.mapInArrow(_spread(windows_of_text), "lang string, rank long, doc_id long, raw binary")
    found = cut.orderBy("rank", "doc_id").limit(2 * sample).select("lang", "raw").collect()
    if not found:
        return None
    x = _CLASS[np.frombuffer(b"".join(bytes(r.raw) for r in found), np.uint8)].reshape(-1, WINDOW)
    return train(x, [r.lang for r in found for _ in range(len(r.raw) // WINDOW)])


def identify_languages(docs: DataFrame, sample: int = 2000, windows_of_text: int = 40) -> DataFrame:
    """`docs` with held_out, lang_pred and lang_score: the language with the highest mean probability over all windows of the
    whole text, and that mean.

    Each window of 256 bytes goes through filters of width 2, 3 and 4, max pooling and softmax, in numpy batches.

    Defined cases: null text or text without a letter: `und`, score 0; nothing to learn from: `und` for all; lang, source and
    doc_id are no inputs; a null doc_id is neither held out nor learned from; other columns pass through (those named
    held_out, lang_pred or lang_score are replaced).
    """
    docs = docs.drop("held_out", "lang_pred", "lang_score")
    net = fit(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample, windows_of_text)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang:string,score:double>")
    def told(texts: pa.Array) -> pa.Array:
        own, names, values = shared.value, [], [np.zeros(0)]
        for lo, hi, buf, off in slices(texts):
            x, first = windows(buf, off)
            p = np.concatenate([own.scores(x[i : i + 128]) for i in range(0, len(x), 128)]) if len(x) and own else np.zeros((0, 1))
            total = np.r_[np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=np.float64)]
            mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None] if len(p) else np.zeros((hi - lo, 1))
            best = mean.argmax(1)
            values.append(mean[np.arange(hi - lo), best])
            names += [own.langs[i] if own else "und" for i in best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.clip(np.concatenate(values), 0, 1))], ["lang", "score"])

    # Only the text goes to Python; not deterministic, so that a filter on what is told does not ask twice.
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    out = docs.select(own, told.asNondeterministic()(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("told"))
    letter = F.coalesce(F.col("own.text").cast("string").rlike(r"\p{L}"), F.lit(False)) & F.lit(net is not None)
    found = {"lang_pred": F.when(letter, F.col("told.lang")).otherwise("und"), "lang_score": F.when(letter, F.col("told.score")).otherwise(0.0)}
    return out.select("own.*", held_out(F.col("own.doc_id")).alias("held_out"), *(c.alias(name) for name, c in found.items()))
