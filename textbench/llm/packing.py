"""Best-fit packing of tokenized documents into sequences of a fixed length (operator 13)."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.shared import arrow_rows, staged

VOCABULARY = "byte_bpe_50k.json"
#: Words kept with their ids in a Python worker, twice.
KEPT = 1 << 18
#: Longer texts are cut into words in stretches of about so many characters.
STRETCH = 1 << 20

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\x09-\x0d\x20\x85\xa0"
#: The tokenizer's own cut into words, spelt out for the code points up to U+024F and the dashes and quotes of U+2010 to U+2027.
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile("[^\x00-ɏ‐-‧]")
_BREAK = re.compile(rf"(?<=[^{_SPACE}])[{_SPACE}]")


def packed(tokenizer, text: str) -> bytes:
    return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _byte_names() -> dict[int, int]:
    """How a byte-level vocabulary writes bytes: printable ones of Latin-1 as they are, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


class _Kept(dict):
    """The ids of each word, as little-endian 32-bit numbers; a missing word is asked of the tokenizer's model. Of two generations of
    KEPT words the older one goes when the younger is full."""

    def __init__(self, tokenizer):
        self.model, self.names, self.older = tokenizer.model, _byte_names(), {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            out = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin1").translate(self.names))]).tobytes()
        self[word] = out
        return out


def _cut_as_usual(path: str) -> bool:
    """Is this a byte-level BPE that neither changes the text nor cuts it otherwise than _CUT?"""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    cut = found.get("pre_tokenizer") or {}
    return found.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and found["model"]["type"] == "BPE"


@functools.cache
def encoder(path: str):
    """A function from a text to its ids as little-endian 32-bit numbers, those of the tokenizer in the file `path`.

    A byte-level BPE works word by word, so a word's ids are asked once and kept; texts with other code points than the cut into
    words is spelt out for, or with a special token's name, go to the tokenizer whole, as do those of other tokenizers.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kept, usual = _Kept(tokenizer), _cut_as_usual(path)
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if not usual or _OTHER.search(text) or any(name in text for name in names):
            return packed(tokenizer, text)
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > STRETCH:
                cut = _BREAK.search(text, at + STRETCH)
                end = cut.start() if cut else end
            out.append(b"".join(map(kept.__getitem__, _CUT.findall(text, at, end))))
            at = end
        return b"".join(out)

    return encode


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, id) of all documents; id: a number of the row, unlike any other's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            own, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + bytes(4)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    own.append(doc_id)
                    piece.append(i)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(memoryview(ids)[4 * lo : 4 * hi]))
            yield pa.record_batch(
                [pa.array(own, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("id", F.monotonically_increasing_id())


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing on numbers of pieces by length: rows (length, first rank, end rank, taken by one sequence, first
    sequence, tokens before).

    A round places all pieces of one length, from the longest down. Sequences of equal gaps are interchangeable runs of
    numbers; the sweep goes from the length's successor among the gaps upwards, each gap takes as many pieces as it holds, the
    runs in the order of their numbers, and moves to the gap that is left. Pieces that find none open sequences.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    out, opened = [], 0

    def put(gap: int, lo: int, hi: int) -> None:
        if gap and lo < hi:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((lo, hi))

    for v in sorted(counts, reverse=True):
        at, end = 0, counts[v]
        while at < end:
            i = bisect_left(gaps, v)
            if i == len(gaps):
                new = -(-(end - at) // (capacity // v))
                gap, lo, hi = capacity, opened, opened + new
                opened += new
            else:
                gap = gaps[i]
                lo, hi = runs[gap].pop(0)
                if not runs[gap]:
                    del runs[gap], gaps[i]
            q = gap // v
            whole = min(hi - lo, (end - at) // q)
            if whole:
                out.append((v, at, at + whole * q, q, lo, capacity - gap))
                put(gap - q * v, lo, lo + whole)
                at, lo = at + whole * q, lo + whole
            if lo < hi and 0 < end - at < q:
                out.append((v, at, end, q, lo, capacity - gap))
                put(gap - (end - at) * v, lo, lo + 1)
                at, lo = end, lo + 1
            put(gap, lo, hi)
    return np.array(out, np.int64).reshape(-1, 6)


def pack_sequences(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id and offset.

    A document is its text's ids (the tokenizer in the file `path`, by default the public 50k byte BPE) and an id 0. One of more
    than `capacity` tokens is cut from its end, so that only its first piece may be shorter. Pieces are sorted by length, as ranks
    within their length, from counts for each task and length; documents that want the same gap get the sequences of that gap in
    the order of their ranks. Gaps are whole numbers up to `capacity`, so a round needs no more than how many gaps of each size
    there are: plan() sweeps over these few numbers and every piece looks up its rank in the plan, which does not grow with
    the data (at most `capacity` lengths, each over the runs of gaps that earlier lengths have left).

    Defined cases: null text is empty, one token; a null or repeated doc_id is packed as any other, each row on its own; an empty
    table gives an empty result; other columns are left behind.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    with arrow_rows(spark, 1000):
        rows = staged(pieces(docs, path, capacity))
    rows = rows.withColumn("part", F.shiftrightunsigned("id", 33))
    counts = staged(rows.groupBy("part", "length").agg(F.count("*").alias("m")))
    total = {r["length"]: r["m"] for r in counts.groupBy("length").agg(F.sum("m").alias("m")).collect()}
    shared = spark.sparkContext.broadcast(plan(total, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("id")) - 1
    ranked = rows.withColumn("rank", rank.cast("long")).join(bases, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        first = {int(v): i for i, v in reversed(list(enumerate(found[:, 0])))}
        last = {int(v): i + 1 for i, v in enumerate(found[:, 0])}
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                own, lo, hi = length == v, first[int(v)], last[int(v)]
                row[own] = lo + np.searchsorted(found[lo:hi, 1], rank[own], "right") - 1
            _, at, _, q, sequence, fill = found[row].T
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence + (rank - at) // q), pa.array(fill + (rank - at) % q * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
