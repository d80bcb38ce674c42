"""Order MinHash document fingerprints (operator 1); DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.shared import bounded, row_key, staged
from textbench.operators.numbering import with_range

#: Of a packed 64-bit entry the low bits hold the place in the text, the rest its hash.
_PLACE = 26
_LOW = (1 << _PLACE) - 1
#: Signatures of a fingerprint; the top bits of a hash name its bin.
BINS = 64
_BIN = 64 - BINS.bit_length() + 1


def _packed(h: Column, place: Column) -> Column:
    return F.coalesce(h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(place.cast("long")), F.lit(0))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, _BIN)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)).cast("int")


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW))


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = 2, size: int = 2) -> DataFrame:
    """`df` with the column `name`: the Order MinHash fingerprint of the column `text`, an array of strings.

    Each k-mer (k consecutive words; all words of a shorter text) is numbered by its occurrence and hashed once. One
    permutation serves all signatures: the hash's top bits deal the k-mers into 64 bins; a bin's `size` smallest keep their
    order in the text, and the tuple of their hashes is hashed, without their places: a shift of the text changes no order. An
    entry is the bin (2 hex digits) and its tuple's hash (8); bins without a k-mer have none, so null, empty and word-less texts
    have an empty fingerprint. A text of 2**26 words or more, over a gigabyte as Spark's array of words, fails the job.

    All steps work on arrays of a row and are linear, but for two sorts of primitive longs; each step is a column that later
    ones use at least twice, so the optimiser evaluates it once.
    """
    w, h, p, r, q, s = (f"__{name}_{c}" for c in "whprqs")
    col = F.col

    def kmer(i):
        return F.xxhash64(*[F.try_element_at(col(w), (i + j + 1).cast("int")) for j in range(k)])

    def occurrences(j):
        lo, hi = col(r)[j], F.coalesce(F.get(col(r), j + 1), F.size(p))
        number = lambda i: _packed(F.xxhash64(col(h)[_place(col(p)[i])], i - lo), _place(col(p)[i]))
        return F.transform(F.sequence(lo, hi - 1), number)

    def signature(i):
        x, y = col(s)[i], F.get(col(s), i + 1)
        rest = [F.get(col(s), i + j) for j in range(2, size)]
        own = F.filter(F.array(x, y, *rest), lambda v: v.isNotNull() & (_bin(v) == _bin(x)))
        own = F.when((_place(x) > _place(y)) & (_bin(x) == _bin(y)), F.xxhash64(_hash(y), _hash(x))).otherwise(
            F.when(_bin(x) == _bin(y), F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(x)))
        ) if size == 2 else F.xxhash64(F.transform(F.array_sort(F.transform(own, lambda v: F.struct(_place(v).alias("at"), v.alias("v")))), lambda t: _hash(t["v"])))
        return F.concat(F.lpad(F.hex(_bin(x)), 2, "0"), F.substring(F.lpad(F.hex(own), 16, "0"), 9, 8))

    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, split)
    over = F.size(w) > _LOW
    df = df.withColumn(h, F.when(over, F.raise_error(F.lit(f"a text of more than {_LOW} words"))).when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), kmer)))
    df = df.withColumn(p, F.sort_array(F.transform(col(h), _packed)))
    new = lambda x, i: (i == 0) | (F.shiftright(x, _PLACE) != F.shiftright(F.get(col(p), i - 1), _PLACE))
    starts = F.filter(F.transform(col(p), lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())
    df = df.withColumn(r, starts)
    df = df.withColumn(q, F.sort_array(F.flatten(F.transform(F.when(F.size(r) > 0, F.sequence(F.lit(0), F.size(r) - 1)).otherwise(F.array().cast("array<int>")), occurrences))))
    df = df.withColumn(s, F.filter(col(q), lambda x, i: (i < size) | (_bin(F.get(col(q), i - size)) != _bin(x))))
    heads = F.filter(F.transform(col(s), lambda x, i: F.when((i == 0) | (_bin(x) != _bin(F.get(col(s), i - 1))), i)), lambda i: i.isNotNull())
    return df.withColumn(name, F.transform(heads, signature)).drop(w, h, p, r, q, s)


def likeness(a: Column, b: Column) -> Column:
    """Equal signatures over the bins that either fingerprint fills; 1 for two empty ones."""
    bins = lambda x: F.transform(x, lambda e: F.substring(e, 1, 2))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def with_next(df: DataFrame, prepare: Callable[[DataFrame], DataFrame], carry: list[str], range_bytes: int = 16 << 20) -> DataFrame:
    """Each row of `prepare(df)`, df being (doc_id, k, ...), with next_<c> for c in `carry`, from the next row in descending
    doc_id (after the last: the first).

    Rows meet in ranges of doc_id. A range also gets a copy of the first row of the next range that has rows, behind its own,
    so one exchange serves all; these copies (one for each range) are found by key and do not come out. There is a range for
    every `range_bytes` of text at least, and four for each shuffle partition.
    """
    spark, size = df.sparkSession, df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes)
    df = with_range(df, "doc_id", least=4 * tasks).withColumnRenamed("_range", "range")
    heads = df.groupBy("range").agg(F.min_by("k", F.struct(F.bitwise_not("doc_id"), F.col("k"))).alias("k"))
    down = Window.orderBy(F.desc("range"))
    above = F.coalesce(F.lag("range").over(down), F.min("range").over(Window.partitionBy()))
    heads = staged(heads.select("k", above.alias("range")))
    extra = df.drop("range").join(bounded(heads), "k")
    rows = prepare(df.withColumn("extra", F.lit(False))).unionByName(prepare(extra.withColumn("extra", F.lit(True))))
    rows = rows.repartition(tasks, "range")
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "k")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})
    return rows.filter("NOT extra").drop("range", "extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited (its edited text), fingerprint and edited_fingerprint (arrays), and
    near_edited and near_next, their likeness to the own fingerprint.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in
    descending doc_id; after the last comes the first.

    Defined cases: null text is empty; a null doc_id comes last, rows of one doc_id go by a hash of the row; a single document
    is its own next; empty fingerprints are alike (1.0); other columns are left behind.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", row_key("doc_id", "text")).withColumn("n_chars", F.length("text").cast("long"))
    joined = lambda c: F.array_join(c, " ")  # noqa: E731  a string is far smaller than an array while rows are dealt out
    rows = with_next(rows, lambda df: with_fingerprint(df, "text", "fp").withColumn("fp", joined("fp")), ["text", "fp"])
    entries = lambda c: F.filter(F.split(c, " "), lambda e: e != "")
    rows = rows.withColumns({"fingerprint": entries("fp"), "next_fingerprint": entries("next_fp")})
    half = (F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    near_next = likeness(F.col("fingerprint"), F.col("next_fingerprint"))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), "fingerprint", near_next.alias("near_next"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
