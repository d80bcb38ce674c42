"""Row keys, staged tables and bounded bitmaps used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from textbench.llm.flat import mix

#: A bitmap that is broadcast has at most this many bits (32 MB), at 16 bits for each entry.
MAX_BITS = 1 << 28
SLICE_BYTES = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`. Where it is unset, a local session gets a temporary
    folder that goes with the process; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that staged() and the archive writer have made in this process.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing else has."""
    _MADE.append(f"{shared_dir(spark)}/textbench-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_staged(spark: SparkSession) -> None:
    """Deletes all tables and archives that this process has staged; to be called once the results that read them are written."""
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: cuts lineage and survives lost executors.

    While it is written, its rows are counted, and the column m, if it has one, summed up, so that no job has to ask later.
    """
    path, seen = new_path(df.sparkSession), Observation()
    often = [F.sum("m").alias("sum_m"), F.max("m").alias("max_m")] if dict(df.dtypes).get("m") in ("int", "bigint") else []
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *often).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.seen_when_staged = seen.get
    return out


def rows_of(df: DataFrame) -> int:
    """How many rows a table has; for a staged one no job is needed."""
    seen = getattr(df, "seen_when_staged", None)
    return df.count() if seen is None else seen["rows"]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most n rows for what runs inside, where a row may hold many sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_key(*cols: str | Column) -> Column:
    """A 64-bit key of the row's own values; rows that agree in them share it, and their results."""
    return F.xxhash64(*cols)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key k; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "k", row_key("doc_id", "text")
    )


def later_copies(docs: DataFrame) -> DataFrame:
    """Row keys of the rows whose exact text a row with a smaller doc_id has (a null doc_id comes last).

    Only hashes are dealt out, first rows meet in a partial aggregate, and large groups of copies are spread over tasks.
    """
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    rows = docs.select("k", last.alias("d"), F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.length("text").alias("t3"))
    first = staged(rows.groupBy("t1", "t2", "t3").agg(F.min("d").alias("first_d"), F.count("*").alias("m")).filter("m > 1"))
    return spread_join(rows, first.drop("m"), first, ["t1", "t2", "t3"], ["k"]).filter("d > first_d").select("k").distinct()


def spread_join(rows: DataFrame, small: DataFrame, counts: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with `small`, unique in `on`; a key that many rows have is split, by the columns `by`, over several tasks.

    counts (a staged table): `on` and m, the rows of each key. A key of more than a quarter of a task's even share of the rows is
    cut into as many parts as it holds such quarters, and its row of `small` is repeated for each: four repeated rows for each
    shuffle partition at most, whatever the data, so the table of parts is broadcast.
    """
    spark = rows.sparkSession
    seen = getattr(counts, "seen_when_staged", {})
    every, most = (seen["sum_m"], seen["max_m"]) if "sum_m" in seen else counts.agg(F.sum("m"), F.max("m")).first()
    every, most = every or 0, most or 0
    share = max(1000, every // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if most <= share:
        return rows.join(small, on, how)
    parts = F.broadcast(counts.filter(F.col("m") > share).select(*on, F.ceil(F.col("m") / share).cast("int").alias("parts__")))
    dealt = rows.join(parts, on, "left").withColumn("part__", F.pmod(F.xxhash64(*by), F.coalesce("parts__", F.lit(1))).cast("int")).drop("parts__")
    held = small.join(parts, on, "left").withColumn("part__", F.explode(F.sequence(F.lit(0), F.coalesce("parts__", F.lit(1)) - 1))).drop("parts__")
    return dealt.join(held, [*on, "part__"], how).drop("part__")


def bounded(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """`df` (a staged table of numbers), marked for broadcast only if its rows, with 32 bytes each for the hash table, take at most
    `most_bytes`; else Spark shuffles it."""
    if any(not isinstance(f.dataType, (NumericType, BooleanType)) for f in df.schema):
        raise TypeError("only columns of a fixed size have a bound")
    return F.broadcast(df) if rows_of(df) * (32 + 8 * len(df.columns)) <= most_bytes else df


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(h.astype(np.uint64))
    return m & np.uint64(bits - 1), (m >> np.uint64(32)) & np.uint64(bits - 1)


def bitmap(hashes: DataFrame, n: int, clamp: bool = False) -> np.ndarray | None:
    """A bitmap of the long column h of `hashes` (n rows); if it would pass MAX_BITS, None, or, with `clamp`, one of MAX_BITS, which
    tells less apart.

    Tasks set bits in slices, slices are OR-ed by key, and only the fixed-size bitmap reaches the driver.
    """
    bits = max(1 << 20, 1 << int(16 * max(n, 1) - 1).bit_length())
    if bits > MAX_BITS and not clamp:
        return None
    bits = min(bits, MAX_BITS)

    def partial(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.asarray(batch.column(0))
            at = np.unique(np.concatenate(_probes(h, bits)))
            byte, bit = at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))
            if not len(at):
                continue
            cut = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            byte, value = byte[cut].astype(np.int64), np.bitwise_or.reduceat(bit, cut)
            part = byte // SLICE_BYTES
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for lo, hi in zip(edges, [*edges[1:], len(part)]):
                out = own.setdefault(int(part[lo]), np.zeros(SLICE_BYTES, np.uint8))
                out[byte[lo:hi] % SLICE_BYTES] |= value[lo:hi]
        for part, out in own.items():
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    def merge(pdf):
        out = np.frombuffer(pdf["bits"].iloc[0], np.uint8).copy()
        for x in pdf["bits"].iloc[1:]:
            out |= np.frombuffer(x, np.uint8)
        return pdf.iloc[:1].assign(bits=[out.tobytes()])

    parts = hashes.select("h").mapInArrow(partial, "part int, bits binary")
    whole = np.zeros(max(SLICE_BYTES, bits // 8), np.uint8)
    for part, data in parts.groupBy("part").applyInPandas(merge, "part int, bits binary").collect():
        whole[part * SLICE_BYTES : (part + 1) * SLICE_BYTES] = np.frombuffer(data, np.uint8)
    return whole[: bits // 8]


def in_bitmap(whole: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of `h` the bitmap may hold (no false negatives)."""
    out = np.ones(len(h), bool)
    for at in _probes(h, len(whole) * 8):
        out &= (whole[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
