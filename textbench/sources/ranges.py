"""Byte ranges of large files, read by position: one task for each range seeks, reads block by block and hashes as it goes.

No file and no range is ever a row: ranges are copied from store to store inside a task, or searched there. Tasks open files through
pyarrow.fs, so paths are those it knows (file:, hdfs:, s3:, gs:, abfs:).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textbench.operators.search import _WORD
from textbench.sources.sinks import MAX_PARTS

BLOCK = 8 << 20
WORK = "_temporary"


def _opened(path: str):
    """(store, path in it) of a path as Spark writes it (file:/x is file:///x)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def file_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of files; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def checked_ranges(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """`ranges` (path, part, start, end), or an error: parts are numbers from 0, at most 10,000, each range lies in its file and no
    two ranges of a file overlap."""
    before = F.max("end").over(Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.join(sizes, "path", "left").withColumn("upto", before)
    bad = "length IS NULL OR start < 0 OR end < start OR end > length OR upto > start"
    found = rows.agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.count_if(F.expr(bad)).alias("bad")).first()
    if found.n > MAX_PARTS or found.parts < found.n:
        raise ValueError("more than 10,000 parts, or a part twice")
    if found.bad:
        raise ValueError("a range overlaps another, is out of order or lies outside its file")
    return ranges


def _copied(target: str):
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_store, out_root = _opened(target)
        for batch in batches:
            for path, part, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                store, name = _opened(path)
                own, left, sha = f"{out_root}/{WORK}/{part:05d}-{uuid.uuid4().hex}", end - start, hashlib.sha256()
                with store.open_input_file(name) as source, out_store.open_output_stream(own) as sink:
                    source.seek(start)
                    while left:
                        block = source.read(min(left, BLOCK))
                        if not block:
                            raise OSError(f"{path} ends before {end}")
                        sha.update(block)
                        sink.write(block)
                        left -= len(block)
                yield pa.record_batch([pa.array([x]) for x in (path, part, start, end, sha.hexdigest(), own.rsplit("/", 1)[1])], ["path", "part", "start", "end", "sha256", "written"])

    return copy


def copy_ranges(ranges: DataFrame, target: str) -> list[dict]:
    """Writes each range (path, part, start, end; checked) as the file part-<number> of the new folder `target`, with manifest.json:
    path, start, end, bytes and sha256 of every part, in order. Returns the manifest, at most 10,000 entries.

    Tasks write under names of their own and report them; the files of attempts that count are then renamed, and the manifest,
    written last, makes the folder whole. A target that exists is refused; if anything fails, nothing is left of it.
    """
    spark = ranges.sparkSession
    sizes = file_sizes(spark, [r.path for r in ranges.select("path").distinct().limit(MAX_PARTS + 1).collect()])
    checked_ranges(ranges, sizes)
    store, root = _opened(target)
    from pyarrow import fs

    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{target} exists already")
    store.create_dir(f"{root}/{WORK}")
    try:
        rows = ranges.select("path", F.col("part").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"))
        tasks = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism))
        done = rows.repartition(tasks, "part").mapInArrow(_copied(target), "path string, part long, start long, end long, sha256 string, written string")
        found = sorted(done.collect(), key=lambda r: r.part)
        manifest = []
        for r in found:
            store.move(f"{root}/{WORK}/{r.written}", f"{root}/part-{r.part:05d}")
            manifest.append({"part": r.part, "path": r.path, "start": r.start, "end": r.end, "bytes": r.end - r.start, "sha256": r.sha256})
        store.delete_dir(f"{root}/{WORK}")
        with store.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps(manifest, indent=1).encode())
    except BaseException:
        store.delete_dir(root)
        raise
    return manifest


def split_by_size(spark: SparkSession, path: str, target: str, per_part: int) -> list[dict]:
    """A file cut at every `per_part` bytes (see copy_ranges())."""
    from textbench.sources.sinks import byte_ranges

    return copy_ranges(byte_ranges(file_sizes(spark, path), per_part).select("path", "part", "start", "end"), target)


def export_lines(spark: SparkSession, path: str, target: str, first: int, last: int, encoding: str = "UTF-8", per_part: int = 1 << 30) -> list[dict]:
    """Lines first..last of a file with all their bytes, in parts of at most `per_part`; a `last` behind the end means the end, a
    `first` behind it is an error."""
    from textbench.sources.files import read_lines
    from textbench.sources.sinks import byte_ranges

    if first < 1 or last < first:
        raise ValueError("no such line range")
    lines = read_lines(spark, path, encoding)
    found = lines.agg(F.min(F.when(F.col("line_no") == first, F.col("offset"))).alias("start"), F.min(F.when(F.col("line_no") == last + 1, F.col("offset"))).alias("end")).first()
    if found.start is None:
        raise ValueError(f"the file has fewer than {first} lines")
    sizes = file_sizes(spark, path).withColumn("own", F.coalesce(F.lit(found.end).cast("long"), F.col("length")) - found.start)
    ranges = byte_ranges(sizes, per_part, "own").select("path", "part", (F.col("start") + found.start).alias("start"), (F.col("end") + found.start).alias("end"))
    return copy_ranges(ranges, target)


def _spans(data: bytes, needle: bytes, fold: bool) -> Iterator[int]:
    """Starts of a literal in bytes, overlapping ones too."""
    data = data.lower() if fold else data  # bytes.lower() folds A-Z alone
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


_HAS_WORD_END = None


def _of_word(chars: str) -> bool:
    global _HAS_WORD_END
    if _HAS_WORD_END is None:
        import regex

        _HAS_WORD_END = regex.compile(_WORD)
    return bool(chars) and bool(_HAS_WORD_END.match(chars))


def _neighbours(data: bytes, at: int, end: int, encoding: str) -> tuple[str | None, str | None]:
    """The characters before and behind data[at:end]; None where the bytes are no character, "" where there are none."""

    def read(raw: bytes, last: bool) -> str | None:
        if not raw:
            return ""
        sizes = range(1, 5) if encoding == "UTF-8" else (2, 4)
        for n in sizes:
            try:
                found = (raw[-n:] if last else raw[:n]).decode(encoding)
            except UnicodeDecodeError:
                continue
            if len(found) == 1:
                return found
        return None

    return read(data[max(0, at - 4) : at], True), read(data[end : end + 4], False)


def find_in_files(
    spark: SparkSession, path: str | list[str], text: str, ignore_case: bool = False, whole_word: bool = False, encoding: str = "UTF-8", per_task: int = 64 << 20, block: int = BLOCK
) -> DataFrame:
    """(path, offset, length) of all matches of a literal in the bytes of files, overlapping ones too, also over line ends.

    Every range of `per_task` bytes is a row and is searched in blocks of `block` bytes. A range owns the matches that start in
    it and also reads as much of its neighbours as a match (and, for whole words, a character on both sides) can reach, so a
    match over a seam is found once. UTF-16 matches lie on even offsets. A neighbour that is no character refuses a whole word.
    """
    if not text:
        raise ValueError("an empty search text")
    if ignore_case and not text.isascii():
        raise ValueError("case is ignored for ASCII search texts only")
    wide = encoding.upper().startswith("UTF-16")
    if ignore_case and wide:
        raise ValueError("case is ignored for encodings that extend ASCII only")
    needle = (text.lower() if ignore_case else text).encode(encoding)
    from textbench.sources.sinks import byte_ranges

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, own = _opened(name)
                with store.open_input_file(own) as source:
                    for lo in range(start, end, block):
                        hi, before = min(lo + block, end), min(4, lo)
                        source.seek(lo - before)
                        data = source.read(hi - lo + before + len(needle) - 1 + 4)
                        found = []
                        for at in _spans(data, needle, ignore_case):
                            if at < before or at - before + lo >= hi or (wide and (at - before + lo) % 2):
                                continue
                            if whole_word:
                                sides = _neighbours(data, at, at + len(needle), encoding)
                                if None in sides or any(map(_of_word, sides)):
                                    continue
                            found.append(at - before + lo)
                        yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array([len(needle)] * len(found), pa.int32())], ["path", "offset", "length"])

    ranges = byte_ranges(file_sizes(spark, path).filter("length > 0"), per_task).select("path", "start", "end")
    tasks = 4 * spark.sparkContext.defaultParallelism
    return ranges.repartition(tasks, "path", "start").mapInArrow(search, "path string, offset long, length int")


_ENDS = re.compile(rb"\r\n|\r|\n")


def _lines_from(source, at: int, block: int) -> Iterator[tuple[int, bytes, int]]:
    """(offset, line, bytes read so far) of the lines of an opened file from offset `at`, the start of a line, on."""
    source.seek(at)
    held, begin, read, over = b"", at, 0, False
    while True:
        place = 0
        for m in _ENDS.finditer(held):
            if m[0] == b"\r" and m.end() == len(held) and not over:
                break  # an LF may follow
            yield begin + place, held[place : m.start()], read
            place = m.end()
        if over:
            if place < len(held):
                yield begin + place, held[place:], read
            return
        held, begin = held[place:], begin + place
        more = source.read(block)
        over, held, read = not more, held + more, read + len(more)


def lines_at(queries: DataFrame, anchors: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(file, line_no, offset, line, bytes_read) of the lines asked for (file, line_no), through a sparse index.

    anchors (file, line_no, offset): where some lines start, as navigate.anchors() takes them once from read_lines(), the file kept. A query finds
    the last anchor at or before its line, and its task seeks there and reads no further than that line: neither the
    table of lines nor the file is scanned. Lines behind the end of a file have no row. For files whose line ends are bytes CR and
    LF.
    """
    from textbench.operators.navigate import floor_lookup

    index = anchors.select("file", "line_no", F.col("line_no").alias("anchor_line"), F.col("offset").alias("anchor"))
    asked = queries.select("file", F.col("line_no").cast("long").alias("line_no")).distinct()
    found = floor_lookup(asked, index, "line_no", ["anchor_line", "anchor"], ["file"]).filter("anchor IS NOT NULL")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, line_no, first, anchor in zip(*(batch.column(i).to_pylist() for i in range(4))):
                store, own = _opened(name)
                with store.open_input_file(own) as source:
                    for i, (at, line, read) in enumerate(_lines_from(source, anchor, block), first):
                        if i == line_no:
                            out.append((name, line_no, at, (line.removeprefix(b"\xef\xbb\xbf") if not at else line).decode(errors="replace"), read))
                            break
            columns = list(zip(*out)) if out else [[] for _ in range(5)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "line_no", "offset", "line", "bytes_read"])

    rows = found.select("file", "line_no", "anchor_line", "anchor")
    return rows.mapInArrow(look, "file string, line_no long, offset long, line string, bytes_read long")
