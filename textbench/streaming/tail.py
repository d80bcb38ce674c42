"""Following logs as streams: files that appear in a folder, and open files that grow, are cut or are rotated."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

#: A file is told from another by the hash of so many first bytes (or of all that have been read, if fewer).
HEAD = 4096
BLOCK = 1 << 20


def follow(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """(value) of each line of each file that appears in a folder (rotated chunks); for files that grow, see follow_growing()."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def follow_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of each Parquet file that appears in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def run_available(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies a row operator to all that has come so far and appends it to a Parquet folder; a rerun goes on where it stopped."""
    writer = operator(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start(target)


class Span(InputPartition):
    """The lines of a file that start at bytes from `start` up to `end`; `end` is the end of a line."""

    def __init__(self, path: str, start: int, end: int, upto: int):
        self.path, self.start, self.end, self.upto = path, start, end, upto


class GrowingReader(DataSourceStreamReader):
    """The offset of the stream is, for every file, the bytes of its whole lines and the hash of its head.

    Files are known by their heads, not their names: one that has grown goes on where it stopped; one that was renamed
    (rotated) is found again under its new name; one that was cut or replaced does not have the head any more, or is shorter,
    and starts anew. A last line without an end waits until it has one.
    """

    def __init__(self, path: str, span_bytes: int):
        self.path, self.span_bytes = path, span_bytes

    def _files(self) -> dict[str, int]:
        from pyarrow import fs

        from textbench.sources.ranges import _opened

        self.store, root = _opened(self.path)
        found = self.store.get_file_info(root)
        if found.type == fs.FileType.Directory:
            listed = self.store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            return {f.path: f.size for f in listed if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}
        return {root: found.size} if found.type == fs.FileType.File else {}

    def _whole_lines(self, path: str, size: int) -> int:
        """Bytes up to the last line end, looked for from the back."""
        with self.store.open_input_file(path) as f:
            at = size
            while at:
                lo = max(0, at - BLOCK)
                f.seek(lo)
                found = f.read(at - lo).rfind(b"\n")
                if found >= 0:
                    return lo + found + 1
                at = lo
        return 0

    def _head(self, path: str, n: int) -> str:
        with self.store.open_input_file(path) as f:
            return hashlib.sha256(f.read(n)).hexdigest()

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        found = {}
        for path, size in self._files().items():
            upto = self._whole_lines(path, size)
            if upto:
                n = min(upto, HEAD)
                found[path] = [upto, n, self._head(path, n)]
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        there = self._files()
        left, out = dict(old), []

        def goes_on(path: str, was: list) -> bool:
            upto, n, head = was
            return path in there and new[path][0] >= upto and there[path] >= new[path][0] and self._head(path, n) == head

        own = {path: path for path in new if path in old and goes_on(path, old[path])}
        for path in own:
            left.pop(path)
        for path in new:  # rotated: another name, the same head
            if path not in own:
                was = next((p for p, x in sorted(left.items(), key=lambda i: -i[1][1]) if goes_on(path, x)), None)
                if was is not None:
                    own[path] = was
                    left.pop(was)
        for path, (upto, _, _) in sorted(new.items()):
            at = old[own[path]][0] if path in own else 0
            if path in there:
                out += [Span(path, lo, min(lo + self.span_bytes, upto), upto) for lo in range(at, upto, self.span_bytes)]
        return out

    def read(self, span: Span) -> Iterator[tuple]:
        from textbench.sources.ranges import _opened

        store, _ = _opened(self.path)
        with store.open_input_file(span.path) as f:
            at = span.start
            if at:  # a line that started before the span belongs to the one before
                f.seek(at - 1)
                rest = f.read(1)
                while rest and rest != b"\n":
                    block = f.read(min(BLOCK, span.upto - at))
                    cut = block.find(b"\n")
                    at += len(block) if cut < 0 else cut + 1
                    rest = b"\n" if cut >= 0 else block
            f.seek(at)
            held, begin = b"", at
            while begin < span.end:
                block = f.read(min(BLOCK, span.upto - at))
                at += len(block)
                *whole, held = (held + block).split(b"\n")
                for line in whole:
                    if begin < span.end:
                        yield span.path, begin, line.removesuffix(b"\r").decode(errors="replace")
                    begin += len(line) + 1
                if not block:
                    return

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """Stream source `growing_files`: path, a file or a folder; spanBytes, bytes for one task (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("spanBytes", 64 << 20)))


def follow_growing(spark: SparkSession, path: str, span_bytes: int = 64 << 20) -> DataFrame:
    """(file, offset, value) of every line that is added to a file, or to the files of a folder, each line once, also after a
    restart from the checkpoint, and over cuts and rotations between two batches. What a file lost before it was read is lost."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", path).option("spanBytes", str(span_bytes)).load()
