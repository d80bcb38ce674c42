"""File sources: lines with byte offsets, binary files, strict delimited records, and dump statements, all splittable.

Records and statements can hold line ends, and what a line means depends on all before it. Each split first reports, for every
state it could start in, the state it ends in and how many units it closes; these functions are put together in a tree; a second
pass reads each split from its true state. A path may name many files; each is read as if it were alone.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Delimiters by name.
DELIMITER_NAMES = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|", "space": " "}
MAX_FIELDS = 1024
MAX_RECORD = 16 << 20


def delimiter(name: str) -> str:
    """A delimiter by name or itself; one character, no quote and no line end."""
    found = DELIMITER_NAMES.get(name, name)
    if len(found) != 1 or found in '"\r\n�\0':
        raise ValueError(f"{name!r} is no delimiter")
    return found


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length and content of whole files."""
    return spark.read.format("binaryFile").load(path)


def _pieces_at_cr(raw: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, row, at): texts that end at LF cut at each lone CR; the row each comes from and its byte place in it."""
    out, row, at = [], [], []
    for i, x in enumerate(raw):
        place = 0
        for part in x.as_py().removesuffix(b"\r").split(b"\r"):
            out.append(part)
            row.append(i)
            at.append(place)
            place += len(part) + 1
    return pa.array(out, pa.binary()), np.array(row, np.int64), np.array(at, np.int64)


def _relative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, split, rel, no, line): byte and line places from the start of each split, whose rows come one after another."""
    last, size, count = None, 0, 0
    for batch in batches:
        f, split, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())
        if not len(raw):
            continue
        length = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        some = pc.any(pc.match_substring(raw, "\r")).as_py()
        lines, row, at = _pieces_at_cr(raw) if some else (raw, np.arange(len(raw)), np.zeros(len(raw), np.int64))
        new = np.r_[True, (split[1:] != split[:-1]) | (f[1:] != f[:-1])]
        begin = np.cumsum(length) - length
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rel = begin[row] - begin[first][group[row]] + at
        lead = np.searchsorted(row, first)
        no = np.arange(len(row)) - lead[group[row]]
        if (f[0], split[0]) == last:
            rel[group[row] == 0] += size
            no[group[row] == 0] += count
        last, size, count = (f[-1], split[-1]), int(rel[-1]) + int(length[-1]) - int(at[-1]), int(no[-1]) + 1
        text = lines.cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
        yield pa.record_batch([pa.array(f[row]), pa.array(split[row]), pa.array(rel), pa.array(no, pa.int64()), text], ["f", "split", "rel", "no", "line"])


class Splits:
    """Files, a path or a folder or several, in the splits of Spark's text reader. A split is known by f, a hash of its file's path,
    and by where it starts, so that nothing of one file meets another's."""

    def __init__(self, spark: SparkSession, path: str | list[str]):
        rows = spark.read.option("lineSep", "\n").text(path)
        self.rows = rows.select(
            F.xxhash64("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("split"),
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
        )
        read = lambda key: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark._jsparkSession.sessionState().conf().getConfString(key))
        total = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        least = max(1, min(read("spark.sql.files.maxPartitionBytes"), max(read("spark.sql.files.openCostInBytes"), total // spark.sparkContext.defaultParallelism)))
        #: No more splits than this.
        self.most = len(rows.inputFiles()) + total // least + 1

    def of_few(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """`rows` with what `table` has of their split: a row for each split at most, so it is broadcast up to 100,000 of them."""
        return rows.join(F.broadcast(table) if self.most <= 100_000 else table, ["f", "split"])

    def lines(self) -> DataFrame:
        """(f, split, rel, no, line): the rows of a split in file order."""
        return self.rows.select("f", "split", "value").mapInArrow(_relative, "f long, split long, rel long, no long, line string")

    def in_order(self, rows: DataFrame, table: DataFrame, place: str = "no") -> DataFrame:
        """of_few() of lines whose order within their split, by `place`, stays."""
        rows = self.of_few(rows, table)
        return rows if self.most <= 100_000 else rows.repartition("f", "split").sortWithinPartitions("f", "split", place)

    def bases(self) -> DataFrame:
        """(f, split, file, base, lines, mark): bytes and lines before each split, and the bytes of a byte order mark (that the reader drops).

        Lines never overlap splits as the reader deals them out, so the sums of earlier splits are the place of a split's first line.
        """
        value = F.col("value")
        breaks = F.length(value) - F.length(F.replace(value, F.lit("\r"))) - F.endswith(value, F.lit("\r")).cast("int")
        sums = self.rows.groupBy("f", "split").agg(F.sum(F.octet_length(value).cast("long") + 1).alias("bytes"), F.sum((1 + breaks).cast("long")).alias("n"), F.max("size").alias("size"), F.max("file").alias("file"))
        own = Window.partitionBy("f")
        before = own.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        mark = F.when(F.max("size").over(own) - F.sum("bytes").over(own) > 1, F.lit(3)).otherwise(F.lit(0))
        at = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        return sums.select("f", "split", "file", at("bytes").alias("base"), at("n").alias("lines"), mark.alias("mark"))

    def placed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """`rows` with file and lines (before their split); `columns` hold places within the split and become offsets in the file.
        What starts the file starts at 0, before its byte order mark."""
        rows = self.of_few(rows, self.bases())
        place = lambda c: F.when((F.col("split") == 0) & (F.col(c) == 0), F.lit(0)).otherwise(F.col(c) + F.col("base") + F.col("mark")).cast("long")
        return rows.withColumns({c: place(c) for c in columns}).drop("base", "mark")


#: Functions of so many splits are put together in one row.
FAN = 256
_STEP = "array<struct<e:int,n:bigint>>"


def start_states(summaries: DataFrame, states: int, most: int, fan: int = FAN) -> DataFrame:
    """(f, split, state, before): for each split, the state that it starts in and how many units earlier splits of its file close.

    summaries: (f, split, fn), fn[s] the state (e) behind the split and the units (n) it closes if it starts in state s. Such
    functions compose, whatever the state before turns out to be: `fan` neighbours become one, these again, up to one for
    each file (most: no file has more splits); then the true states go down the same tree.
    """
    i = F.row_number().over(Window.partitionBy("f").orderBy("split")) - 1
    rows = summaries.select("f", "split", i.cast("long").alias("i"), F.col("fn").cast(_STEP).alias("fn"))
    found = _descended(rows.select("f", "i", "fn"), states, most, fan)
    return rows.select("f", "i", "split").join(found, ["f", "i"]).select("f", "split", "state", "before")


def _descended(rows: DataFrame, states: int, most: int, fan: int) -> DataFrame:
    blocks = rows.groupBy("f", F.floor(F.col("i") / fan).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "fn"))).alias("parts"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("before"))
    if most <= fan:
        blocks = blocks.withColumn("at", start)
    else:
        same = F.array(*[F.struct(F.lit(s).alias("e"), F.lit(0).cast("long").alias("n")) for s in range(states)]).cast(_STEP)
        after = lambda a, x: F.transform(a, lambda s: F.struct(x["fn"][s["e"]]["e"].alias("e"), (s["n"] + x["fn"][s["e"]]["n"]).alias("n"))).cast(_STEP)
        whole = blocks.select("f", F.col("b").alias("i"), F.aggregate("parts", same, after).alias("fn"))
        found = _descended(whole, states, -(-most // fan), fan)
        blocks = blocks.join(found.select("f", F.col("i").alias("b"), F.struct("state", "before").alias("at")), ["f", "b"])
    kind = "struct<out:array<struct<i:bigint,state:int,before:bigint>>,state:int,before:bigint>"

    def down(a, x):
        own = F.struct(x["i"].alias("i"), a["state"].alias("state"), a["before"].alias("before"))
        to = x["fn"][a["state"]]
        return F.struct(F.concat(a["out"], F.array(own)).alias("out"), to["e"].alias("state"), (a["before"] + to["n"]).alias("before")).cast(kind)

    zero = F.struct(F.array().cast("array<struct<i:bigint,state:int,before:bigint>>").alias("out"), F.col("at.state").alias("state"), F.col("at.before").alias("before")).cast(kind)
    return blocks.select("f", F.inline(F.aggregate("parts", zero, down)["out"]))


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, line_no, offset, line) of each file of a path: CR, LF and CRLF end lines; offsets count bytes of the file, a byte order
    mark too. encoding: UTF-8 (or any that has ASCII's bytes for line ends; its bytes are passed on), UTF-16LE or UTF-16BE.

    The files are read twice by Spark's text reader, in splits of `spark.sql.files.maxPartitionBytes`: for the sums of each split,
    and for the lines, which are placed within their split in Arrow batches. A stretch without LF is read as a whole.
    """
    splits = Splits(spark, path)
    if encoding.upper() in ("UTF-16LE", "UTF-16BE"):
        return _unit_lines(splits, encoding.upper())
    rows = splits.placed(splits.lines(), ["rel"])
    return rows.select("file", (F.col("no") + F.col("lines") + 1).alias("line_no"), F.col("rel").alias("offset"), "line")


def _whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, split, rel, value, size, behind, last): what lies between bytes 0A, with its byte place in the split and the first byte of
    the piece behind it; last: of its split. The last row of a batch waits for the next batch."""
    last, at, held = None, 0, None

    def told(rows: pa.RecordBatch, behind: list[int | None], ends: list[bool]) -> pa.RecordBatch:
        return pa.record_batch([*rows.columns, pa.array(behind, pa.int32()), pa.array(ends, pa.bool_())], ["f", "split", "rel", "value", "size", "behind", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        raw, rel, before = batch.column(2).cast(pa.binary()), [], last
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for key, n in zip(keys, pc.binary_length(raw).to_pylist()):
            if key != last:
                last, at = key, 0
            rel.append(at)
            at += n + 1
        heads = [x[0] if x else None for x in pc.binary_slice(raw, 0, 1).to_pylist()]
        rows = pa.record_batch([*batch.columns[:2], pa.array(rel, pa.int64()), raw, batch.column(3)], ["f", "split", "rel", "value", "size"])
        if held is not None:
            yield told(held, heads[:1] if keys[0] == before else [None], [keys[0] != before])
        ends = [a != b for a, b in zip(keys, keys[1:])]
        yield told(rows.slice(0, len(ends)), [None if end else x for x, end in zip(heads[1:], ends)], ends)
        held = rows.slice(len(ends))
    if held is not None:
        yield told(held, [None], [True])


def unit_breaks(data: bytes, start: int, cr: bytes, crlf: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes, ended) of the stretches of `data`, which starts at offset `start`, between CR units at even offsets; crlf: a
    CR at the very end belongs to the LF behind it."""
    at, p = 0, data.find(cr)
    while p >= 0:
        if (start + p) % 2:
            p = data.find(cr, p + 1)
            continue
        if crlf and p + 2 == len(data):
            data = data[:p]
            break
        yield start + at, data[at:p], True
        at = p + 2
        p = data.find(cr, at)
    yield start + at, data[at:], False


def _units(little: bool):
    """Cuts pieces between bytes 0A at the line ends of UTF-16: units at even offsets. An LF unit shows at one piece alone, in
    little endian at the start of the piece behind it (0A, then 00), in big endian at the end of the piece before it."""
    cr = b"\r\0" if little else b"\0\r"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no = None, 0
        for batch in batches:
            out = []
            for f, split, o, v, size, behind in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (f, split) != key:
                    key, no = (f, split), 0
                e = o + len(v)
                if little:
                    lf = o > 0 and o % 2 == 1 and v[:1] == b"\0"
                    start, data = (o + 1, v[1:]) if lf else (o, v) if not o else (o - 1, b"\n" + v)
                    if lf:
                        out.append((f, split, no, o - 1, b"", True))
                        no += 1
                    found = unit_breaks(data, start, cr, e < size and behind == 0)
                else:
                    lf = e < size and e % 2 == 1 and v[-1:] == b"\0"
                    found = unit_breaks(v[:-1] if lf else v + b"\n" * (e < size), o, cr, lf)
                for at, part, ended in found:
                    out.append((f, split, no, at, part, ended))
                    no += ended
                if not little and lf:
                    out.append((f, split, no, e - 1, b"", True))
                    no += 1
            columns = list(zip(*out)) if out else [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["f", "split", "no", "at", "part", "ended"])

    return cut


def _unit_lines(splits: Splits, encoding: str) -> DataFrame:
    """read_lines() for UTF-16. Pieces of a line, which are cut at any byte 0A, meet by its number."""
    kinds = "f long, split long, rel long, value binary, size long, behind int, last boolean"
    pieces = splits.rows.select("f", "split", "value", "size").mapInArrow(_whole_pieces, kinds)
    bases = splits.bases().select("f", "split", "file", "base")
    # the first byte behind a piece's own 0A: that of the next piece, which may start the next split
    heads = pieces.filter("rel = 0").select("f", "split", F.conv(F.hex(F.substring("value", 1, 1)), 16, 10).cast("int").alias("head"))
    heads = heads.select("f", "split", F.lead("head").over(Window.partitionBy("f").orderBy("split")).alias("next_head"))
    rows = splits.in_order(pieces, bases.join(heads, ["f", "split"]), "rel")
    behind = F.coalesce("behind", F.when(F.col("last"), F.col("next_head"))).alias("behind")
    rows = rows.select("f", "split", (F.col("base") + F.col("rel")).alias("o"), "value", "size", behind)
    cut = rows.mapInArrow(_units(encoding == "UTF-16LE"), "f long, split long, no long, at long, part binary, ended boolean")
    counts = cut.groupBy("f", "split").agg(F.count_if("ended").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = splits.of_few(splits.of_few(cut, counts.select("f", "split", before.alias("before"))), bases.select("f", "split", "file"))
    whole = cut.groupBy("f", "file", (F.col("no") + F.col("before") + 1).alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("at", "ended", "part"))).alias("p"))
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    ended = F.exists("p", lambda x: x["ended"])
    begin = F.element_at("p", 1)["at"]
    rows = whole.select("file", "line_no", begin.alias("offset"), data.alias("data"), ended.alias("ended")).filter("ended OR octet_length(data) > 0")
    text = F.regexp_replace(F.decode("data", encoding), "^\ufeff", "")
    return rows.select("file", "line_no", "offset", F.when(F.col("offset") == 0, text).otherwise(F.decode("data", encoding)).alias("line"))


# --- delimited text ---------------------------------------------------------------------------------------------------


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    """The regular tier: typed or text columns by Spark's own reader; quotes doubled, blanks kept, malformed rows fail."""
    reader = spark.read.options(sep=delimiter(sep), header=header, quote='"', escape='"', multiLine=True, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def parse_record(text: str, sep: str) -> list[str]:
    """One record, strictly: a quote inside a bare field or text behind a closing quote is an error."""
    if len(text.encode()) > MAX_RECORD:
        raise ValueError("a record has more than 16 MiB")
    fields, at = [], 0
    while True:
        if at < len(text) and text[at] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(text, at)
            if not m or (m.end() < len(text) and text[m.end()] != sep):
                raise ValueError(f"bad quotes in record {text[:80]!r}")
            fields.append(m[1].replace('""', '"'))
            at = m.end()
        else:
            end = text.find(sep, at)
            end = len(text) if end < 0 else end
            if '"' in text[at:end]:
                raise ValueError(f"a bare quote in record {text[:80]!r}")
            fields.append(text[at:end])
            at = end
        if at >= len(text):
            break
        at += 1
        if at == len(text):
            fields.append("")
            break
    if len(fields) > MAX_FIELDS:
        raise ValueError("a record has more than 1,024 fields")
    return fields


def _quotes_before(batch: pa.RecordBatch, carried: int, new: np.ndarray) -> np.ndarray:
    """Whether an odd number of quotes stands behind each line, counted from its split's start; carried: from earlier batches."""
    n = pc.count_substring(batch.column(batch.schema.get_field_index("line")), '"').to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(n)
    first = np.flatnonzero(np.r_[True, new[1:]])
    group = np.searchsorted(first, np.arange(len(n)), "right") - 1
    base = np.where(new[first], (run - n)[first], -carried)
    return (run - base[group]) % 2


def _fresh(batch: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a split starts in a batch with rows, and the batch's last split."""
    f, split = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    return np.r_[(f[0], split[0]) != last, (f[1:] != f[:-1]) | (split[1:] != split[:-1])], (f[-1], split[-1])


_SUMMARY = f"f long, split long, fn {_STEP}"


def _told(key: tuple, ends: list[int], counts: list[int]) -> pa.RecordBatch:
    fn = pa.array([[{"e": e, "n": n} for e, n in zip(ends, counts)]], pa.list_(pa.struct([("e", pa.int32()), ("n", pa.int64())])))
    return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), fn], ["f", "split", "fn"])


def _record_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, the state (1: inside quotes) behind it and the records it ends, from either state at its start."""
    last, odd, counts = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        new, key = _fresh(batch, last)
        behind = _quotes_before(batch, odd, new)
        f, split = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [*np.flatnonzero(np.r_[True, new[1:]]), len(behind)]
        for lo, hi in zip(edges, edges[1:]):
            if new[lo]:
                if last is not None:
                    yield _told(last, [odd, 1 - odd], counts)
                last, counts = (f[lo], split[lo]), [0, 0]
            ones = int(behind[lo:hi].sum())
            counts = [counts[0] + hi - lo - ones, counts[1] + ones]
            odd = int(behind[hi - 1])
        last = key
    if last is not None:
        yield _told(last, [odd, 1 - odd], counts)


def _record_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, split, no, at, line): each line with the number of its record."""
    last, odd, ended = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new, last = _fresh(batch, last)
        state, before = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        behind = _quotes_before(batch, odd, new)
        closed = ((behind + state) % 2 == 0).astype(np.int64)
        run = np.cumsum(closed)
        first = np.flatnonzero(np.r_[True, new[1:]])
        group = np.searchsorted(first, np.arange(len(run)), "right") - 1
        base = np.where(new[first], (run - closed)[first], -ended)
        no = before + run - closed - base[group]
        odd, ended = int(behind[-1]), int(run[-1] - base[-1])
        yield pa.record_batch([*batch.columns[:2], pa.array(no), *batch.columns[2:4]], ["f", "split", "no", "at", "line"])


def read_records(spark: SparkSession, path: str | list[str], sep: str = ",", fan: int = FAN) -> DataFrame:
    """The strict and ragged tier: (file, record_no, fields ARRAY<STRING>) of UTF-8 files whose records end with LF or CRLF.

    Blank lines are skipped, a byte order mark is dropped, quoted line ends stay (as LF); anything malformed fails the job. A
    lone CR ends a line here. record_no numbers the non-blank records of a file in order, with gaps where blank lines were.
    """
    sep = delimiter(sep)
    splits = Splits(spark, path)
    lines = splits.lines().select("f", "split", F.col("no").alias("at"), "line")
    starts = start_states(lines.mapInArrow(_record_summary, _SUMMARY), 2, splits.most, fan)
    rows = splits.in_order(lines.withColumnRenamed("at", "no"), starts).select("f", "split", F.col("no").alias("at"), "line", "state", "before")
    cut = rows.mapInArrow(_record_pieces, "f long, split long, no long, at long, line string")
    whole = cut.groupBy("f", "no").agg(F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("parts"))

    @F.pandas_udf("array<string>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda t: parse_record(t, sep))

    rows = whole.select("f", "no", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text")).filter("text <> ''")
    names = splits.rows.select("f", "file").distinct()
    rows = rows.join(F.broadcast(names) if splits.most <= 100_000 else names, "f")
    return rows.select("file", (F.col("no") + 1).alias("record_no"), parse("text").alias("fields"))


def csv_line(fields: list[str], sep: str = ",") -> str:
    """A record as text, minimally quoted: what the sinks write."""
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="").writerow(fields)
    return out.getvalue()


# --- dump statements --------------------------------------------------------------------------------------------------

_OUTSIDE = re.compile(r"['\"`;#]|--(?=\s|\Z)|/\*")
_INSIDE = {"'": re.compile(r"\\.|\\\Z|'"), '"': re.compile(r'\\.|\\\Z|"'), "`": re.compile("`"), "*": re.compile(r"\*/")}
#: Lexer states between lines: outside, in a kind of quotes, in a block comment.
STATES = ["", "'", '"', "`", "*"]


def scan_line(line: str, state: str) -> tuple[str, list[int]]:
    """State behind a line of a dump, and where its statements end."""
    at, ends = 0, []
    while True:
        m = (_INSIDE[state] if state else _OUTSIDE).search(line, at)
        if not m:
            return state, ends
        at, token = m.end(), m[0]
        if state:
            if not token.startswith("\\"):
                state = ""
        elif token == ";":
            ends.append(m.start())
        elif token in ("#", "--"):
            return state, ends
        else:
            state = "*" if token == "/*" else token


#: Lines without any of these leave every state as it is.
_MATTERS = r"['\"`;#*\\]|--|/"


def _dump_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, the state behind it and the statements it ends, from every state it may start in."""
    states = range(len(STATES))
    last, at, counts = None, list(states), [0] * len(STATES)
    for batch in batches:
        matters = pc.match_substring_regex(batch.column(2), _MATTERS).to_numpy(zero_copy_only=False)
        for f, split, line, may in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), matters):
            if (f, split) != last:
                if last is not None:
                    yield _told(last, at, counts)
                last, at, counts = (f, split), list(states), [0] * len(STATES)
            if may:
                text = line.as_py()
                step = {s: scan_line(text, STATES[s]) for s in set(at)}
                counts = [n + len(step[s][1]) for n, s in zip(counts, at)]
                at = [STATES.index(step[s][0]) for s in at]
    if last is not None:
        yield _told(last, at, counts)


_HEAD = r"(?s)^(?:\s+|--[^\n]*(?:\n|\z)|#[^\n]*(?:\n|\z)|/\*(?!!).*?\*/)*"
_NAME = r"((?:`(?:[^`]|``)+`|\"[^\"]+\"|[\w$]+))"
_TABLE = rf"(?:{_NAME}\s*\.\s*)?{_NAME}"
_VERBS = {
    "create": rf"(?is)^CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_TABLE}",
    "insert": rf"(?is)^INSERT\s+(?:(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE)\s+)*(?:INTO\s+)?{_TABLE}",
    "replace": rf"(?is)^REPLACE\s+(?:(?:LOW_PRIORITY|DELAYED)\s+)*(?:INTO\s+)?{_TABLE}",
}
#: What a dump must not hold, as the statement kinds that a text tool cannot cut safely.
_HAZARDS = {
    "delimiter": r"(?im)^\s*DELIMITER\s+\S",
    "copy": r"(?is)^COPY\s+.*FROM\s+STDIN",
    "routine": r"(?is)^CREATE\s+.*\b(?:PROCEDURE|FUNCTION|TRIGGER|EVENT)\b",
    "dollar quotes": r"(?s)^(?:DO|CREATE)\b.*\$\w*\$",
    "q quotes": r"(?i)(?<![\w'])n?q'[\[({<!|]",
}


def _bare(c):
    quoted = F.regexp_extract(c, r"(?s)^[`\"](.*)[`\"]\z", 1)
    return F.when(c.rlike(r"^[`\"]"), F.replace(quoted, F.lit("``"), F.lit("`"))).otherwise(c)


def classified(statements: DataFrame) -> DataFrame:
    """`statements` (text) with kind, database, table and hazard."""
    body = F.regexp_replace("text", _HEAD, "")
    rows = statements.withColumn("_body", body)
    kind, database, table = F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string")
    for name, pattern in _VERBS.items():
        hit = F.col("_body").rlike(pattern)
        kind = F.when(hit, name).otherwise(kind)
        database = F.when(hit, _bare(F.regexp_extract("_body", pattern, 1))).otherwise(database)
        table = F.when(hit, _bare(F.regexp_extract("_body", pattern, 2))).otherwise(table)
    hazard = F.lit(None).cast("string")
    for name, pattern in _HAZARDS.items():
        hazard = F.when(F.col("_body").rlike(pattern), name).otherwise(hazard)
    hazard = F.when(~F.col("closed") & (F.trim("_body") != ""), F.coalesce(hazard, F.lit("unterminated"))).otherwise(hazard)
    return rows.withColumns({"kind": F.coalesce(kind, F.lit("other")), "database": database, "table": table, "hazard": hazard}).drop("_body")


def read_statements(spark: SparkSession, path: str | list[str], fan: int = FAN) -> DataFrame:
    """(file, stmt_no, start, end, text, closed, kind, database, table, hazard) of SQL dumps, a file or a folder of them.

    Statements end at a `;` outside quotes and comments; start and end are byte offsets, stmt_no counts within a file; line ends in
    text are LF. A large dump is read in splits; the pieces of a statement meet by its number. What follows the last `;` comes out
    as not closed, unless it is blank.
    """
    splits = Splits(spark, path)
    lines = splits.lines()
    starts = start_states(lines.select("f", "split", "line").mapInArrow(_dump_summary, _SUMMARY), len(STATES), splits.most, fan)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, no = None, None, 0
        for batch in batches:
            out = []
            for f, split, offset, line, begin, before in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (f, split) != last:
                    last, state, no = (f, split), STATES[begin], before
                state, ends = scan_line(line, state)
                at = 0
                for end in ends:
                    lo = offset + len(line[:at].encode())
                    out.append((f, no, split, lo, len(line[at : end + 1].encode()), line[at : end + 1], True))
                    no, at = no + 1, end + 1
                lo = offset + len(line[:at].encode())
                out.append((f, no, split, lo, len(line[at:].encode()), line[at:], False))
            columns = list(zip(*out)) if out else [[] for _ in range(7)]
            kinds = (*[pa.int64()] * 5, pa.string(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["f", "no", "split", "start", "size", "piece", "closed"])

    rows = splits.in_order(lines, starts).select("f", "split", "rel", "line", "state", "before")
    cut = rows.mapInArrow(pieces, "f long, no long, split long, start long, size long, piece string, closed boolean")
    cut = splits.placed(cut, ["start"]).withColumn("end", F.col("start") + F.col("size"))
    whole = cut.groupBy("f", "no").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "piece"))).alias("p"), F.max("end").alias("end"), F.bool_or("closed").alias("closed"), F.max("file").alias("file")
    )
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "\n")
    lead = F.length(F.regexp_extract(text, r"^\s*", 0))
    first = F.filter("p", lambda x: F.trim(x["piece"]) != "")
    lo = F.get(first, F.lit(0))
    begin = lo["start"] + F.octet_length(F.regexp_extract(lo["piece"], r"^\s*", 0))
    rows = whole.select("file", (F.col("no") + 1).alias("stmt_no"), begin.alias("start"), "end", F.substring(text, lead + 1, F.length(text)).alias("text"), "closed")
    return classified(rows.filter("text <> ''"))


def refuse_hazards(statements: DataFrame) -> DataFrame:
    """`statements`, or an error that names the first hazard: to be called before anything is written."""
    bad = statements.filter("hazard IS NOT NULL").orderBy("file", "stmt_no").select("file", "stmt_no", "hazard").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]}, statement {bad[0][1]}: {bad[0][2]}")
    return statements
