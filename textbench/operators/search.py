"""Search and harvest in a text column: one row for each line or document; matches do not cross rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as part of a word: letters, decimal digits, marks and the underscore.
_WORD = r"[\p{L}\p{Nd}\p{M}_]"


def quoted(pattern: str) -> str:
    """A literal as a Java regular expression."""
    return r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of the RE2 dialect as a Java one; patterns that match empty text, look around or refer back are refused."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    if re.compile(re.sub(r"\\[pP](\{\w+\}|\w)", r"\\w", pattern)).match(""):
        raise ValueError("the pattern matches empty text")
    return ("(?diu)" if ignore_case else "(?d)") + pattern.replace("(?P<", "(?<")


def running_places(gaps: Column) -> Column:
    """array of (pos, offset): running sums of an array of (chars, bytes), the last of which is left out.

    Only these lengths reach Python, as Arrow lists, and they are summed without a loop over rows or matches.
    """

    @F.arrow_udf("array<struct<pos:int,offset:bigint>>")
    def run(column: pa.Array) -> pa.Array:
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))].astype(np.int64)
        values = column.flatten()
        keep = np.ones(len(values), bool)
        keep[ends[1:][np.diff(ends) > 0] - 1] = False
        sums = []
        for name, kind in (("chars", np.int32), ("bytes", np.int64)):
            total = np.cumsum(pc.struct_field(values, name).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.r_[0, total][ends[:-1]]
            sums.append((total - np.repeat(before, np.diff(ends)))[keep].astype(kind))
        size = np.diff(ends) - (np.diff(ends) > 0)
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), pa.StructArray.from_arrays([pa.array(v) for v in sums], ["pos", "offset"]))

    return run(gaps)


def _size(*parts: Column, width: Callable[[Column], Column] = F.octet_length) -> Column:
    return F.struct(sum(map(F.length, parts[1:]), F.length(parts[0])).alias("chars"), sum(map(width, parts[1:]), width(parts[0])).cast("long").alias("bytes"))


def literal_at(c: Column, pattern: str, ignore_case: bool = False, whole_word: bool = False, width: Callable[[Column], Column] = F.octet_length) -> Column:
    """Starts (pos in characters, offset in bytes, from 0) of all matches of a literal, overlapping ones too, ascending.

    The text is split by the literal's look-ahead, so each piece but perhaps the first starts at a match, and the running
    lengths of the pieces are the starts; the work is in proportion to the text, whatever the number of matches. `width` tells
    how many bytes a piece has, for texts that come from another encoding.
    """
    if not pattern:
        raise ValueError("an empty search text")
    if ignore_case:
        if not pattern.isascii():
            raise ValueError("case is ignored for ASCII search texts only")
    look = quoted(pattern)
    if whole_word:
        look = rf"(?<!{_WORD}){look}(?!{_WORD})"
    if ignore_case:
        look = rf"(?i:{look})"  # without its Unicode flag, Java's own case-ignoring match is that of A-Z alone
    # Where the text starts with a match, split makes no empty first piece.
    first = F.when(c.rlike(rf"^{look}"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(first, F.split(F.coalesce(c, F.lit("")), rf"(?={look})", -1))
    return running_places(F.transform(pieces, lambda s: _size(s, width=width)))


def regex_at(c: Column, pattern: str) -> Column:
    """(place (pos, offset), match) of all leftmost, non-overlapping matches of a Java pattern: what lies between them and the
    matches themselves come from the same expression engine, and their running lengths are the places."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.split(c, pattern, -1)
    gaps = F.zip_with(between, F.concat(F.array(F.lit("")), found), lambda gap, m: _size(gap, m))
    return F.arrays_zip(running_places(gaps).alias("place"), found.alias("match"))


def regex_count(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """How many leftmost, non-overlapping matches a text has."""
    return F.regexp_count(c, F.lit(java_pattern(pattern, ignore_case)))


def _based(base: str | None) -> Column:
    return F.col(base).cast("long") if base else F.lit(0).cast("long")


def find_plain(df: DataFrame, c: str, pattern: str, base: str | None = None, ignore_case: bool = False, whole_word: bool = False) -> DataFrame:
    """A row for each match, overlapping ones too: the columns of df, pos (characters), offset and length (bytes).

    base: the column with the row's own byte offset. The cheap containment test comes first and drops most rows.
    """
    test = F.col(c).rlike(f"(?i){quoted(pattern)}") if ignore_case else F.contains(F.col(c), F.lit(pattern))
    rows = df.filter(test).withColumn("m__", F.explode(literal_at(F.col(c), pattern, ignore_case, whole_word)))
    length = F.lit(len(pattern.encode()))
    return rows.withColumns({"pos": F.col("m__.pos"), "offset": _based(base) + F.col("m__.offset"), "length": length}).drop("m__")


def find_regex(df: DataFrame, c: str, pattern: str, base: str | None = None, ignore_case: bool = False) -> DataFrame:
    """The same for a pattern: leftmost first, not overlapping; `match` is the text found."""
    java = java_pattern(pattern, ignore_case)
    rows = df.filter(F.col(c).rlike(java)).withColumn("m__", F.explode(regex_at(F.col(c), java)))
    own = {"pos": F.col("m__.place.pos"), "offset": _based(base) + F.col("m__.place.offset"), "length": F.octet_length("m__.match"), "match": F.col("m__.match")}
    return rows.withColumns(own).drop("m__")


def find_encoded(df: DataFrame, c: str, pattern: str, encoding: str, ignore_case: bool = False) -> DataFrame:
    """A row for each match in binary content of an encoding (UTF-8, UTF-16LE, UTF-16BE, Windows-1251, Windows-1252): the columns
    of df, pos (characters), offset and length (bytes of the content, its byte order mark included).

    The content is decoded first, so UTF-16 matches are aligned by themselves and a term that the encoding lacks has none.
    """
    from textbench.operators.replace import ENCODINGS, decode_bytes, marked

    single = not encoding.startswith("UTF-")
    width = F.length if single else lambda x: F.octet_length(F.encode(x, encoding))
    rows = df.withColumn("text__", decode_bytes(F.col(c), encoding))
    rows = rows.withColumn("m__", F.explode(literal_at(F.col("text__"), pattern, ignore_case, width=width)))
    mark = F.when(marked(F.col(c), encoding), F.lit(3 if encoding == "UTF-8" else 2)).otherwise(F.lit(0))
    size = len(pattern) if single else len(pattern.encode(ENCODINGS[encoding]))
    return rows.withColumns({"pos": F.col("m__.pos"), "offset": F.col("m__.offset") + mark, "length": F.lit(size)}).drop("m__", "text__")


def before_offset(matches: DataFrame, order: list[str], upto: dict, k: int | None = None) -> DataFrame:
    """Backward search: the matches that start strictly before a place, nearest first."""
    (name, value), = upto.items()
    out = matches.filter(F.col(name) < value).orderBy(*[F.desc(c) for c in order])
    return out.limit(k) if k else out


def find_next(matches: DataFrame, order: str, start: int) -> DataFrame:
    """The first match at or behind a place."""
    return matches.filter(F.col(order) >= start).orderBy(order).limit(1)


def find_previous(matches: DataFrame, order: str, start: int) -> DataFrame:
    """The last match before a place."""
    return before_offset(matches, [order], {order: start}, 1)


def clipped(c: Column, most: int) -> Column:
    """The longest start of a text of at most `most` bytes that cuts no character."""
    raw = F.encode(c, "UTF-8")
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.lit(most - i)).cast("string")) for i in range(4)]))


def preview(c: Column, at: Column, chars: int, radius: int = 160, most: int = 512) -> Column:
    """The text around a match: white space runs as one space, trimmed, at most `most` bytes."""
    lo = F.greatest(at - radius, F.lit(0))
    return clipped(F.trim(F.regexp_replace(F.substring(c, lo + 1, at - lo + chars + radius), r"\s+", " ")), most)


def search_page(matches: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """The first matches in order, each with `truncated`: are there more?"""
    page = matches.orderBy(*order).limit(size + 1)
    return page.withColumn("truncated", F.count("*").over(Window.partitionBy()) > size).orderBy(*order).limit(size)


def harvest(df: DataFrame, c: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Each match of a pattern as a row; line ends inside a match become one space."""
    found = F.regexp_extract_all(F.col(c), F.lit(java_pattern(pattern, ignore_case)), F.lit(0))
    return df.withColumn("match", F.explode(found)).withColumn("match", F.regexp_replace("match", "\r\n|\r|\n", " "))
