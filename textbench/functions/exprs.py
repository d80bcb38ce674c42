"""Column helpers: guarded numbers, blank tests, SQL and JSON literals, names and byte sizes."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_BLANKS = r"[\s\x{85}\p{Z}]"
_SAFE = r"^[\x20-\x5B\x5D-\x7E]*\z"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def text(c: Column) -> Column:
    """A cell as text; a missing one is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, rf"^{_BLANKS}+|{_BLANKS}+\z", "")


def is_blank(c: Column) -> Column:
    return text(c).rlike(rf"^{_BLANKS}*\z")


def number(c: Column) -> Column:
    """A decimal number, infinity or NaN around which white space may stand; null for anything else."""
    t = F.lower(trimmed(text(c)))
    word = F.when(t.rlike(r"^\+?inf(inity)?\z"), float("inf")).when(t.rlike(r"^-inf(inity)?\z"), float("-inf")).when(t == "nan", float("nan"))
    return F.when(t.rlike(_DECIMAL), t.try_cast("double")).otherwise(word)


def json_number(c: Column) -> Column:
    """Is the cell a number by the JSON grammar, to the digit?"""
    return text(c).rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z")


def json_string(c: Column) -> Column:
    """A JSON string literal; HTML characters stay as they are."""
    return F.regexp_extract(F.to_json(F.struct(text(c).alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)


def sql_literal(c: Column, invalid: str = "fail") -> Column:
    """A MySQL string literal: quotes doubled for printable ASCII without backslash, otherwise hex that states UTF-8.

    `invalid` says what a control character does: fail, skip (null) or replace (by U+FFFD).
    """
    t = text(c)
    if invalid == "replace":
        t = F.regexp_replace(t, _CONTROL, "�")
    plain = F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("''")), F.lit("'"))
    hexed = F.concat(F.lit("CONVERT(X'"), F.hex(F.encode(t, "UTF-8")), F.lit("' USING utf8mb4)"))
    out = F.when(t.rlike(_SAFE), plain).otherwise(hexed)
    if invalid == "replace":
        return out
    bad = F.raise_error(F.lit("a cell holds control characters")).cast("string") if invalid == "fail" else F.lit(None).cast("string")
    return F.when(t.rlike(_CONTROL), bad).otherwise(out)


def sql_identifier(c: Column) -> Column:
    """A MySQL identifier in backticks; null if it is empty, longer than 64 characters or holds control characters."""
    t = text(c)
    quoted = F.concat(F.lit("`"), F.replace(t, F.lit("`"), F.lit("``")), F.lit("`"))
    return F.when((F.length(t) > 0) & (F.length(t) <= 64) & ~t.rlike(r"[\x00-\x1F\x7F]"), quoted)


def typed_value(c: Column, kind: str) -> Column:
    """The SQL token of a cell as BIGINT, DOUBLE or BOOLEAN; null if it is not one."""
    t = text(c)
    if kind == "BIGINT":
        return F.when(t.rlike(r"^[+-]?[0-9]+\z") & t.try_cast("bigint").isNotNull(), t)
    if kind == "DOUBLE":
        value = t.try_cast("double")
        return F.when(t.rlike(_DECIMAL) & value.isNotNull() & (F.abs(value) < float("inf")), t)
    if kind == "BOOLEAN":
        return F.when(F.lower(t).isin("true", "1"), "1").when(F.lower(t).isin("false", "0"), "0")
    raise ValueError(f"unknown type {kind!r}")


#: Device names that a portable file name must not be.
DEVICES = ["con", "prn", "aux", "nul"] + [f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)]


def safe_file_name(c: Column) -> Column:
    """Runs of other characters than letters, digits, dash and underscore become one underscore; ends are trimmed, device names get
    a prefix, an empty name is `table`. For long and non-ASCII names use `safe_file_name_full`."""
    t = F.regexp_replace(F.regexp_replace(text(c), r"^\s+|\s+\z", ""), r"[^\p{L}\p{Nd}_-]+", "_")
    t = F.regexp_replace(t, r"^[_-]+|[_-]+\z", "")
    t = F.when(t == "", "table").otherwise(t)
    return F.when(F.lower(t).isin(DEVICES), F.concat(F.lit("_"), t)).otherwise(t)


def safe_file_name_full(c: Column, most: int = 180) -> Column:
    """`safe_file_name` of the composed (NFC) form; names of more than `most` bytes are cut and end in a hash of the composed name."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x.strip()), na_action="ignore")

    @F.pandas_udf("string")
    def cut(s: pd.Series, whole: pd.Series) -> pd.Series:
        def one(x: str, full: str) -> str:
            raw, end = x.encode(), "_" + hashlib.sha256(full.encode()).hexdigest()[:16]
            return x if len(raw) <= most else (raw[: most - len(end)].decode(errors="ignore") + end).strip("_-")

        return pd.Series([one(x, y) for x, y in zip(s, whole)])

    full = composed(text(c))
    return cut(safe_file_name(full), full)


def portable_key(c: Column) -> Column:
    """What names that a file system may take for one have in common: the composed (NFC) form without regard to case."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")

    return folded(text(c))


_UNITS = ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]


def format_bytes(c: Column, largest: str = "EiB") -> Column:
    """512 B, 1.5 KiB, ... with one decimal (halves to even) in steps of 1024, up to the unit `largest`."""
    out = F.concat(c.cast("string"), F.lit(" B"))
    for i, unit in enumerate(_UNITS[: _UNITS.index(largest) + 1], 1):
        out = F.when(c >= 1 << (10 * i), F.format_string(f"%.1f {unit}", F.bround(c / float(1 << (10 * i)), 1))).otherwise(out)
    return out


def parse_byte_size(c: Column) -> Column:
    """`12`, `1.5K`, `2 MiB`, `3gb` as bytes (units of 1024, halves away from zero); null for anything else."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:([KMGT])(?:I?B)?|B)?\s*\z"
    t = F.upper(text(c))
    unit = F.regexp_extract(t, pattern, 2)
    scale = F.lit(1).cast("decimal(20,0)")
    for i, u in enumerate("KMGT", 1):
        scale = F.when(unit == u, F.lit(1 << (10 * i)).cast("decimal(20,0)")).otherwise(scale)
    value = F.regexp_extract(t, pattern, 1).try_cast("decimal(18,6)")
    return F.when(t.rlike(pattern), F.round(value * scale, 0).try_cast("bigint"))


def parse_offset(c: Column, size: Column) -> Column:
    """A byte size or `n%` of `size`, clamped to it; null for anything else."""
    t = text(c)
    share = F.regexp_extract(t, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*%\s*\z", 1).try_cast("decimal(18,6)")
    at = F.when(t.rlike(r"%\s*\z"), F.round(share * size.cast("decimal(18,0)") / 100, 0).try_cast("bigint")).otherwise(parse_byte_size(c))
    return F.least(at, size)


def parse_line_number(c: Column) -> Column:
    """A positive whole number; null for anything else."""
    t = F.trim(text(c))
    return F.when(t.rlike(r"^[0-9]+\z") & (t.try_cast("bigint") > 0), t.try_cast("bigint"))


def ascii_fold(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hmac_sha256(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, from nested built-in hashes."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in padded).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text(c), "UTF-8")), 256))), 256)
