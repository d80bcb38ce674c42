"""Replacement and conversion of a text column."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.operators.search import _WORD, java_pattern, literal_at, quoted


def java_template(template: str) -> str:
    """A replacement template with $1, ${1} and ${name} as Java reads it; $1x names a group called 1x, which is never there."""
    out, i = [], 0
    while i < len(template):
        m = re.compile(r"\$\$|\$\{(\w+)\}|\$(\w+)").match(template, i)
        if not m:
            out.append("\\" + template[i] if template[i] in "\\$" else template[i])
            i += 1
            continue
        name = m[1] or m[2]
        out.append("\\$" if name is None else f"${name}" if name.isdigit() else f"${{{name}}}" if not name[0].isdigit() else "")
        i = m.end()
    return "".join(out)


def _literal_pattern(find: str, ignore_case: bool, whole_word: bool) -> str:
    if ignore_case and not find.isascii():
        raise ValueError("case is ignored for ASCII search texts only")
    pattern = ("(?i)" if ignore_case else "") + quoted(find)
    return rf"(?<!{_WORD}){pattern}(?!{_WORD})" if whole_word else pattern


def replace_plain(c: Column, find: str, put: str, ignore_case: bool = False, whole_word: bool = False) -> Column:
    """Left to right, not overlapping."""
    if not find:
        raise ValueError("an empty search text")
    if not ignore_case and not whole_word:
        return F.replace(c, F.lit(find), F.lit(put))
    return F.regexp_replace(c, _literal_pattern(find, ignore_case, whole_word), re.sub(r"([\\$])", r"\\\1", put))


def count_plain(c: Column, find: str, ignore_case: bool = False, whole_word: bool = False) -> Column:
    """How many replacements `replace_plain` makes."""
    return F.regexp_count(c, F.lit(_literal_pattern(find, ignore_case, whole_word)))


def replace_regex(c: Column, pattern: str, template: str, ignore_case: bool = False) -> Column:
    """All matches of a pattern, with captures in the template."""
    return F.regexp_replace(c, java_pattern(pattern, ignore_case), java_template(template))


# --- rules ------------------------------------------------------------------------------------------------------------

_RULE = r"^\s*(!)?\s*(?:(.*?)\s+::\s+)?(.*?)\s*(?:=>|->)\s*(.*?)\s*\z"


def parse_rules(lines: DataFrame, line: str = "line", order_by: str = "line_no") -> DataFrame:
    """`Name :: find => put` (or ->) as (rule_no, name, find, put, enabled); ! disables, # comments, blank lines do not count."""
    c = F.col(line)
    rows = lines.filter(~c.rlike(r"^\s*(#|\z)") & c.rlike(_RULE))
    part = lambda i: F.regexp_extract(c, _RULE, i)
    return rows.select(F.col(order_by).alias("rule_no"), part(2).alias("name"), part(3).alias("find"), part(4).alias("put"), (part(1) == "").alias("enabled"))


def replace_batch(c: Column, rules: list[tuple[str, str, int]]) -> Column:
    """Literal rules (find, put, priority) in one pass: earliest start, then lower priority, then longer, then the earlier rule.

    One alternation in that order finds the winners; what they become is looked up in a map. That suits a few rules, as every
    one is tried at every place; batch_result() takes thousands at the cost of one.
    """
    ranked = sorted(dict.fromkeys((p, -len(f), i, f, r) for i, (f, r, p) in enumerate(rules)))
    first: dict[str, str] = {}
    for _, _, _, find, put in ranked:
        first.setdefault(find, put)
    if not first or "" in first:
        raise ValueError("rules need a search text")
    pattern = "|".join(quoted(f) for f in first)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.split(c, pattern, -1)
    table = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    # split drops no pieces with limit -1: one more piece than matches, except where a zero-length first piece was left out.
    pieces = F.when(F.size(between) > F.size(found), between).otherwise(F.concat(F.array(F.lit("")), between))
    joined = F.zip_with(pieces, F.concat(F.transform(found, lambda m: F.element_at(table, m)), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(c)


def _ranked_matches(text: str, rules: list[tuple[re.Pattern, str, int]]) -> tuple[list, int]:
    """Winners in text order, and how many other matches overlap one."""
    every = []
    for i, (find, put, priority) in enumerate(rules):
        every += [(m.start(), priority, m.start() - m.end(), i, m.end(), m.expand(put)) for m in find.finditer(text) if m.end() > m.start()]
    won, end, lost = [], 0, 0
    for m in sorted(every):
        if m[0] >= end:
            won.append(m)
            end = m[4]
        else:
            lost += 1
    return won, lost


#: A rule set is held whole by every worker.
MAX_RULES = 100_000
_FOLD = {i: i + 32 for i in range(65, 91)}


class Literals:
    """Literal rules (find, put, priority) as one automaton, which goes over a text once, however many rules there are.

    Of the matches that start first, the one of the lowest priority, then the longest, then of the earliest rule wins. All other
    matches that start inside it, also its own rule's and each of those that share its search text, are conflicts.
    """

    def __init__(self, rules: list[tuple[str, str, int]], ignore_case: bool = False, whole_word: bool = False):
        import ahocorasick

        if not rules or len(rules) > MAX_RULES:
            raise ValueError(f"1 to {MAX_RULES:,} rules")
        self.ignore_case, self.whole_word = ignore_case, whole_word
        found: dict[str, tuple[tuple[int, int], str, int]] = {}
        for i, (find, put, priority) in enumerate(rules):
            if not find:
                raise ValueError("rules need a search text")
            if ignore_case and not find.isascii():
                raise ValueError("case is ignored for ASCII search texts only")
            key = find.translate(_FOLD) if ignore_case else find
            rank, own, n = found.get(key, ((priority, i), put, 0))
            found[key] = (*min((rank, own), ((priority, i), put)), n + 1)
        self.automaton = ahocorasick.Automaton()
        for key, ((priority, i), put, n) in found.items():
            self.automaton.add_word(key, (len(key), priority, i, put, n))
        self.automaton.make_automaton()

    def replaced(self, text: str) -> tuple[str, int, int]:
        """(text, matches, conflicts) after one pass."""
        low = text.translate(_FOLD) if self.ignore_case else text
        of_word = _word_character() if self.whole_word else None
        every = []
        for last, (size, priority, i, put, n) in self.automaton.iter(low):
            start = last + 1 - size
            if of_word and ((start and of_word(text[start - 1])) or (last + 1 < len(text) and of_word(text[last + 1]))):
                continue
            every.append((start, priority, -size, i, put, n))
        every.sort()
        parts, at, matches, conflicts = [], 0, 0, 0
        for start, _, size, _, put, n in every:
            if start < at:
                conflicts += n
                continue
            parts += [text[at:start], put]
            at, matches, conflicts = start - size, matches + 1, conflicts + n - 1
        return "".join([*parts, text[at:]]), matches, conflicts


@functools.cache
def _word_character():
    import regex

    return regex.compile(_WORD).match


def _python_template(template: str) -> str:
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: rf"\g<{m[1] or m[2]}>", template.replace("\\", r"\\"))


#: So many bytes of texts, and what becomes of them, are Python objects at one time.
SLICE_BYTES = 1 << 20


def by_slices(texts: pa.Array, one: Callable[[str | None], tuple], names: list[str]) -> pa.Array:
    """A struct of a text and whole numbers, what `one` makes of each text: a slice at a time goes to Arrow, so that only the Arrow
    columns grow with the batch."""
    kinds, out, rows, size = [pa.string(), *[pa.int32()] * (len(names) - 1)], [], [], 0

    def told() -> pa.Array:
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    for t in texts:
        rows.append(one(t.as_py()))
        size += len(rows[-1][0] or "") + 64
        if size >= SLICE_BYTES:
            out.append(told())
            rows, size = [], 0
    out.append(told())
    found = out[0] if len(out) == 1 else pa.concat_arrays(out)
    del out
    pa.default_memory_pool().release_unused()
    return found


def batch_result(c: Column, rules: list[tuple[str, str, int]], regex: bool = False, ignore_case: bool = False, whole_word: bool = False) -> Column:
    """struct(text, matches, conflicts) of a pass with all rules: literals by one automaton (see Literals); with `regex`, patterns,
    each of whose own matches do not overlap, and one that lost is not tried again. A null text has no matches."""
    if regex:
        if ignore_case or whole_word:
            raise ValueError("patterns say themselves what case and words they want")
        for f, _, _ in rules:
            java_pattern(f)  # refuses what the other regex operators refuse
            if re.search(r"\\[pPzZGQEhHvVRXk]|\(\?[a-zA-Z-]*[ux]|&&", f):
                raise ValueError(f"{f!r} means different things to the two regex engines")
        # ASCII classes, word limits and case, as the other regex operators have them.
        ready = [(re.compile(f, re.ASCII), _python_template(r), p) for f, r, p in rules]
    else:
        literals = Literals(rules, ignore_case, whole_word)

    def one(text: str | None) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        if not regex:
            return literals.replaced(text)
        won, lost = _ranked_matches(text, ready)
        parts, at = [], 0
        for m in won:
            parts += [text[at : m[0]], m[5]]
            at = m[4]
        return "".join([*parts, text[at:]]), len(won), lost

    @F.arrow_udf("struct<text:string,matches:int,conflicts:int>")
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(texts, one, ["text", "matches", "conflicts"])

    return run(c)


def replace_preview(df: DataFrame, c: str, find: str, put: str, order: list[str], radius: int = 40, k: int = 20) -> DataFrame:
    """Where the first replacements fall: pos, and the text around before and after."""
    rows = df.filter(F.contains(F.col(c), F.lit(find))).withColumn("m__", F.explode(literal_at(F.col(c), find))).withColumn("pos", F.col("m__.pos")).orderBy(*order, "pos").limit(k)
    lo = F.greatest(F.col("pos") - radius, F.lit(0))
    left = F.substring(c, lo + 1, F.col("pos") - lo)
    right = F.substring(c, F.col("pos") + len(find) + 1, F.lit(radius))
    return rows.select(*order, "pos", F.concat(left, F.lit(find), right).alias("before"), F.concat(left, F.lit(put), right).alias("after"))


def size_estimate(df: DataFrame, c: str, find: str, put: str) -> DataFrame:
    """bytes, matches and bytes_after of a plain replacement."""
    n = count_plain(F.col(c), find)
    more = len(put.encode()) - len(find.encode())
    got = df.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("matches"))
    return got.withColumn("bytes_after", F.col("bytes") + F.col("matches") * more)


# --- serialized PHP values --------------------------------------------------------------------------------------------


class _Php:
    """Rewrites the strings of one serialized value and their lengths."""

    def __init__(self, raw: bytes, find: bytes, put: bytes):
        self.raw, self.find, self.put, self.at, self.count = raw, find, put, 0, 0

    def _take(self, pattern: bytes) -> re.Match:
        m = re.compile(pattern).match(self.raw, self.at)
        if not m:
            raise ValueError(f"malformed serialized value at byte {self.at}")
        self.at = m.end()
        return m

    def _bytes(self, n: int, end: bytes) -> bytes:
        body, stop = self.raw[self.at : self.at + n], self.at + n
        if len(body) != n or self.raw[stop : stop + len(end)] != end:
            raise ValueError(f"a length is wrong at byte {self.at}")
        self.at = stop + len(end)
        return body

    def value(self, depth: int = 0) -> bytes:
        kind = self.raw[self.at : self.at + 1]
        if depth > 200:
            raise ValueError("nested too deep")
        if kind in b"NbidrR" and kind:
            return self._take(rb"N;|[birR]:-?\d+;|d:[-+.\deEINFAN]+;")[0]
        if kind in b"sSE" and kind:
            n = int(self._take(rb"[sSE]:(\d+):\"")[1])
            body, count = rewrite_php(self._bytes(n, b'";'), self.find, self.put)
            self.count += count
            return kind + b":%d:\"" % len(body) + body + b'";'
        if kind == b"a":
            n = int(self._take(rb"a:(\d+):\{")[1])
            return b"a:%d:{" % n + self._members(n, depth) + b"}"
        if kind == b"O":
            m = self._take(rb"O:(\d+):\"([^\"]*)\":(\d+):\{")
            if int(m[1]) != len(m[2]):
                raise ValueError("a class name has the wrong length")
            return m[0] + self._members(int(m[3]), depth) + b"}"
        if kind == b"C":
            m = self._take(rb"C:(\d+):\"([^\"]*)\":(\d+):\{")
            body = self._bytes(int(m[3]), b"}")
            if self.find in body:
                raise ValueError("a custom-serialized object holds the search text")
            return m[0] + body + b"}"
        raise ValueError(f"malformed serialized value at byte {self.at}")

    def _members(self, n: int, depth: int) -> bytes:
        out = b"".join(self.value(depth + 1) for _ in range(2 * n))
        self._take(rb"\}")
        return out


_SERIALIZED = re.compile(rb"(?s)\A(?:N;|[bidrR]:[^;]*;|[sSE]:\d+:\".*\";|[aOC]:\d+:.*\})\Z")


def rewrite_php(raw: bytes, find: bytes, put: bytes) -> tuple[bytes, int]:
    """(new bytes, replacements): inside strings of a serialized value, lengths included; plain text is replaced as it is."""
    if not _SERIALIZED.match(raw):
        return raw.replace(find, put), raw.count(find)
    php = _Php(raw, find, put)
    out = php.value()
    if php.at != len(raw):
        raise ValueError("something follows the serialized value")
    return out, php.count


def replace_serialized(c: Column, find: str, put: str) -> Column:
    """struct(text, matches) of a column that may hold serialized PHP; a malformed value fails the job."""

    def one(t: str | None) -> tuple[str | None, int]:
        raw, n = rewrite_php((t or "").encode(), find.encode(), put.encode())
        return None if t is None else raw.decode(), n

    @F.arrow_udf("struct<text:string,matches:int>")
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(texts, one, ["text", "matches"])

    return run(c)


# --- string literals of SQL ---------------------------------------------------------------------------------------------

#: What a statement consists of: comments, quoted identifiers and string literals; `bare` is the text of an unclosed literal.
_SQL_PART = re.compile(r"--(?=\s|\Z)[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)|`(?:[^`]|``)*`|\"(?:[^\"\\]|\\.|\"\")*\"|'(?P<body>(?:[^'\\]|\\.|'')*)'|(?P<bare>')", re.S)
#: MySQL's backslash escapes; any other character stands for itself.
_ESCAPED = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
_WRITTEN = str.maketrans({"\0": "\\0", "\n": "\\n", "\r": "\\r", "\\": "\\\\", "'": "''", "\x1a": "\\Z"})
#: Code that may read strings in another way: routines, other delimiters, other escape rules, bulk data.
_FOREIGN = re.compile(r"(?i)\bDELIMITER\b|NO_BACKSLASH_ESCAPES|\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:DEFINER|PROCEDURE|FUNCTION|TRIGGER|EVENT)\b|\bDO\s+\$|\bCOPY\s|\bSET\s+TERM\b|^GO\s*$", re.M)
_PHP_PIECE = re.compile(rb"(?:\A|[;{])(?:[sSE]:\d+:\"|[aOC]:\d+:[{\"])")


def _unwrapped(raw: bytes) -> list[bytes]:
    """What a literal may hold in hexadecimal or base64 form."""
    raw, out = raw.strip(), []
    digits = raw[2:] if raw[:2].lower() == b"0x" else raw
    if len(digits) >= 8 and re.fullmatch(rb"(?:[0-9A-Fa-f]{2})+", digits):
        out.append(bytes.fromhex(digits.decode()))
    if len(raw) >= 12 and len(raw) % 4 == 0 and re.fullmatch(rb"[A-Za-z0-9+/]+={0,2}", raw):
        out.append(base64.b64decode(raw))
    return out


def rewrite_literals(statement: str, find: str, put: str) -> tuple[str, int]:
    """(new statement, replacements): plain replacement in the decoded string literals only, which are then written anew."""
    count, code = 0, []

    def one(m: re.Match) -> str:
        nonlocal count
        if m["bare"]:
            raise ValueError("a string literal is not closed")
        if m["body"] is None:
            return m[0]
        value = re.sub(r"(?s)\\(.)|''", lambda e: "'" if e[1] is None else _ESCAPED.get(e[1], e[1]), m["body"])
        if "NO_BACKSLASH_ESCAPES" in value.upper():
            raise ValueError("a setting of the dump changes how its strings are read")
        if find in value:
            raw = value.encode()
            if any(_PHP_PIECE.search(x) for x in _unwrapped(raw)) or (_PHP_PIECE.search(raw) and not _SERIALIZED.match(raw)):
                raise ValueError("a literal holds a serialized value in a form that cannot be rewritten")
            raw, n = rewrite_php(raw, find.encode(), put.encode())
            value, count = raw.decode(), count + n
        return "'" + value.translate(_WRITTEN) + "'"

    out, at = [], 0
    for m in _SQL_PART.finditer(statement):
        code.append(statement[at : m.start()])
        out += [code[-1], one(m)]
        at = m.end()
    code.append(statement[at:])
    if _FOREIGN.search(" ".join(code)):
        raise ValueError("a routine, delimiter, escape mode or bulk load that is not rewritten")
    return "".join([*out, statement[at:]]), count


def replace_in_literals(c: Column, find: str, put: str) -> Column:
    """struct(text, matches) of a column of dump statements: replaced inside string literals only, serialized lengths kept right.

    Comments and identifiers stay as they are. Routine bodies, DELIMITER, COPY, other escape modes, unclosed literals and
    serialized values in hexadecimal or base64 form fail the job, so nothing is written.
    """
    if not find:
        raise ValueError("an empty search text")

    @F.arrow_udf("struct<text:string,matches:int>")
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda t: (None, 0) if t is None else rewrite_literals(t, find, put), ["text", "matches"])

    return run(c)


# --- encodings and line ends ------------------------------------------------------------------------------------------

#: Encodings and their Python codecs.
ENCODINGS = {"UTF-8": "utf-8", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "Windows-1251": "cp1251", "Windows-1252": "cp1252"}
_MARKS = {"UTF-8": b"\xef\xbb\xbf", "UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff"}


def encode_text(c: Column, target: str, bom: bool | None = None) -> Column:
    """A text in another encoding, as binary; UTF-16 gets its byte order mark unless `bom` says otherwise."""
    mark = _MARKS.get(target, b"") if (target.startswith("UTF-16") if bom is None else bom) else b""
    if target.startswith("UTF-"):
        return F.concat(F.unhex(F.lit(mark.hex())), F.encode(c, target))
    codec = ENCODINGS[target]

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t.encode(codec), na_action="ignore")

    return run(c)


def decode_bytes(c: Column, source: str) -> Column:
    """Binary to text, without a byte order mark; malformed input fails the job."""
    codec = ENCODINGS[source]
    if source in _MARKS:
        skip = F.when(marked(c, source), F.lit(len(_MARKS[source]))).otherwise(F.lit(0))
        return F.decode(F.substring(c, skip + 1, F.octet_length(c)), source)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode(codec), na_action="ignore")

    return run(c)


def marked(c: Column, source: str) -> Column:
    """Does binary content begin with the byte order mark of the encoding?"""
    return F.startswith(c, F.lit(_MARKS[source])) if source in _MARKS else F.lit(False)


def transcode(c: Column, source: str, target: str) -> Column:
    """Binary in one encoding to another; a UTF-8 mark stays with UTF-8."""
    had = marked(c, "UTF-8") if source == target == "UTF-8" else F.lit(False)
    text = decode_bytes(c, source)
    return F.when(had, encode_text(text, target, True)).otherwise(encode_text(text, target))


def convert_line_ends(c: Column, target: str = "\n") -> Column:
    """CRLF, CR and LF all become `target`."""
    return F.regexp_replace(c, "\r\n|\r|\n", target)


def count_line_ends(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\r\n|\r|\n"))

