import random
import re
import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textbench.operators import profile as P
from textbench.operators import replace as R
from textbench.operators import search as S
from textbench.sources import files as Sources
from textbench.streaming import tail


def places(spark, text, pattern, **kw):
    df = spark.createDataFrame([(text,)], "t string")
    return [r.pos for r in S.find_plain(df, "t", pattern, **kw).orderBy("pos").collect()]


def test_plain_search(spark):
    assert places(spark, "aaaa", "aa") == [0, 1, 2]
    assert places(spark, "éaa\naa", "aa") == [1, 4]
    assert places(spark, "THE the", "The", ignore_case=True) == [0, 4]
    assert places(spark, "the other the_ the", "the", whole_word=True) == [0, 15]
    assert places(spark, "a.c abc", "a.c") == [0]
    assert places(spark, "none", "zz") == []
    with pytest.raises(ValueError):
        S.literal_at(F.col("t"), "é", ignore_case=True)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab\n.é", max_size=12), min_size=1, max_size=8))
def test_search_equals_naive(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {(r.i, r.pos, r.offset) for r in S.find_plain(df, "t", "ab").collect()}
    assert got == {(i, m.start(), len(t[: m.start()].encode())) for i, t in enumerate(texts) for m in re.finditer("(?=ab)", t)}


def test_regex_and_harvest(spark):
    df = spark.createDataFrame([("one id=12\ntwo id=34",), ("alpha\r\nbeta\rgamma\ndelta",)], "t string")
    assert [r.match for r in S.harvest(df, "t", r"id=\d{2}").collect()] == ["id=12", "id=34"]
    assert [r.match for r in S.harvest(df, "t", r"alpha[\s\S]*delta").collect()] == ["alpha beta gamma delta"]
    assert [(r.pos, r.length) for r in S.find_regex(df, "t", r"id=\d").collect()] == [(4, 4), (14, 4)]
    for bad in ("a*", "(?=x)", r"(a)\1"):
        with pytest.raises(ValueError):
            S.java_pattern(bad)


def test_search_queries_search_the_whole_table(spark, tmp_path):
    from textbench.plans import search_queries  # noqa: F401
    from textbench.plans.registry import QUERIES

    rows = [(76, "x" * 1000200 + " the"), (77, "none"), (78, "the"), (4, "a1 " + "7" * 150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert ask("find_next") == [(77000201,)] and ask("find_prev") == []
    assert ask("search_regex_backward") == [(4, 1, "7" * 150), (4, 0, "1")]


def test_replacements(spark):
    df = spark.createDataFrame([("hello world hello",), ("aaaaaa",), ("abc",)], "t string")
    assert [r[0] for r in df.select(R.replace_plain(F.col("t"), "aa", "z")).collect()] == ["hello world hello", "zzz", "abc"]
    assert df.select(R.replace_plain(F.col("t"), "HELLO", "$1", ignore_case=True)).first()[0] == "$1 world $1"
    assert df.select(R.replace_regex(F.col("t"), r"(?P<a>h)el", "${a}$$")).first()[0] == "h$lo world h$lo"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc", max_size=10), min_size=1, max_size=6))
def test_batch_rules(spark, texts):
    rules = [("ab", "X", 1), ("abc", "Y", 1), ("bc", "Z", 0), ("c", "$", 2)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(R.replace_batch(F.col("t"), rules).alias("a"), R.batch_result(F.col("t"), rules)["text"].alias("b")).collect()
    naive = lambda t: re.sub("bc|abc|ab|c", lambda m: {"ab": "X", "abc": "Y", "bc": "Z", "c": "$"}[m[0]], t)
    assert [r.a for r in got] == [r.b for r in got] == [naive(t) for t in texts]


def test_batch_regex_conflicts(spark):
    df = spark.createDataFrame([("this thing",)], "t string")
    r = df.select(R.batch_result(F.col("t"), [(r"th\w+", "T", 0), (r"(?P<x>thi)ng", "${x}", 1)], regex=True).alias("r")).first().r
    assert (r.text, r.matches, r.conflicts) == ("T T", 2, 1)


def brute_rules(text, rules, fold, word):
    """All places of all rules; the best of the first wins, what else starts inside it is a conflict."""
    low = text.translate({i: i + 32 for i in range(65, 91)}) if fold else text
    part = lambda c: bool(regex.match(r"[\p{L}\p{Nd}\p{M}_]", c))
    every = []
    for i, (find, put, priority) in enumerate(rules):
        find = find.translate({i: i + 32 for i in range(65, 91)}) if fold else find
        for at in range(len(low)):
            end = at + len(find)
            if low.startswith(find, at) and not (word and ((at and part(text[at - 1])) or (end < len(text) and part(text[end])))):
                every.append((at, priority, -len(find), i, end, put))
    out, at, matches, conflicts = "", 0, 0, 0
    for start, _, _, _, end, put in sorted(every):
        if start < at:
            conflicts += 1
        else:
            out, at, matches = out + text[at:start] + put, end, matches + 1
    return out + text[at:], matches, conflicts


def test_rule_automaton_against_brute_force(spark):
    rng = random.Random(42)
    texts = ["".join(rng.choice("abAB _.é") for _ in range(80)) for _ in range(12)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for case in range(8):
        rules = [("".join(rng.choice("abAB") for _ in range(rng.randrange(1, 5))), str(i), rng.randrange(3)) for i in range(1 + case)]
        rules += rules[:1]
        fold, word = case % 2 == 0, case % 3 == 0
        got = df.select(R.batch_result(F.col("t"), rules, ignore_case=fold, whole_word=word).alias("r")).collect()
        assert [tuple(r.r) for r in got] == [(None, 0, 0) if t is None else brute_rules(t, rules, fold, word) for t in texts]
    for bad in ([], [("", "x", 0)]):
        with pytest.raises(ValueError):
            R.Literals(bad)
    with pytest.raises(ValueError):
        R.Literals([("é", "x", 0)], ignore_case=True)


def test_five_thousand_rules_cost_about_what_five_do():
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    rules = [(f"q{i:04d}q", "x", i) for i in range(5000)]
    few, many = R.Literals(rules[:5]), R.Literals(rules)

    def cost(r):
        start = time.process_time()
        assert r.replaced(text) == (text, 0, 0)
        return time.process_time() - start

    assert min(cost(many) for _ in range(5)) < 3 * min(cost(few) for _ in range(5)) + 0.02


def lines_of(spark, target):
    return sorted((r.file.rsplit("/", 1)[1], r.offset, r.value) for r in spark.read.parquet(target).collect())


def test_growing_files(spark, tmp_path):
    logs, out, cp = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    logs.mkdir()

    def start():
        return tail.follow_growing(spark, f"file://{logs}", span_bytes=7).writeStream.format("parquet").option("checkpointLocation", cp).trigger(processingTime="0 seconds").start(out)

    (logs / "a.log").write_text("one\ntwo\r\npart")
    query = start()
    query.processAllAvailable()
    want = [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert lines_of(spark, out) == want
    with (logs / "a.log").open("a") as f:  # grows
        f.write("ial\nthree\n")
    query.processAllAvailable()
    want += [("a.log", 9, "partial"), ("a.log", 17, "three")]
    assert lines_of(spark, out) == want
    query.stop()
    (logs / "a.log").rename(logs / "a.log.1")  # rotated while nothing runs, with lines that nobody has read yet
    with (logs / "a.log.1").open("a") as f:
        f.write("four\n")
    (logs / "a.log").write_text("fresh\n")
    query = start()
    query.processAllAvailable()
    want += [("a.log.1", 23, "four"), ("a.log", 0, "fresh")]
    assert lines_of(spark, out) == sorted(want)
    (logs / "a.log").write_text("cut\n")  # truncated and written anew
    query.processAllAvailable()
    want += [("a.log", 0, "cut")]
    (logs / "b.log").write_text("x" * 3000 + "\n\nlast\n")
    query.processAllAvailable()
    query.stop()
    want += [("b.log", 0, "x" * 3000), ("b.log", 3001, ""), ("b.log", 3002, "last")]
    assert lines_of(spark, out) == sorted(want)


def test_php_values():
    raw = b'a:2:{s:3:"url";s:15:"http://old.test";s:1:"n";i:5;}'
    assert R.rewrite_php(raw, b"old.test", b"longer.test") == (b'a:2:{s:3:"url";s:18:"http://longer.test";s:1:"n";i:5;}', 1)
    assert R.rewrite_php(b"plain old.test", b"old", b"new") == (b"plain new.test", 1)
    nested = b's:%d:"%s";' % (len(raw), raw)
    assert R.rewrite_php(nested, b"old.test", b"x")[0] == b's:44:"a:2:{s:3:"url";s:8:"http://x";s:1:"n";i:5;}";'.replace(b"44", str(len(b'a:2:{s:3:"url";s:8:"http://x";s:1:"n";i:5;}')).encode())
    with pytest.raises(ValueError):
        R.rewrite_php(b's:99:"http://old.test";', b"old", b"new")


def test_line_ends_are_idempotent(spark):
    df = spark.createDataFrame([("a\r\nb\rc\nd",)], "t string")
    once = R.convert_line_ends(F.col("t"), "\r\n")
    got = df.select(once.alias("x"), R.convert_line_ends(once, "\r\n").alias("y"), R.count_line_ends(F.col("t")).alias("n"), P.line_ending(F.col("t")).alias("e")).first()
    assert got.x == got.y == "a\r\nb\r\nc\r\nd" and got.n == 3 and got.e == "mixed"


def test_rules(spark):
    df = spark.createDataFrame([(1, "Street names :: Rd. => Road"), (2, " !Later :: a b -> "), (3, "  # a note => none"), (4, " "), (5, "x -> y => z")], "line_no int, line string")
    got = {tuple(r)[1:] for r in R.parse_rules(df).collect()}
    assert got == {("Street names", "Rd.", "Road", True), ("Later", "a b", "", False), ("", "x", "y => z", True)}


def test_classify(spark):
    values = ["007", "00123", "-0042", "0", "-0", "42", "3.14", "true", " true", "\t42", "hello", "99999999999999999999"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    names = [r[0] for r in df.select(P.type_name(P.kind_bit(F.col("v")))).collect()]
    assert names == ["TEXT", "TEXT", "TEXT", "BIGINT", "BIGINT", "BIGINT", "DOUBLE", "BOOLEAN", "TEXT", "TEXT", "TEXT", "TEXT"]
    empty = P.profile(df.limit(0)).collect()
    assert empty == []


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"the line {i}") for i in range(20)], "i int, t string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    op = lambda df: S.harvest(df, "t", r"line \d+").select("i", "match")
    tail.run_available(tail.follow_table(spark, str(tmp_path / "in"), rows.schema), op, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, op(rows).collect()))


def test_header_and_ragged(spark):
    data = [("f", 1, ["id", "name", "active"]), ("f", 2, ["1", "Ada", "true"]), ("g", 1, ["1", "2"]), ("g", 2, ["3", "4"]), ("h", 1, ["a"]), ("h", 2, ["b", "c"])]
    df = spark.createDataFrame(data, "file string, record_no long, fields array<string>")
    assert {r.file: r.header for r in P.has_header(df).collect()} == {"f": True, "g": False, "h": False}
    assert P.ragged_rows(df.filter("file = 'h'"), "record_no").first()[0] == 1
    lines = spark.createDataFrame([("x", "a;b;c"), ("x", "1;2;3"), ("x", "4;5,6;7")], "file string, line string")
    best = P.delimiter_scores(lines).filter("rank = 1").first()
    assert (best.delimiter, best.fields, best.modal_rows) == ("semicolon", 3, 3)


def test_manifest_diff(spark):
    a = spark.createDataFrame([(1, "x" * 10), (2, "y")], "id int, c string")
    b = spark.createDataFrame([(1, "x" * 9 + "z"), (3, "y")], "id int, c string")
    got = P.manifest_diff(P.fingerprint_manifest(a, "id", "c", 4), P.fingerprint_manifest(b, "id", "c", 4), ["id", "chunk_no"])
    assert {tuple(r) for r in got.collect()} == {(1, 2, "changed"), (2, 0, "removed"), (3, 0, "added")}


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "é", "😀", " ", "A", "1", "22", "\n"]) for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, 1000 * i, t) for i, t in enumerate(texts)], "i int, at long, t string").repartition(3)
    for term in ("a", "aa", "é", "a😀", "22"):
        want = {(i, p, 1000 * i + len(t[:p].encode())) for i, t in enumerate(texts) if t for p in range(len(t)) if t.startswith(term, p)}
        got = [(r.i, r.pos, r.offset) for r in S.find_plain(df, "t", term, "at").collect()]
        assert len(got) == len(want) and set(got) == want
    for pattern in ("[0-9]+", "a[^a]", "é|😀", r"\p{L}+"):
        own = pattern.replace(r"\p{L}", "[aAbé]")
        want = {(i, m.start(), 1000 * i + len(t[: m.start()].encode()), m[0]) for i, t in enumerate(texts) if t for m in re.finditer(own, t)}
        got = [(r.i, r.pos, r.offset, r.match) for r in S.find_regex(df, "t", pattern, "at").collect()]
        assert len(got) == len(want) and set(got) == want


def test_search_with_very_many_matches(spark):
    df = spark.createDataFrame([(1, "né the " * 100_000)], "i int, t string")
    start = time.time()
    got = S.find_plain(df, "t", "the").agg(F.count("*"), F.sum("pos"), F.max("offset")).first()
    assert tuple(got) == (100_000, sum(3 + 7 * i for i in range(100_000)), 4 + 8 * 99_999)
    assert S.find_regex(df, "t", "th[a-z]").count() == 100_000 and time.time() - start < 30


def test_preview_keeps_whole_characters(spark):
    texts = ["x" * 2000, "é" * 2000, "a" + "é" * 2000, "😀" * 2000, "ab" + "😀" * 2000, " a  b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", S.preview(F.col("t"), F.lit(0), 1, 1500).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == t.strip().replace("  ", " ").encode()[:512].decode(errors="ignore")


def literals(spark, *texts, find="old", put="new"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [(r.r.text, r.r.matches) for r in df.select("i", R.replace_in_literals(F.col("t"), find, put).alias("r")).orderBy("i").collect()]


def test_replace_in_literals(spark):
    got = literals(
        spark,
        "INSERT INTO `old` VALUES (1, 'old', \"old\"); -- old it's\n/* 'old' */",
        r"UPDATE t SET a = 'it''s old\nand \'old\' \\ \t', b = '';",
        """INSERT INTO o VALUES ('a:1:{s:3:"old";s:5:"x old";}')""",
        "SELECT old",
        None,
        "# 'old\nSELECT 'ol'",
    )
    assert got == [
        ("INSERT INTO `old` VALUES (1, 'new', \"old\"); -- old it's\n/* 'old' */", 1),
        ("UPDATE t SET a = 'it''s new\\nand ''new'' \\\\ \t', b = '';", 2),
        ("""INSERT INTO o VALUES ('a:1:{s:3:"new";s:5:"x new";}')""", 2),
        ("SELECT old", 0),
        (None, 0),
        ("# 'old\nSELECT 'ol'", 0),
    ]
    assert literals(spark, """INSERT INTO o VALUES ('s:3:"old";')""", put="newer") == [("""INSERT INTO o VALUES ('s:5:"newer";')""", 1)]


@pytest.mark.parametrize(
    "text",
    ["SELECT 'old", "DELIMITER ;;", "CREATE DEFINER=`a` PROCEDURE p() SELECT 'old'", "SET sql_mode='NO_BACKSLASH_ESCAPES'", "COPY t FROM stdin", "DO $$ x $$",
     "INSERT INTO t VALUES ('old a:1:{s:3:\"old\";')", "INSERT INTO t VALUES ('" + "733a333a226f6c64223b" + "')"],
)
def test_replace_in_literals_refuses(spark, text):
    with pytest.raises(Exception, match="is not closed|is not rewritten|cannot be rewritten|are read|malformed"):
        literals(spark, text, find="733a" if "733a" in text else "old")


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16LE", "UTF-16BE", "Windows-1251", "Windows-1252"])
def test_search_in_encoded_files(spark, tmp_path, encoding):
    codec, term = R.ENCODINGS[encoding], {"Windows-1251": "жук", "Windows-1252": "né"}.get(encoding, "é😀")
    marks = {"UTF-8": b"\xef\xbb\xbf", "UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff"}
    text = f"a {term}, {term}{term} the THE " + ("慁愀" if encoding.startswith("UTF-") else "")  # holds the bytes of `a` off their places
    for i, mark in enumerate([b"", marks[encoding]] if encoding in marks else [b""]):
        (tmp_path / f"{i}.bin").write_bytes(mark + text.encode(codec))
    df = Sources.read_binary(spark, f"file://{tmp_path}")
    for find, fold in ((term, False), ("the", True), ("a", False)):
        want = set()
        for i in range(len(list(tmp_path.iterdir()))):
            for m in re.finditer(re.escape(find), text, re.I if fold else 0):
                mark = len(marks[encoding]) if i else 0
                want.add((f"{i}.bin", m.start(), mark + len(text[: m.start()].encode(codec)), len(find.encode(codec))))
        got = [(r.path.split("/")[-1], r.pos, r.offset, r.length) for r in S.find_encoded(df, "content", find, encoding, fold).collect()]
        assert len(got) == len(want) and set(got) == want
