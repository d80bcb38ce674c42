import contextlib
import csv
import hashlib
import io
import random
import re

import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from textbench.functions import exprs as E
from textbench.operators import dump as D
from textbench.operators import navigate as N
from textbench.operators import profile as P
from textbench.operators import schemadiff as X
from textbench.sources import files as S
from textbench.sources import ranges as R
from textbench.sources import sinks as K

DUMP = """-- MySQL dump
CREATE TABLE `alpha` (id INT, note VARCHAR(9)) DEFAULT CHARSET=utf8mb4 COLLATE=utf8mb4_bin;
INSERT INTO `alpha` VALUES (1,'a;b'),(2,'it''s'),(3,'x\\'y');
/* CREATE TABLE fake (a INT); */
INSERT INTO `alpha` VALUES (4,GREATEST(2, LENGTH('ab')));
# INSERT INTO fake VALUES (1);
CREATE TABLE db.`be``ta` (
  a INT
) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;
"""


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "d.sql"
    path.write_bytes(DUMP.encode())
    return f"file://{path}"


@contextlib.contextmanager
def splits(spark, size):
    """Splits of `size` bytes, packed as they come."""
    conf = {"spark.sql.files.maxPartitionBytes": str(size or 1 << 20), "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split", [None, 40, 7])
def test_statements_do_not_depend_on_splits(spark, dump, split):
    with splits(spark, split):
        check_statements(spark, dump)


def check_statements(spark, dump):
    got = S.read_statements(spark, dump).orderBy("stmt_no").collect()
    assert [(r.kind, r.database, r.table) for r in got] == [("create", "", "alpha"), ("insert", "", "alpha"), ("insert", "", "alpha"), ("create", "db", "be`ta")]
    raw = DUMP.encode()
    assert all(raw[r.end - 1 : r.end] == b";" and r.hazard is None for r in got)
    assert got[1].text.startswith("INSERT") and raw[got[1].start : got[1].end].decode() == got[1].text


def test_inventory_lint_extract(spark, dump):
    st = S.read_statements(spark, dump)
    inv = {r.table: r for r in D.inventory(st).collect()}
    assert inv["alpha"].regions == D.regions(st).filter("table = 'alpha'").count() == 3 and inv["be`ta"].insert_offset is None
    assert {(r.finding, r.detail) for r in D.lint(st).collect()} >= {("tables without data", "db.be`ta"), ("large table", "alpha")}
    assert {r.name: r.n for r in D.named_settings(st, "charset").collect()} == {"utf8mb4": 2}
    assert D.extract_table(st, "alpha", what="data").count() == 2
    assert {r.name: r.value for r in D.counters(st).collect()} == {"create_tables": 2, "insert_tables": 1, "definers": 0, "header": 1}


def test_reshape(spark, dump):
    st = S.read_statements(spark, dump)
    one = [r.text for r in D.single_inserts(st).collect() if "INSERT INTO `alpha`" in r.text]
    assert len(one) == 4 and one[2].endswith("(3,'x\\'y');")
    many = D.multi_inserts(st, 3).collect()
    assert [r.text.count("),(") for r in many if "INSERT INTO `alpha`" in r.text] == [2, 0]
    fixture = [r.text for r in D.sample_fixture(st, 2).collect()]
    assert any(t.endswith("(1,'a;b'),(2,'it''s');") for t in fixture) and not any("GREATEST" in t for t in fixture)
    for bad in ("INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a=1;", "INSERT INTO t VALUES (1;", "COPY t FROM stdin;"):
        with pytest.raises(ValueError):
            D.split_tuples(bad)


def test_hazards(spark, tmp_path):
    for text in ("DELIMITER //\n", "CREATE PROCEDURE p() SELECT 1;\n", "INSERT INTO t VALUES (1)"):
        path = tmp_path / "h.sql"
        path.write_text(text)
        with pytest.raises(ValueError):
            S.refuse_hazards(S.read_statements(spark, f"file://{path}"))


LINES = [b"\xef\xbb\xbfone\r\ntwo\rthree\n\nfive", b"a\nb\n", b"\r\r\n\n\rx\r", b"", "né\n😀 long line without any break at all\r\nz".encode(), b"\n" * 30 + b"end", b"\xff bad \xfe\r\nok\n"]


def cut_lines(raw):
    out, at = [], 0
    for m in re.finditer(rb"([^\r\n]*)(\r\n|\r|\n|\Z)", raw):
        if m.end() > m.start():
            out.append((m.start(), m[1].removeprefix(b"\xef\xbb\xbf") if not m.start() else m[1]))
    return out


@pytest.mark.parametrize("raw", LINES)
def test_lines_of_any_split(spark, tmp_path, raw):
    path = tmp_path / "l.txt"
    path.write_bytes(raw)
    with splits(spark, 11):
        got = S.read_lines(spark, f"file://{path}").select("line_no", "offset", F.col("line").cast("binary").alias("line")).orderBy("line_no").collect()
    assert [(r.line_no, r.offset, bytes(r.line)) for r in got] == [(i, at, x) for i, (at, x) in enumerate(cut_lines(raw), 1)]


def test_lines_and_anchors(spark, tmp_path):
    path = tmp_path / "l.txt"
    path.write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree\n\nfive")
    lines = S.read_lines(spark, f"file://{path}")
    assert [(r.offset, r.line) for r in lines.orderBy("offset").collect()] == [(0, "one"), (8, "two"), (12, "three"), (18, ""), (19, "five")]
    numbered = S.read_lines(spark, f"file://{path}")
    sparse = N.anchors(numbered, 2)
    asked = spark.createDataFrame([(0,), (13,), (25,)], "offset long")
    assert [r.line_no for r in N.offset_to_line(asked, sparse, 100.0).orderBy("offset").collect()] == [1, 3, 5]


@pytest.mark.parametrize("split", [None, 11])
def test_strict_records(spark, tmp_path, split):
    data = [["id", "note"], ["1", "a,b"], ["2", 'say "hi"\nagain'], ["3", ""], ["short"]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(data)
    path = tmp_path / "r.csv"
    path.write_text(out.getvalue())
    with splits(spark, split):
        assert [r.fields for r in S.read_records(spark, f"file://{path}", "comma").orderBy("record_no").collect()] == data
    path.write_text('a,b"c\n')
    with pytest.raises(Exception, match="bare quote"):
        S.read_records(spark, f"file://{path}").collect()
    with pytest.raises(ValueError):
        S.delimiter('"')
    with pytest.raises(ValueError):
        S.parse_record("," * 1024, ",")


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'q"x'), ("", "b,c")], "x string, y string")
    K.write_delimited(df.coalesce(1), str(tmp_path / "o"))
    back = S.read_delimited(spark, str(tmp_path / "o"))
    assert sorted((r.x or "", r.y) for r in back.collect()) == sorted((r.x, r.y) for r in df.collect())
    with pytest.raises(Exception, match="(?i)exist"):
        K.write_delimited(df, str(tmp_path / "o"))


def test_json_markdown_insert(spark):
    df = spark.createDataFrame([(1, 'a"<b>', "1.50"), (2, "x|y\nz", "01")], "n long, b string, a string")
    assert [r.value for r in K.json_lines(df.drop("n"), ["a"]).collect()] == ['{"a":1.50,"b":"a\\"<b>"}', '{"a":"01","b":"x|y\\nz"}']
    assert K.markdown_rows(df.drop("n")).collect()[1].value == "| x\\|y z | 01 |"
    got = K.insert_statements(df.select("n", "a"), "t", "n", rows=1).orderBy("batch").collect()
    assert got[0].value == "INSERT INTO `t` (`a`) VALUES\n('1.50');"
    tuples = spark.createDataFrame([("g", i, "x" * 10) for i in range(10)], "g string, n long, t string")
    assert [r.batch for r in K.byte_batches(tuples, 100, 40, ["g"]).orderBy("n").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert [r.batch for r in K.byte_batches(tuples, 100, 40, ["g"], block=5).orderBy("n").collect()] == [0, 0, 0, 1, 1, 5, 5, 5, 6, 6]


def test_ranges(spark):
    ranges = spark.createDataFrame([(0, 10), (5, 20)], "range_start long, range_end long")
    records = spark.createDataFrame([(0, 5)], "start long, end long")
    with pytest.raises(ValueError):
        K.export_ranges(records, ranges)
    assert K.export_ranges(records, ranges.limit(1)).count() == 1


def test_encodings(spark):
    from textbench.operators.replace import decode_bytes, transcode

    assert P.detect_encoding(b"\xef\xbb\xbfabc")[:2] == ("UTF-8", True)
    assert P.detect_encoding("привет мир".encode("cp1251"))[0] == "Windows-1251"
    assert P.detect_encoding("café crème".encode("cp1252"))[0] == "Windows-1252"
    assert P.detect_encoding("hello".encode("utf-16-le"))[0] == "UTF-16LE"
    df = spark.createDataFrame(pd.DataFrame({"b": ["привет".encode("cp1251")]}))
    back = df.select(decode_bytes(transcode(F.col("b"), "Windows-1251", "UTF-16BE"), "UTF-16BE"))
    assert back.first()[0] == "привет"


def test_schema_diff_reports_each_change(spark):
    base = "CREATE TABLE t (id INT NOT NULL, a VARCHAR(9) DEFAULT 'x,y', PRIMARY KEY (id), UNIQUE KEY u (a)) ENGINE=InnoDB COLLATE=utf8mb4_bin;"
    variants = [
        base.replace("VARCHAR(9)", "VARCHAR(10)"), base.replace("'x,y'", "'x,z'"), base.replace("PRIMARY KEY (id)", "PRIMARY KEY (a)"), base.replace("u (a)", "u (id)"),
        base.replace("InnoDB", "MyISAM"), base.replace("utf8mb4_bin", "utf8mb4_general_ci"), base.replace("id INT NOT NULL, a", "b INT, id INT NOT NULL, a"), base.replace("CREATE TABLE", "CREATE TEMPORARY TABLE"),
    ]

    def st(text):
        return spark.createDataFrame([("create", "", "t", text)], "kind string, database string, table string, text string")

    assert X.diff_dumps(st(base), st(base.replace(" NOT NULL", "   NOT NULL").replace("(id)", "( id )"))).first().change == "unchanged"
    assert [X.diff_dumps(st(base), st(v)).first().change for v in variants] == ["changed"] * len(variants)
    assert X.diff_dumps(st(base), st("CREATE TABLE t AS SELECT 1")).first().change == "unknown"


def test_ranges_of_files(spark, tmp_path):
    data = {"a.bin": bytes(range(256)) * 5, "c.bin": b"xyz"}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    found = S.read_binary(spark, f"file://{tmp_path}")
    ranges = K.byte_ranges(found.select("path", "length"), 500)
    got = {(r.path.split("/")[-1], r.part): r for r in K.read_ranges(found, ranges.select("path", "part", "start", "end")).collect()}
    assert len(got) == 4
    for (name, part), r in got.items():
        own = data[name][part * 500 : part * 500 + 500]
        assert bytes(r.bytes) == own and r.sha256 == hashlib.sha256(own).hexdigest()


def statement_rows(spark, rows):
    return spark.createDataFrame([("f", i + 1, 100 * i, 100 * i + 50, t, k, d, n) for i, (k, d, n, t) in enumerate(rows)], "file string, stmt_no long, start long, end long, text string, kind string, database string, table string")


def test_split_by_table(spark, tmp_path):
    rows = [("create", "", "T", "CREATE TABLE T (a INT) CHARSET=UTF8MB4;"), ("insert", "", "T", "INSERT INTO T VALUES (1);"), ("create", "", "t", "CREATE TABLE t (a INT) CHARACTER SET latin1;"), ("insert", "x/y", "a b", "INSERT INTO `a b` VALUES ('z');"), ("other", None, None, "SET a = 1;"), ("insert", "", "T", "INSERT INTO T VALUES (2);")]
    df = statement_rows(spark, rows)
    got = {(r.database, r.table): r for r in K.split_manifest(df, 2).collect()}
    assert {k: r.name for k, r in got.items()} == {("", "T"): "T", ("", "t"): "t_02", ("x/y", "a b"): "x_y_a_b"}
    assert got["", "T"].charsets == ["utf8mb4"] and got["", "t"].charsets == ["latin1"] and got["x/y", "a b"].charsets == []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = [(1, rows[0][3]), (2, rows[1][3]), (6, rows[5][3])]
    buckets = [sha("".join(sha(t) for i, t in own if i // 2 == b)) for b in (0, 1, 3)]
    assert got["", "T"].sha256 == sha("".join(buckets)) and (got["", "T"].bytes, got["", "T"].regions, got["", "T"].first, got["", "T"].last) == (150, 3, 0, 550)
    K.write_by_table(df, f"file://{tmp_path}/out")
    back = {p.name.removeprefix("name="): "".join(f.read_text() for f in sorted(p.glob("*.txt"))) for p in (tmp_path / "out").glob("name=*")}
    assert back == {"T": "\n".join(t for _, t in own) + "\n", "t_02": rows[2][3] + "\n", "x_y_a_b": rows[3][3] + "\n"}
    with pytest.raises(Exception, match="(?i)exist"):
        K.write_by_table(df, f"file://{tmp_path}/out")


def test_batches_keep_both_bounds(spark):
    rng = random.Random(2)
    rows = [("insert", "", "t", f"INSERT INTO {rng.choice('ab')} VALUES " + ",".join(f"({i},'{'x' * rng.choice([1, 5, 60])}')" for i in range(rng.randrange(1, 6))) + ";") if rng.random() < 0.8 else ("other", None, None, f"SET a = {n};") for n in range(60)]
    want = []
    for kind, _, _, text in rows:  # runs of one head, then batches of 4, each cut again at 100 bytes
        head, tuples = D.split_tuples(text) if kind == "insert" else (None, [text])
        if head and want and want[-1][0] == head:
            want[-1][1].extend(tuples)
        else:
            want.append((head, list(tuples)))
    out = []
    for head, tuples in want:
        for i in range(0, len(tuples), 4):
            if head is None:
                out.append(tuples[i])
                continue
            own, size = [], len(head)
            for t in tuples[i : i + 4]:
                if size + len(t) + 1 > 100:
                    if own:
                        out.append(head + ",".join(own) + ";")
                    own, size = [], 0
                own.append(t)
                size += len(t) + 1
            out.append(head + ",".join(own) + ";")
    got = [r.text for r in D.multi_inserts(statement_rows(spark, rows), 4, 100, block=7).collect()]
    assert got == out


def test_publish_line_parts_and_headers(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(1, 11)], "line_no long, line string").repartition(3)
    K.write_line_parts(lines, f"file://{tmp_path}/parts", 4)
    assert {p.name: "".join(f.read_text() for f in sorted(p.glob("*.txt"))) for p in (tmp_path / "parts").glob("part=*")} == {f"part={k}": "".join(f"line {i}\n" for i in range(4 * k + 1, min(4 * k + 5, 11))) for k in range(3)}
    with pytest.raises(ValueError):
        K.publish(lines.select("line"), f"file://{tmp_path}/one", lambda df: (_ for _ in ()).throw(ValueError("checked")))
    assert not (tmp_path / "one").exists()
    K.publish(lines.select("line"), f"file://{tmp_path}/one")
    with pytest.raises(Exception, match="(?i)exist"):
        K.publish(lines.select("line"), f"file://{tmp_path}/one")
    assert K.markdown_header(["a|b", " "]) == ["| a\\|b | col2 |", "| --- | --- |"]
    assert K.create_table("a`b", [("x", "BIGINT"), ("y`", "TEXT")]) == "CREATE TABLE IF NOT EXISTS `a``b` (\n  `x` BIGINT NULL,\n  `y``` LONGTEXT NULL\n);"


def test_encoding_census(spark, tmp_path):
    for name, raw in {"a": "é".encode(), "b": b"\xef\xbb\xbfx", "c": "hello there".encode("utf-16-le"), "d": "привет мир".encode("cp1251"), "e": "né".encode("cp1252") + b" abc"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {(r.encoding, r.bom, r.guess): r.files for r in P.encoding_census(S.read_binary(spark, f"file://{tmp_path}")).collect()}
    assert got == {("UTF-8", False, False): 1, ("UTF-8", True, False): 1, ("UTF-16LE", False, True): 1, ("Windows-1251", False, True): 1, ("Windows-1252", False, True): 1}


# --- many files -------------------------------------------------------------------------------------------------------

FOLDER = {
    "a.sql": "insert into t values (1);\n(2);\n",
    "b.sql": "insert into u values (9);\n",
    "c.sql": "/* open ; comment\n" * 9 + "*/ insert into v values ('x;\n" + "y\n" * 40 + "z');\n-- it's\nselect 1; # don't; \nselect `a;\nb`",
    "d.sql": "",
    "e.sql": "select \"q\\\"; ;\";\n" * 25 + "unfinished 'text ;",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("many")
    for name, text in FOLDER.items():
        (path / name).write_text(text)
    return path


def by_file(rows, *columns):
    return sorted((r.file.rsplit("/", 1)[1], *(getattr(r, c) for c in columns)) for r in rows)


@pytest.mark.parametrize(("split", "fan"), [(None, 256), (23, 2)])
def test_a_folder_is_the_union_of_its_files(spark, folder, split, fan):
    columns = ("stmt_no", "start", "end", "text", "closed", "kind", "table")
    want = []
    for name in FOLDER:
        want += by_file(S.read_statements(spark, f"file://{folder}/{name}").collect(), *columns)
    with splits(spark, split):
        got = by_file(S.read_statements(spark, f"file://{folder}", fan=fan).collect(), *columns)
    assert got == sorted(want)
    assert [r[1:5] for r in got if r[0] == "a.sql"] == [(1, 0, 25, "insert into t values (1);"), (2, 26, 30, "(2);")]
    assert [r[4] for r in got if r[0] == "b.sql"] == ["insert into u values (9);"]
    for name, _, start, end, text, closed, *_ in got:
        assert not closed or FOLDER[name].encode()[start:end].decode() == text
    with splits(spark, split):
        lines = S.read_lines(spark, [f"file://{folder}/{n}" for n in ("a.sql", "c.sql")]).collect()
    want = [(n, i, at, x.decode()) for n in ("a.sql", "c.sql") for i, (at, x) in enumerate(cut_lines(FOLDER[n].encode()), 1)]
    assert by_file(lines, "line_no", "offset", "line") == sorted(want)


@pytest.mark.parametrize("split", [None, 13])
def test_records_of_a_folder(spark, tmp_path, split):
    rng = random.Random(3)
    want = []
    for name in ("x.csv", "y.csv", "z.csv"):
        data = [["".join(rng.choice(['"', ",", "\n", "a", "é", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))] for _ in range(30)]
        data = [r for r in data if r != [""]]
        with (tmp_path / name).open("w", newline="") as out:
            csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(data)
        want += [(name, r) for r in data]
    with splits(spark, split):
        got = S.read_records(spark, f"file://{tmp_path}", fan=2).orderBy("file", "record_no").collect()
    assert [(r.file.rsplit("/", 1)[1], r.fields) for r in got] == want


def test_states_compose_over_ten_thousand_splits(spark):
    rng = random.Random(1)
    rows, want = [], []
    for f, n in ((1, 10_000), (2, 700), (3, 1)):
        state, before = 0, 0
        for i in range(n):
            fn = [(rng.randrange(3), rng.randrange(4)) for _ in range(3)]
            rows.append((f, 17 * i, fn))
            want.append((f, 17 * i, state, before))
            state, before = fn[state][0], before + fn[state][1]
    table = spark.createDataFrame(rows, "f long, split long, fn array<struct<e:int,n:bigint>>").repartition(5)
    assert sorted(map(tuple, S.start_states(table, 3, 10_000, 16).collect())) == want


UNITS = ["a\r\nb\rc\nd\r", "", "﻿one\n上海Ċਊ\r\r\n\n\rx", "਀ഀA", "\n\n\n", "\u000aਊ਀\u000dഊ", "ends\r\n", "😀  long " * 9 + "\n", "\rੁ\r\n䄊\r\n"]


@pytest.mark.parametrize("encoding", ["UTF-16LE", "UTF-16BE"])
@pytest.mark.parametrize("split", [None, 3])
def test_lines_of_utf16(spark, tmp_path, encoding, split):
    want = []
    for i, text in enumerate(UNITS):
        (tmp_path / f"{i}.txt").write_bytes(text.encode(encoding))
        found = [m for m in re.finditer(r"([^\r\n]*)(\r\n|\r|\n|\Z)", text) if m.end() > m.start()]
        want += [(f"{i}.txt", n, len(text[: m.start()].encode(encoding)), m[1].removeprefix("﻿")) for n, m in enumerate(found, 1)]
    with splits(spark, split):
        got = S.read_lines(spark, f"file://{tmp_path}", encoding).collect()
    assert by_file(got, "line_no", "offset", "line") == sorted(want)


def test_utf16_anchors(spark, tmp_path):
    path = tmp_path / "u.txt"
    path.write_bytes("a\r\nb\r\nc\r\nd\r\n".encode("UTF-16LE"))
    with splits(spark, 3):
        lines = S.read_lines(spark, f"file://{path}", "utf-16le")
        assert [tuple(r) for r in N.anchors(lines, 2).orderBy("line_no").collect()] == [(1, 0), (3, 12)]
    for data, encoding in ((b"\0\n\0\r\0A", "UTF-16LE"), (b"\n\0\r\0A\0", "UTF-16BE")):
        path.write_bytes(data)
        assert [(r.line_no, r.offset) for r in S.read_lines(spark, f"file://{path}", encoding).collect()] == [(1, 0)]


# --- names and identities ---------------------------------------------------------------------------------------------


def brute_names(names, most=180):
    import unicodedata

    key = lambda s: unicodedata.normalize("NFC", s).casefold()
    used, out = {}, []
    for name in names:
        n = used[key(name)] = used.get(key(name), 0) + 1
        while n > 1:
            end = f"_{n:02d}"
            tried = name.encode()[: most - len(end)].decode(errors="ignore") + end
            if key(tried) not in used:
                used[key(tried)] = 1
                break
            n += 1
        out.append(name if n == 1 else tried)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "A", "a_02", "A_02", "a_02_02", "b_07", "b", "B_03", "é", "é", "É_02", "x" * 180, "X" * 180, "x" * 177 + "_02", "x" * 99 + "_0", "x" * 60, "X" * 60, "x" * 60 + "_02", "", "_02", "straße", "STRASSE", "c_1", "c_1"]
    names = [rng.choice(pool) for _ in range(120)] if seed else ["a", "A", "a_02"]
    got = D.unique_names(spark.createDataFrame(list(enumerate(names)), "i long, name string").repartition(4), "name", "i").orderBy("i").collect()
    assert [r.name for r in got] == brute_names(names)
    keys = spark.createDataFrame([tuple(r) for r in got], "i long, name string").select(E.portable_key(F.col("name")).alias("k"))
    assert keys.distinct().count() == len(names)
    assert D.unique_names(spark.createDataFrame([], "i long, name string"), "name", "i").count() == 0


def test_names_of_tables(spark):
    tables = ["Users", "users", "é", "é", "CON", "lpt1...   ", "a.b", "a/b", "a_b_02", "界" * 300, "界" * 300]
    rows = spark.createDataFrame(list(enumerate(tables)), "i long, t string")
    got = [r.name for r in D.unique_names(rows.withColumn("name", E.safe_file_name_full(F.col("t"))), "name", "i").orderBy("i").collect()]
    assert got[:9] == ["Users", "users_02", "é", "é_02", "_CON", "_lpt1", "a_b", "a_b_02", "a_b_02_02"]
    assert all(len(n.encode()) <= 180 for n in got) and got[9] != got[10] and "_" in got[9]


def ddl_rows(spark, *texts):
    return spark.createDataFrame([("create", "", "t", t) for t in texts], "kind string, database string, table string, text string")


@pytest.mark.parametrize(
    ("old", "new", "change", "added"),
    [
        ("(`id` int)", "(id int)", "unchanged", set()),
        ("(MixedCase int)", '("MixedCase" int)', "changed", {'"MixedCase"'}),
        ("(`Order` int)", "(Order int)", "changed", {"Order"}),
        ("(ID int)", "(id int)", "changed", {"id"}),
        ("(`key` int)", '("key" int)', "changed", {'"key"'}),
        ("(`order` int, a int)", "(`order` int, `a` int)", "unchanged", set()),
        ("(a int, PRIMARY KEY (`a`), KEY k (`a`))", "(a int, PRIMARY KEY (a), KEY `k` (a))", "unchanged", set()),
        ("(a int, PRIMARY KEY (`A`))", "(a int, PRIMARY KEY (A))", "changed", set()),
        ("(a varchar(9) DEFAULT '`x`')", "(a varchar(9) DEFAULT 'x')", "changed", set()),
    ],
)
def test_identity_of_quoted_names(spark, old, new, change, added):
    a, b = ddl_rows(spark, f"CREATE TABLE t {old};"), ddl_rows(spark, f"CREATE TABLE t {new};")
    assert X.diff_dumps(a, b).first().change == change
    found = X.diff_columns(X.column_rows(X.parse_tables(a)), X.column_rows(X.parse_tables(b)), ["database", "table"], "identity").collect()
    assert {r.identity for r in found if r.change == "added"} == added


# --- positioned ranges ------------------------------------------------------------------------------------------------


def test_a_sparse_file_is_cut_by_position(spark, tmp_path):
    path, target = tmp_path / "big.bin", tmp_path / "parts"
    size = 5 * (1 << 30) + 11
    with path.open("wb") as f:
        for at, raw in ((0, b"head\r\n\xff\xfe"), ((1 << 31) - 3, b"\r\nover a seam\xc3"), (size - 4, b"tail")):
            f.seek(at)
            f.write(raw)
    starts = [(0, 9 << 20), ((1 << 31) - (1 << 20), (1 << 31) + 1), ((1 << 31) + 1, (1 << 31) + 100), (size - 77, size)]
    ranges = spark.createDataFrame([(f"file:{path}", i, lo, hi) for i, (lo, hi) in enumerate(starts)], "path string, part long, start long, end long")
    manifest = R.copy_ranges(ranges, f"file://{target}")
    assert [(m["start"], m["end"]) for m in manifest] == starts
    assert sorted(p.name for p in target.iterdir() if not p.name.startswith(".")) == ["manifest.json", *(f"part-{i:05d}" for i in range(4))]
    with path.open("rb") as f:
        for m in manifest:
            f.seek(m["start"])
            own = f.read(m["bytes"])
            assert (target / f"part-{m['part']:05d}").read_bytes() == own and m["sha256"] == hashlib.sha256(own).hexdigest()
    found = R.find_in_files(spark, f"file://{path}", "tail", per_task=1 << 30).collect()
    assert [r.offset for r in found] == [size - 4]
    path.write_bytes(bytes(range(256)) * 5)
    got = R.split_by_size(spark, f"file://{path}", f"file://{tmp_path}/small", 500)
    assert b"".join((tmp_path / "small" / f"part-{m['part']:05d}").read_bytes() for m in got) == bytes(range(256)) * 5 and len(got) == 3
    with pytest.raises(FileExistsError):
        R.split_by_size(spark, f"file://{path}", f"file://{target}", 500)


def test_a_failing_copy_leaves_nothing(spark, tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(b"0123456789")
    ranges = lambda *rows: spark.createDataFrame([(f"file:{path}", *r) for r in rows], "path string, part long, start long, end long")
    for bad in (((0, 0, 6), (1, 5, 9)), ((0, 5, 11),), ((0, 4, 2),), ((0, 0, 2), (0, 2, 3)), ((0, -1, 2),)):
        with pytest.raises(ValueError):
            R.copy_ranges(ranges(*bad), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    with pytest.raises(Exception, match="ends before"):  # the second range fails in its task
        R_check, R.checked_ranges = R.checked_ranges, lambda ranges, sizes: ranges
        try:
            R.copy_ranges(ranges((0, 0, 3), (1, 8, 40)), f"file://{tmp_path}/out")
        finally:
            R.checked_ranges = R_check
    assert not (tmp_path / "out").exists()
    got = R.copy_ranges(ranges((1, 7, 10), (0, 2, 5)), f"file://{tmp_path}/out")
    assert [(tmp_path / "out" / f"part-{i:05d}").read_bytes() for i in range(2)] == [b"234", b"789"] and [m["bytes"] for m in got] == [3, 3]


def test_lines_are_exported_with_their_bytes(spark, tmp_path):
    raw = b"\xef\xbb\xbfone\r\ntwo\rthree\n\xff four\r\nfive"
    (tmp_path / "l.txt").write_bytes(raw)
    for i, (first, last, want) in enumerate([(2, 3, b"two\rthree\n"), (1, 1, b"\xef\xbb\xbfone\r\n"), (4, 99, b"\xff four\r\nfive")]):
        got = R.export_lines(spark, f"file://{tmp_path}/l.txt", f"file://{tmp_path}/o{i}", first, last, per_part=4)
        assert b"".join((tmp_path / f"o{i}" / f"part-{m['part']:05d}").read_bytes() for m in got) == want
    with pytest.raises(ValueError, match="fewer"):
        R.export_lines(spark, f"file://{tmp_path}/l.txt", f"file://{tmp_path}/o9", 6, 7)


@pytest.mark.parametrize(("per_task", "block"), [(1 << 20, 1 << 20), (7, 3), (1, 1), (5, 100)])
def test_matches_over_seams(spark, tmp_path, per_task, block):
    raw = "aaa Boundary b\nbound\r\nary café écafé Café_ boundarý boundary xaaaax ".encode() + b"\xff boundary \xffboundary " + b"A" * 40
    (tmp_path / "s.txt").write_bytes(raw)
    (tmp_path / "t.txt").write_bytes(b"boundary")
    (tmp_path / "none.txt").write_bytes(b"")
    cases = [("boundary", False, False), ("boundary", True, False), ("boundary", False, True), ("aa", False, False), ("d\r\na", False, False), ("café", False, True), ("aaaaa", True, False)]
    for text, fold, word in cases:
        want = []
        for name, data in (("s.txt", raw), ("t.txt", b"boundary")):
            low, n = (data.lower(), text.lower().encode()) if fold else (data, text.encode())
            for at in range(len(low)):
                if low[at : at + len(n)] != n:
                    continue
                before, behind = data[:at].decode(errors="surrogateescape")[-1:], data[at + len(n) :].decode(errors="surrogateescape")[:1]
                odd = lambda c: "\ud800" <= c <= "\udfff" or c == "_" or regex.match(r"[\p{L}\p{Nd}\p{M}]", c)
                if not word or not any(c and odd(c) for c in (before, behind)):
                    want.append((name, at, len(n)))
        got = R.find_in_files(spark, f"file://{tmp_path}", text, fold, word, per_task=per_task, block=block).collect()
        assert sorted((r.path.rsplit("/", 1)[1], r.offset, r.length) for r in got) == want, text


def test_utf16_matches_are_aligned(spark, tmp_path):
    (tmp_path / "u").write_bytes("aŁ䄀Aab ab".encode("UTF-16LE"))
    got = R.find_in_files(spark, f"file://{tmp_path}/u", "A", encoding="UTF-16LE", per_task=3, block=2).collect()
    assert [(r.offset, r.length) for r in got] == [(6, 2)]
    got = R.find_in_files(spark, f"file://{tmp_path}/u", "ab", whole_word=True, encoding="UTF-16LE").collect()
    assert [r.offset for r in got] == [14]


@pytest.mark.parametrize("block", [1, 5, 1 << 16])
def test_lines_through_an_index(spark, tmp_path, block):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree\n\nfive\r\n\r\r\nlast")
    (tmp_path / "b.txt").write_bytes(b"".join(b"line %d\n" % i for i in range(1, 3001)))
    lines = S.read_lines(spark, f"file://{tmp_path}").cache()
    index = N.anchors(lines, 3, ("file",))
    asked = lines.filter("line_no % 7 IN (0, 1, 3)").select("file", "line_no").unionByName(lines.select("file", F.lit(9999).cast("long").alias("line_no")).distinct())
    if block < 100:
        asked = asked.filter("file LIKE '%a.txt'")
    got = R.lines_at(asked, index, block)
    want = lines.join(asked, ["file", "line_no"])
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(map(tuple, want.select("file", "line_no", "offset", "line").collect()))
    if block == 5:
        assert got.agg(F.max("bytes_read")).first()[0] <= 25  # three lines at most, whatever the file's size
    lines.unpersist()
