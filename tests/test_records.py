import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from textbench.functions import exprs as E
from textbench.operators import records as R


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("1", "alice", "30"), ("2", "bob", "17"), ("3", "carol", "40"), ("4", None, "x")], "id string, name string, age string")


def test_numeric_filter(people):
    assert {r.id for r in R.filter_rows(people, "age", "gt", "18").collect()} == {"1", "3", "4"}
    assert {r.id for r in R.filter_rows(people, "age", "lt", "1d").collect()} == {"2"}  # not a number: bytes are compared


def test_negate_and_blank(spark):
    df = spark.createDataFrame([("1", "active"), ("2", "banned"), ("3", "active"), ("4", None), ("5", "  ")], "id string, status string")
    assert {r.id for r in R.filter_rows(df, "status", "eq", "banned", negate=True).collect()} == {"1", "3", "4", "5"}
    assert {r.id for r in R.filter_rows(df, "status", "empty").collect()} == {"4", "5"}


def test_ragged_dedupe(spark):
    data = [(10, ["red", "round", "7"]), (20, ["blue"]), (30, ["green", ""]), (40, ["grey", "round"]), (50, []), (60, ["white", "", "x"])]
    df = spark.createDataFrame(data, "record_no long, fields array<string>")
    assert {r.record_no for r in R.dedupe_fields(df, "record_no", 1).collect()} == {10, 20, 30, 50}
    nul = spark.createDataFrame([(1, ["x\0", "y"]), (2, ["x", "\0y"])], "record_no long, fields array<string>")
    assert R.dedupe_fields(nul, "record_no").count() == 2
    assert R.dedupe_fields(nul, "record_no", 7).count() == 2


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "n long, k string")
    once = R.dedupe(df, ["k"], ["n"])
    assert sorted(rows(once)) == sorted(rows(R.dedupe(once, ["k"], ["n"]))) == [(1, "a"), (2, "b"), (4, "c")]


def test_projection(spark):
    df = spark.createDataFrame([(1, ["1", "Ada", "London"]), (2, ["2"])], "n long, fields array<string>")
    assert [r.fields for r in R.project_fields(df, [2, 0], "-").orderBy("n").collect()] == [["London", "1"], ["-", "2"]]
    with pytest.raises(Exception, match="too short"):
        R.project_fields(df, [2]).collect()
    assert [r.fields for r in R.add_field(df, 2, "X").orderBy("n").collect()] == [["1", "Ada", "X", "London"], ["2", "", "X"]]
    with pytest.raises(ValueError):
        R.project(df, ["n", "n"])


def test_names():
    assert R.normalised_names(["id", "", "id"]) == ["id", "column_2", "id_2"]
    assert R.normalised_names(["a", "a_2", "A"]) == ["a", "a_2", "A_3"]


def test_masks(spark):
    df = spark.createDataFrame([("Alice@x.com",), ("nobody",), ("@x",), ("",), (None,), ("a@b@c",)], "m string")
    assert [r[0] for r in df.select(R.mask(F.col("m"), "email")).collect()] == ["A***@x.com", "n***", "@***", "", "", "a***@c"]
    key = b"k" * 40
    want = hmac.new(key, "Ä-1".encode(), hashlib.sha256).hexdigest()[:32]
    assert spark.createDataFrame([("Ä-1",)], "m string").select(R.mask(F.col("m"), "hash", key=key)).first()[0] == want
    got = R.mask_summary(df, {"m": "fixed"}).first()
    assert (got.records_read, got.cells_masked) == (6, 6)


def test_numbers_and_sizes(spark):
    values = ["007", "0", "-0", "1d", "0x1p3", " 12 ", "1e3", "inf", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(E.number(F.col("v"))).collect()] == [7.0, 0.0, -0.0, None, None, 12.0, 1000.0, float("inf"), None, None]
    sizes = spark.createDataFrame([(v,) for v in ("12", "1.5K", "2 MiB", "3gb", "0.5B", "x", "-1")], "v string")
    assert [r[0] for r in sizes.select(E.parse_byte_size(F.col("v"))).collect()] == [12, 1536, 2 << 20, 3 << 30, 1, None, None]
    ofs = spark.createDataFrame([("50%",), ("200%",), ("1k",)], "v string")
    assert [r[0] for r in ofs.select(E.parse_offset(F.col("v"), F.lit(999).cast("long"))).collect()] == [500, 999, 999]


def test_literals(spark):
    df = spark.createDataFrame([("O'Neil",), ("C:\\x",), ("é",)], "v string")
    assert [r[0] for r in df.select(E.sql_literal(F.col("v"))).collect()] == ["'O''Neil'", "CONVERT(X'433A5C78' USING utf8mb4)", "CONVERT(X'C3A9' USING utf8mb4)"]
    bad = spark.createDataFrame([("a\x01",)], "v string")
    assert bad.select(E.sql_literal(F.col("v"), "skip")).first()[0] is None
    with pytest.raises(Exception, match="control"):
        bad.select(E.sql_literal(F.col("v"))).collect()
    long = "x" * 300
    name = spark.createDataFrame([(long,), ("e\u0301/b",), ("con",)], "v string").select(E.safe_file_name_full(F.col("v"))).collect()
    assert len(name[0][0].encode()) <= 180 and name[1][0] == "é_b" and name[2][0] == "_con"


def test_bounded_prefix(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 31)], "n long, t string").repartition(4)
    size = F.octet_length("t")
    for rows, most in ((5, 1000), (30, 1000), (10, 20), (3, 0), (40, 465)):
        got = [tuple(r) for r in R.bounded_prefix(df, "n", size, rows, most).orderBy("n").collect()]
        want = [i for i in range(1, 31) if i <= rows and i * (i + 1) // 2 <= most]
        assert got == [(i, "x" * i, len(want) < 30) for i in want]


def test_refuse_many_keys(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 50)
    assert R.refuse_many_keys(df, ["k"], 60).count() == 1000
    with pytest.raises(ValueError):
        R.refuse_many_keys(df, ["k", "id"], 60)
