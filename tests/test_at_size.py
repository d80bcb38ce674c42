"""What shows only on larger tables: values beyond those of the small ones, and steps whose tasks must not grow with the input."""

import random
import re
import weakref
from pathlib import Path

import duckdb
import pyarrow as pa

import __spark_entry__
from textbench.operators import replace
from textbench.plans.file_queries import in_files
from textbench.sources import files
from textbench.sources.work import shared_folder


def told(spark, folder, name):
    """Sorted rows of a query, and of its SQL, over the tables of a folder."""
    con = duckdb.connect()
    for table in folder.iterdir():
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}/*.parquet')")
    df = __spark_entry__.queries()[name](spark, str(folder))
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    return sorted(tuple(r) for r in df.select(*columns).collect()), sorted(cursor.fetchall())


def test_sizes_beyond_a_tebibyte(spark, tmp_path):
    keys = [0, 3, 1 << 10, (1 << 20) - 1, 1 << 20, 9_000_000, 54_000_000]
    pairs = [(k, c) for k in keys for c in (1, 1023, 1 << 20, 5_400_000)]
    df = spark.createDataFrame(pairs, "o_orderkey long, o_custkey long")
    df.write.parquet(str(tmp_path / "orders.parquet"))
    ours, sql = told(spark, tmp_path, "format_bytes")
    assert ours == sql
    assert any(size.endswith("GiB") and float(size.split()[0]) > 1024 for _, size in ours)


def test_files_are_written_in_the_parts_they_are_read_in(spark, tmp_path):
    spark.range(40_000).repartition(9).write.parquet(str(tmp_path / "t.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "16m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        df = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert df.rdd.getNumPartitions() == 9
        assert "Exchange" not in in_files(df, 6)._jdf.queryExecution().executedPlan().toString()
        assert in_files(df, 12).rdd.getNumPartitions() == 12
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_utf16_lines_without_a_shuffle_by_split(spark, tmp_path):
    rng = random.Random(5)
    for encoding in ("UTF-16LE", "UTF-16BE"):
        (tmp_path / encoding).mkdir()
        for no in range(3):
            lines = ["".join(rng.choice("aਊ਀\u000bĊé\U0001f40a") for _ in range(rng.randrange(12))) for _ in range(150)]
            (tmp_path / encoding / f"{no}.txt").write_bytes("".join(x + rng.choice(["\n", "\r", "\r\n"]) for x in [*lines, "z"]).encode(encoding))
    settings = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for encoding in ("UTF-16LE", "UTF-16BE"):
            df = files.read_lines(spark, f"file://{tmp_path}/{encoding}", encoding)
            got = {}
            for r in df.orderBy("line_no").collect():
                got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.line)
            for no in range(3):
                text = (tmp_path / encoding / f"{no}.txt").read_bytes().decode(encoding)
                assert got[f"{no}.txt"] == re.split("\r\n|\r|\n", text)[:-1]
            # pieces of all lines meet once, by line; no shuffle and sort of whole splits before that
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "windowspecdefinition(f#" in plan and not re.search(r"windowspecdefinition\(f#\d+L, split#\d+L, rel", plan)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_folder_queries_write_a_file_for_each_part(spark, tmp_path):
    docs = spark.range(90).selectExpr("id AS doc_id", "concat('a', id, ',\"\\n') AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars")
    docs.repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    for k in before:
        spark.conf.set(k, "16777216b")
    try:
        for name, kind in (("records_folder_read", "records"), ("lines_folder_read", "lines"), ("dump_folder_read", "dump"), ("search_files", "search")):
            root = Path(shared_folder(spark).removeprefix("file://"))
            known = set(root.glob(f"textbench-{kind}-*"))
            assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() > 0
            (folder,) = set(root.glob(f"textbench-{kind}-*")) - known
            assert len(list(folder.glob("part-*"))) == 9
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_replaced_texts_become_arrow_slice_by_slice():
    class Text(str):
        pass

    live, most = weakref.WeakSet(), 0

    def one(t):
        nonlocal most
        out = Text(t + "x" * 10_000) if t else None
        if t:
            live.add(out)
        most = max(most, len(live))
        return out, 1

    texts = pa.array([f"{i}" if i % 3 else None for i in range(3000)])
    got = replace.by_slices(texts, one, ["text", "matches"])
    assert got.field("text").to_pylist() == [t and t + "x" * 10_000 for t in texts.to_pylist()] and len(got) == 3000
    assert most <= replace.SLICE_BYTES // 10_000 + 2
    assert len(replace.by_slices(texts[:0], one, ["text", "matches"])) == 0


def test_lines_are_placed_without_dealing_out_texts(spark, tmp_path):
    rng = random.Random(8)
    texts = [None if i % 17 == 3 else rng.choice(["\n", "\nx"]).join("é" * rng.randrange(90) for _ in range(rng.randrange(40))) for i in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("offset_to_line", "line_anchors", "line_to_offset"):
        ours, sql = told(spark, tmp_path, name)
        assert ours == sql, name
    from textbench.plans.sink_queries import _offsets

    plan = _offsets(lambda name: spark.read.parquet(str(tmp_path / f"{name}.parquet")), spark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange[^\n]*\n[^\n]*Project[^\n]*\b(text|line|lines)#", plan) and plan.count("Exchange hashpartitioning") == 2
