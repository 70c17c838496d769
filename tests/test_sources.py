import pytest
from pyspark.sql import functions as F

from tabularium.plans import adhoc, wizard
from tabularium.session import scratch_path
from tabularium.sources import files, readers, sinks
from tabularium.streaming import run


def test_header_line(spark):
    lines = ["Report", "", "made 2024", "id,name,amount", "1,a,2.5", "2,b,3.5", "3,c,4.5"]
    assert files.header_line(spark, lines) == (3, ["id", "name", "amount"])
    assert files.header_line(spark, ["id,name", "1,a", "2,b"])[0] == 0
    assert files.header_line(spark, [""])[0] == 0 and files.header_line(spark, ["", ""])[0] == 0
    assert files.header_line(spark, ['"a, b",c', "1,2"]) == (0, ["a, b", "c"])


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('made 2024\nid,note\n1,"two\nlines"\n2,one\n')
    rows = files.read_csv_with_preamble(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines"), ("2", "one")]
    with pytest.raises(Exception, match="quoted line break"):
        files.read_csv_with_preamble(spark, str(tmp_path / "a.csv")).collect()


def test_raw_load(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Sales export\n\nid , name,Unnamed: 2,note\n1,"x, y",,ok\n2,,,\n3,z,, \ntotal,,,\n')
    df = files.load_raw(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["id", "name", "note"]
    assert [tuple(r) for r in df.collect()] == [("1", "x, y", "ok"), ("2", None, None), ("3", "z", None), ("total", None, None)]


def test_many_files_keep_all_rows(spark):
    path = scratch_path(spark, "many")
    lines = spark.range(1000).select(F.concat_ws(",", F.col("id").cast("string"), F.lit("v")).alias("value")).repartition(6)
    spark.createDataFrame([("junk",), ("id,v",)], "value string").coalesce(1).union(lines).write.text(path)
    assert files.read_csv_with_preamble(spark, path).select("id").distinct().count() == 1000


def test_json_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": 1, "rows": [{"x": 1}, {"x": 2}]}\n{"meta": 2, "rows": [{"x": 3}]}\n')
    assert sorted(r["x"] for r in files.read_json_rows(spark, str(tmp_path / "a.json")).collect()) == [1, 2, 3]
    (tmp_path / "b.json").write_text('[{"x": 5}, {"x": 6}]')
    assert files.read_json_rows(spark, str(tmp_path / "b.json"), multi_line=True).count() == 2


def test_capped(spark):
    kept = files.capped(spark.range(25).repartition(4), [F.desc("id")], 10).collect()
    assert [tuple(r) for r in kept] == [(24 - i, 25, 10, True) for i in range(10)]
    assert not files.capped(spark.range(5), ["id"], 10).first()["truncated"]


def test_list_tables(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "b.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "note.txt").write_text("x")
    assert files.list_tables(spark, str(tmp_path)) == ["a", "b"]


def test_magic_bytes(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "bad.csv").write_bytes(b"a\x00b")
    (tmp_path / "late.csv").write_bytes(b"12345678\x00")
    (tmp_path / "book.xlsx").write_bytes(bytes.fromhex("504B0304") + b"rest")
    (tmp_path / "old.xls").write_bytes(bytes.fromhex("D0CF11E0"))
    (tmp_path / "fake.xlsx").write_bytes(b"no zip")
    got = {r["path"].rsplit("/", 1)[-1]: r["looks_safe"] for r in files.content_kinds(spark, str(tmp_path)).collect()}
    assert got == {"good.csv": True, "bad.csv": False, "late.csv": True, "book.xlsx": True, "old.xls": True, "fake.xlsx": False}


def test_reader_names(spark):
    with pytest.raises(ValueError):
        readers.read(spark, "carrier pigeon")


def test_upsert_and_log(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, at int")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(old, new, ["k"], "at").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    path = scratch_path(spark, "log")
    run.append_log(old, path)
    run.append_log(new, path)
    assert spark.read.parquet(path).count() == 4


def test_adhoc(spark):
    df = spark.range(120).select("id", (F.col("id") % 3).cast("string").alias("k"))
    good = adhoc.run_sql(df, "SELECT * FROM dataset")
    assert tuple(good.facts(50).first()) == (120, True) and good.rows(50).count() == 50
    assert tuple(good.facts().first()) == (120, False) and good.rows().count() == 120
    left = adhoc.run_plan(df, [(str(i), "SELECT 1") for i in range(3)], most_questions=2).collect()
    assert [r["error"] for r in sorted(left)] == [None, None, "not run: beyond 2 questions"]
    assert "UNRESOLVED" in adhoc.run_sql(df, "SELECT nope FROM dataset").error
    assert adhoc.run_sql(df, "DROP TABLE dataset").error


def test_wizard(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0), (3, 7.0)], "k int, x double")
    w = wizard.Wizard(df)
    assert w.preview("null_values").filter("x is null").count() == 0
    assert w.current.filter("x is null").count() == 2  # a preview changes nothing
    w.apply("null_values", {"x": "Fill with 0", "gone": "Fill with 0"})
    w.apply("duplicates", {"strategy": "Keep first"})
    assert w.current.count() == 3
    w.apply("null_values", {"x": "Drop rows"})  # redoing a step drops the later ones
    assert [h[0] for h in w.history] == ["initial", "null_values"] and w.current.count() == 2
    step = w.lineage(copies=True).first()
    assert (step["mode"], step["decisions"], step["rows_before"], step["rows_after"], step["copies_before"]) == ("manual", "x: Drop rows", 4, 2, 1)
    w.finalize(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_reads_a_file_or_a_folder(spark, tables, tmp_path):
    from tabularium.tables import Tables
    tables.events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    folder = Tables(spark, str(tmp_path))
    n = tables.events.count()
    assert run.drain(run.table_stream(tables, "events"), "one").count() == n
    assert run.drain(run.table_stream(folder, "events", batch_bytes=1), "many").count() == n
