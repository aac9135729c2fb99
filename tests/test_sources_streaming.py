from pyspark.sql import functions as F

from quill.sources import jsonl
from quill.streaming import rollup


def test_strict_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes('﻿{"a": 1, "t": "x y"}\r\n\n{"a": 1, "a": 2}\n{"a": NaN}\n{"a": '.encode())
    got = [(r["line"], r["error"] is None) for r in jsonl.scanned(spark, str(p)).orderBy("line").collect()]
    assert got == [(1, True), (3, False), (4, False), (5, False)]
    good = tmp_path / "b.jsonl"
    good.write_text('{"a": 1, "t": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in jsonl.records(spark, str(good), "a int, t string").orderBy("a").collect()] == [(1, "x"), (2, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "view", 1.5), (2, "2024-01-01 11:00:00", "view", 2.0), (3, "2024-01-02 00:00:00", "click", 1.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = rollup.daily(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    rollup.run_once(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    want = {tuple(r) for r in rollup.daily(rows).collect()}
    got = {(r["day"], r["event_type"], r["n"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and len(got) == 2
    assert {(r["user_id"], r["n"], r["refused"]) for r in rollup.tumbling(rows, "user_id", 3600, 0).collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 1)}


def test_lines_have_their_numbers_in_any_block(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("".join('{"a": %d}\n' % i + ("\n" if i % 7 == 0 else "") for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = {r["line"]: r["value"] for r in jsonl.scanned(spark, str(p)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = p.read_text().split("\n")
    assert got == {i + 1: x for i, x in enumerate(lines) if x}


def test_delimited_files(spark, tmp_path):
    import pytest

    from quill.sources.files import delimited, named, separator

    assert named(["a", "", "a", "a", "column_2"]) == ["a", "column_2", "a (2)", "a (3)", "column_2 (2)"]
    assert [separator(x) for x in (["a;b", "1;2"], ["a|b|c", "1|2|3"], ["one", "two"], ["a,b;c", "1,2;3,4"])] == [";", "|", ",", ";"]
    p = tmp_path / "x.csv"
    p.write_text("a;;a\n1;2;3\n4;5;6\n")
    assert [tuple(r) for r in delimited(spark, str(p)).collect()] == [("1", "2", "3"), ("4", "5", "6")] and delimited(spark, str(p)).columns == ["a", "column_2", "a (2)"]
    p.write_text("a;b\n1;2\n3;4;5\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited(spark, str(p), ";").collect()


def test_late_events_within_two_days_are_counted(spark, tmp_path):
    kinds = "user_id long, ts timestamp, event_type string, value double"
    row = lambda day, hour: (1, __import__("datetime").datetime(2024, 1, day, hour), "view", 1.0)
    source, out = str(tmp_path / "events"), str(tmp_path / "days")
    for rows in ([row(1, 1), row(2, 1), row(3, 1)], [row(4, 1), row(3, 5), row(1, 5)]):
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(source)
        sink = rollup.recomputing_days(spark, source, out)
        stream = spark.readStream.schema(kinds).parquet(source).writeStream.option("checkpointLocation", str(tmp_path / "mark"))
        stream.trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    assert {(r["day"].day, r["n"]) for r in spark.read.parquet(out).collect()} == {(2, 1), (3, 2), (4, 1)}
