"""Work that queries used to repeat, or moved with rows that did not need it."""

import os
import random

import pytest

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@tables
def test_chunks_of_a_search_are_cut_once(spark):
    from quill.plans.retrieval import _hybrid

    ranked, chunks = _hybrid(spark, DIR)
    for df in (ranked, chunks):
        assert "documents.parquet" not in df._jdf.queryExecution().executedPlan().toString()


@tables
def test_pictures_are_made_of_what_is_alike(spark, monkeypatch):
    from quill.plans import release

    seen, looks = {}, release._looks
    monkeypatch.setattr(release, "_looks", lambda rows, key: (seen.update({key: rows.count()}), looks(rows, key))[1])
    release.PLANS["join_near_protected"][0](spark, DIR).count()
    assert seen["doc_id"] < 0.8 * (spark.read.parquet(f"{DIR}/documents.parquet").count() + spark.read.parquet(f"{DIR}/benchmark.parquet").count())


def test_exam_lines_are_not_scanned_with_their_texts(spark, monkeypatch):
    from quill.operators import states as S

    seen, scan = [], S.scan_states
    monkeypatch.setattr(S, "scan_states", lambda df, *a, **b: (seen.extend(df.columns), scan(df, *a, **b))[1])
    lines = spark.createDataFrame([("s", k, x) for k, x in enumerate(["Which?", "A. one", "B. two", "ANSWER: B"])], "src string, n int, line string")
    got = S.exam_items(lines, ["n"], ["src"]).collect()
    assert "line" not in seen and [(r["status"], r["prompt"]) for r in got] == [("candidate", "Which?")]


def test_small_groups_are_batched_together(spark):
    """One call for many groups; blocks go on over Arrow batches."""
    from quill.operators import budgets as B

    rng = random.Random(8)
    rows = [(g, k, rng.randrange(9)) for g in [None, *range(40)] for k in range(rng.choice([1, 2, 30]))]
    want = {}
    for g in [None, *range(40)]:
        held, batch = 0, -1
        for _, k, n in (r for r in rows if r[0] == g):
            held, batch = (held + n, batch) if batch >= 0 and held + n <= 12 else (n, batch + 1)
            want[g, k] = batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = B.greedy_batches(spark.createDataFrame(rows, "g long, k long, n long"), ["k"], {"n": 12}, ["g"], block=8)
        plan = made._jdf.queryExecution().toString()
        got = {(r["g"], r["k"]): r["batch"] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and "FlatMapGroupsInArrow" not in plan and hasattr(B, "_over_blocks")
