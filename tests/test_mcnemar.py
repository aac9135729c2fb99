"""McNemar's exact p over all labelled documents, and for counts where a quadratic tail would not end."""

import math

import pytest
from pyspark.sql import functions as F

from quill.functions.values import mcnemar


def exact(b, c):
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n) if n else 1.0


def test_tail(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (0, 7), (3, 9), (9, 3), (5, 5), (30, 12), (400, 350)]
    got = spark.createDataFrame(pairs, "b bigint, c bigint").select("b", "c", mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert {(r["b"], r["c"]): pytest.approx(r["p"], rel=1e-9) for r in got} == {x: exact(*x) for x in pairs}


def test_large_tail(spark):
    # the normal value with continuity correction is right to some 1e-6 here
    b, c = 151000, 150000
    got = spark.createDataFrame([(b, c)], "b bigint, c bigint").select(mcnemar(F.col("b"), F.col("c")).alias("p")).first()["p"]
    assert abs(got - math.erfc((b - c - 1) / math.sqrt(2 * (b + c)))) < 1e-5


def test_all_labelled_documents_count(spark, tmp_path):
    from quill.catalog import QUERIES

    rows = [(i, 3000 if i % 3 == 0 else 10) for i in range(1, 60)]
    labels = [(i, i % 2) for i, _ in rows]
    spark.createDataFrame(rows, "doc_id bigint, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    b = sum(q == 1 and n <= 2000 for (_, n), (_, q) in zip(rows, labels, strict=True))
    c = sum(q == 0 and n > 2000 for (_, n), (_, q) in zip(rows, labels, strict=True))
    got = QUERIES["agg_mcnemar_all"][0](spark, str(tmp_path)).first()
    assert (got["b"], got["c"], got["p"]) == (b, c, round(exact(b, c), 9))
