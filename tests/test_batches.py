"""Python functions over Arrow batches see a slice of texts at a time."""

import pyarrow as pa

from quill.functions import batches as B


def test_slices_bound_what_is_held(spark):
    from pyspark.sql import functions as F


    column = pa.array([f"t{k}" if k % 7 else None for k in range(1000)])
    got = B.by_slices(lambda t: t and t.upper(), pa.string(), column)
    assert got.to_pylist() == [t and t.upper() for t in column.to_pylist()] and B.by_slices(str, pa.string(), column.slice(0, 0)).to_pylist() == []
    df = spark.range(1000).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("a,"), (F.col("id") % 5).cast("int"))).alias("t")).coalesce(1)
    rows = B.exploded(df, ["id"], F.col("t"), lambda t: list(enumerate((t or "").split(",")[:-1])), "place int, part string")
    assert rows.count() == sum(k % 5 for k in range(1000)) and {(r["place"], r["part"]) for r in rows.collect()} == {(k, "a") for k in range(4)}


def test_scores_of_few_queries_are_held(monkeypatch, spark):
    """All queries of a block against a whole batch made one matrix."""
    import numpy as np

    from quill.operators import retrieval as R

    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).round(3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "chunk_id long, vector array<double>").coalesce(1)
    got = R.vector_top(df.where("chunk_id < 200").withColumnRenamed("chunk_id", "query_id"), df, 3)
    want = {(q, int(c)) for q in range(200) for c in R._best(np.round(vectors @ vectors[q], 6), np.arange(300), 3)}
    assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == want and R.STRIP < 200
