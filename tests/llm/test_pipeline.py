"""The pipeline against its stages' plain Python versions, one after the other."""

import brute
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from quill.llm.packing import pack

    rows = brute.documents(8, 60)
    items = [(1, rows[4][1]), (2, "nothing of this is there")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    brute.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language_id"](spark, docs, d)
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    gone = {i for i, t, *_ in rows if i not in kept}
    assert {1, 2, 5000, 5004} <= gone and first.columns == docs.columns
    now = [(i, t, None, None) for i, t in kept.items()]
    second = stage["line_dedup"](spark, first, d)
    want = brute.lines(now)
    got = {r["doc_id"]: r["h"] for r in second.withColumn("h", F.sha2("text", 256)).collect()}
    assert all(want[i][2] == h for i, h in got.items()) and second.where("n_chars <> length(text)").count() == 0
    now = [(r["doc_id"], r["text"], None, None) for r in second.collect()]
    third = stage["jaccard_join"](spark, second, d)
    assert {r["doc_id"] for r in third.collect()} == {c for _, c in brute.components(now).values()}
    now = [(r["doc_id"], r["text"], None, None) for r in third.collect()]
    fourth = stage["decontamination"](spark, third, d)
    assert {r["doc_id"] for r in fourth.collect()} == {i for i, x in brute.leaks(now, items).items() if not x[1]}
    packed = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in fourth.collect()}
    assert packed.agg(F.sum("length")).first()[0] == pack(fourth).agg(F.sum("length")).first()[0]
