"""Weighted fields, paragraphs and change capture on rows of their own."""

import math
from collections import Counter

from quill.operators import fields as S
from quill.streaming.changes import Watch, capturing, changes


def test_weighted_fields(spark):
    docs = [(1, "a", ["tide", "moon"], ["sea", "moon", "moon"]), (2, "a", ["sea"], ["tide"] * 4), (3, "b", [], ["moon", "rock"]), (4, None, None, ["sea", "salt"]), (5, "b", [], []), (6, "a", ["stone"], ["sand"])]
    queries = [(1, ["moon", "tide", "moon"]), (2, ["sea"]), (3, []), (4, ["unknown"])]
    weights = {"head": 3.0, "body": 1.0}
    sizes = {i: len(h or []) + len(b) for i, _, h, b in docs}
    mean, want = sum(sizes.values()) / len(docs), {}
    for q, terms in queries:
        for i, part, h, b in docs:
            score = 0.0
            for t in terms:
                df = sum(t in (x[2] or []) + x[3] for x in docs)
                f = 3.0 * Counter(h or [])[t] + Counter(b)[t]
                idf = math.log((len(docs) - df + 0.5) / (df + 0.5))
                score += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) if f else 0
            if any(t in (h or []) + b for t in terms):
                want.setdefault((q, part), []).append((-round(score, 6), i))
    want = {(q, p, i, n + 1) for (q, p), found in want.items() for n, (_, i) in enumerate(sorted(found)[:2])}
    d = spark.createDataFrame(docs, "chunk_id int, part string, head array<string>, body array<string>")
    q = spark.createDataFrame(queries, "query_id int, terms array<string>")
    got = {(r["query_id"], r["part"], r["chunk_id"], r["rank"]) for r in S.weighted_top(q, d, weights, 2, ("part",)).collect()}
    assert got == want and len(got) > 4
    assert S.weighted_top(q, d.limit(0), weights, 2).count() == 0 and S.weighted_top(q.limit(0), d, weights, 2).count() == 0
    assert max(r["rank"] for r in S.weighted_top(q, d.withColumn("chunk_id", d.chunk_id), weights, 1000).collect()) <= S.MOST


def test_query_words(spark):
    row = spark.createDataFrame([("A to É1 x " + "Wort " * 40,), (None,)], "t string").select(S.query_words(S.F.col("t")).alias("w")).collect()
    assert row[0]["w"] == ["to", "é1"] + ["wort"] * 28 and row[1]["w"] == []


def plain_paragraphs(text):
    found, open_, at = [], None, 0
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    for line in lines:
        body = line.strip("\t\n\x0b\x0c\r ")
        if not body or body.isascii() and body.isdigit():
            open_ = None
        elif open_ is None or line.lstrip("\t\n\x0b\x0c\r ")[:2] in ("- ", "* ", "• "):
            open_ = [at, at + len(line)]
            found.append(open_)
        else:
            open_[1] = at + len(line)
        at += len(line)
    return [(a, b, text[a:b]) for a, b in found]


def test_paragraphs(spark):
    texts = ["one\ntwo\n\nthree", "", None, "  \n 12 \nx", "- a\n- b\nc\n\n\n* d\n7\ne 7\n", "é𝄞\n𝄞\n\nz", "\n\n", "-a\n •  b\r\n\r\nlast", "x" * 100_000 + "\n" + "y\n" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in sorted(S.paragraphs(docs, "id", "text").collect(), key=lambda r: (r["id"], r["place"])):
        assert r["place"] == len(got[r["id"]])
        got[r["id"]].append((r["start"], r["stop"], r["paragraph"]))
    assert got == {i: plain_paragraphs(t) if t else [] for i, t in enumerate(texts)}


WATCHES = [Watch("NEW"), Watch("READY", "state", ("ready",)), Watch("MARKED", "mark", from_null=True), Watch("STATE", "state")]
KIND = "key string, n int, state string, mark int"
VERSIONS = [("a", 1, "draft", None), ("a", 2, "ready", None), ("a", 3, "ready", 5), ("b", 1, None, 1), ("b", 4, "ready", 2), ("a", 6, None, 5), (None, 1, "x", None), (None, 2, "y", None), ("c", 9, "ready", 1), ("a", 7, "ready", None), ("a", 8, "ready", 1)]


def test_changes(spark):
    got = {(r["key"], r["n"], r["event"], r["old_value"], r["new_value"]) for r in changes(spark.createDataFrame(VERSIONS, KIND), "key", ["n"], WATCHES).collect()}
    assert got == {
        ("a", 1, "NEW", None, None), ("b", 1, "NEW", None, None), ("c", 9, "NEW", None, None), (None, 1, "NEW", None, None),
        ("a", 2, "READY", "draft", "ready"), ("a", 2, "STATE", "draft", "ready"), ("a", 3, "MARKED", None, "5"), ("b", 4, "READY", None, "ready"), ("b", 4, "STATE", None, "ready"),
        ("a", 6, "STATE", "ready", None), (None, 2, "STATE", "x", "y"), ("a", 7, "READY", None, "ready"), ("a", 7, "STATE", None, "ready"), ("a", 8, "MARKED", None, "1"),
    }


def test_stream_of_changes_equals_batch_after_restarts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sink = capturing(out, "key", ["n"], WATCHES)
    done = []

    def failing(batch, n):
        sink(batch, n)
        if n == 1 and not done:  # all is written, but the stream never learns of it
            done.append(n)
            raise RuntimeError("lost")

    for part in (VERSIONS[:4], VERSIONS[4:7], VERSIONS[7:9], VERSIONS[9:]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            stream = spark.readStream.schema(KIND).parquet(source).writeStream.option("checkpointLocation", str(tmp_path / "mark"))
            query = stream.trigger(availableNow=True).foreachBatch(failing).start()
            try:
                query.awaitTermination()
                break
            except Exception:
                assert done
    assert done
    row = lambda r: (r["key"], r["n"], r["event"], r["old_value"], r["new_value"])
    got = sorted(map(row, spark.read.parquet(f"{out}/events").collect()), key=repr)
    want = sorted(map(row, changes(spark.createDataFrame(VERSIONS, KIND), "key", ["n"], WATCHES).collect()), key=repr)
    assert got == want
