"""Column functions on the cases that are easy to get wrong."""

from pyspark.sql import functions as F

from quill.functions import text as T
from quill.functions import values as V
from quill.operators import corpus as C
from quill.operators import retrieval as R
from quill.sources.flatten import leaves


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_guarded_cast(spark):
    df = spark.createDataFrame([("1.5",), ("-1",), ("1e3",), ("",), (None,), ("07",)], "t string")
    assert [float(r[0]) for r in df.select(V.guarded_decimal(F.col("t"))).collect()] == [1.5, 0, 0, 0, 0, 7]


def test_tokens_keep_code(spark):
    found = one(spark, T.tokens(F.lit("FOR UPDATE SKIP_LOCKED và C++ /api/v1")))
    assert {"skip_locked", "c++", "/api/v1"} <= set(found)


def test_grading(spark):
    s = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, V.same_choice(s("b", "a"), s("a", "b")))
    assert not one(spark, V.same_choice(s("a"), s("a", "b")))
    assert not one(spark, V.same_choice(s("a", "a"), s("a")))


def test_boxes(spark):
    box = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, V.iou(box(0, 0, 2, 2), box(0, 0, 2, 2))) == 1
    assert one(spark, V.iou(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0
    assert one(spark, V.iou(box(0, 0, 0, 1), box(0, 0, 1, 1))) is None


def test_error_rates(spark):
    assert abs(one(spark, T.cer(F.lit("abc"), F.lit("adc"))) - 1 / 3) < 1e-9
    assert abs(one(spark, T.wer(F.lit("a b c"), F.lit("a x c"))) - 1 / 3) < 1e-9
    assert one(spark, T.cer(F.lit(""), F.lit("a"))) is None
    assert one(spark, T.cer(F.lit("abc"), F.lit(None).cast("string"))) == 1


def test_answers_keep_marks(spark):
    assert one(spark, T.answer_key(F.lit("  HÀ   NỘI "))) == "hà nội"
    assert one(spark, T.unaccented(F.lit("Hà Nội Đà"))) == "ha noi da"


def test_balance_and_bits(spark):
    assert [one(spark, T.brace_balance(F.lit(x))) for x in ("{a}{b}", "{{a}", "}a{")] == [0, 1, -1]
    assert one(spark, V.hamming(F.lit("ffffffffffffffff"), F.lit("fffffffffffffff0"))) == 4


def test_shingles(spark):
    assert one(spark, T.word_shingles(F.split(F.lit("a b c d"), " "), 3)) == ["a b c", "b c d"]
    assert one(spark, T.word_shingles(F.split(F.lit("a b"), " "), 3)) == []
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0)) == 1


def test_leaves():
    assert leaves('{"a.b": 1, "a": {"b": 2.50}, "o": [{"t": "x", "c": true}], "s": [1, 2], "đ": {"é_1": null}, "e": {}}') == [('["a.b"]', "1"), ("a.b", "2.50"), ("o[0].t", "x"), ("o[0].c", "true"), ("s", "[1, 2]"), ("đ.é_1", None), ("e", "{}")]
    assert leaves("7") == [("value", "7")] and leaves('[{"a": [1.10]}]') == [("value[0].a", "[1.10]")]


def test_chunks_cover_text():
    text = "One sentence here. " * 300
    cuts = R.cut_chunks(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b[0] <= a[1] and a[1] - a[0] <= 1200 for a, b in zip(cuts, cuts[1:]))


def test_canonical_span(spark):
    assert one(spark, R.canonical_span(F.lit("It says: “The  QUICK brown fox” here"), F.lit("the quick Brown fox"))) == [10, 30]


def test_components(spark):
    nodes, edges = spark.range(1, 9).withColumnRenamed("id", "k"), spark.createDataFrame([(1, 2), (3, 2), (5, 6), (6, 7), (7, 8)], "a long, b long")
    assert {r[0]: r[1] for r in C.smallest_reachable(nodes, edges, "k").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5}


def test_span_of_whole_words():
    from quill.operators.retrieval import span_of

    source = "Embedding là “vector số” biểu diễn ý nghĩa.\nHai văn bản gần nhau."
    a, b = span_of(source, 'embedding là "vector số"  biểu diễn ý nghĩa')
    assert source[a:b] == "Embedding là “vector số” biểu diễn ý nghĩa"
    assert span_of("bathe quick foxes", "the quick fox") is None and span_of("a b", "a b") is None
    assert span_of("An inter­esting ﬁnd indeed", "interesting find") == (3, 21) or span_of("An interesting ﬁnd", "inter-\n esting find") == (3, 18)


def test_windows_are_slices_of_the_source():
    from quill.operators.retrieval import sentence_windows

    text = "The first sentence is here. And a second…  Short. The fourth one is long enough\nThe fifth follows on a line"
    found = sentence_windows(text)
    assert all(text[a:b].strip() == w and 20 <= len(w) <= 600 for a, b, w in found)
    assert "The first sentence is here. And a second…" in [w for *_, w in found] and len(found) == len(set(found))


def test_vector_blocks(spark, monkeypatch):
    import numpy as np

    from quill.operators import retrieval

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    q = spark.createDataFrame(rows[::3], "query_id int, vector array<double>")
    c = spark.createDataFrame(rows, "chunk_id int, vector array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    for first in (True, False):
        got = sorted(tuple(r) for r in retrieval.vector_top(q, c, 5, 1.0, first).select("query_id", "rank", "chunk_id", "score").collect())
        want = []
        for i, v in rows[::3]:
            every = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows)
            every = [x for x in every if -x[0] >= 1.0] if first else every
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(every[:5]) if -s >= 1.0]
        assert got == sorted(want)
