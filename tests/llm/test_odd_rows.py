"""Null and repeated ids, repeated rows, blank and very long texts, clashing columns and empty tables, for every operator on texts."""

import random

import pytest
from pyspark.sql import functions as F

_rng = random.Random(3)
A = " ".join(_rng.choice(["tea", "rain", "stone", "river", "light", "seven", "glass"]) + str(_rng.randrange(50)) for _ in range(60))
B = "An entirely different text of its own, with a few words more."
#: Beyond what one vectorised step works on, with A at its end.
LONG = " ".join(f"w{_rng.randrange(10**6)}" for _ in range(320_000)) + " " + A
ROWS = [(1, A), (1, A), (1, B), (None, A), (None, None), (2, ""), (3, LONG), (4, "  \n\n "), (5, A), (6, None)]
CLASH = "lang_pred score spans votes posterior quality keep n_lines n_dropped n_shingles component_id d v n ids kept start length".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src", "en" if i == 1 else None) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


def by_row(rows, *names):
    """(doc_id, length of text) -> the set of what rows of it got."""
    out = {}
    for r in rows:
        out.setdefault((r["doc_id"], r["size"]), set()).add(tuple(r[n] for n in names))
    return out


def size():
    return F.length(F.coalesce("text", F.lit(""))).alias("size")


def test_lines(docs):
    from quill.llm.lines import line_dedup

    got = sorted((r["doc_id"] or 99, r["n_lines"], r["n_dropped"]) for r in line_dedup(docs).collect())
    assert got == sorted([(1, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 3, 0), (5, 1, 1), (6, 1, 0), (99, 1, 1), (99, 1, 0)])


def test_languages(docs):
    from quill.llm.language import language_id

    got = by_row(language_id(docs).select("doc_id", size(), "lang_pred").collect(), "lang_pred")
    assert all(len(x) == 1 for x in got.values()) and got[1, len(A)] == {("en",)} and got[None, 0] == got[2, 0] == got[4, 5] == {("und",)}
    assert language_id(docs.limit(0)).count() == 0


def test_repeats(docs):
    from quill.llm.repeats import without_repeats

    got = sorted((r["doc_id"] or 99, r["n_bytes"], r["n_removed"]) for r in without_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect())
    a, b, long = len(A), len(B), len(LONG)
    assert got == sorted([(1, a, 0), (1, a, 0), (1, b, 0), (2, 0, 0), (3, long, a), (4, 5, 0), (5, a, a), (6, 0, 0), (99, a, a), (99, 0, 0)])


def test_quality(docs):
    from quill.llm.quality import quality

    got = by_row(quality(docs).select("doc_id", size(), "votes", "posterior", "quality", "keep").collect(), "votes", "posterior", "quality", "keep")
    assert all(len(x) == 1 for x in got.values()) and got[1, len(A)] == got[None, len(A)] == got[5, len(A)]
    assert quality(docs.limit(0)).count() == 0


def test_packing(docs):
    from quill.llm.packing import pack

    pieces = pack(docs).select("doc_id", "length", "doc_tokens", "sequence_id", "offset").collect()
    assert sum(r["length"] for r in pieces) == sum({(r["sequence_id"], r["offset"]): r["length"] for r in pieces}.values())
    assert sorted({r["doc_tokens"] for r in pieces if r["doc_id"] in (2, 6)}) == [1]
    assert max(r["sequence_id"] for r in pieces) == (sum(r["length"] for r in pieces) - 1) // 4096


def test_similar(docs):
    from quill.llm.jaccard import similar_documents

    got = sorted((r["doc_id"] or 99, r["n_shingles"] > 0, r["component_id"]) for r in similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted([(1, True, 1)] * 3 + [(2, False, 2), (3, True, 3), (4, False, 4), (5, True, 1), (6, False, 6)] + [(99, True, 1)] * 2)


def test_warc(spark):
    from quill.llm.warc import warc_round_trip

    page = "<p>" + "x" * 2000 + "</p>"
    rows = [(1, "u", page), (1, "u", page), (2, None, page), (None, "w", page), (3, "u", None), (4, "u", ""), (5, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id bigint, url string, html string, record_type string, payload_bytes int")
    got = sorted((r["page_id"] or 99, r["record_type"], r["refers_to"], r["payload_bytes"], r["intact"]) for r in warc_round_trip(pages).collect())
    assert got == sorted([(1, "revisit", 2, 2007, True)] * 2 + [(2, "response", None, 2007, True), (99, "response", None, 2007, True), (3, "response", None, 0, True), (4, "response", None, 0, True), (5, "response", None, 3_000_000, True)], key=lambda r: r[:2])
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_stages_of_the_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs.limit(0), docs.where(F.length("text") < 10_000).unionByName(docs.where("text is null"))):
        kept = rows.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, str(tmp_path))
            assert out.columns == kept.columns, name
            kept = spark.createDataFrame(out.collect(), kept.schema)
        # rows of one doc_id are one document: they stay or go together
        assert sorted(r["doc_id"] for r in kept.collect()) == ([1, 1, 1] if kept.count() else [])
        assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() >= kept.count()
