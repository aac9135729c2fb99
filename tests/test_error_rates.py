"""Error rates of whole texts against the reference's plain edit distance."""

import unicodedata

import pytest


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        now = [i]
        for j, b in enumerate(y, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = now
    return row[-1]


def plain(t):
    return " ".join(unicodedata.normalize("NFC", t or "").split())


REFERENCES = {1: "học máy " * 30 + "the end", 2: "đề thi số một", 3: "a b\u00a0c  d", 4: " ", 5: "no prediction at all", 6: "x" * 300 + " tail 😀", 7: "e\u0301t\u00e9"}
PREDICTIONS = {1: "học máy " * 30 + "one end more", 2: "đê thì sỗ mốt", 3: "a b c e", 4: "something", 6: "x" * 300 + " tall 😁 " + "y z " * 200, 7: "\u00e9te\u0301", 8: "no item"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rates"))
    spark.createDataFrame(list(REFERENCES.items()), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(list(PREDICTIONS.items()), "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_whole_texts_by_pair_and_pooled(spark, folder):
    from quill.catalog import QUERIES

    want = {}
    for i, t in REFERENCES.items():
        r, p = plain(t), plain(PREDICTIONS.get(i))
        n, words = len(r), len(r.split())
        want[i] = (n, distance(r, p) if r else 0, words, distance(r.split(), p.split()) if r else 0)
    got = {r["item_id"]: r for r in QUERIES["agg_error_rates_by_pair"][0](spark, folder).collect()}
    assert {i: tuple(r[c] for c in ("n_chars", "char_edits", "n_words", "word_edits")) for i, r in got.items()} == want
    assert got[4]["cer"] is None and got[4]["wer"] is None and got[5]["doc_id"] is None and got[5]["cer"] == 1
    assert got[1]["cer"] == want[1][1] / want[1][0] > 0 and got[2]["cer"] > 0
    chars, edits, words, word_edits = (sum(w[k] for w in want.values()) for k in range(4))
    pooled = QUERIES["agg_error_rates"][0](spark, folder).collect()[0]
    assert (pooled["pairs"], pooled["n_chars"], pooled["char_edits"], pooled["n_words"], pooled["word_edits"]) == (7, chars, edits, words, word_edits)
    assert pooled["cer"] == edits / chars and pooled["wer"] == word_edits / words
    some = [w for w in want.values() if w[0]]
    assert abs(pooled["macro_cer"] - sum(w[1] / w[0] for w in some) / len(some)) < 1e-12
