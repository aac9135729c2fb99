"""Proximity matches against every run of words, and odd rows of the exact ones."""

import re

from pyspark.sql import functions as F


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def matches(docs, items, window, slack, missing):
    """(doc, item, words of the window) -> the most terms in a run, by trying them all."""
    found = {}
    for i, t in items:
        own = words(t)
        for s in range(max(1, len(own) - window + 1)) if own else ():
            cut = own[s : s + window]
            terms = set(cut)
            if len(terms) <= missing + 1:
                continue
            for d, text in docs:
                all_ = words(text)
                best = max((len(terms & set(all_[k : k + window + slack])) for k in range(len(all_))), default=0)
                if best >= len(terms) - missing:
                    found[d, i, " ".join(cut)] = best
    return found


def test_proximity(spark):
    from quill.llm.leaks import SLACK, Index, proximity_matches, windows_of

    item = "the quick brown fox jumps over a lazy dog while seven wizards box with care"
    docs = [
        (1, item.upper()),
        (2, "x y the quick red brown fox jumps over one lazy dog while z"),
        (3, "dog lazy a over jumps fox brown quick the while seven"),
        (4, "the quick brown fox " + "filler " * 20 + "jumps over a lazy dog while seven wizards"),
        (5, None),
        (6, "nothing of it"),
        (7, "the " * 50 + "seven wizards box with care while a lazy dog"),
    ]
    items = [(1, item), (2, "two words"), (3, None), (4, "seven wizards box with much care")]
    d, b = spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "item_id int, text string")
    names = {r["w"]: " ".join(r["words"]) for r in windows_of(b).collect()}
    got = {(r["d"], r["item_id"], names[r["w"]]): r["n_terms"] for r in proximity_matches(Index(d, b, slack=SLACK)).collect()}
    assert got == matches(docs, items, 10, 4, 2) and {k[0] for k in got} >= {1, 2, 3}


def test_odd_rows(spark):
    from quill.llm.leaks import decontaminate

    passage = "one two three four five six seven eight nine ten"
    rows = [(1, passage), (1, passage), (1, "other text"), (None, passage), (None, None), (2, ""), (3, "w " * 300000 + passage)]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id bigint, text string, items string, n_hit int")
    bench = spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id int, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate(docs, bench, slack=4).collect())
    assert got == [(0, 0, 0, [], False), (0, 10, 10, [1], True), (1, 2, 0, [], False), (1, 10, 10, [1], True), (1, 10, 10, [1], True), (2, 0, 0, [], False), (3, 300010, 10, [1], True)]
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where(F.col("contaminated")).count() == 0


def test_words(spark):
    from quill.llm.leaks import words_of

    texts = [None, "", " ", "Ab\x00cD9_É\x7fÉx İ", "K Kk ", "[A]^`{z|", "É", "A" * 70000 + " \x1f" + "Z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2)
    assert {r["i"]: r["w"] for r in rows.select("i", words_of(F.col("text")).alias("w")).collect()} == {i: words(t) for i, t in enumerate(texts)}
