"""Texts with nearly the same shingles: pairs, links and what they move."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quill.catalog import QUERIES
from quill.functions import shingles as S
from quill.operators import similar as N

DIR = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall("[a-z]+", (text or "").lower())
    return frozenset(zip(w, w[1:], w[2:], strict=False))


def brute(texts, threshold):
    """rep of each, and the similar pairs of those that stand for others."""
    held = {k: shingles(t) for k, t in texts.items()}
    rep = {k: min(j for j in held if held[j] == held[k]) if held[k] else k for k in held}
    firsts = sorted(k for k in held if held[k] and rep[k] == k)
    like = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in itertools.combinations(firsts, 2)}
    return rep, {p: x for p, x in like.items() if x >= threshold}


def reached(nodes, edges):
    owner = {k: k for k in nodes}

    def root(k):
        while owner[k] != k:
            k = owner[k]
        return k

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        owner[y] = x
    return {k: root(k) for k in nodes}


@pytest.fixture(scope="module")
def texts():
    """Odd texts, and families of near copies that are larger than a cell, one of them chained."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    made = [None, "", " ", "one two", "ONE two three", "one, two; three!", "Kelvin a b c", "kelvin A B C", "x\x00y z", "İa b c d"]
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            made.append(" ".join(own) + rng.choice(["", ".", "\n"]))
    walk = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(40):
        walk[rng.randrange(len(walk))] = rng.choice(vocabulary)
        made.append("  ".join(walk).upper())
    made += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))) for _ in range(60)]
    rng.shuffle(made)
    return {7 * k - 50: t for k, t in enumerate(made)}


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_pairs_are_whole(spark, texts, threshold, monkeypatch):
    monkeypatch.setattr(N, "CELL", 8)
    members, pairs = N.near_texts(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", F.col("t"), threshold)
    rep, like = brute(texts, threshold)
    assert {r["k"]: r["rep"] for r in members.collect()} == rep and len(set(rep.values())) < len(rep)
    got = [(r["a"], r["b"], r["similarity"]) for r in pairs.collect()]
    assert sorted(got) == sorted((a, b, x) for (a, b), x in like.items()) and len(got) > 100


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_links_connect_the_same_texts_in_fewer_rows(spark, texts, threshold):
    _, links = N.near_texts(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", F.col("t"), threshold, links=True)
    rep, like = brute(texts, threshold)
    got = [(r["a"], r["b"]) for r in links.collect()]
    nodes = set(rep.values())
    assert reached(nodes, got) == reached(nodes, like) and len(got) < len(like)


def test_no_texts(spark):
    for links in (False, True):
        members, pairs = N.near_texts(spark.createDataFrame([], "k long, t string"), "k", F.col("t"), 0.85, links=links)
        assert not members.collect() and not pairs.collect()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["set_near_dup_components", "join_near_dup_pairs"])
def test_no_row_is_moved_for_each_shingle(spark, name):
    def written():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    QUERIES[name][0](spark, DIR).collect()
    assert 0 < written() - before < 4 * os.path.getsize(f"{DIR}/documents.parquet")


def test_words_and_sets_of_flat_bytes(monkeypatch):
    rows = ["", "a", "ab cdéef", "x" * 5000 + " y", "the cat the cat the cat the", "no", "z a b", "ab cd ef"]
    column = pa.array([t + " " for t in rows])
    whole = S.words(column)
    monkeypatch.setattr(S, "STEP_BYTES", 4)
    hashes, counts = S.words(column)
    want = [re.findall("[a-z]+", t) for t in rows]
    assert counts.tolist() == [len(w) for w in want] and (hashes == whole[0]).all()
    known = dict(zip(itertools.chain(*want), hashes.tolist(), strict=True))
    assert hashes.tolist() == [known[w] for w in itertools.chain(*want)] and len(set(known.values())) == len(known)
    row, item, _ = S.sets(hashes, counts, 3)
    assert np.bincount(row, minlength=len(rows)).tolist() == [len(shingles(t)) for t in rows]
    assert len(set(item.tolist())) == len(set().union(*map(shingles, rows)))


def test_sketches_never_part_sets_by_more_than_they_differ():
    rng = np.random.default_rng(3)
    pool = S.mixed(np.arange(1, 4000, dtype=np.uint64))
    held = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 3, 64, 65, 70, 300, 2000, 2049)]
    held += [np.sort(x[rng.random(len(x)) < 0.9]) for x in held]
    size = np.array([len(x) for x in held])
    sketch = S.sketches(np.repeat(np.arange(len(held)), size), np.concatenate(held), size)
    for i, j in itertools.combinations(range(len(held)), 2):
        differ = len(np.setxor1d(held[i], held[j]))
        bits = S.apart(sketch.slice(i, 1), sketch.slice(j, 1))[0]
        assert bits <= differ and (bits - differ) % 2 == 0
    assert S.apart(sketch.slice(6, 1), sketch.slice(7, 1))[0] > 500
    both = S.overlaps([x.view(np.int64) for x in held])
    assert all(both[i, j] == len(np.intersect1d(held[i], held[j])) for i, j in itertools.permutations(range(len(held)), 2))
