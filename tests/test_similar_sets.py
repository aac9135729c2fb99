"""Similarity joins over sets of hashes."""

import random

from quill.operators import corpus as C


def test_sets_are_made_once_and_pairs_are_whole(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(5), []
    for k in range(120):
        base = rng.choice(rows)[1] if rows and rng.random() < 0.6 else [rng.randrange(400) for _ in range(rng.choice([0, 1, 20, 40]))]
        rows.append((k, list({*base[rng.randrange(3) :], *([rng.randrange(400)] if rng.random() < 0.4 else [])})))
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    sets = spark.createDataFrame(rows, "k long, items array<long>").mapInArrow(counted, "k long, items array<long>")
    alone, members = C.representatives(sets, "k")
    got = {(r["a"], r["b"]): r["similarity"] for r in C.similar_sets(alone, "k", 0.85).collect()}
    rep = {r["k"]: r["rep"] for r in members.collect()}
    assert made.value == len(rows)
    held = {k: frozenset(x) for k, x in rows}
    assert rep == {k: min(j for j in held if held[j] == held[k]) if held[k] else k for k in held}
    firsts = sorted({r for k, r in rep.items() if held[k]})
    like = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a in firsts for b in firsts if a < b}
    assert got == {p: x for p, x in like.items() if x >= 0.85} and len(got) > 5
    assert {r["k"] for r in alone.select(F.col("k")).collect()} == {k for k, r in rep.items() if k == r}


def test_prefix_of_a_size_whose_product_is_not_exact(spark):
    """0.56 * 25 is 14.000000000000002 in floating point: a prefix was one item too short."""
    rows = [(1, list(range(25))), (2, list(range(14)))]
    got = C.similar_sets(spark.createDataFrame(rows, "k long, items array<long>"), "k", 0.56).collect()
    assert [(r["a"], r["b"], r["similarity"]) for r in got] == [(1, 2, 0.56)]
