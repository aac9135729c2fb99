"""Distinct related rows and glossary contexts against plain versions that hold everything."""

import hashlib
import math
import random

from quill.operators import related as R


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(a, b):
    return 1 - lev(a, b) / max(len(a), len(b), 1)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def plain_related(rows, n):
    rows = [(k, p, at, name or "", set(t or [])) for k, p, at, name, t in rows]
    want = set()
    for k, p, at, name, terms in rows:
        if k % 3 or p is None:
            continue
        found = []
        for o in rows:
            like = jaccard(terms, o[4])
            if o[0] != k and o[1] == p and 0 < like <= 0.72 and o[3] not in name and name not in o[3] and names(o[3], name) < 0.8:
                near = None if at is None or o[2] is None else -abs(o[2] - at)
                found.append(((like, near is not None, near or 0, hashlib.sha256(str(o[0]).encode()).hexdigest()), o))
        chosen = []
        for _, o in sorted(found, reverse=True, key=lambda x: x[0]):
            if all(names(o[3], c[3]) < 0.8 and jaccard(o[4], c[4]) < 0.8 for c in chosen):
                chosen.append(o)
        if len(chosen) >= n:
            want |= {(k, i + 1, o[0]) for i, o in enumerate(chosen[:n])}
    return want


KIND = "key long, part string, place long, name string, terms array<string>"


def test_distinct_related(spark):
    rng, rows = random.Random(3), []
    for k in range(260):
        base = rng.choice(rows) if rows and rng.random() < 0.4 else None
        terms = list(base[4] or []) if base else rng.sample("abcdefghijklmnop", rng.randint(0, 7))
        if base and terms and rng.random() < 0.5:
            terms[0] = "z"
        name = (base[3] or "x") + "s" if base and rng.random() < 0.5 else "".join(rng.choices("klmno", k=rng.randint(2, 12)))
        rows.append((k, rng.choice(["u", "u", "v", None]), rng.choice([None, 1, 5, 9]), rng.choice([name] * 20 + [None]), rng.choice([sorted(set(terms))] * 8 + [None])))
    df = spark.createDataFrame(rows, KIND).withColumn("extra", R.F.lit(1))
    for n in (1, 3):
        got = {tuple(r) for r in R.distinct_related(df, R.F.col("key") % 3 == 0, "part", n).collect()}
        assert got == plain_related(rows, n) and len(got) > 20
    assert R.distinct_related(df.limit(0), R.F.col("key") % 3 == 0, "part").count() == 0


def plain_contexts(queries, corpus, glossary):
    table = {}
    for a, b in glossary:
        table.setdefault(a, set()).add(b)
        table.setdefault(b, set()).add(a)
    wide = lambda ts: set(ts) | {x for t in ts for x in table.get(t, ())}
    mean = sum(len(t or []) for _, _, t, _ in corpus) / len(corpus)
    want = set()
    for q, terms in queries:
        terms = wide(terms or [])
        searched = sorted(terms, key=lambda w: (-len(w), w))[:45]
        ranked = {}
        for key, part, ts, n in corpus:
            ts, score = ts or [], 0.0
            for t in set(searched) & set(ts):
                df = sum(t in (x[2] or []) for x in corpus)
                idf, f = math.log((len(corpus) - df + 0.5) / (df + 0.5)), ts.count(t)
                score += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / mean))
            if set(searched) & set(ts):
                ranked.setdefault(part, []).append((-round(score, 6), key, wide(ts), n))
        for part, found in ranked.items():
            kept, used = [], 0
            for _, key, ts, n in sorted(found, key=lambda x: x[:2])[:15]:
                shared = len(ts & terms)
                if shared < 3 or shared / len(terms) < 0.08 or len(kept) == 2 or kept and used + n > 5500:
                    continue
                kept.append((q, part, len(kept) + 1, key, shared))
                used += n
            want |= set(kept)
    return want


def test_glossary_contexts(spark):
    rng = random.Random(4)
    words = [c * (1 + i % 5) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [f"w{i}" for i in range(40)]
    glossary = [tuple(rng.sample(words, 2)) for _ in range(12)] + [("a", "a")]
    corpus = [(k, rng.choice(["u", "v", None]), rng.choices(words, k=rng.randint(1, 25)), rng.choice([200, 2700, 5000, 9000])) for k in range(120)] + [(900, "u", None, 0), (901, "v", [], 0)]
    queries = [(q, rng.choices(words, k=rng.choice([1, 4, 8, 60]))) for q in range(12)] + [(50, []), (51, None), (52, ["unknown"])]
    c = spark.createDataFrame(corpus, "key long, part string, terms array<string>, chars int")
    q = spark.createDataFrame(queries, "query_id long, terms array<string>")
    g = spark.createDataFrame(glossary, "a string, b string")
    got = {tuple(r)[:5] for r in R.glossary_contexts(q, c, g, "part").collect()}
    assert got == plain_contexts(queries, corpus, glossary) and {r[2] for r in got} == {1, 2}
    assert R.glossary_contexts(q, c, g.limit(0), "part").count() > 0 and R.glossary_contexts(q, c.limit(0), g, "part").count() == 0


def test_related_rows_of_blocks(spark, monkeypatch):
    """Many blocks, pieces of few places, groups of near copies that outnumber what a block gives; no row for a pair."""
    from quill.functions import nearest as N

    rng, rows = random.Random(8), []
    words = [f"w{i}" for i in range(60)]
    for k in range(240):
        base = rng.choice(rows) if rows and rng.random() < 0.5 else None
        terms = [t for t in base[4] if rng.random() < 0.97] if base else rng.sample(words, rng.randint(4, 30))
        rows.append((k, rng.choice("uv"), rng.choice([None, k]), "".join(rng.choices("klmnopq", k=rng.randint(3, 14))), terms))
    rows += [(300 + k, "u", k, "".join(rng.choices("abcdefgh", k=9)), words[:30]) for k in range(60)]
    rows += [(400 + k, "u", k, f"one site, page {k:03}", words[5:30]) for k in range(60)]
    for name, value in {"BITS": 64, "STRIP": 7, "CELLS": 200, "PLACES": 50, "CHARS": 90, "WAITING": 100}.items():
        monkeypatch.setattr(N, name, value)
    for name, value in {"NEAREST": 2, "SPREAD_TERMS": 1200}.items():
        monkeypatch.setattr(R, name, value)
    kept = []
    monkeypatch.setattr(R, "stored", lambda df, what, f=R.stored: (kept.append((what, f(df, what))), kept[-1][1])[1])
    df = spark.createDataFrame(rows, KIND)
    got = {tuple(r) for r in R.distinct_related(df, R.F.col("key") % 3 == 0, "part").collect()}
    assert got == plain_related(rows, 3) and len(got) > 150
    asked = sum(k % 3 == 0 for k, *_ in rows)
    assert len([w for w, _ in kept if w == "related-best"]) == 3
    assert all(t.count() <= 3 * asked for w, t in kept if w != "related-pool")


def test_edits_of_pairs():
    from quill.functions import nearest as N

    rng = random.Random(2)
    a, b = ([rng.choice(["", "é", "x" * 40, "".join(rng.choices("abcé😀", k=rng.randint(0, 12)))]) for _ in range(300)] for _ in range(2))
    assert N.edits(a, b).tolist() == [lev(x, y) for x, y in zip(a, b, strict=True)] and N.edits([], []).tolist() == []
    assert N.names_differ(a, b, 0.8).tolist() == [names(x, y) < 0.8 for x, y in zip(a, b, strict=True)]
