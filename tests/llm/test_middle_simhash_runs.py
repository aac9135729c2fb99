"""Fill-in-middle, SimHash and periodic runs: the queries against plain versions, odd rows, long texts and every size of block."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from brute import LOW
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
CLASH = "n form prefix_chars middle_chars output restored fingerprint component_id runs collapsed d v f start length period best".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts():
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("ab é😀<PSM>\n") for _ in range(rng.choice([0, 1, 2, 255, 256, 257, 600])))) for i in range(60)]
    base = [rng.choice(["tea", "Rain", "stone", "über"]) + str(rng.randrange(40)) for _ in range(90)]
    rows += [(100 + i, " ".join(base[:k] + ["new"] * (i % 3) + base[k:])) for i, k in enumerate(range(0, 90, 3))]
    rows += [(200 + i, "x y  z\t" * rng.randrange(40) + " ".join(base[: rng.randrange(60)]) + " q" * rng.randrange(50)) for i in range(60)]
    return rows + [(300, None), (301, " \n"), (302, "One"), (303, "one TWO"), (304, "a<S>b"), (305, base[0]), (306, " ".join(base)), (307, " ".join(base))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    return where


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, equal rows, blank texts, columns of the names that the operators give."""
    t = "one two three four five six seven eight " * 4
    long = " ".join(f"w{k % 7}" for k in range(9000)) + " " + "y" * 3_000_000 + " " + " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, t), (1, t), (1, "other words here"), (None, t), (None, None), (2, ""), (3, long), (4, " \n "), (5, t)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(3), long


def middle(i, text, units):
    n = len(units)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if out[1] == "S" else "psm", len(p), len(m), out, text


@pytest.mark.parametrize("unit,run", [(None, 256), (None, 1), (r"[a-z]+\s*", 3)])
def test_middle_by_units(spark, folder, unit, run):
    from quill.llm.fim import fill_in_middle

    got = fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"), unit, run=run).collect()
    for r in got:
        text = dict(texts())[r["doc_id"]] or ""
        units = list(text) if unit is None else [m.group() for m in re.finditer(unit + "|.", text, re.S)]
        assert tuple(r[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output", "restored")) == middle(r["doc_id"], text, units)
    assert len(got) == len(texts()) and {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middle_query_and_sql(spark, folder):
    from quill.llm.oracles import OP11
    from quill.llm.queries import op11_fim

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = op11_fim(spark, folder)
    want = con.sql(OP11)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_middle_of_odd_rows(odd):
    from quill.llm.fim import fill_in_middle

    docs, long = odd
    got = fill_in_middle(docs).select("doc_id", "text", "n", "form", "output", "restored", "start").collect()
    assert len(got) == docs.count() and {r["start"] for r in got} == {"clash"}
    for r in got:
        assert (r["n"], r["form"], r["output"], r["restored"]) == tuple(middle(r["doc_id"], r["text"] or "", list(r["text"] or ""))[k] for k in (0, 1, 4, 5))
    assert fill_in_middle(docs.limit(0)).count() == 0


def fingerprint(text):
    w = words((text or "").translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, distance=3):
    prints = {i: fingerprint(t) for i, t in rows}
    parts = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if i < j and (prints[i] ^ prints[j]).bit_count() <= distance:
                low, high = sorted((parts[i], parts[j]))
                parts = {k: low if c == high else c for k, c in parts.items()}
    return {i: (f"{prints[i]:016x}", parts[i]) for i in prints}


def test_simhash_query(spark, folder):
    from quill.llm.queries import op12_simhash

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op12_simhash(spark, folder).collect()}
    assert got == near(texts()) and len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("distance,blocks,large", [(3, 6, 2), (3, 4, 1), (2, 5, 3), (5, 8, 2), (0, 4, 512)])
def test_links_connect_what_near_pairs_connect(spark, distance, blocks, large):
    """Dense clusters, in groups of every size: pairs, and links to the smallest near value, connect the same fingerprints."""
    from quill.llm.jaccard import components
    from quill.llm.simhash import near_links

    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for base in list(prints)[:4]:
        for _ in range(60):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(0, 64, 5), rng.randrange(6))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ids = sorted(signed(x) for x in prints)
    parts = {x: x for x in ids}
    for x in ids:
        for y in ids:
            if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= distance:
                low, high = sorted((parts[x], parts[y]))
                parts = {k: low if c == high else c for k, c in parts.items()}
    links = near_links(spark.createDataFrame([(x, x) for x in ids], "f bigint, d bigint"), distance, blocks, large)
    pairs = links.collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= distance for r in pairs)
    found = {r["d"]: r["c"] for r in components(links).collect()}
    assert {x: found.get(x, x) for x in ids} == parts


def test_simhash_of_odd_rows(odd):
    from quill.llm.simhash import near_duplicates

    docs, long = odd
    got = near_duplicates(docs).select("doc_id", "text", "fingerprint", "component_id", "start").collect()
    assert len(got) == docs.count() and {r["start"] for r in got} == {"clash"}
    assert all(r["fingerprint"] == f"{fingerprint(r['text']):016x}" for r in got)
    assert sorted(((r["doc_id"] or 99), r["component_id"]) for r in got if (r["text"] or "").startswith("one two")) == [(1, 1), (1, 1), (5, 1), (99, 1)]
    assert sorted(((r["doc_id"] or 99), r["component_id"]) for r in got if not words(r["text"])) == [(2, 2), (4, 2), (99, 2)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_votes_of_a_long_text_in_blocks():
    from quill.llm.simhash import _long_votes, _votes

    text = ("ab cd e  f\ngh " * 400 + "z" * 500 + " x y").encode()
    data = np.frombuffer(text, np.uint8)
    whole = _votes(data, np.array([0, len(data)]), 3)
    for most in (5, 64, 1000, 1 << 20):
        s, t = _long_votes(data, 3, most)
        assert (s == whole[0]).all() and (t == whole[1]).all()


def plain_runs(w, least=24, periods=3):
    found = set()
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if size >= max(least, periods * p) and not any(all(w[k] == w[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                found.add((i, size, p))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    from quill.llm.runs import runs

    rng = random.Random(3)
    for _ in range(600):
        n, k = rng.randrange(1, 60), rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            p, a = rng.randrange(1, 8), rng.randrange(n)
            w = w[:a] + [w[min(a + (i - a) % p, n - 1)] for i in range(a, n)]
        for least, periods in ((2, 2), (6, 3), (24, 3)):
            assert sorted(runs(np.array(w), least, periods), key=lambda r: (r[0], r[2])) == plain_runs(w, least, periods)


def test_comparisons_grow_with_the_words():
    """At most three comparisons of letters a position, on words made to provoke more."""
    from quill.llm.runs import lyndon

    fibonacci, ruler, rng = [[0], [0, 1]], [0], random.Random(1)
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for c in range(1, 14):
        ruler = [*ruler, c, *ruler]
    block = [rng.randrange(9) for _ in range(2000)]
    for w in ([0] * 20_000, [0, 1] * 10_000, fibonacci[-1], ruler, [i.bit_count() & 1 for i in range(20_000)], block * 10, ([0] * 99 + [1]) * 200, sum(([0] * k + [1] for k in range(200)), []), [rng.randrange(2) for _ in range(20_000)]):
        for order in (np.array(w) + 1, max(w) + 1 - np.array(w)):
            told = []
            lyndon([*order.tolist(), 0], told)
            assert told[0] <= 3.1 * len(w)


def test_runs_query(spark, folder):
    from quill.llm.queries import op13_runs

    got = {r["doc_id"]: tuple(r)[1:] for r in op13_runs(spark, folder).collect()}
    planted = 0
    for i, text in texts():
        w, h = words(text), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
            planted += 1
        found = plain_runs(w)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), i
    assert planted and sum(x[0] > 0 for x in got.values()) > 20


def test_runs_of_odd_rows(odd):
    from quill.llm.runs import periodic_runs

    docs, long = odd
    got = periodic_runs(docs).select("doc_id", "text", "runs", "collapsed", "start").collect()
    assert len(got) == docs.count() and {r["start"] for r in got} == {"clash"}
    for r in got:
        found = [tuple(x) for x in r["runs"]]
        assert found == ([(0, 9000, 7)] if r["text"] == long else plain_runs(words(r["text"])))
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        assert r["collapsed"] == " ".join(x for k, x in enumerate(words(r["text"])) if k not in gone)
    assert periodic_runs(docs.limit(0)).count() == 0
