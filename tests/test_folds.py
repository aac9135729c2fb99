"""Budgets, resamples, holdouts, state scans and trees against plain Python, with groups that span blocks and partitions."""

import hashlib
import random

import pytest


@pytest.mark.parametrize("block", [4, 4096])
def test_greedy_batches(spark, block):
    from quill.operators.budgets import greedy_batches

    rng = random.Random(1)
    rows = []
    for g, n in (("a", 30), ("b", 1), (None, 13), ("c", 70)):
        for i in range(n):
            items = [f"n{rng.randrange(12)}" for _ in range(rng.randrange(4))]
            rows.append((g, i, rng.choice([None, 0, 1, 5, 30, 400]), rng.randrange(4), [(x, 14 + int(x[1:])) for x in items]))
    df = spark.createDataFrame(rows, "g string, i long, s long, q long, it array<struct<name:string,bytes:bigint>>").repartition(7)
    want = {}
    for group in {r[0] for r in rows}:
        held, batch = None, 0
        for g, i, s, q, items in rows:
            if g != group:
                continue
            grown = held and [held[0] + (s or 0), held[1] + q, held[2] + 1, held[3] | dict(items)]
            if held and (grown[0] > 220 or grown[1] > 9 or grown[2] > 6 or sum(grown[3].values()) > 60):
                batch, grown = batch + 1, None
            held = grown or [s or 0, q, 1, dict(items)]
            want[g, i] = batch
    got = greedy_batches(df, ["i"], {"s": 220, "q": 9}, ["g"], 6, {"it": 60}, block).collect()
    assert {(r["g"], r["i"]): r["batch"] for r in got} == want and len(got) == len(rows)


def test_one_group_over_many_blocks(spark):
    """A path of several hundred steps, each of which depends on the one before, and rows beyond the budget."""
    from quill.operators.budgets import greedy_batches

    rng = random.Random(2)
    sizes = [rng.choice([1, 2, 3, 50]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, s long").repartition(9)
    want, held, batch = [], 0, -1
    for s in sizes:
        if batch < 0 or held + s > 7:
            held, batch = 0, batch + 1
        held += s
        want.append(batch)
    got = greedy_batches(df, ["i"], {"s": 7}, block=16)
    assert [r["batch"] for r in got.orderBy("i").collect()] == want and want[-1] > 200
    assert greedy_batches(df.limit(0), ["i"], {"s": 7}).count() == 0


def test_lines_that_are_too_long_part_the_pieces(spark):
    from quill.operators.budgets import lines_of, pieces_of

    docs = spark.createDataFrame([(1, "aa\nbb\n" + "x" * 30 + "\ncc\nAA\nbb\n"), (2, None), (3, "one\n\n two \nthree")], "id int, t string")
    pieces = pieces_of(lines_of(docs, "id", "t", 8), "id", 8)
    assert sorted((r["id"], r["seg"], r["piece"], r["text"]) for r in pieces.collect()) == [(1, 0, 0, "aa\nbb"), (1, 1, 0, "cc\nAA"), (1, 1, 1, "bb"), (3, 0, 0, "one"), (3, 0, 1, "two"), (3, 0, 2, "three")]


def test_cluster_interval(spark):
    from quill.operators.resample import cluster_interval

    rng = random.Random(4)
    rows = [(c, rng.random() if rng.random() < 0.9 else None) for c in [*"abcdefg", None] for _ in range(rng.randrange(1, 9))]
    units = {}
    for c, x in rows:
        if x is not None:
            units.setdefault(c, []).append(x)
    ordered = [units[c] for c in sorted(units, key=lambda c: (c is not None, c))]
    draw = lambda r, k: ordered[int(hashlib.md5(f"42|{r}|{k}".encode()).hexdigest()[:8], 16) % len(ordered)]
    means = []
    for r in range(200):
        drawn = [draw(r, k + 1) for k in range(len(ordered))]
        means.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
    means.sort()
    got = cluster_interval(spark.createDataFrame(rows, "c string, x double").repartition(4), "c", "x", replicates=200).first()
    assert got["clusters"] == len(ordered)
    assert (got["low"], got["high"]) == (pytest.approx(means[4]), pytest.approx(means[194]))


def test_sizes_that_add_up():
    from quill.operators.resample import wanted_sizes

    rng = random.Random(5)
    for _ in range(400):
        sizes = [rng.choice([1, 2, 3, 7, 12, 60, 500]) for _ in range(rng.randrange(12))]
        target = rng.randrange(1, 80)
        limit, reach = max(2 * target, target + 50), {0}
        for s in sizes:
            reach |= {r + s for r in reach if r + s <= limit}
        best = min(reach - {0}, key=lambda n: (abs(n - target), n > target), default=min(sizes, default=0))
        counts = {s: sizes.count(s) for s in sizes}
        taken = wanted_sizes(counts, target)
        assert sum(s * n for s, n in taken.items()) == best and all(0 < n <= counts[s] for s, n in taken.items())


def test_held_out_groups(spark):
    from quill.operators.resample import held_out_groups

    rows = [(g,) for g, n in (("a", 5), ("b", 9), ("c", 5), ("d", 40), (None, 2)) for _ in range(n)]
    got = {r["g"]: (r["size"], r["held_out"]) for r in held_out_groups(spark.createDataFrame(rows, "g string").repartition(3), "g", 12).collect()}
    assert {g: n for g, (n, _) in got.items()} == {"a": 5, "b": 9, "c": 5, "d": 40, None: 2}
    assert sum(n for n, held in got.values() if held) == 12


def test_states_over_blocks(spark):
    from quill.operators.states import scan_states

    rng = random.Random(6)
    moves = [[rng.randrange(5) for _ in range(5)] for _ in range(3)]
    rows = [(g, i, rng.randrange(3)) for g, n in (("a", 157), (None, 20), ("b", 1)) for i in range(n)]
    want = {}
    for group in ("a", None, "b"):
        state = 2
        for g, i, s in rows:
            if g == group:
                want[g, i] = (state, moves[s][state])
                state = moves[s][state]
    df = spark.createDataFrame(rows, "g string, i long, s int").repartition(6)
    for block in (3, 64):
        got = scan_states(df, ["i"], "s", moves, 2, ["g"], block).collect()
        assert {(r["g"], r["i"]): (r["before"], r["after"]) for r in got} == want


def test_exam_items(spark):
    from quill.operators.states import exam_items

    pages = [
        (1, "Which is it?\nstill the question\nA. one\nB) two\ngoes on"),
        (2, "C. three\nANSWER: B, C\nNo options here\nANSWER: A\nStem\nA. x\nC. y\nANSWER: A"),
        (3, "Stem\nA. x\nB. y\nANSWER: D\nStem\nA. x\nB. y\nANSWER: see below\n\nlast\nA. no key"),
    ]
    lines = [(p, i, t) for p, text in pages for i, t in enumerate(text.split("\n"))]
    got = exam_items(spark.createDataFrame(lines, "page int, i int, line string").repartition(4), ["page", "i"], [], block=3).orderBy("item").collect()
    assert [(r["item"], r["status"], r["reason"]) for r in got] == [(0, "candidate", None), (1, "quarantine", "nonsequential_or_missing_option_labels"), (2, "quarantine", "nonsequential_or_missing_option_labels"), (3, "quarantine", "answer_key_label_missing"), (4, "quarantine", "unsupported_answer_key_format")]
    assert got[0]["prompt"] == "Which is it? still the question" and [tuple(o) for o in got[0]["options"]] == [("A", "one", False), ("B", "two goes on", True), ("C", "three", True)]


def test_tree_order(spark):
    from quill.operators.trees import tree_order

    rng = random.Random(7)
    rows = [("t", 0, None, 5), ("t", 1, None, 5)] + [("t", k, rng.randrange(k), rng.randrange(4)) for k in range(2, 120)]
    rows += [("u", 0, None, 1)] + [("u", k, k - 1, 0) for k in range(1, 40)]  # a chain
    rows += [("v", 1, 99, 3), ("v", 2, 1, 1), ("v", 3, 4, 2), ("v", 4, 3, 2), ("v", 5, 4, 0), ("v", 6, None, 9), ("v", 7, 6, 1)]  # a missing parent, a cycle

    def walk(group):
        own = [r for r in rows if r[0] == group]
        out, stack = [], sorted(((r[3], r[1], 1) for r in own if r[2] is None), reverse=True)
        while stack:
            _, node, depth = stack.pop()
            out.append((node, depth))
            stack += sorted(((r[3], r[1], depth + 1) for r in own if r[2] == node), reverse=True)
        seen = {n for n, _ in out}
        return out + [(r[1], None) for r in sorted(own, key=lambda r: (r[3], r[1])) if r[1] not in seen]

    got = tree_order(spark.createDataFrame(rows, "g string, node long, parent long, ord int").repartition(5), "node", "parent", "ord", ["g"]).orderBy("g", "place").collect()
    for g in "tuv":
        assert [(r["node"], r["depth"]) for r in got if r["g"] == g] == walk(g)
        assert [r["place"] for r in got if r["g"] == g] == list(range(1, 1 + sum(r[0] == g for r in rows)))


def test_elements_of_a_page(spark):
    from quill.operators.trees import elements

    html = "<div><p>a<br>b</p><ul><li>x</li><li>y</li></ul></div><p>z"
    got = elements(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").orderBy("node").collect()
    names = {r["node"]: r["name"] for r in got}
    assert [(r["name"], names.get(r["parent"])) for r in got] == [("div", None), ("p", "div"), ("br", "p"), ("ul", "div"), ("li", "ul"), ("li", "ul"), ("p", None)]


def test_order_and_trees_broadcast_nothing(spark):
    """Groups are as many as rows: what stands before a range must not be sent to all as a whole."""
    from quill.operators.ordered import numbered
    from quill.operators.trees import tree_order

    rows = spark.createDataFrame([(k % 7, k // 2, k) for k in range(40)], "g long, p long, v long")
    placed = numbered(rows, ["v"], "n", ["g", "p"])
    nodes = spark.createDataFrame([(1, 0, None, "a"), (1, 1, 0, "b"), (1, 2, 0, "a")], "g long, node long, parent long, name string")
    tree = tree_order(nodes, "node", "parent", "name", ["g"])
    for df in (placed, tree):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["node"], r["name"], r["place"]) for r in tree.orderBy("place").collect()] == [(0, "a", 1), (2, "a", 2), (1, "b", 3)]
    assert sorted((r["v"], r["n"]) for r in placed.collect()) == [(k, 1 if k % 2 == 0 or (k - 1) % 7 != k % 7 else 2) for k in range(40)]
