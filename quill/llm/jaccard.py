"""Exact Jaccard join of documents on word shingles by vertical partitioning.

Shingles have one global order: by the count of their rarest word, from a table of fixed size over
the whole corpus, ties by hash. Two sets that are similar enough share a shingle of their prefixes in
that order, so only prefixes are dealt out, by shingle, to find candidates. The sets of candidates
are cut into fragments; partial overlaps are counted fragment by fragment and summed per pair.

Groups of documents that share a prefix shingle are not expanded into all pairs: the members of a
large group are compared with one of them at a time, and only those whom the verified links leave in
different components are at last compared with each other, in blocks of a bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.shared import STEP_BYTES, Rolling, dropped, flat, lean, mixed, partitions, steps, table_path, written

WORDS, SIMILARITY = 5, 75
#: Entries of the word count table (a power of two): what is broadcast is this many bytes, whatever the corpus.
COUNTERS = 1 << 20
SLICES = 64
#: Ranges of hashes that a set is cut into; most pairs that are not similar stop after the first.
FRAGMENTS = 4
#: Rounds of comparisons with one member of each group, at most, before what is open is compared.
ROUNDS = 4
#: Groups of at most FEW are compared at once; open ones of more than SMALL in blocks of so many documents.
FEW, SMALL, BLOCK_ROWS = 4, 64, 1024
#: A block that has more feasible pairs than this for each member counts them by fragment, all together.
DENSE = 4
LAST_ID = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_rolling: list[Rolling] = []


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = _rolling[0].ranges(_rolling[0].sums(_LOWER[data]), start, stop)
    return hashes, np.diff(np.searchsorted(start, offsets))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every row, and each row's count. One long row is taken in blocks of whole words."""
    if not _rolling:
        _rolling.append(Rolling(9))
    data, offsets = flat(column)
    if len(offsets) != 2 or len(data) <= 2 * STEP_BYTES:
        return _words(data, offsets)
    found, low = [], 0
    while low < len(data):
        high = min(len(data), low + STEP_BYTES)
        if high < len(data):
            blanks = np.flatnonzero(_SPACE[data[low:high]])
            while not len(blanks) and high < len(data):
                more = min(len(data), high + STEP_BYTES)
                blanks = np.flatnonzero(_SPACE[data[high:more]]) + (high - low)
                high = more
            high = low + int(blanks[-1]) + 1 if len(blanks) else high
        found.append(_words(data[low:high], np.array([0, high - low]))[0])
        low = high
    hashes = np.concatenate(found)
    return hashes, np.array([len(hashes)])


def shingles(hashes: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Row, hash and weight of every shingle (with repeats); a row of fewer words is one shingle.

    The weight is that of the rarest word: no shingle is in more places than its rarest word.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    m = max(0, len(hashes) - n + 1)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc += hashes[k : k + m] * _FACTORS[k]
    whole = (rows[:m] == rows[n - 1 : n - 1 + m]) if m else np.zeros(0, bool)
    row, hashed = rows[:m][whole], mixed(acc[whole] + np.uint64(n))
    own = weights[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64) if weights is not None else None
    heavy = np.zeros(len(row), np.int64)
    if own is not None and m:
        heavy = np.min([own[k : k + m] for k in range(n)], axis=0)[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        load = np.full(len(short), 255, np.int64)
        for k in range(n - 1):
            there = counts[short] > k
            extra[there] += hashes[first[short[there]] + k] * _FACTORS[k]
            if own is not None:
                load[there] = np.minimum(load[there], own[first[short[there]] + k])
        row, hashed, heavy = np.concatenate([row, short]), np.concatenate([hashed, mixed(extra + counts[short].astype(np.uint64))]), np.concatenate([heavy, load])
    return row, hashed, heavy if own is not None else None


def sets(row: np.ndarray, hashed: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes without repeats, by row, in the order of ``key`` within it."""
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[new], hashed[new]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("v"), text.alias("text"))


def _sequences_and_counts(rows: DataFrame) -> DataFrame:
    """A row per document (d, v, s1, s2: its words in order; n_words), and the tasks' word counts in slices."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = np.zeros(COUNTERS, np.int64), ["d", "v", "s1", "s2", "n_words", "slice", "counts"]
        for batch in it:
            for b in steps(batch, "text"):
                hashes, counts = words(b.column("text"))
                table += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                first = np.cumsum(counts) - counts
                at = np.arange(len(hashes)) - np.repeat(first, counts)
                sums = []
                for seed in (1, 2):
                    run = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(mixed(hashes + mixed(at.astype(np.uint64) * np.uint64(2) + np.uint64(seed << 40))), out=run[1:])
                    sums.append((run[first + counts] - run[first]).view(np.int64))
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("v"), pa.array(sums[0]), pa.array(sums[1]), pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if table.any():
            cut = [x.tobytes() for x in np.split(table, SLICES)]
            empty = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([empty] * 5 + [pa.array(range(SLICES), pa.int32()), pa.array(cut, pa.binary())], names)

    return rows.mapInArrow(lean(batches), "d bigint, v bigint, s1 bigint, s2 bigint, n_words bigint, slice int, counts binary")


def _weights(counted: DataFrame) -> np.ndarray:
    """A byte per counter: four times the binary logarithm of its count."""

    def added(key, table):
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.int64)
        load = np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "load": pa.array([load.tobytes()], pa.binary())})

    parts = counted.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(added, "slice int, load binary").collect()
    out = np.zeros(COUNTERS, np.uint8)
    for r in parts:
        width = COUNTERS // SLICES
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["load"], np.uint8)
    return out


def _prefixes(rows: DataFrame, weights: np.ndarray, similarity: int, n: int) -> DataFrame:
    """Of each document (d, size) the shingles h of its prefix with their places in its order; h is null in one row of each, for its size."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in steps(batch, "text"):
                row, hashed, load = shingles(*words(b.column("text")), shared.value, n)
                row, hashed = sets(row, hashed, load.astype(np.uint64) << np.uint64(56) | hashed >> np.uint64(8))
                size = np.bincount(row, minlength=b.num_rows)
                length = size - -(-size * similarity // 100) + 1
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                keep = at < length[row]
                row, hashed, at = row[keep], hashed[keep].view(np.int64), at[keep].astype(np.int32)
                ids = b.column("d").to_numpy(zero_copy_only=False)
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(size, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], ["d", "size", "h", "place"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(size[row], pa.int32()), pa.array(hashed), pa.array(at)], ["d", "size", "h", "place"])

    return rows.mapInArrow(lean(batches), "d bigint, size int, h bigint, place int")


def _groups(entries: DataFrame, similarity: int) -> DataFrame:
    """g, k, d, size, place: the k documents that share a prefix shingle; equal groups once, with the least places."""
    same = Window.partitionBy("h")
    k, one, two = F.count(F.lit(1)).over(same), F.expr("bit_xor(xxhash64(d))").over(same), F.expr("bit_xor(xxhash64(1, d))").over(same)
    shared = entries.select("h", "d", "size", "place").withColumns({"k": k, "one": one, "two": two}).where("k > 1")
    groups = shared.select(F.xxhash64("one", "two", "k").alias("g"), "k", "d", "size", "place").groupBy("g", "d").agg(F.max("k").alias("k"), F.max("size").alias("size"), F.min("place").alias("place"))
    # a document stays if the smallest set of its group that is near enough in size could make up the overlap
    least = F.greatest(F.ceil(F.col("size") * similarity / 100).cast("long"), F.min("size").over(Window.partitionBy("g")).cast("long"))
    return groups.withColumn("least", least).where((F.col("size") - F.col("place")).cast("long") * (100 + similarity) >= (F.col("size") + F.col("least")) * similarity).drop("least")


def _feasible(similarity: int, x: str = "x.", y: str = "y.") -> Column:
    """Whether what follows the first shared shingle, at its place in both orders, can make up the overlap."""
    n, m = F.col(x + "size"), F.col(y + "size")
    return F.least(n - F.col(x + "place"), m - F.col(y + "place")).cast("long") * (100 + similarity) >= (n + m).cast("long") * similarity


def _pairs(groups: DataFrame, similarity: int, apart: bool) -> DataFrame:
    """a, b: feasible pairs of the members of small groups; ``apart``: of different components c only."""
    x, y = groups.alias("x"), groups.alias("y")
    met = x.join(y.hint("merge"), (F.col("x.g") == F.col("y.g")) & (F.col("x.d") < F.col("y.d")) & _feasible(similarity))
    if apart:
        met = met.where("x.c <> y.c")
    return met.select(F.col("x.d").alias("a"), F.col("y.d").alias("b")).distinct()


class Fragments:
    """The sets of documents as a table bucketed by document, a column for each fragment of the order of hashes.

    Joins with it move the other side only, whatever the size of the table.
    """

    def __init__(self, rows: DataFrame, n: int):
        names = ["d", "size", *(f"p{k}" for k in range(FRAGMENTS))]

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for b in steps(batch, "text"):
                    row, hashed, _ = shingles(*words(b.column("text")), None, n)
                    row, hashed = sets(row, hashed, hashed)
                    key = row * FRAGMENTS + (hashed >> np.uint64(62)).astype(np.int64)
                    cuts = np.searchsorted(key, np.arange(b.num_rows * FRAGMENTS + 1))
                    parts = [hashed[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
                    size = np.bincount(row, minlength=b.num_rows)
                    yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(size, pa.int64()), *(pa.array(parts[k::FRAGMENTS], pa.binary()) for k in range(FRAGMENTS))], names)

        self.spark, self.name, self.path = rows.sparkSession, f"quill_sets_{uuid.uuid4().hex}", table_path(rows.sparkSession, "sets")
        made = rows.mapInArrow(lean(batches), "d bigint, size bigint, " + ", ".join(f"{x} binary" for x in names[2:]))
        count = partitions(self.spark)
        made.repartition(count, "d").write.bucketBy(count, "d").sortBy("d").option("compression", "zstd").option("path", self.path).saveAsTable(self.name)

    def table(self, *columns: str) -> DataFrame:
        return self.spark.table(self.name).select("d", *columns)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        dropped(self.spark, self.path)

    def overlaps(self, pairs: DataFrame, fragments: list[int], keep: str) -> DataFrame:
        """``keep`` and, of each pair (a, b), the shared hashes and the smaller count in each of the fragments."""
        kept = keep.split(", ")
        out = [f"{kind}{k}" for k in fragments for kind in ("both", "least")]

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in it:
                columns = []
                for k in fragments:
                    both, least = np.zeros(x.num_rows, np.int64), np.zeros(x.num_rows, np.int64)
                    for i, (p, q) in enumerate(zip(x.column(f"p{k}"), x.column(f"q{k}"), strict=True)):
                        p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                        s = np.sort(np.concatenate([p, q]), kind="stable")
                        both[i], least[i] = int((s[1:] == s[:-1]).sum()), min(len(p), len(q))
                    columns += [pa.array(both), pa.array(least)]
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in kept), *columns], [*kept, *out])

        q, p = ([f"{c}{k}" for k in fragments] for c in "qp")
        own = self.table("size", *p).withColumnsRenamed(dict(zip(p, q, strict=True)) | {"d": "b", "size": "nb"})
        hub = self.table("size", *p).withColumnsRenamed({"d": "a", "size": "na"})
        met = pairs.join(own.hint("merge"), "b").join(hub.hint("merge"), "a").select(*kept, *p, *q)
        return met.mapInArrow(lean(batches), ", ".join(f"{c} bigint" for c in [*kept, *out]))

    def verified(self, pairs: DataFrame, similarity: int) -> DataFrame:
        """Of the pairs (a, b) those that are similar enough, by overlaps counted per fragment and summed.

        Pairs whose first fragment leaves too little to reach the similarity stop there.
        """
        enough = lambda both: both * (100 + similarity) >= (F.col("na") + F.col("nb")) * similarity
        begun = self.overlaps(pairs.select("a", "b"), [0], "a, b, na, nb")
        # what the other fragments share at most is what the smaller set has outside the first
        open_, path = written(begun.where(enough(F.col("both0") + F.least("na", "nb") - F.least("least0", F.least("na", "nb")))).select("a", "b", "both0"), "open-pairs")
        rest = self.overlaps(open_, list(range(1, FRAGMENTS)), "a, b, both0, na, nb")
        total = sum((F.col(f"both{k}") for k in range(1, FRAGMENTS)), F.col("both0"))
        links, _ = written(rest.where(enough(total)).select("a", "b"), "links")
        dropped(self.spark, path)
        return links


def components(links: DataFrame) -> DataFrame:
    """d, c: every document of the links (a, b) with the smallest one it is connected to."""
    spark = links.sparkSession
    edges, path = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "edges")
    labels, old = written(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("d"), F.least("x", "y").alias("c")), "labels")
    while True:
        near = edges.join(labels.select(F.col("d").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("n"))
        lower = labels.join(near, labels["d"] == near["x"]).select("d", "c", F.least("c", "n").alias("n"))
        jump = labels.select(F.col("d").alias("n"), F.col("c").alias("j"))
        fresh, new = written(lower.join(jump, "n", "left").select("d", F.least("n", F.coalesce("j", "n")).alias("c"), (F.least("n", F.coalesce("j", "n")) < F.col("c")).alias("moved")), "labels")
        moved = fresh.where("moved").limit(1).count()
        dropped(spark, old)
        labels, old = fresh.select("d", "c"), new
        if not moved:
            dropped(spark, path)
            return labels


def _placed(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of groups whose documents are not yet in one component, with their components c."""
    if labels is None:
        return groups.withColumn("c", F.col("d"))
    placed = groups.join(labels, "d", "left").withColumn("c", F.coalesce("c", "d"))
    split = placed.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("g")
    return placed.join(split, "g")


def _links(few: DataFrame, groups: DataFrame, fragments: Fragments, similarity: int) -> DataFrame:
    """Links (a, b) that connect all documents of the groups that similar pairs connect: those of the pairs ``few``, and in ``groups``.

    Each round compares one member of the largest component of each large group with the group's
    other components, another member each time. When rounds find little, all feasible pairs across
    components that no round has compared are.
    """
    tested = links = None
    labels: DataFrame | None = None
    for turn in range(ROUNDS):
        placed, placed_path = written(_placed(groups, labels), "open-groups")
        by_part = placed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("d", "size"), F.xxhash64("d", F.lit(turn))).alias("hub"))
        by_group = by_part.groupBy("g").agg(F.max_by(F.struct("c", "hub"), F.struct("n", -F.col("c"))).alias("top")).select("g", F.col("top.c").alias("top"), F.col("top.hub.d").alias("hub"), F.col("top.hub.size").alias("hub_size"))
        near = F.least("size", "hub_size") * 100 >= F.greatest("size", "hub_size") * similarity
        stars = placed.join(by_group, "g").where((F.col("c") != F.col("top")) & near).select(F.least("hub", "d").alias("a"), F.greatest("hub", "d").alias("b")).distinct()
        if turn == 0:
            stars = stars.unionByName(few).distinct()
        fresh, _ = written(stars if tested is None else stars.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        n = fresh.count()
        dropped(groups.sparkSession, placed_path)
        if not n:
            break
        tested = fresh if tested is None else tested.unionByName(fresh)
        new = fragments.verified(fresh, similarity)
        found = new.count()
        links = new if links is None else links.unionByName(new)
        if found:
            labels = components(links)
        if turn and found * 50 < n:
            break
    open_, path = written(_placed(groups, labels), "open-groups")
    if open_.isEmpty():
        return links if links is not None else few.limit(0)
    last = _pairs(open_.where(F.col("k") <= SMALL), similarity, True)
    blocks, blocks_path = written(_blocks(open_.where(F.col("k") > SMALL), similarity), "blocks")
    last = last.unionByName(blocks.where("a is not null").select("a", "b")).distinct()
    last, _ = written(last if tested is None else last.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    found = fragments.verified(last, similarity)
    many = blocks.where("a is null").select("g", "i", "j")
    if not many.isEmpty():
        found = found.unionByName(written(_dense_links(open_, many, fragments, similarity), "links")[0])
    dropped(groups.sparkSession, path, blocks_path)
    return found if links is None else links.unionByName(found)


def _dealt(open_: DataFrame) -> DataFrame:
    """The members of large groups, cut into blocks of a bounded size, once for each two blocks (i, j) that meet."""
    cuts = F.ceil(F.col("k") / BLOCK_ROWS).cast("int")
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("d"), cuts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    return dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "d", "c", "size", "place", "own")


def _blocks(open_: DataFrame, similarity: int) -> DataFrame:
    """Of each two blocks of large groups the feasible pairs (a, b) across components or, where these are many, a row without a pair."""

    most = 2 * DENSE

    def met(table):
        order = np.argsort(table.column("d").to_numpy())
        d, c, n, place, own = (table.column(x).to_numpy()[order].astype(np.int64) for x in ("d", "c", "size", "place", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        ok = np.minimum((n - place)[left][:, None], (n - place)[right][None]) * (100 + similarity) >= (n[left][:, None] + n[right][None]) * similarity
        p, q = np.nonzero(ok & (c[left][:, None] != c[right][None]))
        a, b = np.minimum(d[left[p]], d[right[q]]), np.maximum(d[left[p]], d[right[q]])
        if len(a) > most * len(d):
            a, b = pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())
        m = len(a)
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * m, pa.int64()), "i": pa.array([i] * m, pa.int32()), "j": pa.array([j] * m, pa.int32()), "a": a, "b": b})

    return _dealt(open_).groupBy("g", "i", "j").applyInArrow(met, "g bigint, i int, j int, a bigint, b bigint")


def _dense_links(open_: DataFrame, dense: DataFrame, fragments: Fragments, similarity: int) -> DataFrame:
    """Links across components of the blocks that have many feasible pairs, without rows for pairs.

    A task adds up the overlaps of the documents of two blocks fragment by fragment and gives, for
    each document, one link into each component that it is similar to.
    """

    def met(table):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        d, c, size, own = (table.column(x).to_numpy() for x in ("d", "c", "size", "own"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        place = np.zeros((2, len(d)), np.int64)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)
        for f in range(FRAGMENTS):
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(f"p{f}")]
            doc = np.repeat(np.arange(len(d)), [len(x) for x in parts])
            hashed, column = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_inverse=True)
            many = np.bincount(column, minlength=len(hashed)) > 1
            keep, rank = many[column], np.cumsum(many) - 1
            doc, column = doc[keep], rank[column[keep]]
            order = np.argsort(column, kind="stable")
            doc, column = doc[order], column[order]
            for low in range(0, int(many.sum()), 1024):
                k = slice(*np.searchsorted(column, (low, low + 1024)))
                x, y = np.zeros((len(left), 1024), np.float32), np.zeros((len(right), 1024), np.float32)
                for block, side, wanted in ((x, 0, i), (y, 1, j)):
                    mine = own[doc[k]] == wanted
                    block[place[side, doc[k][mine]], column[k][mine] - low] = 1
                both += x @ y.T
        total = size[left][:, None].astype(np.int64) + size[right][None, :]
        p, q = np.nonzero((both.astype(np.int64) * (100 + similarity) >= total * similarity) & (c[left][:, None] != c[right][None, :]))
        _, one = np.unique(np.stack([left[p], np.unique(c, return_inverse=True)[1][right[q]]]), axis=1, return_index=True)
        a, b = d[left[p[one]]], d[right[q[one]]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    rows = _dealt(open_).drop("size", "place").join(dense.hint("merge"), ["g", "i", "j"], "left_semi")
    rows = rows.join(fragments.table("size", *(f"p{k}" for k in range(FRAGMENTS))).hint("merge"), "d")
    return rows.groupBy("g", "i", "j").applyInArrow(met, "a bigint, b bigint").distinct()


def _texts_of(rows: DataFrame, own: DataFrame) -> DataFrame:
    """One row (d, text) for each of ``own`` (d, w): of the rows of d one whose text has the hash w.

    The hashes are compared after the join, so that texts are dealt by d alone, and once.
    """
    return rows.join(own.hint("merge"), "d").where(F.col("v").bitwiseXOR(F.col("w")) == 0).select("d", "text").dropDuplicates(["d"])


def linked(docs: DataFrame, similarity: int = SIMILARITY, n: int = WORDS) -> DataFrame:
    """d, size, c per document of ``docs`` that has words: set size and component."""
    spark = docs.sparkSession
    rows = _keyed(docs)
    counted, counted_path = written(_sequences_and_counts(rows), "word-counts")
    weights = _weights(counted)
    # rows of one doc_id are one document: the one of most words stands for them
    each = counted.where("slice is null and n_words > 0").groupBy("d").agg(F.max(F.struct("n_words", "v", "s1", "s2")).alias("r")).select("d", "r.v", "r.s1", "r.s2")
    classes = each.groupBy("s1", "s2").agg(F.min("d").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("s1", "s2", "rep")
    nodes, nodes_path = written(each.join(classes, ["s1", "s2"], "left").select("d", "v", F.coalesce("rep", "d").alias("rep")), "nodes")
    dropped(spark, counted_path)
    # what these sides hold grows with the corpus: sort and merge at every size, never a broadcast
    own = nodes.where("d = rep").select("d", F.col("v").alias("w"))
    rest = _texts_of(rows, own)
    entries, entries_path = written(_prefixes(rest, weights, similarity, n), "prefixes")
    dropped(spark)
    sizes, sizes_path = written(entries.where("h is null").select("d", "size"), "set-sizes")
    groups, groups_path = written(_groups(entries.where("h is not null"), similarity), "groups")
    dropped(spark, entries_path)
    few, few_path = written(_pairs(groups.where(F.col("k") <= FEW), similarity, False), "pairs")
    large = groups.where(F.col("k") > FEW)
    members = large.select("d").union(few.select("a")).union(few.select("b")).distinct()
    fragments = Fragments(_texts_of(rows, own.join(members, "d", "left_semi")), n)
    dropped(spark)
    links = _links(few, large, fragments, similarity)
    final = components(links)
    fragments.drop()
    out = nodes.join(sizes.withColumnRenamed("d", "rep"), "rep").join(final.withColumnRenamed("d", "rep"), "rep", "left").select("d", "size", F.coalesce("c", "rep").alias("c"))
    out, _ = written(out, "linked")
    dropped(spark, nodes_path, sizes_path, groups_path, few_path)
    return out


def similar_documents(docs: DataFrame, similarity: int = SIMILARITY, n: int = WORDS) -> DataFrame:
    """All columns of ``docs``, and n_shingles and component_id.

    Documents link when 100 * intersection >= ``similarity`` * union of their sets of ``n``-word
    shingles; component_id is the smallest doc_id reachable by links. Texts of fewer words are one
    shingle; null texts and texts without words have none and link with nothing. Rows of one doc_id
    are one document, for which the text of most words stands (of those the one of the largest
    hash), and get equal results. Null doc_ids are one document, after all others; its component_id
    is null where it links with no other. Columns of docs of these names are replaced. An empty table
    gives an empty one.
    """
    out = linked(docs, similarity, n)
    rows = docs.drop("n_shingles", "component_id", "_d").withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    named = out.select(F.col("d").alias("_d"), F.col("size").cast("long").alias("n_shingles"), F.col("c").alias("component_id"))
    both = rows.join(named, "_d", "left").withColumns({"n_shingles": F.coalesce("n_shingles", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "_d")})
    return both.withColumn("component_id", F.when(F.col("component_id") < LAST_ID, F.col("component_id"))).drop("_d")
