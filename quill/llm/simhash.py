"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

Fingerprints that differ in at most ``distance`` of 64 bits agree on all but ``distance`` of ``BLOCKS``
blocks of bits. Each distinct fingerprint is dealt out once for every choice of that many blocks;
those that meet are compared. A fingerprint stands for all documents that have it.

In a group of more than ``LARGE`` fingerprints not all pairs are looked at: every fingerprint at
distance d or less of another one has a value in between, at half of d from either, where both are
linked with the smallest fingerprint that is as near. That is a fixed number of rows for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.jaccard import components
from quill.llm.shared import STEP_BYTES, dropped, flat, lean, steps, written

WORDS, DISTANCE, SEED = 3, 3, 42
#: Blocks of a fingerprint: with a distance of 3 there are 20 choices of three blocks, of 31 to 33 bits.
BLOCKS = 6
LARGE = 512
LAST_ID = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words with one blank after each, where each starts and ends there, and the words of every row."""
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = stop - start
    last = np.cumsum(size + 1) - 1
    out = np.full(int(last[-1]) + 1 if len(last) else 0, 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOWER[data[inside]]
    return out, last - size, last, np.diff(np.searchsorted(start, offsets))


def _votes(data: np.ndarray, offsets: np.ndarray, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For every row how many of its shingles' hashes have each bit set (rows x 64), and how many shingles it has."""
    out, start, stop, counts = _joined(data, offsets)
    first = np.cumsum(counts) - counts
    rows = np.repeat(np.arange(len(counts)), counts)
    m = max(0, len(start) - n + 1)
    at = np.flatnonzero(rows[:m] == rows[n - 1 : n - 1 + m])
    low, high, row = start[at], stop[at + n - 1], rows[at]
    short = np.flatnonzero((counts > 0) & (counts < n)) if whole else np.zeros(0, np.int64)
    if len(short):
        low, high, row = np.append(low, start[first[short]]), np.append(high, stop[first[short] + counts[short] - 1]), np.append(row, short)
        order = np.argsort(row, kind="stable")
        low, high, row = low[order], high[order], row[order]
    raw, hashed = out.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((hashed(raw[i:j], SEED) for i, j in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(low))
    total = np.bincount(row, minlength=len(counts))
    sums = np.zeros((len(counts), 64), np.int64)
    if len(h):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        there = np.flatnonzero(total)
        sums[there] = np.add.reduceat(bits, (np.cumsum(total) - total)[there], axis=0, dtype=np.int64)
    return sums, total


def _long_votes(data: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long row, in blocks of whole words; a block begins with the last n - 1 words of the one before."""
    sums, total, low, width = np.zeros((1, 64), np.int64), np.zeros(1, np.int64), 0, most
    while low < len(data):
        high = min(len(data), low + width)
        blanks = np.flatnonzero(_SPACE[data[low:high]])
        if high < len(data):
            if not len(blanks):
                width *= 2
                continue
            high = low + int(blanks[-1])
        inside = ~_SPACE[data[low:high]]
        inside[1:] &= ~inside[:-1]
        begins = np.flatnonzero(inside)
        if high < len(data) and len(begins) < n:
            width *= 2
            continue
        s, t = _votes(data[low:high], np.array([0, high - low]), n, whole=low == 0 and high == len(data))
        sums, total = sums + s, total + t
        low, width = (low + int(begins[1 - n]) if n > 1 else high, most) if high < len(data) else (high, most)
    return sums, total


def _bits(sums: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A bit is set if more than half of a row's hashes have it."""
    return np.packbits(2 * sums > total[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(rows: DataFrame, n: int = WORDS) -> DataFrame:
    """d, v, f: the fingerprint of the text of every row, as a signed number."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in steps(batch, "text"):
                data, offsets = flat(b.column("text"))
                long = len(offsets) == 2 and len(data) > 2 * STEP_BYTES
                f = _bits(*(_long_votes(data, n, STEP_BYTES) if long else _votes(data, offsets, n)))
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("v"), pa.array(f, pa.int64())], ["d", "v", "f"])

    return rows.mapInArrow(lean(batches), "d bigint, v bigint, f bigint")


def _masks(blocks: int, kept: int) -> list[int]:
    """The bits of every choice of ``kept`` of the blocks."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << j) - 1) ^ ((1 << i) - 1) for i, j in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(block, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _keys(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """k, w, f, size: each fingerprint under the bits of every choice k of blocks, where others have the same."""
    dealt = nodes.select("f", F.posexplode(F.array(*(F.col("f").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("k", "w"))
    return dealt.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("k", "w"))).where("size > 1")


def _pairs(keys: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """a, b: near pairs of small groups, each from the first choice of blocks that they agree on."""
    x, y = keys.alias("x"), keys.alias("y")
    differ = F.col("x.f").bitwiseXOR(F.col("y.f"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(k)) for k, m in enumerate(masks)))
    near = (F.col("x.k") == F.col("y.k")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.f") < F.col("y.f"))
    met = x.join(y.hint("merge"), near & (_apart("x.f", "y.f") <= distance) & (first == F.col("x.k")))
    return met.select(F.col("x.f").alias("a"), F.col("y.f").alias("b"))


def _stars(keys: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """a, b: links that connect, in large groups, whatever near pairs connect there.

    ``near`` bits from a value on one side and the rest of ``distance`` on the other: any two that meet
    there are near each other, so that a link with the smallest of the nearer ones stands for all.
    """
    spark, near = keys.sparkSession, distance // 2
    free = [[1 << i for i in range(64) if not m >> i & 1] for m in masks]
    flips = [(k, r, _signed(sum(c))) for k, bits in enumerate(free) for r in range(distance - near + 1) for c in combinations(bits, r)]
    # as many rows as the choices of blocks and their bits give, whatever the corpus
    table = F.broadcast(spark.createDataFrame(flips, "k int, r int, flip bigint"))
    values = keys.join(table, "k").select("k", "r", F.col("f").bitwiseXOR(F.col("flip")).alias("z"), "f")
    hubs = values.where(F.col("r") <= near).groupBy("k", "z").agg(F.min("f").alias("hub"))
    met = values.join(hubs.hint("merge"), ["k", "z"]).where((F.col("f") != F.col("hub")) & (_apart("f", "hub") <= distance))
    return met.select(F.least("f", "hub").alias("a"), F.greatest("f", "hub").alias("b")).distinct()


def near_links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, large: int = LARGE) -> DataFrame:
    """a, b: pairs of the fingerprints f of ``nodes``, all different, at most ``distance`` apart; enough to connect all that such pairs connect."""
    masks = _masks(blocks, blocks - distance)
    keys, path = written(_keys(nodes, masks), "blocks")
    links = _pairs(keys.where(F.col("size") <= large), masks, distance)
    big = keys.where(F.col("size") > large)
    if not big.isEmpty():
        links = links.unionByName(_stars(big, masks, distance)).distinct()
    out, _ = written(links, "links")
    dropped(nodes.sparkSession, path)
    return out


def near_duplicates(docs: DataFrame, n: int = WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, large: int = LARGE) -> DataFrame:
    """All columns of ``docs``, and fingerprint (16 hex digits) and component_id.

    A fingerprint has a bit set if more than half of the XXH64 hashes (seed 42) of the text's
    ``n``-word shingles have it, repeats included; a text of fewer words is one shingle, one without
    words, or null, has fingerprint zero, which links like any other. Fingerprints of at most
    ``distance`` differing bits link (fewer than ``blocks``); component_id is the smallest doc_id
    reachable.

    A null doc_id comes after all others, and its component_id is null where no other id is in it.
    Rows of one doc_id each have the fingerprint and links of their own text; equal rows have equal
    results.
    Texts of any length are read in blocks of whole words. Columns of docs of these names are
    replaced. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d, v = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64(text)
    own, own_path = written(fingerprints(docs.select(d.alias("d"), v.alias("v"), text.alias("text")), n), "fingerprints")
    nodes, nodes_path = written(own.groupBy("f").agg(F.min("d").alias("d")), "distinct-fingerprints")
    links = near_links(nodes, distance, blocks, large)
    placed = nodes.join(components(links).withColumnRenamed("d", "f"), "f", "left").select("f", "d", F.coalesce("c", "f").alias("part"))
    classes = placed.join(placed.groupBy("part").agg(F.min("d").alias("c")), "part").select("f", "c")
    rows = own.dropDuplicates(["d", "v"]).join(classes.hint("merge"), "f").select(F.col("d").alias("_d"), F.col("v").alias("_v"), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), F.when(F.col("c") < LAST_ID, F.col("c")).alias("component_id"))
    named, _ = written(rows, "components")
    dropped(spark, own_path, nodes_path)
    return docs.drop("fingerprint", "component_id", "_d", "_v").withColumns({"_d": d, "_v": v}).join(named, ["_d", "_v"]).drop("_d", "_v")
