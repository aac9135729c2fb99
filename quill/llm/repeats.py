"""Removal of byte strings that earlier documents have, by prefix doubling over position ranks.

Spark sorts (rank, document, position) rows at growing lengths, 20, 35 and ``LENGTH`` bytes; what has
a rank of its own, or one that no other document has, drops out before the next. Ranks of all
positions are too many to sort, so the first round ranks anchors only: in every window of ``LENGTH``
bytes the position whose ``START`` bytes have the smallest hash. Equal windows have equal anchors at
equal places, so a window whose anchor is unique is unique.

1. Anchors by the rank of their 20 bytes. Those of one document alone drop out.
2. The others by the rank of all their windows together. Later documents lose these windows at once;
   the first document of each rank goes on.
3. The pairs (rank of the anchor, rank of the 15 bytes before or after it). Every window of an anchor
   has one or the other; windows whose pair is in one document alone drop out.
4. What is left, window by window.

Ranks are hashes, of 128 bits where they decide. What a task can settle among the documents it holds
it does not send: of many copies of a string one from each step of text meets the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.shared import STEP_BYTES, Rolling, dropped, flat, lean, mixed, partitions, steps, stops, table_path, written

LENGTH, START = 50, 20
#: Bytes beside an anchor that the third round adds: every window has them on one side.
BESIDE = (LENGTH - START) // 2
WINDOWS = LENGTH - START + 1
CONTEXT = LENGTH + WINDOWS - 1
LAST_ID = (1 << 63) - 1
#: Anchors whose contexts are hashed at once.
AT_ONCE = 1 << 15
_rolling: list[Rolling] = []


def _rollings() -> list[Rolling]:
    if not _rolling:
        _rolling.extend((Rolling(17), Rolling(19)))
        for r in _rolling:
            r.sums(np.zeros(CONTEXT, np.uint8))
    return _rolling


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window of every anchor of the rows of a step, in order."""
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    if len(data) < LENGTH:
        return none
    if len(offsets) == 2 and len(data) > 2 * STEP_BYTES:  # one long row: blocks that overlap by a window
        cut = [(low, anchors(data[low : low + STEP_BYTES + LENGTH - 1], np.array([0, len(data[low : low + STEP_BYTES + LENGTH - 1])]))) for low in range(0, len(data), STEP_BYTES)]
        return tuple(np.concatenate([x[k] + (low if k else 0) if k else x[k] for low, x in cut]) for k in range(4))
    rolling = _rollings()[0]
    hashed = rolling.windows(rolling.sums(data), START)
    key = hashed >> np.uint64(32) << np.uint64(32) | np.arange(len(hashed), dtype=np.uint64)
    width = 1
    while width < WINDOWS:
        step = min(width, WINDOWS - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    size = np.diff(offsets)
    long_ = size >= LENGTH
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    if not len(start):
        return none
    at = at[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = stops(first, len(at)) - 1
    return hashed[at[first]], at[first], start[first], start[last]


def _packed(at: np.ndarray, left: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An anchor of a row as one number: its place, how far before it its first window starts, how many more windows it has."""
    return at << 10 | left << 5 | more


def _unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 10, p >> 5 & 31, p & 31


def _earlier(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> np.ndarray:
    """Whether an entry's key is found in a document before its own."""
    order = np.lexsort((docs, *keys[::-1]))
    if not len(order):
        return np.zeros(0, bool)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = docs[order] > first
    return out


def _alone(docs: np.ndarray, places: np.ndarray, salt: int) -> np.ndarray:
    """Keys of their own for entries that are settled."""
    return mixed(mixed(docs.astype(np.uint64) + np.uint64(salt)) + places.astype(np.uint64))


class Texts:
    """Texts by (d, v) in a table bucketed by them, which later rounds join without moving a text.

    d: doc_id, null ids last; v: a hash of the text, which tells rows of one doc_id apart; n: how many
    rows are equal; copied: whether a smaller doc_id has the same text.
    """

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("v"), F.xxhash64(F.lit(1), text).alias("u"), text.alias("text"))
        ids, ids_path = written(rows.where(F.octet_length("text") >= LENGTH).groupBy("d", "v", "u").agg(F.count(F.lit(1)).alias("n")), "ids")
        classes, classes_path = written(ids.groupBy("v", "u").agg(F.min("d").alias("rep"), F.max("d").alias("latest")).where("rep < latest").select("v", "u", "rep"), "classes")
        marks = ids.join(classes, ["v", "u"], "left").select("d", "v", "n", F.coalesce(F.col("d") > F.col("rep"), F.lit(False)).alias("copied")).where("copied or n > 1")
        marked = rows.drop("u").join(marks.hint("merge"), ["d", "v"], "left")
        once = marked.where("n is null or n = 1").withColumn("n", F.lit(1).cast("long"))
        twice = marked.where("n > 1").dropDuplicates(["d", "v"])
        both = once.unionByName(twice).select("d", "v", "n", F.coalesce("copied", F.lit(False)).alias("copied"), "text")
        self.name, self.path, count = f"quill_texts_{uuid.uuid4().hex}", table_path(self.spark, "texts"), partitions(self.spark)
        both.repartition(count, "d", "v").write.bucketBy(count, "d", "v").option("compression", "zstd").option("path", self.path).saveAsTable(self.name)
        dropped(self.spark, ids_path, classes_path)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def with_lists(self, rows: DataFrame, column: str) -> DataFrame:
        """The texts that have rows, with the values of all these in one list."""
        lists = rows.repartition(partitions(self.spark), "d", "v").groupBy("d", "v").agg(F.collect_set(column).alias("list"))
        return self.table().select("d", "v", "text").join(lists.hint("merge"), ["d", "v"])


def _listed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of a step's texts, and the row, the document and the value of every entry of their lists."""
    data, offsets = flat(b.column("text"))
    lists = b.column("list")
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return data, offsets, row, b.column("d").to_numpy(zero_copy_only=False)[row], values


def _ranks(data: np.ndarray, begin: np.ndarray):
    """Hashes of any parts of the contexts that begin at the places: a function of a seed, starts and stops."""
    context = data[np.minimum(begin[:, None] + np.arange(CONTEXT), len(data) - 1)]
    rows, rollings = np.arange(len(begin)), _rollings()
    sums = [np.concatenate([np.zeros((len(begin), 1), np.uint64), np.cumsum(r.value[context] * r.up[:CONTEXT], axis=1)], axis=1) for r in rollings]

    def rank(seed: int, start, stop, of=rows) -> np.ndarray:
        r, s = rollings[seed], sums[seed]
        return mixed((s[of, stop] - s[of, start]) * r.down[start] + np.asarray(stop - start).astype(np.uint64))

    return rank


def _first_round(texts: DataFrame) -> DataFrame:
    """d, v, p: the anchors whose ``START`` bytes another document has too."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in steps(batch, "text"):
                data, offsets = flat(b.column("text"))
                h, at, first, last = anchors(data, offsets)
                row = np.searchsorted(offsets, at, "right") - 1
                ids, versions = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d", "v"))
                d, v, p = ids[row], versions[row], _packed(at - offsets[row], at - first, last - first)
                order = np.lexsort((d, h))
                new = np.ones(len(h), bool)
                new[1:] = h[order][1:] != h[order][:-1]
                start = np.flatnonzero(new)
                many = d[order][start] != d[order][stops(start, len(h)) - 1] if len(h) else np.zeros(0, bool)
                known = np.zeros(len(h), bool)
                known[order] = many[np.cumsum(new) - 1]
                mark = order[start[many]]  # stands for all of its hash: others have to know that they are not alone
                kind = np.concatenate([known.astype(np.int8), np.full(len(mark), 2, np.int8)])
                key = np.concatenate([np.where(known, _alone(d, p, 3), h), h[mark]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), *(pa.array(np.concatenate([x, x[mark]])) for x in (d, v, p))], ["h", "kind", "d", "v", "p"])

    same = Window.partitionBy("h")
    ranked = texts.select("d", "v", "text").mapInArrow(lean(batches), "h bigint, kind tinyint, d bigint, v bigint, p bigint")
    ranked = ranked.withColumns({"low": F.min("d").over(same), "high": F.max("d").over(same), "most": F.max("kind").over(same)})
    return ranked.where("kind = 1 or kind = 0 and (low < high or most = 2)").select("d", "v", "p")


def _second_round(found: DataFrame) -> DataFrame:
    """d, v, p, gone, before, after: anchors whose windows an earlier document has all, and the first ones of each rank with the ranks of their sides."""
    names = ["c1", "c2", "gone", "d", "v", "p", "before", "after"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in steps(batch, "text"):
                data, offsets, row, docs, packed = _listed(b)
                versions = b.column("v").to_numpy(zero_copy_only=False)[row]
                for k in range(0, len(row), AT_ONCE):
                    some = slice(k, k + AT_ONCE)
                    d, v, p = docs[some], versions[some], packed[some]
                    at, left, more = _unpacked(p)
                    rank = _ranks(data, offsets[row[some]] + at - left)
                    zero = np.zeros(len(p), np.int64)
                    c1, c2 = (rank(seed, zero, more + LENGTH) for seed in (0, 1))
                    gone = _earlier((c1, c2), d)
                    c1[gone], c2[gone] = _alone(d[gone], p[gone], 5), _alone(d[gone], p[gone], 7)
                    sides = []
                    for there, start, size in ((left >= BESIDE, left - BESIDE, START + BESIDE), (left - more < BESIDE, left, START + BESIDE)):
                        start = np.where(there, start, 0)
                        sides.append(pa.array(rank(0, start, start + size).view(np.int64), mask=~there | gone))
                    yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(gone), pa.array(d), pa.array(v), pa.array(p), *sides], names)

    same = Window.partitionBy("c1", "c2")
    ranked = found.mapInArrow(lean(batches), "c1 bigint, c2 bigint, gone boolean, d bigint, v bigint, p bigint, before bigint, after bigint")
    return ranked.withColumn("gone", F.col("gone") | (F.col("d") > F.min("d").over(same))).select("d", "v", "p", "gone", "before", "after")


def _third_round(firsts: DataFrame) -> DataFrame:
    """d, v, q: the anchor p and the side (q = 2 p + side) where other documents have the same bytes beside it."""
    sides = firsts.select("d", "v", "p", F.posexplode(F.array("before", "after")).alias("side", "rank")).where("rank is not null")
    same = Window.partitionBy("side", "rank")
    shared = sides.withColumns({"low": F.min("d").over(same), "high": F.max("d").over(same)}).where("low < high")
    return shared.select("d", "v", (F.col("p") * 2 + F.col("side")).alias("q"))


def _fourth_round(found: DataFrame) -> DataFrame:
    """d, v, start: the windows that an earlier document has."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in steps(batch, "text"):
                data, offsets, row, docs, packed = _listed(b)
                versions = b.column("v").to_numpy(zero_copy_only=False)[row]
                for k in range(0, len(row), AT_ONCE):
                    some = slice(k, k + AT_ONCE)
                    side, (at, left, more) = packed[some] & 1, _unpacked(packed[some] >> 1)
                    rank = _ranks(data, offsets[row[some]] + at - left)
                    window = np.arange(WINDOWS)
                    before = left[:, None] - window
                    entry, w = np.nonzero((window <= more[:, None]) & np.where(side[:, None] == 0, before >= BESIDE, before < BESIDE))
                    keys = [rank(seed, w, w + LENGTH, entry) for seed in (0, 1)]
                    d, v, start = docs[some][entry], versions[some][entry], (at - left)[entry] + w
                    gone = _earlier(tuple(keys), d)
                    for key, salt in zip(keys, (5, 7), strict=True):
                        key[gone] = _alone(d[gone], start[gone], salt)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in keys), pa.array(gone), pa.array(d), pa.array(v), pa.array(start)], ["w1", "w2", "gone", "d", "v", "start"])

    same = Window.partitionBy("w1", "w2")
    ranked = found.mapInArrow(lean(batches), "w1 bigint, w2 bigint, gone boolean, d bigint, v bigint, start bigint")
    return ranked.withColumn("gone", F.col("gone") | (F.col("d") > F.min("d").over(same))).where("gone").select("d", "v", "start")


def repeated_windows(texts: Texts) -> DataFrame:
    """d, v, cut (start << 7 | bytes): what earlier documents have, of the texts that are no copies."""
    spark = texts.spark
    found, found_path = written(_first_round(texts.table().where("not copied")), "anchors")
    dropped(spark)
    second, second_path = written(_second_round(texts.with_lists(found, "p")), "contexts")
    dropped(spark, found_path)
    third, third_path = written(_third_round(second.where("not gone")), "sides")
    place, left, more = F.shiftright("p", 10), F.shiftright("p", 5).bitwiseAND(31), F.col("p").bitwiseAND(31)
    whole = second.where("gone").select("d", "v", ((place - left) * 128 + more + LENGTH).alias("cut"))
    single = _fourth_round(texts.with_lists(third, "q")).select("d", "v", (F.col("start") * 128 + LENGTH).alias("cut"))
    cuts, _ = written(whole.unionByName(single), "cuts")
    dropped(spark, second_path, third_path)
    return cuts


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans, spans (list of start and stop) per row of ``docs`` (doc_id, text).

    A byte goes if a ``LENGTH``-byte string over it also starts in a document of smaller doc_id.
    Strings lie in one text and are judged on the input. Null texts are empty, and null doc_ids
    one document after all others; rows of one doc_id do not judge each other, and equal rows have
    equal results. Removal may split a character, so what is kept is bytes. Other columns are not
    read. An empty table gives an empty one.
    """
    texts = Texts(docs)
    cuts = repeated_windows(texts)
    kinds = "d bigint, n bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<array<bigint>>"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ("d", "n", "kept", "n_bytes", "n_removed", "n_spans", "spans")]
        for batch in it:
            for b in steps(batch, "text"):
                out = []
                for text, cut, copied in zip(b.column("text").cast(pa.large_binary()), b.column("list"), b.column("copied").to_pylist(), strict=True):
                    raw = np.frombuffer(text.as_buffer(), np.uint8)
                    if copied:
                        out.append((b"", len(raw), len(raw), 1, [[0, len(raw)]]))
                        continue
                    if not cut.is_valid:
                        out.append((raw.tobytes(), len(raw), 0, 0, []))
                        continue
                    packed = cut.values.to_numpy(zero_copy_only=False)
                    start = packed >> 7
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + (packed & 127), -1)
                    lost = np.cumsum(depth)[:-1] > 0
                    edge = np.diff(np.concatenate([[0], lost.view(np.int8), [0]]))
                    spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
                    out.append((raw[~lost].tobytes(), len(raw), int(lost.sum()), len(spans), spans.tolist()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("n"), pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.list_(pa.list_(pa.int64())))], names)

    lists = cuts.repartition(partitions(texts.spark), "d", "v").groupBy("d", "v").agg(F.collect_set("cut").alias("list"))
    out = texts.table().join(lists.hint("merge"), ["d", "v"], "left").select("d", "n", "text", "list", "copied").mapInArrow(lean(batches), kinds)
    out = out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("doc_id", F.when(F.col("d") < LAST_ID, F.col("d")))
    return out.select("doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans")
