"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' ids. Every slot of ``SEQUENCE`` ids grants each queue its
share; the part of a grant that is no whole id is carried as that queue's deficit to the next
slot. After x slots a queue of N ids in W slots has been served floor(N * x / W), and N * x / W
less that is its deficit. So the place of any id follows from its place in its queue alone, in any
task, and deficits carry over windows and partitions without a serial pass. A queue that ends
leaves its share to the others: the schedule has a phase for each such end.

Among very many sources the small ones without a weight share queues. A shared queue takes the ids
of its members by their progress, (r + 1/2) / n for id r of n, so their proportions hold in it too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.shared import lean, steps, written

SEQUENCE, END_ID = 4096, 2
#: With more sources the smallest without a weight share queues, so that a slot's grants stay this few.
QUEUES = 256
#: Slots times queues that are looked at together.
AT_ONCE = 1 << 20
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, source string, sequence_id bigint, offset bigint, ids binary"
_encoders: dict = {}


def encoder(path: str):
    """The worker's encoder of a tokenizer file: its tables and a bounded number of words stay with the worker."""
    if path not in _encoders:
        from quill.llm.tokens import Encoder

        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Schedule:
    """By phase: its first slot, its slots; and by phase and queue: ids served before and in it."""

    first: np.ndarray
    slots: np.ndarray
    before: np.ndarray
    served: np.ndarray
    slot_ids: int

    @classmethod
    def of(cls, totals: np.ndarray, weights: np.ndarray | None = None, sequence: int = SEQUENCE) -> Schedule:
        """weights: target proportions; none: those of the totals, so that all queues end together."""
        left = totals.astype(object)
        share = totals.astype(float) if weights is None else weights.astype(float)
        wide = sequence * max(1, -(-int(totals.sum()) // (sequence << 31)))  # products below stay in 64 bits
        first, slots, before, served, at = [], [], [], [], 0
        while sum(left):
            open_ = np.array([x > 0 for x in left])
            rate = np.where(open_, share, 0)
            if not rate.sum():
                rate = np.where(open_, [float(x) for x in left], 0)
            until = min(float(x) / r for x, r in zip(left, rate, strict=True) if r > 0)
            now = [min(x, int(round(until * r))) if r > 0 else 0 for x, r in zip(left, rate, strict=True)]
            now = [x if r > 0 and float(x) / r <= until * (1 + 1e-12) else n for x, r, n in zip(left, rate, now, strict=True)]
            n = max(1, -(-sum(now) // wide))
            first.append(at)
            slots.append(n)
            before.append([t - x for t, x in zip(totals.tolist(), left, strict=True)])
            served.append(now)
            left = np.array([x - y for x, y in zip(left, now, strict=True)], object)
            at += n
        shape = (len(first), len(totals))
        return cls(np.array(first, np.int64), np.array(slots, np.int64), np.array(before, np.int64).reshape(shape), np.array(served, np.int64).reshape(shape), wide)

    def upto(self, phase: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Ids of every queue that are served before slot x of the phase: (slots, queues)."""
        n, w = self.served[phase], self.slots[phase][:, None]
        return self.before[phase] + n // w * x[:, None] + n % w * x[:, None] // w

    def places(self, queue: int, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slices of a range of a queue: their first ids, lengths, and places in the stream of all ids."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for p in range(len(self.first)):
            low, high = max(start, int(self.before[p, queue])), min(start + length, int(self.before[p, queue] + self.served[p, queue]))
            if low >= high:
                continue
            n, w, base = int(self.served[p, queue]), int(self.slots[p]), int(self.before[p, queue])
            a, b = (((r + 1) * w - 1) // n for r in (low - base, high - 1 - base))
            step = max(1, AT_ONCE // self.served.shape[1])
            for k in range(a, b + 1, step):  # some slots at a time, so that long documents take no more memory
                x = np.arange(k, min(k + step, b + 1) + 1)
                ids = self.upto(np.full(len(x), p), x)
                cut = np.clip(ids[:, queue], low, high)
                grants = ids[1:, :queue] - ids[:-1, :queue]
                place = ids[:-1].sum(axis=1) + grants.sum(axis=1) + cut[:-1] - ids[:-1, queue]
                keep = cut[1:] > cut[:-1]
                found.append((cut[:-1][keep], (cut[1:] - cut[:-1])[keep], place[keep]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


    def at(self, queue: int, ids: np.ndarray) -> np.ndarray:
        """Places in the stream of all ids of single ids of a queue."""
        out = np.zeros(len(ids), np.int64)
        for p in range(len(self.first)):
            n, w, base = int(self.served[p, queue]), int(self.slots[p]), int(self.before[p, queue])
            own = np.flatnonzero((ids >= base) & (ids < base + n))
            if not len(own):
                continue
            x = np.array([((r - base + 1) * w - 1) // n for r in ids[own].tolist()], np.int64)
            phase = np.full(len(own), p)
            low, high = self.upto(phase, x), self.upto(phase, x + 1)
            out[own] = low.sum(axis=1) + (high - low)[:, :queue].sum(axis=1) + ids[own] - low[:, queue]
        return out


def interleaved(members: np.ndarray, q: int, start: int, length: int) -> np.ndarray:
    """Places in a shared queue of a range of ids of its q-th member: by progress, then by member."""
    n, found = int(members[q]), []
    small = 4 * n * int(members.max()) < 1 << 62
    totals = members if small else members.astype(object)
    later = (np.arange(len(members)) >= q).astype(np.int64)
    step = max(1, (1 << 20) // len(members))
    for low in range(start, start + length, step):
        r = np.arange(low, min(low + step, start + length))
        odd = (2 * r + 1) if small else (2 * r + 1).astype(object)
        found.append(((odd[:, None] * totals + n - later) // (2 * n)).sum(axis=1).astype(np.int64))
    return np.concatenate(found)


@dataclass
class Plan:
    """The schedule of the queues; by source its queue and, in a shared one, its number there; members' totals by shared queue."""

    schedule: Schedule
    queue: dict[str, tuple[int, int]]
    members: dict[int, np.ndarray]

    @classmethod
    def of(cls, totals: dict[str, int], weights: dict[str, float] | None, sequence: int, queues: int) -> Plan:
        own, shared = list(totals), []
        if len(totals) > queues:
            weighted = [s for s in totals if (weights or {}).get(s, 0.0) > 0]
            rest = sorted(totals.keys() - set(weighted), key=lambda s: (-totals[s], s))
            large, small = rest[: queues // 2], rest[queues // 2 :]
            own = weighted + large
            dealt = max(1, queues - queues // 2)
            shared = [small[k::dealt] for k in range(min(dealt, len(small)))]
        queue = {s: (i, 0) for i, s in enumerate(own)}
        queue |= {s: (len(own) + k, m) for k, names in enumerate(shared) for m, s in enumerate(names)}
        members = {len(own) + k: np.array([totals[s] for s in names], np.int64) for k, names in enumerate(shared)}
        sums = np.array([totals[s] for s in own] + [int(m.sum()) for m in members.values()], np.int64)
        share = None if weights is None else np.array([weights.get(s, 0.0) for s in own] + [0.0] * len(members))
        return cls(Schedule.of(sums, share, sequence), queue, members)

    def places(self, source: str, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Schedule.places``, of a range of a source."""
        queue, m = self.queue[source]
        if queue not in self.members:
            return self.schedule.places(queue, start, length)
        place = self.schedule.at(queue, interleaved(self.members[queue], m, start, length))
        first = np.flatnonzero(np.diff(place, prepend=-2) != 1)
        return first + start, np.diff(first, append=length), place[first]


def tokenized(docs: DataFrame, tokenizer: str, source: str = "source") -> DataFrame:
    """doc_id, source, part, before (ids of its queue ahead of it in its part), n, ids; written to the shared folder."""
    name = F.coalesce(F.col(source).cast("string"), F.lit("")) if source in docs.columns else F.lit("")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = np.dtype("<u2") if enc.size <= 1 << 16 else np.dtype("<u4")
        part, ahead = TaskContext.get().partitionId(), {}
        for batch in it:
            for b in steps(batch, "text", 1 << 20):
                ids, counts = enc.encode([t or "" for t in b.column("text").to_pylist()])
                stops = np.cumsum(counts)
                full = np.insert(ids, stops, END_ID).astype(kind)
                stops = stops + np.arange(1, len(stops) + 1)
                sources, before = b.column("source").to_pylist(), []
                for s, n in zip(sources, counts, strict=True):
                    before.append(ahead.get(s, 0))
                    ahead[s] = before[-1] + int(n) + 1
                offsets = np.concatenate([[0], stops * kind.itemsize]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(full.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([part] * len(stops), pa.int32()), pa.array(before, pa.int64()), pa.array(counts + 1, pa.int64()), data], ["doc_id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), name.alias("source"))
    return written(rows.mapInArrow(lean(batches), "doc_id bigint, source string, part int, before bigint, n bigint, ids binary"), "tokens")[0]


def pack(docs: DataFrame, tokenizer: str | None = None, weights: dict[str, float] | None = None, source: str = "source", sequence: int = SEQUENCE, queues: int = QUEUES) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, source): each id of each document in exactly one.

    ``ids`` are little-endian unsigned 32-bit. Sequences are ``sequence`` ids without gaps; only
    the last one may be shorter. ``weights`` are target proportions by source; sources without one
    are served when those with one have ended. With more than ``queues`` sources those with a weight
    and the largest others have queues of their own and the rest share some. Null text: the end id
    alone. A null source counts as an empty one, as does a missing column. Null or repeated doc_ids
    stay rows of their own. Other columns are not read. An empty table gives no pieces.
    """
    rows = tokenized(docs, tokenizer or default_tokenizer(), source)
    spark = rows.sparkSession
    parts = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases, _ = written(parts.withColumn("base", ahead), "bases")
    totals = {r["source"]: r["n"] for r in bases.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()}
    plan = Plan.of(totals, weights, sequence, queues)
    wide = np.dtype("<u4")
    shared_plan = spark.sparkContext.broadcast(plan)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared_plan.value
        fields = [f.split()[0] for f in PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for b in it:
            out, held = [], 0
            for doc_id, name, start, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "start", "n", "ids")), strict=True):
                own = np.frombuffer(ids, np.dtype("<u2") if len(ids) == 2 * n else wide).astype(wide)
                for first, size, place in zip(*(c.tolist() for c in plan.places(name, start, n)), strict=True):
                    while size:
                        take = min(size, sequence - place % sequence)
                        piece = own[first - start : first - start + take].tobytes()
                        out.append((doc_id, first - start, take, n, name, place // sequence, place % sequence, piece))
                        held += len(piece)
                        first, size, place = first + take, size - take, place + take
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], fields)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], fields)

    placed = rows.join(bases.select("part", "source", "base"), ["part", "source"]).select("doc_id", "source", (F.col("base") + F.col("before")).alias("start"), "n", "ids")
    return placed.mapInArrow(lean(batches), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary, pieces in order), length."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(ordered, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
