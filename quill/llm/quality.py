"""Quality of documents without gold labels: a weak-label model, then a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing. Expectation-maximisation over the counts
of vote patterns estimates each labeller's accuracy and the share of good documents; the posterior
of each pattern is a soft label. On a bounded sample of documents these labels train a logistic
scorer of hashed words and shape features, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.llm.shared import Rolling, flat, lean, steps, written

BITS = 16
#: Documents that the scorer is trained on, at most: those of the smallest hashes of doc_id.
TRAIN_ROWS = 20_000
SHARDS, EPOCHS, BATCH, RATE = 8, 15, 16, 0.5
LABELLERS = ("symbols", "table_marks", "capitals", "shouting", "adjacent_repeats", "few_distinct", "sentences", "plain")
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower and non-ASCII, 2 capital, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 line feed
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 11, 12, 13]], _CLASS[[46, 44, 59, 58, 39, 45, 34, 40, 41, 63]] = 2, 3, 4, 5
_CLASS[[33, *range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)]], _CLASS[10] = 6, 7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rolling: list[Rolling] = []


class Shapes:
    """Per row of a text column: rates that the labellers look at, and hashed features in rows."""

    def __init__(self, column: pa.Array):
        if not _rolling:
            _rolling.append(Rolling(13))
        data, offsets = flat(column)
        n, kind = len(offsets) - 1, _CLASS[data]
        rows = np.repeat(np.arange(n), np.diff(offsets))
        count = np.bincount(rows * 8 + kind, minlength=n * 8).reshape(n, 8)
        self.size = np.diff(offsets)
        shown = np.maximum(1, self.size - count[:, 4] - count[:, 7])
        letters = np.maximum(1, count[:, 1] + count[:, 2])
        blank = (kind == 4) | (kind == 7)
        inside = ~blank
        before, after = np.concatenate([[False], inside[:-1]])[: len(data)], np.concatenate([inside[1:], [False]])[: len(data)]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.words = np.diff(np.searchsorted(start, offsets))
        hashed = _rolling[0].ranges(_rolling[0].sums(_LOWER[data]), start, stop)
        self.row = np.repeat(np.arange(n), self.words)
        order = np.lexsort((hashed, self.row))
        new = np.ones(len(order), bool)
        new[1:] = (self.row[order][1:] != self.row[order][:-1]) | (hashed[order][1:] != hashed[order][:-1])
        some = np.maximum(1, self.words)
        twice = (hashed[1:] == hashed[:-1]) & (self.row[1:] == self.row[:-1])
        self.adjacent = np.bincount(self.row[1:][twice], minlength=n) / some
        self.symbols, self.capitals = count[:, 6] / shown, count[:, 2] / letters
        self.distinct = np.bincount(self.row[order][new], minlength=n) / some
        self.mean_word = (count[:, 1] + count[:, 2]) / some
        pipes, bangs = data == 124, data == 33
        self.pipes, self.bangs = np.bincount(rows[pipes], minlength=n) / some, np.bincount(rows[bangs], minlength=n) / some
        self.stops = np.bincount(rows[data == 46], minlength=n) / some
        self.hashed = (hashed >> np.uint64(64 - BITS)).astype(np.int64)

    def votes(self) -> np.ndarray:
        """(rows, labellers): 1 good, 0 bad, 2 nothing. Most can only object, and overlap in what they object to."""
        against = lambda bad: np.where(bad, 0, 2)
        some = self.words >= 8
        return np.stack([
            against(self.symbols > 0.05),
            against(self.pipes > 0.02),
            against((self.capitals > 0.30) & some),
            against(self.bangs > 0.05),
            against((self.adjacent > 0.10) & some),
            against((self.distinct < 0.40) & some),
            np.where((self.stops < 0.02) & (self.words >= 40), 0, np.where((self.stops > 0.03) & (self.stops < 0.30), 1, 2)),
            np.where((self.symbols < 0.02) & (self.capitals < 0.20) & (self.distinct > 0.50), 1, 2),
        ], axis=1)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, hashed feature and value; the words of a row weigh 1 together, shape bins 1 each."""
        n = len(self.size)
        values = 1.0 / np.maximum(1, self.words)[self.row]
        cuts = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
        shapes = [np.searchsorted(cuts, x) for x in (self.symbols, self.capitals, self.distinct, self.adjacent, self.mean_word / 20, self.pipes, self.bangs, self.stops)]
        shapes.append(np.log2(self.words + 1).astype(np.int64))
        bins = np.concatenate([(np.int64(k) * 64 + x) * 2654435761 % (1 << BITS) for k, x in enumerate(shapes)])
        return np.concatenate([self.row, np.tile(np.arange(n), len(shapes))]), np.concatenate([self.hashed, bins]), np.concatenate([values, np.ones(n * len(shapes))])


def _codes(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(votes.shape[1])


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern, accuracies of labellers where they vote, and the share of good.

    ``patterns``: (patterns, labellers) of votes. Starts from the majority; a labeller's chances of
    each vote given the truth are re-estimated with one smoothing count each.
    """
    vote = np.stack([(patterns == v) for v in (0, 1, 2)], axis=2).astype(float)
    good, bad = vote[:, :, 1].sum(axis=1), vote[:, :, 0].sum(axis=1)
    p = (good + 1) / (good + 4 * bad + 2)
    for _ in range(rounds):
        share = ((p * counts).sum() + 1) / (counts.sum() + 2)
        chance = []
        for weight in (counts * (1 - p), counts * p):
            c = np.einsum("p,plv->lv", weight, vote) + 1
            chance.append(c / c.sum(axis=1, keepdims=True))
        logs = [np.einsum("plv,lv->p", vote, np.log(c)) for c in chance]
        x = logs[1] + np.log(share) - logs[0] - np.log(1 - share)
        fresh = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        if np.abs(fresh - p).max() < 1e-9:
            p = fresh
            break
        p = fresh
    right = np.stack([chance[0][:, 0] / (chance[0][:, 0] + chance[0][:, 1]), chance[1][:, 1] / (chance[1][:, 0] + chance[1][:, 1])]).mean(axis=0)
    return p, right, float(share)


def voted(docs: DataFrame) -> DataFrame:
    """A row per vote pattern: code and count, over all documents."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in it:
            for b in steps(batch, "text"):
                total += np.bincount(_codes(Shapes(b.column("text")).votes()), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["code", "n"])

    return docs.select("text").mapInArrow(lean(batches), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors by code, weights of the scorer with its bias last, labellers' accuracies.

    The label model counts all documents. The scorer is trained on at most ``most`` of them, those of
    the smallest hashes of id and text, whatever ids repeat or are null, in ``SHARDS`` parts whose
    weights are averaged.
    """
    rows = voted(docs).collect()  # at most 3 ** labellers rows
    codes, counts = (np.array([r[c] for r in rows], np.int64) for c in ("code", "n"))
    posteriors = np.full(3 ** len(LABELLERS), 0.5)
    if not len(codes):
        return posteriors, np.zeros((1 << BITS) + 1), np.full(len(LABELLERS), 0.5)
    posteriors[codes], right, _ = label_model(codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, counts)
    spark = docs.sparkSession
    shared, order = spark.sparkContext.broadcast(posteriors), F.xxhash64("doc_id", "text")
    bound = docs.select(order.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]

    def fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in it:
            for b in steps(batch, "text"):
                s = Shapes(b.column("text"))
                row, feature, value = s.features()
                order = np.argsort(row, kind="stable")
                label = shared.value[_codes(s.votes())]
                cuts = np.searchsorted(row[order], np.arange(0, len(label) + BATCH, BATCH))
                parts.append((row[order], feature[order], value[order], label, cuts))
        if not parts:
            return
        w, bias, squared = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-6)
        for _ in range(EPOCHS):
            for row, feature, value, label, cuts in parts:
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    r, f, v, y = row[i:j] - k * BATCH, feature[i:j], value[i:j], label[k * BATCH : (k + 1) * BATCH]
                    x = np.bincount(r, weights=w[f] * v, minlength=len(y)) + bias
                    error = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - y
                    used, at = np.unique(f, return_inverse=True)
                    step = np.bincount(at, weights=error[r] * v) / len(y)
                    squared[used] += step**2
                    w[used] -= RATE * step / np.sqrt(squared[used])
                    bias -= RATE * error.mean()
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(p[3]) for p in parts)], pa.int64()), pa.array([np.append(w, bias).tobytes()], pa.binary())], ["n", "weights"])

    # rows of one hash are equal: any of them will do where the bound parts them
    sample = docs.where(order <= bound).select("text").limit(most).repartition(SHARDS)
    shards = written(sample.mapInArrow(lean(fitted), "n bigint, weights binary"), "quality-weights")[0].collect()  # SHARDS rows of fixed size
    n = np.array([r["n"] for r in shards], float)
    return posteriors, np.average([np.frombuffer(r["weights"]) for r in shards], axis=0, weights=n), right


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and votes, posterior (of the label model), quality (of the scorer), keep.

    Null texts are empty; empty ones are scored like any other. Equal texts get equal scores.
    Columns of these names are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("votes", "posterior", "quality", "keep")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    posteriors, weights, _ = train(rows)
    shared = docs.sparkSession.sparkContext.broadcast((posteriors, weights))
    schema = T.StructType([*docs.schema.fields, T.StructField("votes", T.LongType()), T.StructField("posterior", T.DoubleType()), T.StructField("quality", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posteriors, w = shared.value
        for batch in it:
            for b in steps(batch, "text"):
                s = Shapes(b.column("text"))
                codes = _codes(s.votes())
                row, feature, value = s.features()
                x = np.bincount(row, weights=w[feature] * value, minlength=b.num_rows) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes), pa.array(posteriors[codes]), pa.array(score), pa.array(score >= least)], [f.name for f in schema.fields])

    return docs.mapInArrow(lean(batches), schema)
