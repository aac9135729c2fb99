"""Language labels for spans of text: script ranges, per-word scores, Viterbi.

The script of a word's first letter leaves the languages that were seen in that script. A word's
score for a language is the sum of the log-probabilities of its hashed byte trigrams and of the
hashed word itself. Viterbi over the words of a text, with a penalty for each switch, labels them;
runs of one label are spans, and the language of most letters is the text's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.llm.shared import Rolling, flat, lean, steps, written

BITS, SLICES = 15, 32
#: Cost of a switch between two words, in nats; weight of the word itself beside its trigrams.
SWITCH, WORD_WEIGHT = 12.0, 0.5
SMOOTHING = 0.5
#: Rows of more words are labelled by stretches.
LONG = 1024
#: A language keeps a script in which it has at least this share of its words.
SCRIPT_SHARE = 0.01
#: First code points of the scripts' ranges.
SCRIPT_STARTS = np.array([0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
SCRIPT_NAMES = ["Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "other", "Indic", "Thai", "other", "Hangul", "other", "Latin", "Greek", "other", "Kana", "other", "Han", "other", "Hangul", "other"]
_NAMES = sorted(set(SCRIPT_NAMES))
_SCRIPTS = np.array([_NAMES.index(n) for n in SCRIPT_NAMES])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[~_LETTER] = 32
_rolling: list[Rolling] = []


@dataclass
class Words:
    """Words of a step's rows: bytes at which they begin and end, row of each, and their features."""

    start: np.ndarray
    stop: np.ndarray
    counts: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    whole: np.ndarray


def words(column: pa.Array) -> Words:
    if not _rolling:
        _rolling.append(Rolling(11))
    data, offsets = flat(column)
    low = _LOWER[data]
    if len(data) > 1:  # capitals of Latin-1, two bytes each
        caps = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][caps] += 32
    inside = _LETTER[data]
    before, after = np.concatenate([[False], inside[:-1]])[: len(data)], np.concatenate([inside[1:], [False]])[: len(data)]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    left, right = np.concatenate([[32], low[:-1]])[: len(data)], np.concatenate([low[1:], [32]])[: len(data)]
    left[~before], right[~after] = 32, 32
    code = left.astype(np.uint64) << np.uint64(16) | low.astype(np.uint64) << np.uint64(8) | right.astype(np.uint64)
    grams = ((code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
    whole = (_rolling[0].ranges(_rolling[0].sums(low), start, stop) >> np.uint64(64 - BITS)).astype(np.int32)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c = wide[start], wide[start + 1] & 63, wide[start + 2] & 63
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, 0xFFFF)))
    script = _SCRIPTS[np.searchsorted(SCRIPT_STARTS, point, "right") - 1]
    return Words(start, stop, np.diff(np.searchsorted(start, offsets)), script, grams, whole)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray
    whole: np.ndarray
    scripts: np.ndarray
    prior: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        """(words, languages)"""
        first = np.cumsum(w.stop - w.start) - (w.stop - w.start)
        out = np.add.reduceat(self.grams[w.grams], first, axis=0) if len(first) else np.zeros((0, len(self.langs)), np.float32)
        return out + WORD_WEIGHT * self.whole[w.whole] + np.where(self.scripts[w.script], 0, -1e4).astype(np.float32)


def _stretches(scores: np.ndarray, prior: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the words of one long row: its stretches at once, for every label that may come before.

    The first stretch starts from the prior. Of each other stretch the best scores by the label before
    it are known after as many steps as a stretch has words; then one step for each stretch joins them.
    """
    n, langs = scores.shape
    size = int(np.sqrt(n)) + 1
    m = -(-n // size)
    s = np.zeros((m * size, langs), np.float32)
    s[:n] = scores
    s = s.reshape(m, size, langs)
    each = np.arange(langs, dtype=np.int16)
    best = s[:, :1] - switch * (each[:, None] != each)[None].astype(np.float32)
    best[0] = prior + s[0, 0]
    came = np.zeros((size, m, langs, langs), np.int16)
    for k in range(1, size):
        top = best.argmax(axis=2).astype(np.int16)
        jump = np.take_along_axis(best, top[..., None].astype(np.int64), 2) - np.float32(switch)
        stay = best >= jump
        came[k] = np.where(stay, each, top[..., None])
        best = np.where(stay, best, jump) + s[:, k, None]
    total, entered = best[0, 0].astype(np.float64), np.zeros((m, langs), np.int16)
    for k in range(1, m):
        paths = total[:, None] + best[k]
        entered[k] = paths.argmax(axis=0)
        total = paths.max(axis=0)
    last, before = np.zeros(m, np.int64), np.zeros(m, np.int64)
    last[-1] = total.argmax()
    for k in range(m - 1, 0, -1):
        before[k] = last[k - 1] = entered[k, last[k]]
    labels, rows = np.zeros((m, size), np.int16), np.arange(m)
    for k in range(size - 1, -1, -1):
        labels[:, k] = last
        if k:
            last = came[k, rows, before, last].astype(np.int64)
    return labels.reshape(-1)[:n]


def viterbi(scores: np.ndarray, counts: np.ndarray, prior: np.ndarray, switch: float = SWITCH, long: int = LONG) -> np.ndarray:
    """Labels of the words of many rows at once: one step for the k-th word of every row that has one.

    Rows of more than ``long`` words are labelled one by one, their stretches at once.
    """
    wide = np.flatnonzero(counts > long)
    if len(wide):
        first = np.cumsum(counts) - counts
        labels, short = np.zeros(len(scores), np.int16), np.repeat(counts <= long, counts)
        labels[short] = viterbi(scores[short], counts[counts <= long], prior, switch, long)
        for r in wide:
            labels[first[r] : first[r] + counts[r]] = _stretches(scores[first[r] : first[r] + counts[r]], prior, switch)
        return labels
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # rows with more than k words
    came = np.zeros((len(scores), scores.shape[1]), np.int16)
    each = np.arange(scores.shape[1], dtype=np.int16)
    best = prior + scores[first[: active[0]]]
    last = np.zeros(len(order), np.int16)
    for k in range(1, longest):
        n = int(active[k])
        if n < len(best):
            last[n : len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        jump = best[np.arange(n), top] - switch
        stay = best >= jump[:, None]
        at = first[:n] + k
        came[at] = np.where(stay, each, top[:, None].astype(np.int16))
        best = np.where(stay, best, jump[:, None]) + scores[at]
    last[: len(best)] = best.argmax(axis=1)
    for k in range(longest - 1, -1, -1):
        n = int(active[k])
        at = first[:n] + k
        labels[at] = last[:n]
        last[:n] = came[at, last[:n]] if k else last[:n]
    return labels


def train(labelled: DataFrame) -> Model | None:
    """From all rows of ``labelled`` (text, lang); none if there are none."""
    langs = sorted(r["lang"] for r in labelled.where("lang is not null and text is not null").select("lang").distinct().collect())
    if not langs:
        return None
    index = {x: i for i, x in enumerate(langs)}
    size, n = 1 << BITS, len(langs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, whole, scripts, rows = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64), np.zeros((n, len(_NAMES)), np.int64), np.zeros(n, np.int64)
        for batch in it:
            for b in steps(batch, "text"):
                w = words(b.column("text"))
                lang = np.array([index[x] for x in b.column("lang").to_pylist()], np.int64)
                rows += np.bincount(lang, minlength=n)
                of_word = np.repeat(lang, w.counts)
                of_gram = np.repeat(of_word, w.stop - w.start)
                grams += np.bincount(of_gram * size + w.grams, minlength=n * size).reshape(n, size)
                whole += np.bincount(of_word * size + w.whole, minlength=n * size).reshape(n, size)
                scripts += np.bincount(of_word * len(_NAMES) + w.script, minlength=n * len(_NAMES)).reshape(n, -1)
        if rows.any():
            parts = [(f"{t}{k}", x.tobytes()) for t, table in (("g", grams), ("w", whole)) for k, x in enumerate(np.split(table, SLICES, axis=1))] + [("s", scripts.tobytes()), ("r", rows.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts]), pa.array([x for _, x in parts], pa.binary())], ["part", "counts"])

    def added(key, table):
        total = np.sum([np.frombuffer(c.as_buffer(), np.int64) for c in table.column("counts")], axis=0)
        return pa.table({"part": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    counted, _ = written(labelled.where("lang is not null and text is not null").select("text", "lang").mapInArrow(lean(batches), "part string, counts binary"), "language-counts")
    got = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in counted.groupBy("part").applyInArrow(added, "part string, counts binary").collect()}
    logs = []
    for t in "gw":
        table = np.concatenate([got[f"{t}{k}"].reshape(n, -1) for k in range(SLICES)], axis=1).astype(float) + SMOOTHING
        logs.append(np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)))
    scripts = got["s"].reshape(n, -1)
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    allowed[~allowed.any(axis=1)] = True
    rows = got["r"] + 1.0
    return Model(langs, logs[0], logs[1], allowed, np.log(rows / rows.sum()).astype(np.float32))


def _letterless(text: str | None) -> bool:
    return not any(unicodedata.category(c)[0] == "L" for c in text or "")


def label(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (share of the letters), spans (bytes of UTF-8, lang).

    Null texts and texts without a letter are `und` with score 0 and no spans, as is everything
    without a model. Nothing but the text is looked at. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "spans": F.expr("cast(array() as array<struct<start:bigint,stop:bigint,lang:string>>)")})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in it:
            for b in steps(batch, text, (1 << 23) // max(8, len(m.langs))):
                w = words(b.column(text))
                labels = viterbi(m.scores(w), w.counts, m.prior)
                rows = np.repeat(np.arange(b.num_rows), w.counts)
                letters = np.bincount(rows * len(m.langs) + labels, weights=w.stop - w.start, minlength=b.num_rows * len(m.langs)).reshape(b.num_rows, -1)
                top, total = letters.argmax(axis=1), letters.sum(axis=1)
                data, offsets = flat(b.column(text))
                ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
                for i in np.flatnonzero(ascii_letter[offsets[1:]] == ascii_letter[offsets[:-1]]):
                    if _letterless(b.column(text)[int(i)].as_py()):
                        total[i] = 0
                there = total > 0
                score = np.where(there, letters.max(axis=1) / np.maximum(total, 1), 0.0)
                new = np.ones(len(labels), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(new & there[rows])
                ends = np.flatnonzero(np.append(new[1:], True) & there[rows])
                spans = pa.StructArray.from_arrays([pa.array(w.start[at] - offsets[rows[at]]), pa.array(w.stop[ends] - offsets[rows[at]]), pa.array(names[labels[at]], pa.string())], ["start", "stop", "lang"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows[at], minlength=b.num_rows))]), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[np.where(there, top, len(m.langs))], pa.string()), pa.array(score), lists], [f.name for f in schema.fields])

    return docs.mapInArrow(lean(batches), schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``docs`` (doc_id, text, lang) that are not held out, label all rows by their text alone."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return label(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
