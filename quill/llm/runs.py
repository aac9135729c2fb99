"""Periodic runs of words by Lyndon arrays (the linear-time runs of Ellert and Fischer).

The next smaller suffix of a position ends the longest Lyndon word that starts there. A run has, under
one of the two orders of its words, Lyndon roots: positions whose longest Lyndon word has the run's
period and is followed by itself. Both arrays come from one scan each that compares words only. A
comparison begins where others show it to: the suffixes on the chain of previous smaller ones share
what their neighbours share, and inside the furthest match so far the earlier copy's results hold.

A task reads whole texts, one step of bytes after another; a text is one row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quill.llm.shared import flat, lean, steps

#: A run has at least so many words, and so many times its period.
LEAST, PERIODS = 24, 3
#: Longer stretches keep their arrays as plain numbers, which take less memory and a little more time.
FEW = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lyndon(word: list[int], told: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Of each position of ``word`` the next smaller suffix and how much the two have in common.

    ``word`` ends with a letter below all others, that it has once. ``told`` gets the count of
    comparisons of letters, for tests.
    """
    n = len(word) - 1
    held = (lambda x: [x] * n) if n <= FEW else (lambda x: array("i", [x]) * n)
    nss, common, pss, before = held(n), held(0), held(-1), held(0)
    edge = box = shift = seen = 0  # word[box:edge] is also at box - shift
    for i in range(1, n):
        j, size = i - 1, 0
        top = top_at = -1
        while True:
            if i + size < edge:  # what the copy of i was compared with
                k = i - shift
                q = j - shift if j >= box else j
                z = -1
                if 0 <= q < k:
                    if nss[q] == k:
                        z = common[q]
                    elif pss[k] == q:
                        z = before[k]
                if z >= 0:
                    z = min(z, edge - i)
                    if z > size:
                        size = z
            begun = size
            while word[j + size] == word[i + size]:
                size += 1
            seen += size - begun + 1
            if size > top:
                top, top_at = size, j
            if word[j + size] < word[i + size]:
                pss[i], before[i] = j, size
                break
            nss[j], common[j] = i, size
            j, shared = pss[j], before[j]
            while j >= 0 and shared > size:  # it differs from i where the one before did
                nss[j], common[j] = i, size
                j, shared = pss[j], before[j]
            if j < 0:
                break
            if shared < size:  # it differs from i as from the one before
                pss[i], before[i] = j, shared
                break
        if i + top > edge:
            edge, box, shift = i + top, i, i - top_at
    if told is not None:
        told.append(seen)
    return nss, common


def runs(letters: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` letters and ``periods`` (two or more) times their period."""
    found = set()
    for order in (letters + 1, letters.max(initial=0) + 1 - letters):
        word = np.append(order, 0)
        word = word.tolist() if len(word) <= FEW else array("i", word.astype(np.int32).tobytes())
        nss, common = (np.asarray(x) for x in lyndon(word))
        period = nss - np.arange(len(nss))
        # of the roots of a run the first one counts: less than a period of the run comes before it
        for j in np.flatnonzero((common + 2 * period - 1 >= np.maximum(least, periods * period)) & (common >= period * (periods - 2))).tolist():
            p, left = int(period[j]), 0
            while left < p and left < j and word[j - left - 1] == word[j - left - 1 + p]:
                left += 1
            length = left + p + int(common[j])
            if left < p and length >= max(least, periods * p):
                found.add((j - left, length, p))
    return found


def _stretches(codes: np.ndarray, counts: np.ndarray, least: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """(row, from, to): the stretches of words that can hold a run. In a run each word comes as often as its periods, so rarer ones end it."""
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(rows * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    r, c = rows[order], codes[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    often = np.zeros(len(order), bool)
    often[order] = (np.bincount(group) >= periods)[group] if len(order) else False
    starts = often.copy()
    starts[1:] &= ~often[:-1] | (rows[1:] != rows[:-1])
    ends = often.copy()
    ends[:-1] &= ~often[1:] | (rows[1:] != rows[:-1])
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    wide = b - a >= least
    yield from zip(rows[a[wide]].tolist(), a[wide].tolist(), b[wide].tolist(), strict=True)


def _found(column: pa.Array, least: int, periods: int) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """The runs of each text in order, and the texts collapsed: the words that are left, one blank between them."""
    data, offsets = flat(column)
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    size, letters = stop - start, data[inside]
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    each = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    codes = pc.dictionary_encode(each).indices.to_numpy().astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    gone = np.zeros(len(size) + 1, np.int32)
    for row, i, j in _stretches(codes, np.diff(first), least, periods):
        for s, length, p in runs(np.unique(codes[i:j], return_inverse=True)[1], least, periods):
            out[row].append((int(s + i - first[row]), length, p))
            gone[s + i + p] += 1
            gone[s + i + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    size, letters = size[kept], letters[np.repeat(kept, size)]
    rows = np.repeat(np.arange(len(out)), np.diff(first))[kept]
    # a blank before each word that is not the first of its text
    lead = np.ones(len(size), np.int64)
    lead[:1] = 0
    lead[1:] = rows[1:] == rows[:-1]
    joined = np.full(int((size + lead).sum()), 32, np.uint8)
    joined[np.arange(len(letters)) + np.repeat(np.cumsum(lead), size)] = letters
    ends = np.zeros(len(out) + 1, np.int64)
    ends[1:] = np.cumsum(np.bincount(rows, weights=size + lead, minlength=len(out)).astype(np.int64))
    text = pa.Array.from_buffers(pa.large_string(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(joined)])
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out], text


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def periodic_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """All columns of ``docs``, and runs (an array of start, length and period in words, by start, then period) and collapsed.

    Words are what lies between white space [\\x20\\x09-\\x0D], as they are written. A run is a stretch
    of words with the smallest period q, of at least ``least`` words and ``periods`` times q (two at
    least), that no neighbouring word prolongs. collapsed holds the words, one blank between them,
    without those that any run contains after its first period.

    Null texts, texts without words and short ones have no runs. Each row stands for itself: null or
    repeated ids and equal rows change nothing. A text of any length is taken whole, in memory of a
    fixed number of bytes a word. Columns of docs of these names are replaced. An empty table gives
    an empty one.
    """
    rows = docs.drop("runs", "collapsed")
    schema = T.StructType([*rows.schema.fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for b in steps(batch, "text"):
                found, text = _found(b.column("text"), least, periods)
                flat_runs = [r for x in found for r in x]
                s, length, p = (pa.array([r[k] for r in flat_runs], pa.int64()) for k in range(3))
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                made = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([s, length, p], fields=list(kind.value_type)), type=kind)
                yield pa.RecordBatch.from_arrays([*b.columns, made, text.cast(pa.string())], [*b.schema.names, "runs", "collapsed"])

    return rows.mapInArrow(lean(batches), schema)
