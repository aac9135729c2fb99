"""Shingles of ASCII words over flat byte arrays: hashes, sets, digests and sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; temporaries take some tens of times as much.
STEP_BYTES = 1 << 20
#: Entries of the table that words are counted in (a power of two), whatever the corpus.
COUNTERS = 1 << 20
_A, _LETTERS = np.uint8(97), np.uint8(26)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    """Fixed odd numbers for 0 to n - 1."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_VALUES, _FACTORS = _numbers(256, 1), _numbers(64, 2)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text or binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most STEP_BYTES of text, or one row."""
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STEP_BYTES, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of a-z of every row, and each row's count; rows end with something else."""
    data, offsets = flat(column)
    letter = (data - _A) < _LETTERS
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    start, stop = edges[::2], edges[1::2]
    length = stop - start
    ends, out, i = np.cumsum(length), np.empty(len(start), np.uint64), 0
    while i < len(start):
        done = ends[i] - length[i]
        j = max(i + 1, int(np.searchsorted(ends, done + STEP_BYTES, "right")))
        own, first = length[i:j], ends[i:j] - length[i:j] - done
        codes = _VALUES[data[start[i] : stop[j - 1]][letter[start[i] : stop[j - 1]]]]
        codes *= _numbers(int(own.max()), 3)[np.arange(len(codes)) - np.repeat(first, own)]
        out[i:j] = mixed(np.add.reduceat(codes, first) + own.astype(np.uint64))
        i = j
    return out, np.diff(np.searchsorted(start, offsets))


def counted(hashes: np.ndarray) -> np.ndarray:
    """How many words each entry of the table counts."""
    return np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)


def sets(hashes: np.ndarray, counts: np.ndarray, n: int, loads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and load of the distinct shingles of n words, by row and in it by load and hash.

    The load (a byte) is the least of its words', 0 without ``loads``; a row of fewer words has no shingle.
    """
    m = max(0, len(hashes) - n + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = row[:m] == row[n - 1 : n - 1 + m]
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc += hashes[k : k + m] * _FACTORS[k]
    row, item = row[:m][whole], mixed(acc[whole])
    load = np.zeros(len(row), np.uint8)
    if loads is not None and m:
        own = loads[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
        load = np.min([own[k : k + m] for k in range(n)], axis=0)[whole]
    order = np.argsort(load.astype(np.uint64) << np.uint64(56) | item >> np.uint64(8))
    # rows of a step are few: 16 bits are put in order by digits
    order = order[np.argsort(row[order].astype(np.uint16 if len(counts) <= 1 << 16 else np.int64), kind="stable")]
    row, item, load = row[order], item[order], load[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[new], item[new], load[new]


def digests(row: np.ndarray, item: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's set its size, 128 bits that equal sets share, and its least hash; zeros where it is empty."""
    size = np.bincount(row, minlength=rows)
    some = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[some]
    out = np.zeros((3, rows), np.uint64)
    if len(some):
        out[0, some] = np.add.reduceat(mixed(item + _FACTORS[62]), first)
        out[1, some] = np.add.reduceat(mixed(item ^ _FACTORS[63]), first)
        out[2, some] = np.minimum.reduceat(item, first)
    return size, *out.view(np.int64)


def sketches(row: np.ndarray, item: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each row's set the parity of the hashes that end alike, a bit for each ending.

    There are as many bits as the power of two that is not below the size, 64 at least. Two sets differ in as many
    members at least as their sketches differ in bits.
    """
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64))
    begin = np.cumsum(width) - width
    at = begin[row] + (item & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little")
    offsets = np.append(begin, width.sum()) // 8
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits sketches differ; of two lengths the longer one is folded."""
    (left, at), (right, to) = flat(x), flat(y)
    left, right, at, to = left.view(np.uint64), right.view(np.uint64), at // 8, to // 8
    n, m = np.diff(at), np.diff(to)
    out = np.zeros(len(n), np.int64)
    for a, b in set(zip(n.tolist(), m.tolist(), strict=True)):
        same, w = np.flatnonzero((n == a) & (m == b)), min(a, b)
        for k in range(0, len(same), most := max(1, STEP_BYTES // max(a, b))):
            rows = same[k : k + most]
            p, q = left[at[rows][:, None] + np.arange(a)], right[to[rows][:, None] + np.arange(b)]
            p, q = (np.bitwise_xor.reduce(z.reshape(len(rows), -1, w), axis=1) for z in (p, q))
            out[rows] = np.bitwise_count(p ^ q).sum(axis=1)
    return out


def overlaps(sets_: list[np.ndarray]) -> np.ndarray:
    """How many members each two of some sets share, as a square; its diagonal means nothing."""
    m = len(sets_)
    row = np.repeat(np.arange(m), [len(x) for x in sets_])
    ids, column, times = np.unique(np.concatenate([np.zeros(0, np.int64), *sets_]), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    code = np.full(len(ids), -1)
    code[common] = np.arange(len(common))
    code = code[column]
    row, code = row[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((m, m), np.int64)
    for low in range(0, len(common), 1024):
        part = slice(*np.searchsorted(code, (low, low + 1024)))
        x = np.zeros((m, 1024), np.float32)
        x[row[part], code[part] - low] = 1
        both += (x @ x.T).astype(np.int64)
    return both
