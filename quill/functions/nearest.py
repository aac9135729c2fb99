"""The nearest sets of a block, counted together, and how alike names are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms that most asked sets hold are bits of a row; others are lists of the asked sets that hold them.
BITS = 512
#: Asked rows and pairs that are counted at once, places of terms and characters of names likewise, pairs that wait.
STRIP, CELLS, PLACES, CHARS, WAITING = 4096, 1 << 18, 1 << 21, 1 << 20, 1 << 19


def _sets(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Members of all sets, and the size of each."""
    return pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)


def _places(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Places, and which of them are known."""
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


class Counter:
    """How many members each of some asked sets shares with others."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray) -> None:
        self.n, self.sizes = len(sizes), sizes
        self.ids, at, times = np.unique(members, return_inverse=True, return_counts=True)
        self.code = np.empty(len(self.ids), np.int64)
        self.code[np.argsort(-times, kind="stable")] = np.arange(len(self.ids))  # the most common first
        code, row = self.code[at], np.repeat(np.arange(self.n), sizes)
        self.bits = np.ascontiguousarray(self._packed(row, code, self.n).T)
        rare = np.flatnonzero(code >= BITS)
        rare = rare[np.argsort(code[rare], kind="stable")]
        self.holders = row[rare]
        self.first = np.searchsorted(code[rare], np.arange(BITS, max(BITS, len(self.ids)) + 1))

    @staticmethod
    def _packed(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        own, held = code < BITS, np.zeros((n, BITS), bool)
        held[row[own], code[own]] = True
        return np.packbits(held, axis=1).view(np.uint64)

    def coded(self, members: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and code of the members that any asked set holds."""
        at = np.minimum(np.searchsorted(self.ids, members), len(self.ids) - 1)
        known = self.ids[at] == members
        return np.repeat(np.arange(len(sizes)), sizes)[known], self.code[at[known]]

    def shared(self, row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """A row for each of ``n`` sets, a column for each asked one."""
        rare = code >= BITS
        start = self.first[code[rare] - BITS]
        times = self.first[code[rare] - BITS + 1] - start
        ends, base = np.cumsum(times), row[rare] * self.n
        both = np.zeros(n * self.n, np.int64)
        cuts = [0, *np.searchsorted(ends, np.arange(PLACES, ends[-1], PLACES), "right"), len(ends)] if len(ends) else [0]
        for i, j in zip(cuts, cuts[1:], strict=False):  # pieces of few places, however long the sets are
            t = times[i:j]
            own = np.repeat(start[i:j] - np.cumsum(t) + t, t) + np.arange(t.sum())
            both += np.bincount(np.repeat(base[i:j], t) + self.holders[own], minlength=len(both))
        both = both.reshape(n, self.n)
        for word, theirs in zip(self.bits, self._packed(row, code, n).T, strict=True):
            both += np.bitwise_count(theirs[:, None] & word[None, :])
        return both


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between the strings of each pair."""
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    longest, out = np.maximum(na, nb), np.zeros(len(a), np.int64)
    order, i = np.argsort(-longest, kind="stable"), 0
    while i < len(order):
        at = order[i : i + max(1, CHARS // (int(longest[order[i]]) + 1))]
        i += len(at)
        x, y = (np.array([s[k] for k in at] + ["."]).view(np.uint32).reshape(len(at) + 1, -1)[:-1] for s in (a, b))
        places = np.arange(y.shape[1] + 1)
        row = np.broadcast_to(places, (len(at), len(places))).copy()
        done = np.where(na[at] == 0, nb[at], 0)
        for k in range(int(na[at].max(initial=0))):
            new = np.empty_like(row)
            new[:, 0] = k + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (y != x[:, k : k + 1]))
            row = np.minimum.accumulate(new - places, axis=1) + places
            ends = np.flatnonzero(na[at] == k + 1)
            done[ends] = row[ends, nb[at[ends]]]
        out[at] = done
    return out


def names_differ(a: list[str], b: list[str], apart: float) -> np.ndarray:
    """Whether 1 less the edits over the longer name is less than ``apart``; edits are counted where letters alone do not tell."""
    longest = np.array([max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], np.int64)
    letters = [np.bincount(np.repeat(np.arange(len(s)), [len(x) for x in s]) * 32 + np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), np.uint32) % 32, minlength=len(s) * 32).reshape(-1, 32) for s in (a, b)]
    more = letters[0] - letters[1]
    least = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
    out = 1 - least / longest < apart
    open_ = np.flatnonzero(~out)
    out[open_] = 1 - edits([a[k] for k in open_], [b[k] for k in open_]) / longest[open_] < apart
    return out


class Nearest:
    """The ``k`` nearest rows of a block for each asked one of a strip, kept while the block goes by.

    ``asked`` are rows (query_id, slot, name, place, terms) by query and slot: slot 0 is the asked row, later ones
    what was chosen for it. Order is by likeness, nearness of places (unknown ones last) and tie.
    """

    def __init__(self, asked: pa.Table, block: pa.Table, k: int, most: float, apart: float) -> None:
        self.k, self.most, self.apart = k, most, apart
        self.counter = Counter(*_sets(asked.column("terms")))
        slot = asked.column("slot").to_numpy()
        self.heads, self.later = np.flatnonzero(slot == 0), np.flatnonzero(slot)
        self.owner = np.cumsum(slot == 0) - 1
        self.names = asked.column("name").to_pylist()
        self.query_ids = asked.column("query_id").combine_chunks().take(pa.array(self.heads))
        self.index = {x: i for i, x in enumerate(self.query_ids.to_pylist())}
        self.at, self.known = _places(asked.column("place"))
        self.block_at, self.block_known = _places(block.column("place"))
        self.block_names = block.column("name")
        self.tie = np.argsort(np.argsort(np.array(block.column("tie").to_pylist(), "S32"), kind="stable"))
        self.least = np.zeros(len(self.heads))
        none = np.zeros(0, np.int64)
        self.held, self.waiting, self.new = (none, none, np.zeros(0), np.zeros(0, bool)), [], 0

    def see(self, batch: pa.RecordBatch, start: int) -> None:
        """Rows of the block from ``start`` on."""
        members, sizes = _sets(batch.column("terms"))
        row, code = self.counter.coded(members, sizes)
        own = np.array([self.index.get(x, -1) for x in batch.column("key").to_pylist()], np.int64)
        step = max(1, CELLS // self.counter.n)
        for i in range(0, batch.num_rows, step):
            j = min(i + step, batch.num_rows)
            a, b = np.searchsorted(row, [i, j])
            both = self.counter.shared(row[a:b] - i, code[a:b], j - i)
            like = both / (self.counter.sizes[None, :] + sizes[i:j, None] - both)
            mine = like[:, self.heads] if len(self.later) else like
            good = (mine > 0) & (mine <= self.most) & (mine >= self.least)
            if len(self.later):
                r, c = np.nonzero(like[:, self.later] >= self.apart)
                good[r, self.owner[self.later[c]]] = False
            self_ = np.flatnonzero(own[i:j] >= 0)
            good[self_, own[i:j][self_]] = False
            r, q = np.nonzero(good)
            self.waiting.append((q, r + i + start, mine[r, q], np.zeros(len(q), bool)))
            self.new += len(q)
            if self.new > WAITING:
                self.settle()

    def settle(self) -> None:
        """Keep the ``k`` best whose names differ from the asked one's and the chosen ones'."""
        q, row, like, sure = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        self.waiting, self.new = [], 0
        far, unknown = self.far(q, row)
        order = np.lexsort((-self.tie[row], far, unknown, -like, q))
        q, row, like, sure = q[order], row[order], like[order], sure[order]
        keep, found = np.zeros(len(q), bool), np.zeros(len(self.heads), np.int64)
        seen = np.searchsorted(q, np.arange(len(self.heads)))  # each one's next pair to be looked at
        ends = np.searchsorted(q, np.arange(len(self.heads)), "right")
        while True:
            need = np.where(seen < ends, np.minimum(self.k - found, ends - seen), 0)
            if not need.any():
                break
            at = np.repeat(seen - np.cumsum(need) + need, need) + np.arange(need.sum())
            keep[at] = sure[at]
            doubt = at[~sure[at]]
            keep[doubt] = self.differ(q[doubt], row[doubt])
            found += np.bincount(q[at], keep[at], len(found)).astype(np.int64)
            seen = seen + need
        self.held = q[keep], row[keep], like[keep], np.ones(keep.sum(), bool)
        full = np.flatnonzero(found >= self.k)
        last = np.searchsorted(self.held[0], full, "right") - 1
        self.least[full] = self.held[2][last]

    def far(self, q: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = self.heads[q]
        unknown = ~(self.known[heads] & self.block_known[row])
        return np.where(unknown, 0, np.abs(self.block_at[row] - self.at[heads])), unknown

    def differ(self, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        theirs = self.block_names.take(pa.array(row)).to_pylist()
        mine = [self.names[k] for k in self.heads[q]]
        out = np.array([x not in y and y not in x for x, y in zip(mine, theirs, strict=True)], bool)
        ends = np.append(self.heads[1:], len(self.names))
        for slot in range(int((ends - self.heads).max(initial=0))):
            at = np.flatnonzero(out & (self.heads[q] + slot < ends[q]))
            if len(at):
                out[at] = names_differ([self.names[k] for k in self.heads[q[at]] + slot], [theirs[k] for k in at], self.apart)
        return out


def nearest(block: pa.Table, asked: pa.Table, k: int, most: float, apart: float) -> pa.Table:
    """query_id, key, likeness, near (less the distance of places, null where unknown) of the ``k`` nearest rows (key, name, place, tie, terms) of ``block``; see Nearest."""
    asked = asked.sort_by([("query_id", "ascending"), ("slot", "ascending")])
    heads = np.append(np.flatnonzero(asked.column("slot").to_numpy() == 0), asked.num_rows)
    out = []
    for i in range(0, len(heads) - 1, STRIP):
        first, end = heads[i], heads[min(i + STRIP, len(heads) - 1)]
        strip, seen = Nearest(asked.slice(first, end - first), block, k, most, apart), 0
        for b in block.select(["key", "terms"]).to_batches(max_chunksize=2048):
            strip.see(b, seen)
            seen += b.num_rows
        strip.settle()
        q, row, like, _ = strip.held
        far, unknown = strip.far(q, row)
        out.append(pa.table({"query_id": strip.query_ids.take(pa.array(q)), "key": block.column("key").take(pa.array(row)), "likeness": like, "near": pa.array(-far, mask=unknown)}))
    return pa.concat_tables(out)
