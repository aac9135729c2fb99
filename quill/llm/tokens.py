"""Token ids of whole texts by a public tokenizer file, with a vectorised path for word-end BPE.

The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``. For a
lower-casing BPE with word ends, texts of plain Latin letters are split into words as byte arrays,
each word of at most ``SHORT`` bytes is looked up by these bytes, and each distinct word is merged
once, all new words of a step together, in numpy. What holds another character, a special token or
a very long word goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Texts on the fast path have these characters alone; U+0130 lower-cases to two.
PLAIN = re.compile("[\t\n\x0b\x0c\r -~À-įı-ɏ]*")
CHUNK = re.compile("[\t\n\x0b\x0c\r ]+")
SHORT, LONGEST = 16, 48
#: Words that are kept with their ids before the cache starts anew: some 100 MB.
CACHED = 1_500_000
SLOTS = 22
FAST_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for a chunk that is not plain among the bytes of plain ones.
ODD = 1
SPACE, LETTER, OTHER, ALONE = range(4)


def _kinds() -> np.ndarray:
    """Kind of each byte of a lower-case plain text; bytes of letters beyond ASCII are letters."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[0, 9, 10, 11, 12, 13, 32]] = SPACE
    kinds[97:123] = kinds[128:] = LETTER
    kinds[48:58] = kinds[ODD] = ALONE
    return kinds


KINDS = _kinds()
#: By length, the bytes of a 64-bit value that a word of it fills.
FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words, as FAST_SPLIT has them, of lower-case plain text that ends in two zeros."""
    kinds = KINDS[data]
    sign = np.flatnonzero(data[:-1] == 0xC3)
    sign = sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]  # of the bytes of letters, × and ÷ are none
    kinds[sign] = kinds[sign + 1] = OTHER
    edge = kinds == ALONE
    edge[1:] |= kinds[1:] != kinds[:-1]
    edge[0] = True
    mark = np.flatnonzero((data == 39) & edge)
    a, b = data[mark + 1], data[mark + 2]
    two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    three = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    edge[mark[two | three] + 1] = False
    edge[mark[two] + 2] = edge[mark[three] + 3] = True
    at = np.flatnonzero(edge)
    own = np.flatnonzero(kinds[at[:-1]] != SPACE)
    return at[own], at[own + 1]


def _byte_chars() -> list[str]:
    """The printable stand-ins of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


class Ranks:
    """(left, right) -> rank and merged id, in two tables that need one look each."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, bits: int = 20):
        self.shift, keys, self.merged = np.uint64(64 - bits), left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), merged
        rng = np.random.default_rng(7)
        while True:
            self.factors, self.keys, self.ranks, open_ = [], [], [], np.arange(len(keys))
            for _ in range(2):
                factor = rng.integers(1 << 62, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                at = (keys[open_] * factor) >> self.shift
                _, first = np.unique(at, return_index=True)
                table, rank = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, len(keys), np.int32)
                table[at[first]], rank[at[first]] = keys[open_[first]], open_[first]
                open_ = np.delete(open_, first)
                self.factors.append(factor)
                self.keys.append(table)
                self.ranks.append(rank)
            if not len(open_):
                return

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(key.shape, len(self.merged), np.int32)
        for factor, table, rank in zip(self.factors, self.keys, self.ranks, strict=True):
            at = (key * factor) >> self.shift
            hit = table[at] == key
            out[hit] = rank[at[hit]]
        return out


class Encoder:
    """Ids of texts. One lives in a Python worker and keeps the words it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = None
        self.size = self.tokenizer.get_vocab_size()
        if self._word_ends(spec):
            vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
            self.ranks = Ranks(*(np.array([vocab[x(a, b)] for a, b in pairs], np.int64) for x in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b)))
            chars = _byte_chars()
            self.inner, self.final = (np.array([vocab[c + end] for c in chars], np.int64) for end in ("", "</w>"))
            self._clear()

    @staticmethod
    def _word_ends(spec: dict) -> bool:
        model, before, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        split = (before.get("pretokenizers") or [{}])[0]
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        return model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges") and split.get("pattern", {}).get("Regex") == FAST_SPLIT and kinds == ["NFC", "Replace", "Lowercase"]

    def _clear(self) -> None:
        self.other: dict[str, int] = {}
        self.n, self.ids, self.offsets = 0, np.zeros(1024, np.int32), np.zeros(1024, np.int64)
        self.one, self.two, self.slots = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.full(1 << SLOTS, -1, np.int32)

    def merged(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words, rows of SHORT bytes that zeros fill up, all merged together."""
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, SHORT)):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(own):
                continue
            raw = words[own, :high]
            sym, n = self.inner[raw], lengths[own].copy()
            rows = np.arange(len(own))
            sym[rows, n - 1] = self.final[raw[rows, n - 1]]
            place, done = np.arange(high), np.zeros((len(own), high), np.int64)
            active = rows
            while len(active):
                rank = self.ranks.of(sym[:, :-1], sym[:, 1:])
                rank[place[1 : sym.shape[1]] >= n[:, None]] = len(self.ranks.merged)
                best = rank.min(axis=1)
                over = best == len(self.ranks.merged)
                if over.any():
                    done[active[over]] = np.pad(sym[over], ((0, 0), (0, high - sym.shape[1])))
                    counts[own[active[over]]] = n[over]
                    active, sym, n, rank, best = active[~over], sym[~over], n[~over], rank[~over], best[~over]
                    if not len(active):
                        break
                join = rank == best[:, None]
                for j in range(1, join.shape[1]):
                    join[:, j] &= ~join[:, j - 1]
                sym[:, :-1][join] = np.repeat(self.ranks.merged[best], join.sum(axis=1))
                keep = place[: sym.shape[1]] < n[:, None]
                keep[:, 1:] &= ~join
                n = n - join.sum(axis=1)
                to = np.cumsum(keep, axis=1) - 1
                fresh = np.zeros((len(active), max(2, int(n.max()))), np.int64)
                r, c = np.nonzero(keep)
                fresh[r, to[r, c]] = sym[r, c]
                sym, place = fresh, np.arange(high)
            found.append((own, done))
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for own, done in found:
            inside = np.arange(done.shape[1]) < counts[own][:, None]
            ids[((ends[own] - counts[own])[:, None] + np.arange(done.shape[1]))[inside]] = done[inside]
        return ids, counts

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of words with these ids."""
        n, used = self.n + len(counts), int(self.offsets[self.n])
        self.ids, self.offsets = _grown(self.ids, used + len(ids)), _grown(self.offsets, n + 1)
        self.ids[used : used + len(ids)] = ids
        self.offsets[self.n + 1 : n + 1] = used + np.cumsum(counts)
        numbers = np.arange(self.n, n)
        self.n = n
        return numbers

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.offsets[at]
        sizes = self.offsets[at + 1] - first
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def _slot(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mix = (one ^ (two * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _known(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers of short words by their bytes; -1 for new ones."""
        at = self._slot(one, two)
        out = self.slots[at]
        open_ = np.flatnonzero((self.one[out] != one) | (self.two[out] != two) | (out < 0))
        while len(open_):
            got = out[open_]
            same = (self.one[got] == one[open_]) & (self.two[got] == two[open_]) & (got >= 0)
            open_ = open_[~same & (got >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << SLOTS) - 1)
            out[open_] = self.slots[at[open_]]
        return out

    def _learn(self, one: np.ndarray, two: np.ndarray) -> None:
        """Merge new short words and put them where they are looked up."""
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        keep = np.ones(len(one), bool)
        keep[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        one, two = one[keep], two[keep]
        raw = np.stack([one, two], axis=1).astype("<u8").view(np.uint8)
        numbers = self._add(*self.merged(raw, np.count_nonzero(raw, axis=1)))
        self.one, self.two = _grown(self.one, self.n), _grown(self.two, self.n)
        self.one[numbers], self.two[numbers] = one, two
        at, left = self._slot(one, two), np.arange(len(one))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = numbers[free]
            left = left[self.slots[at[left]] != numbers[left]]
            at[left] = (at[left] + 1) & ((1 << SLOTS) - 1)

    def _other(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Numbers of long words and of chunks that are not plain; the last numbers are of very long ones, which are not kept after the step."""
        new = list({w for w in words if len(w) <= LONGEST}.difference(self.other))
        slow = new + list({w for w in words if len(w) > LONGEST})
        got = [e.ids for e in self.tokenizer.encode_batch(slow, add_special_tokens=False)]
        numbers = self._add(np.array([x for g in got for x in g], np.int32), np.array([len(g) for g in got], np.int64)).tolist()
        self.other.update(zip(new, numbers, strict=False))
        brief = dict(zip(slow[len(new) :], numbers[len(new) :], strict=True))
        return np.array([brief[w] if len(w) > LONGEST else self.other[w] for w in words], np.int64), len(brief)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each text's count."""
        if self.ranks is None:
            got = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *got]), np.array([len(g) for g in got], np.int64)
        if self.n > CACHED or self.offsets[self.n] > 8 * CACHED:
            self._clear()
        odd: list[str] = []
        lines: list[bytes] = []
        for t in texts:
            if not PLAIN.fullmatch(t) or "<|" in t:
                chunks = CHUNK.split(t)
                strange = [not PLAIN.fullmatch(c) or "<|" in c for c in chunks]
                odd += [c for c, x in zip(chunks, strange, strict=True) if x]
                t = " ".join(chr(ODD) if x else c for c, x in zip(chunks, strange, strict=True))
            lines.append(t.lower().encode())
        data = np.frombuffer(b"\n".join(lines) + bytes(SHORT), np.uint8)
        starts, ends = words_at(data)
        numbers, eights = np.zeros(len(starts), np.int64), np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
        for k in range(0, len(starts), 1 << 18):  # some words at a time, so that long documents take no more memory
            first, size = starts[k : k + (1 << 18)], (ends - starts)[k : k + (1 << 18)]
            one, two = eights[first] & FILLED[np.minimum(size, 8)], eights[first + 8] & FILLED[np.clip(size - 8, 0, 8)]
            own = self._known(one, two)
            fresh = np.flatnonzero((own < 0) & (size <= SHORT))
            if len(fresh):
                self._learn(one[fresh], two[fresh])
                own[fresh] = self._known(one[fresh], two[fresh])
            numbers[k : k + (1 << 18)] = own
        strange = data[starts] == ODD
        long = np.flatnonzero((ends - starts > SHORT) & ~strange)
        raw = data.tobytes() if len(long) else b""
        words = odd + [raw[a:b].decode() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        brief = 0
        if words:
            numbers[np.concatenate([np.flatnonzero(strange), long])], brief = self._other(words)
        ids, stops = self._gather(numbers)
        self.n -= brief
        at = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in lines]) if lines else np.zeros(0, np.int64))
        return ids, np.diff(np.concatenate([[0], stops])[at], prepend=0)
