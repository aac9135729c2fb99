"""Plain Python versions of the operators' results, and a fixture of odd documents."""

import hashlib
import random
import re
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def documents(seed=5, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "and", "über", "Straße", "maison", "ÉCOLE", "x1", "end.", "niño", "very", "long"] + [f"w{i}" for i in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) for _ in range(60)]
    rows = []
    for k in range(n):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))
        rows.append((k * 7 + 3, text, rng.choice(["en", "de", "fr"]), rng.choice(["a", "a", "a", "b", "c", None])))
    base = rows[0][1]
    rows += [(1, None, "en", "a"), (2, "", None, "b"), (5000, "   \n\t", "en", None), (5001, base, "en", "a"), (5002, base + " tail", "en", "a"), (5003, "a" * 5000, "de", "b"), (5004, "12345 !!!", "en", "c"), (5005, "z" * 49, "en", "c"), (5006, "Word", "en", "c")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def lines(rows, least=10):
    key = lambda x: x.strip(BLANK).translate(LOW)
    owner = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            owner[key(x)] = min(i, owner.get(key(x), i))
    out = {}
    for i, t, *_ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < least or owner[key(x)] == i]
        out[i] = (len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def repeats(rows, n=50):
    seen, out = {}, {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]] = min(i, seen.get(b[p : p + n], i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        lost = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] < i:
                lost[p : p + n] = b"\1" * n
        out[i] = (len(b), sum(lost), len(re.findall(b"\1+", bytes(lost))), hashlib.sha256(bytes(x for x, gone in zip(b, lost) if not gone)).hexdigest())
    return out


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, similarity=75):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), root(i)) for i in ids}


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def leaks(rows, items, n=10):
    windows = {}
    for item, t in items:
        w = leak_words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = {}
    for i, t, *_ in rows:
        w, hit, found = leak_words(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= own
        out[i] = (len(w), len(hit), sorted(found))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
