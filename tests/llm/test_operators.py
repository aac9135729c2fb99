"""The operators against plain Python versions, on texts with nulls, blanks, repeats and ties."""

import hashlib
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

ROWS = brute.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).withColumns({"n_lines": F.lit(9), "c": F.lit("x"), "d": F.lit(1)}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return brute.frame(spark, [])


def test_lines(docs, empty):
    from quill.llm.lines import line_dedup

    got = {r[0]: tuple(r)[1:] for r in line_dedup(docs, batches=5).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()}
    assert got == brute.lines(ROWS)
    assert line_dedup(empty).count() == 0


def test_repeats(docs, empty):
    from quill.llm.repeats import without_repeats

    got = {r[0]: tuple(r)[1:] for r in without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == brute.repeats(ROWS)
    assert without_repeats(empty).count() == 0


def test_repeats_inside_documents_across_batches(spark):
    from quill.llm.repeats import without_repeats

    rng = np.random.default_rng(5)
    fresh = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    a, b = fresh(300), fresh(150)
    texts = {-3: b + fresh(90), 1: "a" * 5000, 2: "a" * 6000, 3: fresh(80) + a + fresh(70), 4: a + fresh(60) + a + fresh(90) + a + b + fresh(55) + a, 5: b + a[:120] + fresh(65) + b + b + "a" * 200, 6: (b + fresh(60)) * 4}
    rows = [(i, t) for i, t in texts.items()]
    want = brute.repeats(rows)
    spread = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (1, 3, 10000):  # rows of an Arrow batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            out = without_repeats(spread.coalesce(1)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r[0]: tuple(r)[1:] for r in out} == want


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quill.llm.packing import pack

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in ROWS}
    pieces, places = {}, set()
    for r in pack(docs, sequence=64).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["offset"] + r["length"] <= 64
        assert zlib.crc32(r["ids"]) == brute.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places |= {(r["sequence_id"], r["offset"] + k) for k in range(r["length"])}
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    total = sum(map(len, ids.values()))
    assert places == {(k // 64, k % 64) for k in range(total)}
    assert pack(empty).count() == 0


def test_packing_of_many_sources(spark):
    from quill.llm.packing import Plan, pack

    rng = np.random.default_rng(8)
    rows = [(i, " ".join("w" + str(x) for x in rng.integers(0, 99, 40)), f"site{i % 30}" if i % 3 else "big") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    for weights in (None, {"site4": 3.0, "site7": 1.0}):
        got = pack(docs, weights=weights, sequence=64, queues=8).collect()
        assert {r["doc_id"]: r["source"] for r in got} == {i: s for i, _, s in rows}
        n = {r["doc_id"]: r["doc_tokens"] for r in got}
        own = sorted((r["doc_id"], r["start"] + k) for r in got for k in range(r["length"]))
        assert own == sorted((i, k) for i in n for k in range(n[i]))
        at = {r["sequence_id"] * 64 + r["offset"] + k: r["source"] for r in got for k in range(r["length"])}
        assert sorted(at) == list(range(sum(n.values())))
        stream = [at[k] for k in range(len(at))]
        if weights:  # the two alone until the first ends, three to one
            head = stream[:64]  # slots are somewhat shorter than windows here
            assert abs(head.count("site4") - 48) <= 2 and head.count("site4") + head.count("site7") == 64
    # proportions of every source hold in every part of the stream, in shared queues too
    totals = {f"s{i}": 1000 - 7 * i for i in range(40)}
    plan = Plan.of(totals, None, 512, 8)
    assert max(len(m) for m in plan.members.values()) > 3
    every = np.zeros(sum(totals.values()), int)
    place = {}
    for s, t in totals.items():
        cuts = [plan.places(s, a, min(333, t - a)) for a in range(0, t, 333)]
        own = np.concatenate([np.arange(p, p + k) for c in cuts for _, k, p in zip(*c, strict=True)])
        every[own] += 1
        assert (np.diff(own) > 0).all()
        place[s] = own
    assert (every == 1).all()
    for s, t in totals.items():
        progress = np.abs(place[s] / len(every) - (np.arange(t) + 0.5) / t)
        assert progress.max() < 512 / len(every) + 2 / t


def test_packing_targets():
    from quill.llm.packing import Schedule

    totals = np.array([5000, 900, 4000])
    plan = Schedule.of(totals, np.array([0.5, 0.2, 0.3]), 100)
    seen, first = np.zeros(int(totals.sum()), int), np.zeros(3)
    for q in range(3):
        for a, n, p in zip(*plan.places(q, 0, int(totals[q]))):
            seen[p : p + n] += 1
            first[q] += max(0, min(p + n, 4000) - p)
    assert (seen == 1).all() and np.abs(first / 4000 - [0.5, 0.2, 0.3]).max() < 0.01


def test_tokens_equal_the_tokenizers():
    import public_tokenizers

    from quill.llm.tokens import Encoder

    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for _, t, *_ in ROWS] + ["<|endoftext|> hi", "it's WE'LL", "İstanbul ΟΔΟΣ", "日本 café", "a_b 4½", "x" * 300, "\x1c\x85 b"]
    ids, counts = e.encode(texts)
    stops = np.cumsum(counts)
    assert [ids[s - n : s].tolist() for s, n in zip(stops, counts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("few", "small", "dense"), [(1, 1, 0), (2, 1, 99)])
def test_jaccard(docs, empty, monkeypatch, few, small, dense):
    from quill.llm import jaccard

    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "ROUNDS", 1 if small == 1 else 6)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar_documents(docs, 30).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute.components(ROWS, 30)
    assert jaccard.similar_documents(empty).count() == 0


def test_leaks(spark, docs, empty):
    from quill.llm.leaks import decontaminate

    items = [(i, t) for i, t, *_ in ROWS[:6]] + [(900, "end."), (901, None), (902, "w1 w2"), (903, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate(docs, bench).collect()}
    assert got == brute.leaks(ROWS, items)
    assert decontaminate(empty, bench).count() == 0


def test_language(spark, docs, empty):
    from quill.llm.language import label, language_id, train

    texts = {"en": "the house of the mother and the water was there", "de": "das Haus der Mutter und das Wasser war dort nicht", "ru": "дом матери и вода была там"}
    rows = [(k, texts[lang], lang, "a") for k, lang in enumerate(list(texts) * 20)]
    model = train(brute.frame(spark, rows))
    mixed = brute.frame(spark, [(1, texts["en"] + " " + texts["de"] + " " + texts["ru"], None, "a"), (2, None, None, "a"), (3, "123 ²!", None, "a"), (4, "ДОМ матери", None, "a")])
    got = {r["doc_id"]: r for r in label(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de", "ru"]
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] == "ru"
    assert language_id(empty).count() == 0
    assert language_id(docs).count() == len(ROWS)


def test_html():
    from quill.llm.htmltext import Model, extract

    model = Model.of({})
    page = "<header><nav><a href=x>Home</a></nav></header><article><h1>Title</h1><p>One &amp; <b>two</b>.<p>Three</article><div class=comments><p>Nice</p></div><script>x='<p>'</script>"
    assert extract(model, page)[0] == "Title One & two. Three"
    for odd in ("", "<", "<p", "<<>>", "<a href='", "</p></p>", "<div>" * 2000, "<!-- open"):
        extract(model, odd)


def test_transport(docs, empty):
    from quill.llm.transport import demux, media_columns, mux, padded

    for n in (0, 1, 64, 180, 184, 353, 5000, 64_001):
        raw = bytes(k % 251 for k in range(n))
        s = demux(mux(padded(raw)))
        assert b"".join(u[2] for u in s.units[0x100]) == padded(raw) and not (s.gaps or s.lost_sync or s.bad_tables)
    broken = bytearray(mux(bytes(5000)))
    del broken[188 * 6 : 188 * 7]
    assert demux(bytes(broken)).gaps == 1
    got = {r["doc_id"]: r for r in media_columns(docs).collect()}
    for i, t, *_ in ROWS:
        p = padded((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len((t or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media_columns(empty).count() == 0


def test_warc(spark):
    from quill.llm.warc import warc_round_trip

    big, same = "x" * 200_000, "y" * 1000
    rows = [(1, "u", big), (2, "u", same), (3, None, same), (9, "u", same), (4, "u", None), (5, "u", ""), (6, "u", "é" * 499), (7, "u", "é" * 499)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["intact"]) for r in warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        refers = 9 if i in (2, 3) else None
        assert got[i] == ("revisit" if refers else "response", refers, len(b), hashlib.sha1(b).hexdigest(), True)


def test_quality(spark, empty):
    from quill.llm.quality import label_model, quality

    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    votes = np.stack([np.where(rng.random(4000) < p, good, ~good).astype(int) for p in (0.9, 0.8, 0.7)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, right, share = label_model(patterns, counts)
    assert abs(share - 0.8) < 0.06 and np.all(np.diff(right) < 0)
    clean = [(k, f"This is sentence number {k} of a plain text. It has words, and it ends here.", "en", "a") for k in range(60)]
    junk = [(100 + k, " ".join(f"a{k}%%%" for _ in range(40)), "en", "a") for k in range(20)]
    got = {r["doc_id"]: r["keep"] for r in quality(brute.frame(spark, clean + junk + [(500, None, None, None)])).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)
    assert quality(empty).count() == 0


def test_flat_handles_slices():
    from quill.llm.shared import flat

    a = pa.array(["ab", None, "", "é"]).slice(1)
    data, offsets = flat(a)
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 0, 2]


def test_runs_are_joined_where_they_lie(spark):
    import io
    from contextlib import redirect_stdout

    from quill.llm.lines import anti_joined
    from quill.llm.shared import Bucketed, partitions

    keys = spark.range(1000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("owner"))
    runs = [Bucketed.of(keys.where(F.col("owner") % 3 == k).select("h1", "h2").repartition(partitions(spark), "h1", "h2"), "run", "h1", "h2") for k in (0, 1)]
    out = anti_joined(keys.groupBy("h1", "h2").agg(F.min("owner").alias("owner")), [r.table() for r in runs])
    told = io.StringIO()
    with redirect_stdout(told):
        out.explain()
    assert told.getvalue().count("Exchange hashpartitioning") == 1 and told.getvalue().count("SortMergeJoin") == 2
    assert sorted(r["owner"] for r in out.where("new").collect()) == [k for k in range(1000) if k % 3 == 2]
    for r in runs:
        r.drop()


def test_windows_hold_the_targets(spark):
    from quill.llm.packing import pack

    rows = [(i, "word " * 40, "abc"[i % 3]) for i in range(120)] + [(None, None, None), (None, "x", "a"), (5, "word " * 40, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = pack(docs, weights={"a": 0.5, "b": 0.3, "c": 0.2}, sequence=256).collect()
    assert sum(r["length"] for r in got) == sum(len(t.split()) + 1 if t else 1 for _, t, _ in rows)
    first = {s: sum(r["length"] for r in got if r["sequence_id"] < 8 and r["source"] == s) / (8 * 256) for s in "abc"}
    assert all(abs(first[s] - w) < 0.01 for s, w in {"a": 0.5, "b": 0.3, "c": 0.2}.items())
    for k in range(8):  # each of them, too
        assert all(abs(sum(r["length"] for r in got if r["sequence_id"] == k and r["source"] == s) / 256 - w) < 0.03 for s, w in {"a": 0.5, "b": 0.3, "c": 0.2}.items())


def test_schedule_in_parts(monkeypatch):
    from quill.llm import packing

    plan = packing.Schedule.of(np.array([50_000, 7_000, 43_000]), None, 128)
    whole = plan.places(0, 1234, 40_000)
    monkeypatch.setattr(packing, "AT_ONCE", 50)
    assert all((a == b).all() for a, b in zip(whole, plan.places(0, 1234, 40_000), strict=True))
