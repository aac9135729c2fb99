"""Loss encoding of conversations against the tokenizer over each whole conversation, and faults."""

import hashlib
import os

import pytest

from quill.catalog import QUERIES

DIR = "/root/testdata/sf0.001"
END = "<|endoftext|>"
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))


@pytest.fixture(scope="module")
def conversations(spark):
    out = {}
    for r in spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    return out


def whole(tokenizer, turns, every):
    """Ids and labels of a conversation encoded as one text: a label where a token lies in a target's characters."""
    text, targets = "", []
    for k, (_, role, said) in enumerate(turns):
        text += ("\n" if k else "") + f"### {role}\n"
        if role == "assistant" and (every or k == len(turns) - 1):
            targets.append((len(text), len(text) + len(said) + len(END)))
        text += said + END
    e = tokenizer.encode(text, add_special_tokens=False)
    return e.ids, [i if any(a <= s and t <= b for a, b in targets) else -100 for i, (s, t) in zip(e.ids, e.offsets, strict=True)]


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def test_turns_add_up_to_the_conversation(spark, tokenizer, conversations):
    from quill.operators.loss import encoded_turns

    for every in (False, True):
        rows = encoded_turns(spark.read.parquet(f"{DIR}/conversations.parquet"), str(public.path("byte_bpe_50k.json")), every).orderBy("conv_id", "turn").collect()
        got = {}
        for r in rows:
            ids, labels = got.setdefault(r["conv_id"], ([], []))
            assert r["start"] == len(ids)
            ids += r["ids"]
            labels += r["labels"]
        assert {c: whole(tokenizer, t, every) for c, t in conversations.items()} == got


def test_mask_query(spark, tokenizer, conversations):
    got = {r["conv_id"]: r for r in QUERIES["arr_loss_mask_tokens"][0](spark, DIR).collect()}
    for c, turns in conversations.items():
        ids, labels = whole(tokenizer, turns, True)
        roles = [r for _, r, _ in turns]
        body = roles[1:] if roles[0] == "system" else roles
        order = len(body) % 2 == 0 and body == ["user", "assistant"] * (len(body) // 2) and bool(body)
        n = sum(x != -100 for x in labels)
        assert (got[c]["tokens"], got[c]["supervised"], got[c]["masked"]) == (len(ids), n, len(ids) - n)
        assert got[c]["spans"] == roles.count("assistant") and got[c]["valid"] == order and got[c]["suffix"] == (roles[-1] == "assistant")


def test_padding_query(spark, tokenizer, conversations):
    rows = QUERIES["arr_pad_tokens"][0](spark, DIR).collect()
    batches = {}
    for r in rows:
        batches.setdefault(r["batch"], []).append(r)
    for own in batches.values():
        encoded = {r["conv_id"]: whole(tokenizer, conversations[r["conv_id"]], False) for r in own}
        width = -(-max(len(ids) for ids, _ in encoded.values()) // 8) * 8
        for r in own:
            ids, labels = encoded[r["conv_id"]]
            more = width - len(ids)
            assert (r["width"], r["tokens"], r["attended"]) == (width, len(ids), len(ids))
            assert (r["ids_sha256"], r["labels_sha256"]) == (digest(ids + [50256] * more), digest(labels + [-100] * more))
    assert rows and all(len(b) == 8 for n, b in batches.items() if n < max(batches))


def test_faults(spark):
    from quill.operators.loss import encoded_turns, mask_stats

    rows = [
        (1, 0, "user", "Good day"), (1, 1, "assistant", "Good day to you"),
        (2, 0, "assistant", "I begin"), (2, 1, "user", "You do"),
        (3, 0, "user", f"an end {END} inside"), (3, 1, "assistant", "   "),
        (4, 0, "user", "one"), (4, 0, "user", "two"), (4, 1, "tool", "x"), (4, 2, "assistant", None),
        (5, 0, "user", "why"), (5, 1, "assistant", "\n\nbecause"),
        (None, 0, "user", "who"), (None, 1, "assistant", "nobody"),
    ]
    encoded = encoded_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4), str(public.path("byte_bpe_50k.json")))
    got = sorted(((r["conv_id"] or 9, r["turn"], r["reason"]) for r in encoded.collect()), key=str)
    assert got == [(1, 0, None), (1, 1, None), (2, 0, "order"), (2, 1, "order"), (3, 0, "reserved_marker"), (3, 1, "empty"), (4, 0, "repeated_turn"), (4, 0, "repeated_turn"), (4, 1, "unknown_role"), (4, 2, "empty"), (5, 0, None), (5, 1, "token_over_the_border"), (9, 0, None), (9, 1, None)]
    assert {r["conv_id"]: r["valid"] for r in mask_stats(encoded).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, None: True}
    assert encoded_turns(spark.createDataFrame([], "conv_id int, turn int, role string, text string"), str(public.path("byte_bpe_50k.json"))).count() == 0
