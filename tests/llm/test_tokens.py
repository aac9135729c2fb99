"""Words of plain text as byte arrays, against the tokenizer's own, and words that are merged once."""

import random

import numpy as np
import public_tokenizers
import pytest


@pytest.fixture
def encoder():
    from quill.llm.tokens import Encoder

    return Encoder(public_tokenizers.path("word_bpe_49k.json"))


def same(encoder, texts):
    ids, counts = encoder.encode(texts)
    wanted = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[s - n : s].tolist() for s, n in zip(np.cumsum(counts), counts, strict=True)] == wanted
    assert len(ids) == sum(map(len, wanted))


def test_letters_that_leave_the_range_in_lower_case(encoder):
    same(encoder, ["Ⱥb cȾ", "ȾȾ", "xȺ's"])


def test_any_mix(encoder, monkeypatch):
    from quill.llm import tokens

    rng = random.Random(5)
    plain = "abcdestrvmlREVSTL''''..!?0123  \n\t×÷éÈßÄǅȾŉ<|>$*_\x0b\r"
    odd = plain + "İ \xa0日本́\x85\x01\x00K"
    texts = ["".join(rng.choices(rng.choice([plain, odd]), k=rng.randint(0, 60))) for _ in range(600)]
    texts += ["a" * n for n in (8, 15, 16, 17, 48, 49, 500)] + ["é" * 8, "é" * 9, "日" * 200, "!" * 50 + "<|endoftext|>abc", "'s's", "''s", "it's'll", ""]
    for _ in range(2):
        same(encoder, texts)
    assert encoder.encode([])[1].tolist() == []
    monkeypatch.setattr(tokens, "CACHED", 50)
    for k in range(0, len(texts), 100):
        same(encoder, texts[k : k + 100])


def test_words_are_merged_once(encoder, monkeypatch):
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{t}." for k in range(17576)) for t in ("", "a", "bc", "def", "xyz", "qu", "zo", "ul", "em", "ri", "on", "ta")]
    encoder.encode(texts[:6])
    encoder.encode(texts[6:])
    monkeypatch.setattr(encoder, "merged", None)
    encoder.encode(texts)
