"""JSON in free text against the standard library's decoder, tried at every brace."""

import json
import random
import time

from quill.functions import recovered as R


def refused(_):
    raise ValueError


def plain(text):
    try:
        json.loads(text, parse_constant=refused)
        return R.STRICT, text
    except ValueError:
        pass
    decoder = json.JSONDecoder(parse_constant=refused)
    for i, c in enumerate(text):
        if c == "{":
            try:
                value, end = decoder.raw_decode(text, i)
            except ValueError:
                continue
            if "q" in value:
                return R.RECOVERED, text[i:end]
    return R.UNPARSEABLE, None


def test_random_texts():
    rng, kinds = random.Random(5), set()
    parts = ["{", "}", "[", "]", ",", ":", '"', "\\", '"q"', '"q":', '"q":1', '{"q":', '{"a":', '\\"', "1", "-", "0", ".5", "e3", "true", "null", "NaN", " ", "\n", "x", "\\u0071", '"\\u0071":', "é", "{}", "[]", '{"q":[]}', '"b":{', "\x01"]
    for _ in range(60_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        got = R.find(text, "q")
        assert got == plain(text), text
        kinds.add(got[0])
    assert len(kinds) == 3


def test_changed_objects():
    rng = random.Random(6)
    for _ in range(3_000):
        inner = {"q": [{"t": "a{b\"}\\", "n": -1.5e3}, None, [True, {}]], "s": json.dumps({"q": 1})}
        text = list("so {x} " + json.dumps({"o": inner} if rng.random() < 0.5 else inner) + " end }")
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice('{}[]",:\\ 1')
        assert R.find("".join(text), "q") == plain("".join(text))


def test_linear():
    n = 60_000
    for text in ("{" * n, '{"a":' * n, '{"' * n, '{"a":"{' * n, '{"a":{"b":"{' * n + "\n", '{"x\\"' * n, "[" * n + '{"a":' * n, '{"a":1}' * n, '{"q ":[' * n):
        start = time.monotonic()
        assert R.find(text, "q")[0] == R.UNPARSEABLE
        assert time.monotonic() - start < 20
    deep = '{"a":' * n + '{"q":0}' + "}" * n
    assert R.find(deep, "q") == (R.STRICT, deep) and R.find("- " + deep, "q") == (R.RECOVERED, '{"q":0}')


def test_column(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, 'x {"q": "é"} y'), (4, ' {"z": 1} '), (5, "x")], "id int, t string")
    got = {r["id"]: (r["r"]["status"], r["r"]["json"]) for r in rows.select("id", R.recovered(R.F.col("t"), "q").alias("r")).collect()}
    assert got == {1: (R.UNPARSEABLE, None), 2: (R.UNPARSEABLE, None), 3: (R.RECOVERED, '{"q": "é"}'), 4: (R.STRICT, ' {"z": 1} '), 5: (R.UNPARSEABLE, None)}
