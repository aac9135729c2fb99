"""Export of reviewed records against a plain pass in the order of ids."""

import random
import re
import unicodedata

import pytest

from quill.operators import export as E


def plain(records, reviews):
    seen, want = {}, set()
    last = {}
    for r in sorted(reviews, key=lambda r: r[1]):
        last[r[0]] = r
    for i, revision, split, pixels, had, has in sorted(records):
        r = last.get(i)
        if r is None or r[3] not in ("approve", "correct") or not r[4] or r[2] != revision:
            want.add((i, "not_human_approved_or_stale", None, None))
        elif split != "train":
            want.add((i, "protected_" + (split or "unknown"), None, None))
        elif had is not None and had != has:
            want.add((i, "changed_asset", None, None))
        else:
            text = re.sub(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "[EMAIL]", " ".join(unicodedata.normalize("NFC", r[5] or "").split()))
            first = seen.setdefault((text, pixels), i)
            want.add((i, None, None, text) if first == i else (i, "true_exact_text_and_image_duplicate", first, None))
    return want


def test_region_export(spark):
    rng = random.Random(8)
    texts = ["one", " one\n", "é two", "é two", "to a.b+c@d-e.org now", "to x@y.vn now", "", None, "long " * 30_000]
    records = [(i, rng.choice([1, 2, None]), rng.choice(["train"] * 6 + ["test", None]), rng.choice(["p", "q", None]), rng.choice(["h", "h", None]), rng.choice(["h"] * 5 + ["g", None])) for i in range(400)]
    reviews = [(i, n, rng.choice([1, 1, 2, None]), rng.choice(["approve", "correct", "approve", "reject", None]), rng.choice([True, True, True, False, None]), rng.choice(texts)) for i in range(430) for n in range(rng.randint(0, 3))]
    r = spark.createDataFrame(records, "id long, revision int, split string, pixels string, had string, has string").withColumn("text", E.F.lit("clash"))
    v = spark.createDataFrame(reviews, "id long, seq int, revision int, decision string, verified boolean, text string")
    got = {tuple(x) for x in E.region_export(r, v, [("had", "has")]).collect()}
    want = {x for x in plain(records, reviews)}
    assert got == want and len({x[1] for x in got}) == 6
    assert E.region_export(r.limit(0), v, []).count() == 0
    assert {x["reason"] for x in E.region_export(r, v.limit(0), []).collect()} == {E.NOT_APPROVED}
    with pytest.raises(Exception, match="changed asset of record"):
        E.region_export(r, v, [("had", "has")], strict=True).collect()
