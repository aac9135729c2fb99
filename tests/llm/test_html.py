"""Main text of pages: marginals against enumeration, held-out pages without their names, odd and hostile markup."""

import html
import itertools
import re
import time
from collections import Counter

import pytest
from quill.llm import htmltext as ht

PAGES = "/root/testdata/sf0.001/pages.parquet"


def stripped(page):
    return re.sub(r'\s(class|id|role|itemprop)="[^"]*"', "", page)


def told(text):
    """The text of what a page's own tags say is content."""
    page = ht.parse(text)
    own, blocks = ht.labels(page), {}
    for k, block, run in page.runs:
        if own[k] and page.shown[k]:
            blocks.setdefault(block, []).append(html.unescape(run))
    return " ".join(x for v in blocks.values() if (x := " ".join("".join(v).split())))


@pytest.fixture(scope="module")
def pages():
    import pyarrow.parquet as pq

    return [x for x in pq.read_table(PAGES, columns=["html"]).column(0).to_pylist() if x]


@pytest.fixture(scope="module")
def model(pages):
    return ht.Model.of(ht.counted(pages[::2]))


def test_marginals_equal_those_of_all_labellings(model):
    for text in ("<article><h1>A</h1><p>Some text, and more.</p><ul><li><a href=x>b</a></ul></article>", "<body><div class=ad>x</div><p>y", "<nav><a>1</a></nav><table><tr><td>two<td>three"):
        page = ht.parse(text)
        kinds, local = [ht.kind(t) for t in page.tags], model.local(page)
        weight = [0.0] * len(kinds)
        total = 0.0
        for y in itertools.product((0, 1), repeat=len(kinds)):
            x = ht.ROOT[y[0]] * local[0][y[0]]
            for k in range(1, len(kinds)):
                p = page.parents[k]
                x *= model.moves[kinds[p], kinds[k]][y[p]][y[k]] * local[k][y[k]]
            total += x
            weight = [w + x * b for w, b in zip(weight, y, strict=True)]
        assert model.marginals(page) == pytest.approx([w / total for w in weight], abs=1e-9)


def test_held_out_pages_without_names(pages, model):
    hits = got = want = 0
    for text in pages[1::2]:
        a, b = Counter(told(text).split()), Counter(ht.extract(model, re.sub(r"<(/?)(article|main)\b", r"<\1div", stripped(text)))[0].split())
        hits, got, want = hits + sum((a & b).values()), got + sum(b.values()), want + sum(a.values())
        assert ht.extract(model, text)[0] == told(text)
    assert hits / got > 0.99 and hits / want > 0.99


def test_names_do_not_decide_alone(model):
    text = "<article><p>Alpha beta gamma, delta epsilon.</p><p class='share-price'>The share price rose, and it fell after that.</p><section class='related-work'><h2>Related work</h2><p>Others have written of this, at length.</p></section></article>"
    assert "share price" in ht.extract(model, text)[0] and "Others have" in ht.extract(model, text)[0]


def test_pages_of_other_templates(model):
    text = "<body><div id=wrapper><div class=header><a href=x>Home</a></div><div class=sidebar><p>Sign up for our letter, it is free.</p></div><div class=content><h1>Title</h1><p>The first paragraph of the story, which is long enough to be read by somebody.</p><p>The second one, not so long.</p></div><div class=comments><p>I liked this story, thank you very much.</p></div><div class=footer>Copyright us</div></div>"
    assert ht.extract(model, text)[0] == "Title The first paragraph of the story, which is long enough to be read by somebody. The second one, not so long."


@pytest.mark.parametrize("text", ["<a " * 300000, '<a "' * 200000, "<div>" * 10000 + "</span>" * 50000, "<b>" * 20000 + "<p></p>" * 20000, "<!--" * 200000, "<" * 500000, "<table><tr><td>" * 20000, "<x a='" * 100000 + ">", "<a 'b\">" * 50000])
def test_hostile_markup_takes_linear_time(model, text):
    began = time.perf_counter()
    ht.extract(model, text)
    assert time.perf_counter() - began < 20


def test_table(spark):
    rows = [(1, "u", "<article><p>A b</p></article>"), (1, "u", "<article><p>A b</p></article>"), (2, None, None), (3, "u", ""), (None, "u", "<p>" + "Long text, and more of it. " * 40000)]
    pages = spark.createDataFrame([(*r, "clash", 7, [1]) for r in rows], "page_id long, url string, html string, text string, n_chars int, blocks array<int>")
    got = sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in ht.main_text(pages, ht.Model.of({})).collect())
    assert got == [(0, 27 * 40000 - 1, 27 * 40000 - 1), (1, 3, 3), (1, 3, 3), (2, 0, 0), (3, 0, 0)]
    assert ht.main_text(pages.limit(0)).count() == 0
