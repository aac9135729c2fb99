"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element is content or not. Its own evidence (tag, names, text length, link density, marks, depth)
multiplies with a potential between parent and child by their kinds of tag; sum-product messages up
and down the tree give exact marginals. Both are counted on labelled pages. These label themselves by
their tags alone, never by names: content is what lies in the one article or main element of a page
and in no nav, aside, footer, form or menu there. What names such as `sidebar` say is counted like any
other evidence; a prior stands in for names that the pages do not show, and gives way to counts.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.llm.shared import lean, written

#: Features of an element that the training pages show less often tell nothing and are left out (moves between kinds always count).
LEAST_COUNT = 3
#: Labelled pages that the model is counted on, at most: those of the smallest hashes of page_id.
TRAIN_PAGES = 2000
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup, and those of which no text is ever shown as part of an article.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = RAW | frozenset("head noscript template object svg math select option button canvas audio video map datalist dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input nobr".split())
INLINE_OR_WEAK = INLINE | {"p", "li"}
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table td th caption article main section aside nav header footer form div ul ol dl blockquote template".split())
#: Tags that say by themselves that their inside is no article.
ASIDE = frozenset("nav footer aside form menu fieldset".split())
KINDS = {t: k for k, tags in {"frame": "#root html body", "section": "article main section", "box": "div header figure center", "list": "ul ol li dl dt dd", "table": "table thead tbody tfoot tr td th caption", "text": "p h1 h2 h3 h4 h5 h6 blockquote pre figcaption address hgroup", "aside": " ".join(ASIDE)}.items() for t in tags.split()}
#: Names that pages commonly use, for the prior: of what is no article, and of what is.
FURNITURE = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist cookie cookies consent copyright disclaimer disqus feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary contentinfo alert".split())
ARTICLE = frozenset("article articlebody body content entry main post story text".split())


@dataclass
class Page:
    """Elements in page order, each with its parent, depth and names; runs of text with their element and block.

    Inline elements are no nodes of their own unless they have names: their text is their parent's.
    """

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    shown: list[bool] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)
    linked: dict[int, int] = field(default_factory=dict)

    def add(self, tag: str, parent: int, names: tuple[str, ...], shown: bool) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.shown.append(shown and (parent < 0 or self.shown[parent]))
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return len(self.tags) - 1


def said(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """The names of an element, whole and in parts, and whether it is shown."""
    if not attributes or tag in ("html", "body"):
        return (), True
    names: dict[str, None] = {}
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return (), False
        if name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                parts = [x.lower() for x in NAME_PART.findall(token)]
                if len(parts) == 1:
                    names["is " + parts[0]] = None
                else:
                    names |= dict.fromkeys("has " + x for x in parts)
    return tuple(names), True


def tokens(text: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, stop, whether it ends an element, name (of a comment: empty) and attributes of every tag, in one pass."""
    at, quotes = 0, {'"': True, "'": True}  # whether there may be another one ahead
    last = text.rfind(">")
    while 0 <= (start := text.find("<", at)) < last:
        if text.startswith("<!--", start):
            stop = text.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else len(text)
            yield start, at, False, "", ""
            continue
        if text[start + 1] in "!?":
            at = text.find(">", start) + 1
            yield start, at, False, "", ""
            continue
        end = text[start + 1] == "/"
        m = NAME.match(text, start + 1 + end)
        if not m:
            at = start + 1
            continue
        k = m.end()
        while k <= last:
            k = PLAIN.match(text, k).end()
            if k > last or text[k] == ">":
                break
            quote = text[k]
            close = text.find(quote, k + 1) if quotes[quote] else -1
            quotes[quote] = close >= 0
            k = close + 1 if 0 <= close < last else k + 1
        if k > last:
            at = start + 1
            last = min(last, start)  # what follows has no end of a tag outside quotes
            continue
        at = k + 1
        yield start, at, end, m[0].lower(), text[m.end() : k]


def parse(text: str) -> Page:
    page, block, at, skip, links = Page(), 0, 0, None, 0
    stack: list[tuple[int, str]] = [(page.add("#root", -1, (), True), "#root")]
    open_: dict[str, list[int]] = {}  # by name, where in the stack it is open
    scopes: list[int] = [0]
    rows: list[int] = [0]  # scopes that are no cells

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            name = stack.pop()[1]
            open_[name].pop()
            links -= name == "a"
            for s in (scopes, rows):
                if s[-1] == len(stack):
                    s.pop()

    def run(piece: str) -> None:
        node = stack[-1][0]
        page.runs.append((node, block, piece))
        if links:
            page.linked[node] = page.linked.get(node, 0) + len(piece.strip())

    for start, stop, end, tag, attributes in tokens(text):
        if skip and not (end and tag == skip):
            continue
        if start > at and not skip:
            run(text[at:start])
        at = stop
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if end:
            skip = None
            if open_.get(tag) and not (tag in INLINE_OR_WEAK and open_[tag][-1] < scopes[-1]):
                close(open_[tag][-1])
            continue
        if tag not in INLINE and tag not in VOID:  # a block ends an open paragraph, and like ends like
            bound = (rows if tag in ENDS else scopes)[-1]
            for x in (*ENDS.get(tag, ()), "p"):
                while open_.get(x) and open_[x][-1] > bound:
                    close(open_[x][-1])
        names, shown = said(tag, attributes)
        shown = shown and tag not in NEVER
        node = page.add(tag, stack[-1][0], names, shown) if tag not in INLINE or names or not shown else stack[-1][0]
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((node, tag))
            open_.setdefault(tag, []).append(len(stack) - 1)
            if tag in SCOPES:
                scopes.append(len(stack) - 1)
                if tag not in ("td", "th"):
                    rows.append(len(stack) - 1)
            links += tag == "a"
            if tag in RAW:
                skip = tag
    if at < len(text) and not skip:
        run(text[at:])
    return page


def evidence(page: Page) -> list[tuple[str, ...]]:
    """The features of every element; lengths, marks and links are those of its kind of tag."""
    n = len(page.tags)
    own, linked, total, marks = [0] * n, [0] * n, [0] * n, [0] * n
    for k, _, run in page.runs:
        own[k] += len(run.strip())
        marks[k] += run.count(".") + run.count(",")
    for k, x in page.linked.items():
        linked[k] = x
    for k in range(n - 1, -1, -1):
        total[k] += own[k]
        if k:
            total[page.parents[k]] += total[k]
            linked[page.parents[k]] += linked[k]
    size = lambda x: "0" if not x else "1" if x < 20 else "2" if x < 80 else "3" if x < 300 else "4"
    out = []
    for k, tag in enumerate(page.tags):
        what, told = kind(tag), ["tag " + tag, f"depth {min(page.depth[k], 12) // 3}"]
        if own[k]:
            told += [f"own {what} {size(own[k])}", f"marks {what} {size(20 * marks[k])}"]
        if total[k]:
            told += [f"all {what} {size(total[k])}", f"links {what} {int(3.99 * linked[k] / total[k])}"]
        out.append((*told, *("name " + x for x in page.names[k])))
    return out


def labels(page: Page) -> list[bool] | None:
    """Content or not by the page's one article, or else its one main element; none if it has neither."""
    at = [k for k, t in enumerate(page.tags) if t == "article"]
    if len(at) != 1:
        at = [k for k, t in enumerate(page.tags) if t == "main"]
    if len(at) != 1:
        return None
    out = [False] * len(page.tags)
    for k in range(1, len(page.tags)):
        out[k] = page.tags[k] not in ASIDE and page.shown[k] and (k == at[0] or out[page.parents[k]])
    return out


#: Counts that stand for what tags say before any page is seen: (feature, not content, content).
PRIOR = [("tag article", 2, 60), ("tag main", 2, 30), ("tag p", 60, 300), *((f"tag h{k}", 40, 150) for k in range(1, 7)), ("tag li", 100, 100), ("tag ul", 100, 100), ("tag div", 300, 300), ("tag section", 50, 50), ("tag header", 80, 20), *((f"tag {t}", 200, 2) for t in sorted(ASIDE)), *((f"links {k} {n}", no, yes) for k in ("box", "list", "text", "table", "other", "section") for n, no, yes in ((0, 50, 200), (1, 60, 60), (2, 100, 10), (3, 200, 4))), *((f"own {k} {n}", no, yes) for k in ("frame", "box", "list", "table", "text") for n, no, yes in ((1, 60, 20), (2, 60, 40), (3, 20, 80), (4, 10, 80)))]
#: Log-odds of a name before any page is seen, whole and as a part of a longer one; they weigh as much as so many elements.
NAMED = {"is": (-7.0, 2.5), "has": (-1.5, 0.5)}
NAME_WEIGHT = 5.0
#: Counts before any page is seen of a child's label (not content, content), by the parent's kind and label.
MOVES = {("frame", 0): (20.0, 10.0), ("box", 0): (150.0, 1.0), ("section", 0): (80.0, 1.5), ("aside", 0): (400.0, 0.2), ("other", 0): (200.0, 0.5)}
STAY = (2.0, 50.0)
#: What a box or section that is no content may still hold: (not content, content).
OPENS = (20.0, 4.0)
#: What counts weigh at most beside the priors, in elements: all features of a sort, and moves of a sort.
MOST, MOST_MOVES = 600, 60
#: Features of one element repeat each other; their log-odds count for so much, those of tags for all.
TEMPER = 0.5
SMOOTH = 4.0


def kind(tag: str) -> str:
    return KINDS.get(tag, "other")


def _move_prior(parent: str, child: str, label: int) -> tuple[float, float]:
    if label:
        return STAY
    if parent in ("box", "section") and child in ("box", "section"):
        return OPENS
    return MOVES.get((parent, 0), MOVES["other", 0])


@dataclass
class Model:
    """Log-odds by feature; chances of a child's label by the kinds of parent and child and the parent's label."""

    odds: dict[str, float]
    moves: dict[tuple[str, str], tuple[tuple[float, float], tuple[float, float]]]

    @classmethod
    def of(cls, counts: dict[tuple[str, int], int]) -> Model:
        table: dict[str, list[float]] = {f: [no, yes] for f, no, yes in PRIOR}
        named: dict[str, list[float]] = {}
        # few templates make many pages: counts keep their proportions, but weigh no more than so many elements
        seen = sum(n for (f, _), n in counts.items() if f.startswith("tag "))
        scale = min(1.0, MOST / max(1, seen))
        for (f, label), n in counts.items():
            if f.startswith("name "):
                named.setdefault(f, [0.0, 0.0])[label] += n
            elif not f.startswith("move "):
                table.setdefault(f, [0.0, 0.0])[label] += n * scale
        odds = {}
        groups: dict[str, dict[str, list[float]]] = {}
        for f, c in table.items():
            groups.setdefault(f.rpartition(" ")[0], {})[f] = c
        for group, own in groups.items():
            sums = [sum(c[y] for c in own.values()) + SMOOTH * (len(own) + 1) for y in (0, 1)]
            weight = 1.0 if group == "tag" else TEMPER
            odds |= {f: weight * (math.log((c[1] + SMOOTH) / sums[1]) - math.log((c[0] + SMOOTH) / sums[0])) for f, c in own.items()}
        # names: what they add to an even chance, in proportion to how often they were seen
        totals = [sum(n for (f, x), n in counts.items() if x == y and f.startswith("tag ")) + 1 for y in (0, 1)]
        for f in {*named, *(f"name {w} {x}" for w in NAMED for x in FURNITURE | ARTICLE)}:
            _, whole, word = f.split(" ", 2)
            before = NAMED[whole][0] if word in FURNITURE else NAMED[whole][1] if word in ARTICLE else 0.0
            no, yes = named.get(f, (0.0, 0.0))
            even = [2 * t / sum(totals) for t in totals]
            learned = math.log((yes + even[1]) / totals[1]) - math.log((no + even[0]) / totals[0])
            odds[f] = (NAME_WEIGHT * before + (no + yes) * learned) / (NAME_WEIGHT + no + yes)
        kinds = sorted({*KINDS.values(), "other"})
        moves = {}
        for a in kinds:
            for b in kinds:
                rows = []
                for x in (0, 1):
                    own = [counts.get((f"move {a} {b} {x}", y), 0) for y in (0, 1)]
                    part = min(1.0, MOST_MOVES / max(1, sum(own)))
                    rows.append([own[y] * part + _move_prior(a, b, x)[y] for y in (0, 1)])
                moves[a, b] = tuple(tuple(v / sum(row) for v in row) for row in rows)
        return cls(odds, moves)

    def local(self, page: Page) -> list[tuple[float, float]]:
        out = []
        for feats in evidence(page):
            x = sum(self.odds.get(f, 0.0) for f in feats)
            p = 1 / (1 + math.exp(-max(-80.0, min(80.0, x))))
            out.append((1 - p, p))
        return out

    def marginals(self, page: Page) -> list[float]:
        """Of content, per element, by one upward and one downward pass of messages."""
        n, kinds = len(page.tags), [kind(t) for t in page.tags]
        local = self.local(page)
        up, message = [list(x) for x in local], [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            a, b = up[k]
            s = a + b
            a, b = a / s, b / s
            p = page.parents[k]
            (m00, m01), (m10, m11) = self.moves[kinds[p], kinds[k]]
            to0, to1 = m00 * a + m01 * b, m10 * a + m11 * b
            message[k] = (to0, to1)
            parent = up[p]
            parent[0] *= to0
            parent[1] *= to1
            s = parent[0] + parent[1]
            if s < 1e-100:
                parent[0] /= s
                parent[1] /= s
            parent[0], parent[1] = max(parent[0], 1e-250), max(parent[1], 1e-250)
        down, out = [ROOT] * n, [0.0] * n
        for k in range(n):
            a, b = up[k]
            if k:
                p = page.parents[k]
                (m00, m01), (m10, m11) = self.moves[kinds[p], kinds[k]]
                pa_, pb = up[p][0] * down[p][0] / message[k][0], up[p][1] * down[p][1] / message[k][1]
                s = pa_ + pb
                pa_, pb = pa_ / s, pb / s
                down[k] = (pa_ * m00 + pb * m10, pa_ * m01 + pb * m11)
            a, b = a * down[k][0], b * down[k][1]
            out[k] = b / (a + b)
        return out


#: Chances of the label of the root.
ROOT = (0.8, 0.2)


def extract(model: Model, text: str, least: float = 0.5) -> tuple[str, list[tuple[str, float]]]:
    """The text of what is content, and its blocks with their marginals."""
    page = parse(text)
    chance = model.marginals(page)
    blocks: dict[int, list] = {}
    for k, block, run in page.runs:
        if chance[k] >= least and page.shown[k]:
            own = blocks.setdefault(block, [[], 1.0])
            own[0].append(html.unescape(run) if "&" in run else run)
            own[1] = min(own[1], chance[k])
    out = [(s, p) for parts, p in blocks.values() if (s := " ".join("".join(parts).split()))]
    return " ".join(s for s, _ in out), out


def counted(pages: Iterator[str]) -> dict[tuple[str, int], int]:
    """Counts of features and moves by label over the pages that label themselves."""
    total: dict[tuple[str, int], int] = {}
    for text in pages:
        page = parse(text)
        own = labels(page)
        if own is None:
            continue
        for k, feats in enumerate(evidence(page)):
            if not page.shown[k]:
                continue
            p = page.parents[k]
            moved = (f"move {kind(page.tags[p])} {kind(page.tags[k])} {int(own[p])}",) if k else ()
            for f in (*feats, *moved):
                total[f, int(own[k])] = total.get((f, int(own[k])), 0) + 1
    return total


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Model:
    """Counts of features and moves by label, over at most ``most`` labelled pages."""
    order = F.xxhash64("page_id", "html")
    bound = pages.where("html is not null").select(order.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            total = counted(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([y for _, y in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["feature", "label", "n"])

    if bound is None:
        return Model.of({})
    sample = pages.where(F.col("html").isNotNull() & (order <= bound)).select("html")
    rows, _ = written(sample.mapInArrow(lean(batches), "feature string, label int, n bigint"), "html-counts")
    return Model.of({(r["feature"], r["label"]): r["n"] for r in rows.groupBy("feature", "label").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT} or feature like 'move %'").collect()})


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``pages`` but html, and text, n_chars, blocks (text, marginal).

    Null or empty html: an empty text. Broken markup is read as far as it goes. Rows that repeat
    are extracted alike. Columns of these names are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages))
    rest = pages.drop("text", "n_chars", "blocks")
    kept = [f for f in rest.schema.fields if f.name != "html"]
    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("marginal", T.DoubleType())])
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("blocks", T.ArrayType(block))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                done = [extract(shared.value, t or "") for t in b.column("html").to_pylist()]
                blocks = pa.array([[{"text": s, "marginal": p} for s, p in x[1]] for x in done], pa.list_(pa.struct([("text", pa.string()), ("marginal", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array([x[0] for x in done], pa.string()), pa.array([len(x[0]) for x in done], pa.int64()), blocks], [f.name for f in schema.fields])

    return rest.mapInArrow(lean(batches), schema)
