"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

A benchmark window is ``WINDOW`` consecutive words of an item. Of each window the two terms that
are rarest in the corpus are looked up: the index has (term, document, position) postings of those
terms. Positions less the term's offset in the window are where the window would start; the starts
that both lists give are compared word by word. Proximity matches start from the three rarest terms;
64 bits beside every posting tell which words may lie around it, so that few places are compared.
Where there are such bits, they stand in for the second list of phrases too.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.shared import dropped, written

WINDOW = 10
#: A proximity match may have so many other words in it, and lack so many terms of the window.
SLACK, MISSING = 4, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, each character by itself: a table look-up to the regular expression, where ranges are comparisons.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def words_of(text):
    text = F.coalesce(text, F.lit(""))
    # of ASCII alone, lower() changes A-Z alone, and takes far less time than translate()
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, BETWEEN, -1), "")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, w (a hash of the window), words: the distinct windows of each item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = items.select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))).alias("start"))
    cut = starts.select("item_id", F.slice("words", F.col("start"), window).alias("words"))
    return cut.select("item_id", F.sha1(F.array_join("words", " ")).alias("w"), "words").distinct()


def _bit(term):
    """One of 64 bits for a term."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(term), F.lit(64)).cast("int"))


def _lacking():
    """How many bits of a window's terms the words around a posting lack."""
    return F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not("around")))


def _surroundings(docs: DataFrame, reach: int) -> DataFrame:
    """d, all (the words), around: for every word the bits of the words less than ``reach`` places away.

    The bits of 2, 4, 8 ... words from each place on are those of half as many from there and from
    behind these; two such stretches that overlap make the width wanted.
    """
    zeros = F.array_repeat(F.lit(0).cast("long"), reach - 1)
    own = docs.select("d", words_of(F.col("text")).alias("all")).select("d", "all", F.concat(zeros, F.transform("all", _bit)).alias("around"))
    width, wanted = 1, 2 * reach - 1
    while width < wanted:
        step = min(width, wanted - width)
        behind = F.slice("around", step + 1, F.greatest(F.lit(0), F.size("around") - step))
        own = own.select("d", "all", F.zip_with("around", behind, lambda x, y: x.bitwiseOR(F.coalesce(y, F.lit(0).cast("long")))).alias("around"))
        width += step
    return own


def _postings(docs: DataFrame, terms: DataFrame, reach: int | None = None) -> DataFrame:
    """term, d, pos of every place of the terms; with ``reach`` also the bits of the words around."""
    if reach is None:
        placed = docs.select("d", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    else:
        each = _surroundings(docs, reach).select("d", F.posexplode(F.arrays_zip("all", F.slice("around", 1, F.size("all")).alias("around"))).alias("pos", "x"))
        placed = each.select("d", "pos", F.col("x.all").alias("term"), F.col("x.around").alias("around"))
    return placed.join(terms, "term")


def _ranked(docs: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """w, len, n_terms, bits (of its terms), rarest: of each window the ``most`` distinct terms (n in the corpus, term, first offset) that the corpus has least often."""
    placed = windows.select("w", "words").distinct().select("w", F.size("words").alias("len"), F.posexplode("words").alias("offset", "term"))
    vocabulary, _ = written(placed.select("term").distinct(), "vocabulary")
    counted = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = written(counted, "term-counts")
    first = placed.groupBy("w", "len", "term").agg(F.min("offset").alias("offset"))
    terms = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")))
    return first.join(counts, "term", "left").groupBy("w", "len").agg(F.count(F.lit(1)).alias("n_terms"), F.bit_or(_bit(F.col("term"))).alias("bits"), F.slice(terms, 1, most).alias("rarest"))


class Index:
    """Windows of a benchmark, their rarest terms, and the postings of those terms in ``docs`` (d, text), written once.

    Phrases need the two rarest terms of a window. With ``slack``, proximity needs the ``missing + 1``
    rarest of those windows that have more, and every posting the bits of the words around it.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None, missing: int = MISSING) -> None:
        self.docs, self.missing, self.reach = docs, missing, None if slack is None else window + slack
        self.windows, _ = written(windows_of(benchmark, window), "windows")
        ranked, _ = written(_ranked(docs, self.windows, 2 if slack is None else max(2, missing + 1)), "ranked")
        # a window with a term that the corpus lacks occurs nowhere
        live = ranked.where(F.col("rarest")[0]["n"] > 0).select("w", "len", "bits", F.col("rarest")[0].alias("one"), F.when(F.size("rarest") > 1, F.col("rarest")[1]).alias("two"))
        self.anchors, _ = written(live.select("w", "len", "bits", F.col("one.term").alias("term"), F.col("one.offset").alias("offset"), F.col("two.term").alias("other"), F.col("two.offset").alias("other_offset")), "anchors")
        terms = self.anchors.select("term")
        if slack is None:
            terms = terms.union(self.anchors.where("other is not null").select(F.col("other").alias("term")))
        else:
            near = ranked.where(F.col("n_terms") > missing + 1).select("w", "bits", F.explode(F.slice("rarest", 1, missing + 1)).alias("r"))
            self.near, _ = written(near.select("w", "bits", "r.term"), "near-anchors")
            terms = terms.union(self.near.select("term"))
        wanted, _ = written(terms.distinct(), "anchor-terms")
        self.postings, self.path = written(_postings(docs, wanted, self.reach), "postings")

    def _starts(self) -> DataFrame:
        """d, w, at, len: places where windows may start."""
        first = self.postings.join(self.anchors, "term").withColumns({"at": F.col("pos") - F.col("offset"), "pos": F.col("pos") - F.col("offset") + F.col("other_offset")}).where("at >= 0")
        if self.reach is not None:
            return first.where(_lacking() == 0).select("d", "w", "at", "len").distinct()
        first = first.select("d", "w", "at", "len", "other", "pos")
        second = self.postings.select("d", "pos", F.col("term").alias("other")).join(self.anchors.select("other").distinct(), "other", "left_semi")
        both = first.where("other is not null").join(second, ["d", "pos", "other"]).unionByName(first.where("other is null"))
        return both.select("d", "w", "at", "len").distinct()

    @functools.cached_property
    def compared(self) -> DataFrame:
        """d, w, at, len: where a window of ``len`` words starts. Without len, around places that have all but ``missing`` of a window's n terms: low, n, around (the words there by their places among the terms, others 0)."""
        places = self._starts()
        if self.reach is not None:
            near = self.postings.join(self.near, "term").where(_lacking() <= self.missing)
            places = places.unionByName(near.select("d", "w", F.col("pos").alias("at")), allowMissingColumns=True)
        places, path = written(places, "places")
        # the documents with places grow with the corpus: sort and merge at every size, never a broadcast
        texts = self.docs.join(places.select("d").distinct().hint("merge"), "d", "left_semi").select("d", words_of(F.col("text")).alias("all"))
        reach, low = self.reach or 1, F.greatest(F.lit(0), F.col("at") - (self.reach or 1) + 1)
        words = self.windows.select("w", "words", F.array_distinct("words").alias("terms")).distinct()
        told = places.join(words, "w").join(texts.hint("merge"), "d").withColumn("low", low)
        told = told.withColumn("around", F.when(F.col("len").isNull(), F.slice("all", F.col("low") + 1, F.col("at") - F.col("low") + reach)))
        same = F.slice("all", F.col("at") + 1, F.col("len")) == F.col("words")
        close = F.size(F.array_intersect("around", "terms")) >= F.size("terms") - self.missing
        found = told.where(F.when(F.col("len").isNull(), close).otherwise(same))
        found = found.select("d", "w", "at", "len", "low", F.size("terms").alias("n"), F.transform("around", lambda x: F.array_position("terms", x)).alias("around"))
        # written, so that the words around are cut once for all runs in them
        out, _ = written(found, "compared")
        dropped(self.docs.sparkSession, path)
        return out

    def drop(self) -> None:
        dropped(self.docs.sparkSession, self.path)


def phrase_matches(index: Index) -> DataFrame:
    """d, start, w, len: every place of every window in the documents."""
    return index.compared.where("len is not null").select("d", F.col("at").alias("start"), "w", "len")


def proximity_matches(index: Index) -> DataFrame:
    """d, item_id, w, start, n_terms: where documents have the terms of a window near each other, in any order.

    A match is a run of at most ``window + slack`` document words with all but ``missing`` of the
    distinct terms of a window; of each window and document the run of most terms is given, of those
    the first. Windows of no more than ``missing + 1`` distinct terms match as phrases only. Every match
    has one of the ``missing + 1`` rarest terms of its window, so the postings of these are all its
    candidates; those where the words around lack more than ``missing`` bits of the window's terms
    are none, and for the others the words are compared.
    """
    if index.reach is None:
        raise ValueError("an index for proximity matches is made with `slack`")
    missing, windows, reach = index.missing, index.windows, index.reach
    shared = lambda s: F.size(F.array_remove(F.array_distinct(F.slice("around", s + 1, reach)), 0))
    told = index.compared.where((F.col("n") > missing + 1) & F.col("len").isNull())
    runs = told.select("d", "w", "n", F.array_max(F.transform(F.sequence(F.lit(0), F.col("at") - F.col("low")), lambda s: F.struct(shared(s).alias("n_terms"), (-s - F.col("low")).alias("back")))).alias("run"))
    best = runs.where(F.col("run.n_terms") >= F.col("n") - missing).groupBy("d", "w").agg(F.max("run").alias("run"))
    found, _ = written(best.join(windows.select("w", "item_id"), "w").select("d", "item_id", "w", (-F.col("run.back")).alias("start"), "run.n_terms"), "proximities")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """All columns of ``docs``, and n_words, n_hit, items (array of item_id), contaminated; with ``slack`` also near_items.

    near_items are those of ``proximity_matches``; they do not count as hits.

    A word is hit if it lies inside any occurrence of a window; items of fewer words are one
    window, items without words none. Null text has no words. Rows of one doc_id with unequal
    texts are documents of their own, equal rows one; a null doc_id is an id like any other. An empty table gives no rows, an empty
    benchmark no hits. Very long texts are split into words by their own task, whole. Columns of docs of
    these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("n_words", "n_hit", "items", "contaminated", "near_items").withColumn("_d", F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("v")))
    counted = rows.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))  # before the joins, so that they need no texts
    keyed = rows.select(F.col("_d").alias("d"), text.alias("text"))
    index = Index(keyed, benchmark, window, slack)
    found, windows = phrase_matches(index), index.windows
    hit = found.select("d", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("d").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("d", "w").distinct().join(windows.select("w", "item_id"), "w").groupBy("d").agg(F.collect_set("item_id").alias("items"))
    both = hit.join(items, "d", "left").withColumnRenamed("d", "_d")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    if slack is not None:
        near = proximity_matches(index).groupBy(F.col("d").alias("_d")).agg(F.collect_set("item_id").alias("near_items"))
        counted = counted.join(near, "_d", "left").withColumn("near_items", F.coalesce("near_items", F.expr(f"cast(array() as array<{kind}>)")))
    index.drop()
    out = counted.join(both, "_d", "left").drop("_d")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.expr(f"cast(array() as array<{kind}>)")), "contaminated": F.coalesce("n_hit", F.lit(0)) > 0})
