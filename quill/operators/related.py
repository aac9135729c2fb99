"""Related texts that differ from one another, and contexts for questions with a glossary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType

from quill.functions.nearest import nearest
from quill.operators.fields import weighted_top
from quill.session import bucketed, stored

#: A related text is at most this like the asked one, and less than this like any other that is chosen.
MOST_LIKE, APART, RELATED = 0.72, 0.8, 3
#: Rows found for an asked one in each block and round; blocks that terms are spread over where each has so many, and terms of a block at most.
NEAREST, SPREAD, SPREAD_TERMS, BLOCK_TERMS = 8, 8, 1 << 20, 1 << 24
#: Longest terms that are searched, results looked at, terms and share of them that a context has at least.
SEARCHED, LOOKED_AT, LEAST_TERMS, LEAST_COVERAGE = 45, 15, 3, 0.08
#: Contexts of a question and their code points in all.
CONTEXTS, CONTEXT_CHARS = 2, 5500


def name_likeness(a: Column, b: Column) -> Column:
    """1 less the edits over the longer name; 1 for two empty ones."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _distinct(found: DataFrame, n: int) -> DataFrame:
    """query_id, have, chosen: of each asked row's ``ranked`` those that are unlike all taken before, as long as it ``have`` fewer than ``n``."""

    def like(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return both / (F.size(a) + F.size(b) - both)

    def step(held: Column, x: Column) -> Column:
        alike = F.exists(held, lambda c: (like(c["terms"], x["terms"]) >= APART) | (name_likeness(c["name"], x["name"]) >= APART))
        return F.when((F.size(held) + F.col("have") < n) & ~alike, F.array_append(held, x)).otherwise(held)

    kind = found.schema["ranked"].dataType.simpleString()
    return found.withColumn("chosen", F.aggregate("ranked", F.expr("array()").cast(kind), step)).drop("ranked")


def distinct_related(rows: DataFrame, asked: Column, part: str, n: int = RELATED) -> DataFrame:
    """query_id, rank (1..n), key: for each row where ``asked`` holds the ``n`` most related rows of its part that differ.

    ``rows`` are (key, ``part``, place, name, terms: distinct strings); keys are distinct. Related rows share
    a term, are at most ``MOST_LIKE`` alike in terms, and neither name contains the other. They come by
    falling similarity, then by nearness of places, then by SHA-256 of the key; one is passed over where
    it is ``APART`` or more like the asked row or one chosen before, in terms or in name. A row with
    fewer than ``n`` such has none. Null parts meet nothing, null names and terms are empty (an empty name is
    contained in every other), null places
    are last.

    Rows are dealt into blocks, once, and every block meets the asked rows of its part: terms, as 64-bit
    hashes, are counted there, all pairs of them, and only the ``NEAREST`` rows of each block that are unlike the asked
    one and those chosen before leave it. The best of these is always chosen, so ``n`` rounds at most are
    made, later ones for asked rows whose ``NEAREST`` were too alike. No row is made for a pair.
    """
    integral = isinstance(rows.schema["place"].dataType, IntegralType)
    name, terms = F.coalesce("name", F.lit("")), F.transform("terms", lambda t: F.xxhash64(t))
    clean = rows.select("key", part, F.col("place").cast("long" if integral else "double").alias("place"), name.alias("name"), terms.alias("terms"), F.coalesce(asked, F.lit(False)).alias("asked"))
    # a row without terms shares none, one without a name is contained in every other
    pool = stored(clean.where((F.size("terms") > 0) & (F.col("name") != "") & F.col(part).isNotNull()), "related-pool")
    total = pool.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(min(SPREAD, -(-total // SPREAD_TERMS)), -(-total // BLOCK_TERMS), 1)
    dealt = pool.drop("asked").withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), "tie": F.unhex(F.sha2(F.col("key").cast("string"), 256))})
    block = bucketed(dealt, "related", 8 * blocks, part, "block")
    key, at = pool.schema["key"].dataType.simpleString(), pool.schema["place"].dataType.simpleString()
    open_ = pool.where("asked").select(F.col("key").alias("query_id"), F.lit(0).alias("slot"), part, "place", "name", "terms")
    chosen = None
    for _ in range(n):
        best = stored(_best_of_blocks(block, open_, part, blocks, f"query_id {key}, {part} {pool.schema[part].dataType.simpleString()}, block int, key {key}, likeness double, near {at}"), "related-best")
        told = best.groupBy(part, "block").cogroup(block.groupBy(part, "block")).applyInArrow(_told, T.StructType([*best.schema.fields, pool.schema["name"], pool.schema["terms"]]))
        ranked = F.sort_array(F.collect_list(F.struct("rank", "key", "name", "terms")))
        had = open_.groupBy("query_id", part).agg(F.max("slot").alias("have"))
        lists = told.groupBy("query_id").agg(ranked.alias("ranked"), F.max("more").alias("more")).join(had, "query_id")
        new = stored(_distinct(lists, n), "related-chosen")
        put = new.select("query_id", part, "have", "more", F.size("chosen").alias("got"), F.posexplode("chosen").alias("pos", "c"))
        put = put.select("query_id", (F.col("have") + F.col("pos") + 1).alias("slot"), part, "c.key", "c.name", "c.terms", ((F.col("have") + F.col("got") < n) & F.col("more")).alias("open"))
        picked = put.select("query_id", F.col("slot").cast("long").alias("rank"), "key")
        chosen = picked if chosen is None else chosen.union(picked)
        left = put.where("open")
        again = open_.join(left.select("query_id").distinct(), "query_id", "left_semi")
        open_ = stored(again.unionByName(left.select("query_id", "slot", part, F.lit(None).cast(at).alias("place"), "name", "terms")), "related-open")
        if open_.isEmpty():
            break
    whole = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") == n)
    return chosen.join(whole.select("query_id"), "query_id", "left_semi").select("query_id", "rank", "key")


def _best_of_blocks(block: DataFrame, asked: DataFrame, part: str, blocks: int, kinds: str) -> DataFrame:
    """query_id, part, block, key, rank, more: the ``NEAREST`` rows for each of ``asked``, and whether there may be others."""

    def met(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return schema.empty_table()
        found = nearest(mine, theirs, NEAREST, MOST_LIKE, APART)
        here = {c: pa.array([mine.column(c)[0].as_py()] * found.num_rows, schema.field(c).type) for c in (part, "block")}
        return pa.table({c: here.get(c, found.column(c) if c in found.column_names else None) for c in schema.names}, schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(kinds))
    # asked rows that a block meets at once are bounded too; more than one turn takes millions of them
    turns = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS))
    copies = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = None
    for turn in range(turns):
        own = copies if turns == 1 else copies.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        new = block.groupBy(part, "block").cogroup(own.groupBy(part, "block")).applyInArrow(met, kinds)
        found = new if found is None else found.unionByName(new)
    order = Window.partitionBy("query_id").orderBy(F.desc("likeness"), F.desc_nulls_last("near"), F.desc(F.sha2(F.col("key").cast("string"), 256)))
    ranked = found.withColumns({"rank": F.row_number().over(order), "more": F.count(F.lit(1)).over(Window.partitionBy("query_id")) >= NEAREST})
    return ranked.where(F.col("rank") <= NEAREST).drop("likeness", "near")


def _told(found: pa.Table, block: pa.Table) -> pa.Table:
    """Names and terms of the rows of a block that were found."""
    place = {k: i for i, k in enumerate(block.column("key").to_pylist())} if found.num_rows else {}
    at = pa.array([place[k] for k in found.column("key").to_pylist()], pa.int64())
    return found.append_column("name", block.column("name").take(at)).append_column("terms", block.column("terms").take(at))


def expanded(rows: DataFrame, key: list[str], glossary: DataFrame) -> DataFrame:
    """key, term, distinct: the ``terms`` of each row and what the glossary (a, b) has for them, either way; once, not on and on."""
    own = rows.select(*key, F.explode(F.array_distinct("terms")).alias("term"))
    both = glossary.select("a", "b").union(glossary.select("b", "a")).where("a <> b").distinct()
    return own.union(own.join(both, own["term"] == both["a"]).select(*key, "b")).distinct()


def glossary_contexts(queries: DataFrame, corpus: DataFrame, glossary: DataFrame, part: str) -> DataFrame:
    """query_id, ``part``, place, key, overlap, coverage: at most ``CONTEXTS`` contexts of each question in each part.

    ``queries`` are (query_id, terms), ``corpus`` is (key, ``part``, terms with repeats, chars); ``terms`` are
    words that count. A question's terms and the glossary's for them are searched, the ``SEARCHED`` longest
    (then by name), and of the ``LOOKED_AT`` best by text rank those stay that have at least ``LEAST_TERMS``
    of all its terms, ``LEAST_COVERAGE`` of them, where the glossary's words for a context's count as its
    own. The first is taken whatever its length, later ones while all have ``CONTEXT_CHARS`` code points.
    Questions without terms have none; null terms are none, ties go by key.

    No text is shuffled: places of searched terms for the ranking, then the terms of what it found.
    """
    asked = stored(expanded(queries, ["query_id"], glossary), "asked-terms")
    listed = F.sort_array(F.collect_list(F.struct((-F.length("term")).alias("l"), "term")))
    searched = asked.groupBy("query_id").agg(F.slice(F.transform(listed, lambda x: x["term"]), 1, SEARCHED).alias("terms"))
    fields = corpus.select(F.col("key").alias("chunk_id"), part, "terms")
    top = stored(weighted_top(searched, fields, {"terms": 1.0}, LOOKED_AT, (part,)).select("query_id", part, F.col("chunk_id").alias("key"), "rank"), "asked-top")
    found = corpus.join(top.select("key").distinct(), "key", "left_semi")
    held = expanded(found, ["key"], glossary)
    shared = top.join(held, "key").join(asked, ["query_id", "term"]).groupBy("query_id", part, "key", "rank").agg(F.count(F.lit(1)).alias("overlap"))
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    good = shared.join(sizes, "query_id").withColumn("coverage", F.col("overlap") / F.col("n")).where((F.col("overlap") >= LEAST_TERMS) & (F.col("coverage") >= LEAST_COVERAGE))
    sized = good.join(found.select("key", F.col("chars").cast("long").alias("chars")), "key")
    ranked = F.sort_array(F.collect_list(F.struct("rank", "key", "chars", "overlap", "coverage")))
    chosen = sized.groupBy("query_id", part).agg(ranked.alias("ranked"))
    kept = chosen.withColumn("kept", _filled(chosen))
    return kept.select("query_id", part, F.posexplode("kept").alias("place", "k")).select("query_id", part, (F.col("place") + 1).cast("long").alias("place"), "k.key", "k.overlap", "k.coverage")


def _filled(df: DataFrame) -> Column:
    """The first of ``ranked``, then each that the budget still holds, up to ``CONTEXTS``; at most ``LOOKED_AT`` are looked at."""
    kind = df.schema["ranked"].dataType.simpleString()
    start = F.struct(F.expr("array()").cast(kind).alias("kept"), F.lit(0).cast("long").alias("used"))

    def step(held: Column, x: Column) -> Column:
        n = F.size(held["kept"])
        fits = (n == 0) | (n < CONTEXTS) & (held["used"] + x["chars"] <= CONTEXT_CHARS)
        return F.when(fits, F.struct(F.array_append(held["kept"], x).alias("kept"), (held["used"] + x["chars"]).alias("used"))).otherwise(held)

    return F.aggregate("ranked", start, step, lambda held: held["kept"])
