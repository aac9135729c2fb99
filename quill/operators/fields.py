"""Search over texts of several fields, and paragraphs with their exact places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Saturation, length and least idf of the full-text index whose ranking this is; a result has at most MOST rows.
K1, B, LEAST_IDF, MOST = 1.2, 0.75, 1e-6, 20
#: Words of a query that count, and the letters that each has at least.
QUERY_WORDS, QUERY_LETTERS = 30, 2
WORD = r"[\p{L}\p{N}]+"
SPACE = r"[\x09-\x0D\x20]"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; none of null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def query_words(text: Column) -> Column:
    """The first ``QUERY_WORDS`` words of at least ``QUERY_LETTERS``; a word that comes again counts again."""
    return F.slice(F.filter(words(text), lambda w: F.length(w) >= QUERY_LETTERS), 1, QUERY_WORDS)


def weighted_top(queries: DataFrame, corpus: DataFrame, weights: dict[str, float], k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """query_id, the ``within`` columns, chunk_id, score, rank: the ``min(k, MOST)`` best of each query in each part.

    ``queries`` are (query_id, terms), any of which may match; ``corpus`` is (chunk_id, an array of
    terms for each field of ``weights``, the ``within`` columns). A term counts in a row as often as
    its fields have it, times their weights, before it saturates; lengths are those of all fields.
    Document counts and the mean length are of the whole corpus, whatever part is asked for. Null
    fields are empty, rows without terms match nothing, null parts are parts, ties go by chunk_id.

    Only places of query terms are shuffled; their document counts come from the same rows.
    """
    every = [F.coalesce(F.col(f), F.expr("array()").cast("array<string>")) for f in weights]
    sized = corpus.select("chunk_id", *within, *[e.alias(f) for f, e in zip(weights, every, strict=True)]).withColumn("dl", reduce(lambda x, y: x + y, [F.size(f) for f in weights]))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    wanted = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    marked = F.concat(*[_weighed(f, x) for f, x in weights.items()])
    placed = sized.select("chunk_id", *within, "dl", F.explode(marked).alias("p")).select("chunk_id", *within, "dl", "p.term", "p.w")
    tf = placed.join(wanted.select("term").distinct(), "term").groupBy("chunk_id", *within, "dl", "term").agg(F.sum("w").alias("f"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(totals)
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.select("term", "avgdl", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(idf, "term").join(wanted, "term").groupBy("query_id", *within, "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", *within).orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= min(k, MOST))


def _weighed(field: str, weight: float) -> Column:
    return F.transform(field, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))


def paragraphs(docs: DataFrame, key: str, text: str, begins: str = r"[-*•] ", drops: str = r"[0-9]+") -> DataFrame:
    """key, place, start, stop, paragraph: what lies between blank lines, with its exact places in the text.

    A line whose content is all of ``drops`` parts paragraphs and belongs to none; one that opens with
    ``begins`` opens a paragraph. Lines end at \\n, which stays with its line; places are code points
    from 0, so that a paragraph is the text from ``start`` to ``stop``. Null and blank texts have no
    paragraphs; keys must be distinct.
    """
    split = docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "line"), (F.size(F.split(F.col(text), "\n", -1)) - 1).alias("last"))
    whole = split.withColumn("line", F.when(F.col("i") < F.col("last"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")))
    own = Window.partitionBy(key).orderBy("i")
    placed = whole.withColumn("start", F.sum(F.length("line")).over(own) - F.length("line"))
    parts = F.col("line").rlike(f"^{SPACE}*(?:{drops})?{SPACE}*$")
    marked = placed.withColumn("parts", parts).withColumn("opens", F.col("line").rlike(f"^{SPACE}*(?:{begins})") | F.lag("parts", 1, True).over(own))
    numbered = marked.where(~F.col("parts")).withColumn("place", F.sum(F.col("opens").cast("long")).over(own) - 1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "")
    return numbered.groupBy(key, "place").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("stop"), joined.alias("paragraph"))
