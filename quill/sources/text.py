"""Structured text in a column: Markdown by section, recognised words by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^#{1,6}\s+(\S.*)$"


def markdown_sections(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, section, heading, body: a heading opens a section, what stands before the first one is section 0; sections without text go.

    Lines of a document are counted within it; a document is one row before and after.
    """
    lines = F.split(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    placed = docs.select(*key, F.posexplode(lines).alias("pos", "line")).withColumn("is_heading", F.col("line").rlike(HEADING))
    section = F.count_if("is_heading").over(Window.partitionBy(*key).orderBy("pos"))
    own = placed.withColumn("section", section).groupBy(*key, "section")
    parts = own.agg(F.max(F.when(F.col("is_heading"), F.trim(F.regexp_extract("line", HEADING, 1)))).alias("heading"), F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))).alias("lines"))
    body = F.regexp_replace(F.array_join("lines.line", "\n"), r"^\s+|\s+$", "")
    return parts.select(*key, "section", "heading", body.alias("body")).where("body <> ''")


def recognised_words(rows: DataFrame, key: str) -> DataFrame:
    """One row per page of recognised words (key, level, block, par, line, word, conf, text): lines, words and confidences.

    Words of level 5 with text and a confidence that is not negative count, in their order.
    """
    w = rows.where((F.col("level") == 5) & (F.trim("text") != "") & (F.col("conf") >= 0)).withColumn("text", F.trim("text"))
    lines = w.groupBy(key, "block", "par", "line").agg(F.array_join(F.sort_array(F.collect_list(F.struct("word", "text")))["text"], " ").alias("t"))
    text = lines.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "par", "line", "t")))["t"], "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"))
    n, size = F.count(F.lit(1)), F.length("text")
    stats = w.groupBy(key).agg(n.alias("n_words"), F.round(F.sum(F.col("conf") * size) / F.sum(size), 3).alias("weighted"), F.round(F.avg("conf"), 3).alias("mean"), F.round(F.count_if(F.col("conf") >= 80) / n, 4).alias("ge80"), F.round(F.count_if(F.col("conf") < 40) / n, 4).alias("lt40"))
    return text.join(stats, key)
