"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents are taken in batches by growing doc_id. A batch's line keys are merge-anti-joined with the
runs, tables of the keys of earlier batches that are bucketed and sorted by key, so that a join moves
the batch alone; its new keys become a run of level 0. When a level has ``FANOUT`` runs they are
merged into one of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.shared import Bucketed, dropped, partitions, written

MIN_CHARS = 10
#: There are so many batches at least, and more if one would hold more lines than this.
BATCHES, BATCH_LINES = 4, 1 << 30
FANOUT = 2
#: What a key is stripped of: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _identified(docs: DataFrame) -> DataFrame:
    """d orders the documents (null ids last); with v, a hash of the text, it names a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("v"), text.alias("text"))


def _keys(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select("d", "v", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.select("d", "v", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("d", "v", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _batched(keys: DataFrame, batches: int, most: int) -> tuple[DataFrame, list[int], str]:
    """The keys in a table of the shared folder, with the batch of each by growing d, the batches' numbers, and the table's path."""
    held, path = written(keys, "keys")
    n = max(batches, -(-held.count() // most))
    cuts = sorted(set(held.select(F.percentile_approx("d", [k / n for k in range(1, n)], 100 * n)).first()[0] or [])) if n > 1 else []
    batch = reduce(lambda a, b: a + b, (F.when(F.col("d") > x, 1).otherwise(0) for x in cuts), F.lit(0))
    return held.withColumn("batch", batch), list(range(len(cuts) + 1)), path


def anti_joined(first: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """The keys h1, h2 of a batch with ``new``: whether no run has them. Runs are merged in one after another, where they lie."""
    for k, run in enumerate(runs):
        first = first.join(run.select("h1", "h2", F.lit(True).alias(f"in{k}")).hint("merge"), ["h1", "h2"], "left")
    seen = reduce(lambda a, b: a | b, (F.col(f"in{k}").isNotNull() for k in range(len(runs))), F.lit(False))
    return first.withColumn("new", ~seen).drop(*(f"in{k}" for k in range(len(runs))))


def losing_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """d, v, pos of the lines whose key an earlier document has."""
    keys, numbers, keys_path = _batched(_keys(_identified(docs), min_chars), batches, BATCH_LINES)
    spark = docs.sparkSession
    levels: dict[int, list[Bucketed]] = {}
    losers: list[DataFrame] = []
    for b in numbers:
        own = keys.where(F.col("batch") == b)
        first = own.groupBy("h1", "h2").agg(F.min("d").alias("owner"), F.max("d").alias("latest"))
        runs = [run.table() for level in levels.values() for run in level]
        told, told_path = written(anti_joined(first, runs), "batch-keys")
        # the keys that anything is to be dropped for, in a table of their own: its size decides how Spark joins
        shared, shared_path = written(told.where("not new or owner < latest").select("h1", "h2", F.when(F.col("new"), F.col("owner")).alias("owner")), "shared-keys")
        losers.append(written(own.join(shared, ["h1", "h2"]).where("owner is null or d > owner").select("d", "v", "pos"), "losing-lines")[0])
        if b != numbers[-1]:
            fresh = told.where("new").select("h1", "h2").repartition(partitions(spark), "h1", "h2")
            levels.setdefault(0, []).append(Bucketed.of(fresh, "run", "h1", "h2"))
        level = 0
        while len(levels.get(level, [])) >= fanout:
            old = levels.pop(level)
            merged = reduce(DataFrame.unionAll, [r.table() for r in old]).repartition(partitions(spark), "h1", "h2")
            levels.setdefault(level + 1, []).append(Bucketed.of(merged, "run", "h1", "h2"))
            for r in old:
                r.drop()
            level += 1
        dropped(spark, told_path, shared_path)
    for run in (r for level in levels.values() for r in level):
        run.drop()
    dropped(spark, keys_path)
    return reduce(DataFrame.unionAll, losers)


def line_dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with ``text`` as kept, and n_lines, n_dropped.

    Lines are what lies between line feeds. Lines whose key (stripped, A-Z in lower case) has at
    least ``min_chars`` code points stay only in the smallest doc_id that has the key, all of them
    there. Null text is an empty one, of one empty line. Rows of one doc_id are one document, equal
    rows have equal results. A null doc_id comes after all others. Columns of docs named n_lines or
    n_dropped are replaced. An empty table gives an empty one.
    """
    lost = losing_lines(docs, batches, fanout, min_chars).groupBy("d", "v").agg(F.sort_array(F.collect_set("pos")).alias("lost")).withColumnsRenamed({"d": "_d", "v": "_v", "lost": "_lost"})
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("n_lines", "n_dropped", "_d", "_v", "_lost").withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "_v": F.xxhash64(text)}).join(lost, ["_d", "_v"], "left")
    lines, n = F.split(text, "\n", -1), F.coalesce(F.size("_lost"), F.lit(0))
    cuts = F.concat(F.array(F.lit(-1)), F.col("_lost"), F.array(F.col("_n")))
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_lost")), lambda i: F.slice(F.col("_lines"), F.get(F.col("_cuts"), i) + 2, F.get(F.col("_cuts"), i + 1) - F.get(F.col("_cuts"), i) - 1))), "\n")
    rows = rows.withColumn("_lines", lines).withColumn("_n", F.size("_lines")).withColumn("_cuts", cuts)
    rows = rows.withColumns({"text": F.when(F.col("_lost").isNull(), text).otherwise(kept), "n_lines": F.col("_n").cast("long"), "n_dropped": F.when(F.col("_lost").isNull(), 0).otherwise(n).cast("long")})
    return rows.drop("_d", "_v", "_lost", "_lines", "_n", "_cuts")
