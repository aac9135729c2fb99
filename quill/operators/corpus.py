"""Corpus preparation: exact dedup, similarity joins, components, splits, samples, packing, quality reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import nfc, word_distance
from quill.operators.ordered import numbered, running
from quill.session import checkpointed, stored


def first_per_key(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """Each row with the first row's ``order`` of its key; the key's first row has place 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the least ``order`` of its key, first_id, and how many rows the key has, n.

    Keys are counted before they are shuffled, and the join may split a common one.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n"))
    return df.join(firsts, key)


def merged(df: DataFrame, key: Column, keep: str, best: Column, origin: str) -> DataFrame:
    """One row per canonical content: the best row's ``keep``, how many there are and all origins."""
    return df.groupBy(key.alias("content")).agg(F.max_by(keep, best).alias(keep), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(origin)).alias("origins"))


def conflicts(df: DataFrame, key: Column, answer: str) -> DataFrame:
    """Contents with more than one answer: the whole group is to go."""
    return df.groupBy(key.alias("content")).agg(F.countDistinct(answer).alias("answers"), F.count(F.lit(1)).alias("n")).where("answers > 1")


def reasons(**rules: Column) -> Column:
    """Names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def first_reason(**rules: Column) -> Column:
    return F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules.items()), F.lit("kept"))


def sample_per_stratum(df: DataFrame, stratum: str, key: Column, quota: int) -> DataFrame:
    """The ``quota`` smallest SHA-256 of each stratum; ties by the key itself."""
    keyed = df.withColumns({"_d": F.sha2(key, 256), "_k": key}).withColumn("_part", F.pmod(F.xxhash64("_k"), F.lit(256)))
    first = lambda rows, *by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_d", "_k"))).where(F.col("_r") <= quota)
    # the smallest of each part, then the smallest of those: no task sees a whole stratum
    return first(first(keyed, stratum, "_part"), stratum).drop("_r", "_d", "_k", "_part")


def balanced(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Round robin over groups: every group's k-th row before any k+1-th, ``limit`` rows in all."""
    return numbered(df, [order], "turn", [group]).orderBy("turn", group).limit(limit)


def running_units(df: DataFrame, order: list[str], size: Column, unit: int, by: list[str] | None = None) -> DataFrame:
    """Rows cut into units of a running total: first and last unit that each row lies in."""
    placed = running(df.withColumn("_n", size), order, F.col("_n"), "start", by).withColumn("stop", F.col("start") + F.col("_n")).drop("_n")
    return placed.withColumns({"first_unit": F.floor(F.col("start") / unit), "last_unit": F.floor(F.greatest(F.col("start"), F.col("stop") - 1) / unit)})


def token_spans(df: DataFrame, key: str, order: list[str], size: Column, window: int, by: list[str]) -> DataFrame:
    """Spans of fixed windows over each group's running tokens, one row for each window that a document touches."""
    narrow = df.select(*dict.fromkeys([*by, key, *order]), size.alias("n")).where("n > 0")
    placed = running_units(narrow, order, F.col("n"), window, by)
    spans = placed.select(*by, key, "start", "stop", F.explode(F.sequence("first_unit", "last_unit")).alias("window"))
    return spans.select(*by, key, "window", F.greatest(F.col("start"), F.col("window") * window).alias("start"), F.least(F.col("stop"), (F.col("window") + 1) * window).alias("stop"))


def representatives(sets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of equal sets the one of the least key (key, items), and which one stands for each (key, rep); sets without items stand for themselves.

    ``items`` are distinct 64-bit hashes; sets are stored once, so that what made them runs once.
    """
    keyed = stored(sets.select(key, F.array_sort("items").alias("items")), "sets")
    digests = stored(keyed.where(F.size("items") > 0).select(key, F.sha2(F.array_join("items", ","), 256).alias("_h")), "digests")
    firsts = digests.groupBy("_h").agg(F.min(key).alias("rep"))
    copies = stored(digests.join(firsts.hint("merge"), "_h").where(F.col(key) != F.col("rep")).select(key, "rep"), "copies")
    members = keyed.select(key).join(copies.hint("merge"), key, "left").select(key, F.coalesce("rep", key).alias("rep"))
    return keyed.join(copies.hint("merge"), key, "left_anti"), members


def similar_sets(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """Pairs a < b of (key, items: distinct 64-bit hashes) with Jaccard similarity of the threshold or more.

    Prefix filter under the order of growing frequency: only the rarest items are joined, and only
    where sizes and what follows the item in both orders still allow the similarity. Candidates are
    verified on whole sets. Rows of prefixes are stored, so that both sides of the join are one.
    """
    items = sets.where(F.size("items") > 0).select(F.col(key).alias("k"), "items", F.size("items").alias("n"))
    single = items.select("k", "n", F.explode("items").alias("item"))
    counts = single.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # items of one set alone come first in the order and meet nothing: they count, but are not put in order
    own = Window.partitionBy("k")
    shared = single.join(counts.hint("merge"), "item").withColumn("place", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "item")))
    # a product such as 0.85 * 20 may lie above the whole number it stands for
    least = F.ceil(threshold * F.col("n") - 1e-9)
    prefix = stored(shared.where(F.col("place") <= F.col("n") - least + 1).select("k", "n", "place", "item"), "prefix")
    a, b = prefix.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), "item"), prefix.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), "item")
    sized = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    follows = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6
    near = stored(a.join(b.hint("merge"), "item").where((F.col("a") < F.col("b")) & sized & follows).select("a", "b").distinct(), "near")
    both = near.join(items.select(F.col("k").alias("a"), F.col("items").alias("x")).hint("merge"), "a").join(items.select(F.col("k").alias("b"), F.col("items").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def smallest_reachable(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key, component of each node: labels fall to the smallest neighbour and jump to their label's label.

    Each round is checkpointed, so that the plan stays short and a lost executor costs one round.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct()
    both = checkpointed(both)
    labels = checkpointed(nodes.select(F.col(key).alias("x"), F.col(key).alias("c")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("c").alias("n"))
        lower = labels.join(near, "x", "left").select("x", "c", F.least("c", F.coalesce("n", "c")).alias("n"))
        jumped = checkpointed(lower.join(labels.select(F.col("x").alias("n"), F.col("c").alias("j")), "n").select("x", F.least("n", "j").alias("c"), (F.least("n", "j") < F.col("c")).alias("moved")))
        labels = jumped.select("x", "c")
        if not jumped.where("moved").limit(1).count():
            return labels.select(F.col("x").alias(key), F.col("c").alias("component"))


def manifest_diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """path, status: deleted, new, updated or unchanged."""
    both = old.select(path, F.col(digest).alias("o")).join(new.select(path, F.col(digest).alias("n")), path, "full_outer")
    return both.select(path, F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull(), "new").when(F.col("o") == F.col("n"), "unchanged").otherwise("updated").alias("status"))


def leaked(df: DataFrame, key: Column, split: Column) -> DataFrame:
    """Keys that lie in more than one split."""
    return df.groupBy(key.alias("key")).agg(F.countDistinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).where("splits > 1")


def error_rates(pairs: DataFrame, reference: str, prediction: str) -> DataFrame:
    """``pairs`` with edits, lengths and rates over whole texts, by characters and by words.

    Texts are compared after NFC with white space collapsed. A missing prediction is an empty
    text; an empty reference has no rates and counts nothing.
    """
    r, p = F.coalesce(nfc(F.col(reference)), F.lit("")), F.coalesce(nfc(F.col(prediction)), F.lit(""))
    n = pairs.withColumns({"_r": r, "_p": p}).withColumns({"n_chars": F.length("_r").cast("long"), "n_words": F.size(F.filter(F.split("_r", " "), lambda w: w != "")).cast("long")})
    some = F.col("n_chars") > 0
    edits = {"char_edits": F.when(some, F.levenshtein("_r", "_p")).otherwise(0).cast("long"), "word_edits": F.when(some, word_distance("_r", "_p")).otherwise(0).cast("long")}
    rates = {"cer": F.when(some, F.col("char_edits") / F.col("n_chars")), "wer": F.when(some, F.col("word_edits") / F.col("n_words"))}
    return n.withColumns(edits).drop("_r", "_p").withColumns(rates)


def pooled_error_rates(rates: DataFrame) -> DataFrame:
    """One row: sums of ``error_rates``, micro averages (sum of edits / sum of lengths) and macro means."""
    sums = [F.sum(c).alias(c) for c in ("n_chars", "char_edits", "n_words", "word_edits")]
    out = rates.agg(F.count(F.lit(1)).alias("pairs"), *sums, F.avg("cer").alias("macro_cer"), F.avg("wer").alias("macro_wer"))
    micro = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({"cer": micro("char_edits", "n_chars"), "wer": micro("word_edits", "n_words")})
