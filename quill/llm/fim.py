"""Fill-in-middle transformation by relational units.

A text is a row of units, the matches of a pattern that follow one another. Runs of at most ``RUN``
units are exploded with their positions; a window adds up their lengths; requests for cuts, two for a
document, are joined to the run that holds the unit they ask for, and their offsets are aggregated by
document. Prefix, middle and suffix are then substrings of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units in a row of the exploded table, the last one of a text excepted.
RUN = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
LAST_ID = (1 << 63) - 1


def _id(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def draw(doc: Column, k: int, seed: int) -> Column:
    """The k-th group of eight hex digits of sha256("seed:doc") as a number; a null doc_id counts as an empty one."""
    name = F.when(doc == LAST_ID, "").otherwise(doc.cast("string"))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 8 * k - 7, 8), 16, 10).cast("long")


def _pattern(unit: str) -> str:
    """What the pattern leaves out is cut by code points, so that units cover the text."""
    return f"(?:{unit})|(?s:.)"


def unit_runs(docs: DataFrame, unit: str | None, run: int) -> DataFrame:
    """d, v, place, units, chars: runs of ``run`` units in the order of each text (the last one may be shorter)."""
    pattern = f"(?s).{{1,{run}}}" if unit is None else f"(?:{_pattern(unit)}){{1,{run}}}"
    rows = docs.select("d", "v", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("place", "part"))
    sizes = [F.length("part").cast("long").alias("chars")]
    if unit is not None:
        sizes.append(F.size(F.regexp_extract_all("part", F.lit(_pattern(unit)), F.lit(0))).cast("long").alias("units"))
    # equal rows have equal runs: one of each is enough
    runs = rows.select("d", "v", "place", *sizes).repartition("d", "v").dropDuplicates(["d", "v", "place"])
    return runs if unit is not None else runs.withColumn("units", F.col("chars"))


def cut_offsets(rows: DataFrame, unit: str | None = None, run: int = RUN, seed: int = 1) -> DataFrame:
    """d, v, n and, for the two cuts of each text that has units, the offset of its run, the run's length, and the units before the cut in it."""
    order = Window.partitionBy("d", "v").orderBy("place")
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("units").over(Window.partitionBy("d", "v"))
    runs = unit_runs(rows, unit, run).withColumns({"start": before, "n": total})
    one, two = (F.pmod(draw(F.col("d"), k, seed), F.col("n") + 1) for k in (1, 2))
    wanted = runs.where("place = 0").select("d", "v", "n", F.posexplode(F.array(F.least(one, two), F.greatest(one, two))).alias("cut", "before"))
    # the run that holds the last unit before the cut; the first one where there is none
    wanted = wanted.withColumn("place", F.floor(F.greatest(F.col("before") - 1, F.lit(0)) / run).cast("int")).withColumn("rest", F.col("before") - F.col("place") * run)
    found = runs.select("d", "v", "place", "start", "chars").join(wanted, ["d", "v", "place"])
    at = lambda k: F.max(F.when(F.col("cut") == k, F.struct("start", "chars", "rest")))
    return found.groupBy("d", "v").agg(F.max("n").alias("n"), at(0).alias("one"), at(1).alias("two"))


def _offset(cut: str, unit: str | None) -> Column:
    """Code points before a cut: those before its run, and those of its units in the run."""
    if unit is None:
        return F.col(f"{cut}.start") + F.col(f"{cut}.rest")
    part = F.substring("_text", F.col(f"{cut}.start").cast("int") + 1, F.col(f"{cut}.chars").cast("int"))
    first = F.slice(F.regexp_extract_all(part, F.lit(_pattern(unit)), F.lit(0)), 1, F.col(f"{cut}.rest").cast("int"))
    return F.col(f"{cut}.start") + F.aggregate(first, F.lit(0), lambda a, x: a + F.length(x))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. No mark can arise across a seam: each begins with its only ``<`` and no text with a mark is cut."""
    body = F.substring(output, 4, LAST_ID >> 32)
    halves = lambda x, mark: (F.substring_index(x, mark, 1), F.substring(x, F.length(F.substring_index(x, mark, 1)) + 4, LAST_ID >> 32))
    psm_prefix, psm_rest = halves(body, SUFFIX)
    psm_suffix, psm_middle = halves(psm_rest, MIDDLE)
    spm_suffix, spm_rest = halves(body, PREFIX)
    spm_prefix, spm_middle = halves(spm_rest, MIDDLE)
    return F.when(form == "psm", F.concat(psm_prefix, psm_middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str | None = None, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: int = 1, run: int = RUN) -> DataFrame:
    """All columns of ``docs`` and n, form, prefix_chars, middle_chars, output, restored.

    ``unit`` is a Java pattern that matches no empty string (None: a code point); where it matches
    nothing a code point is a unit. A text of n units is cut after two numbers of units that follow
    from its doc_id and ``seed``. The form is plain if the text is empty, has one of the marks or is
    among ``plain`` percent of the documents; otherwise spm for ``suffix_first`` percent, else psm.
    prefix_chars and middle_chars count code points and are null for plain.

    Null texts are empty ones; a null doc_id draws as an empty string does. Rows of one doc_id share
    its draws, each for its own text; equal rows have equal results, and there are as many rows as
    before. A text is cut whole at any length: its runs are rows, and only the last step holds it in
    one row, as the table itself does. Columns of docs of these names are replaced. An empty table
    gives an empty one.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(_id(docs).alias("d"), F.xxhash64(text).alias("v"), text.alias("text"))
    offsets = cut_offsets(keyed, unit, run, seed).withColumnsRenamed({"d": "_d", "v": "_v", "n": "_n", "one": "_one", "two": "_two"})
    own = docs.drop(*made, "_d", "_v", "_n", "_one", "_two", "_text", "_p", "_q").withColumns({"_d": _id(docs), "_v": F.xxhash64(text), "_text": text})
    # offsets are one short row a document: hashed where the texts are dealt to, so that texts are not sorted
    rows = own.join(offsets.hint("shuffle_hash"), ["_d", "_v"], "left").withColumns({"_p": _offset("_one", unit), "_q": _offset("_two", unit)})
    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    is_plain = (F.col("_text") == "") | marked | (F.pmod(draw(F.col("_d"), 3, seed), F.lit(100)) >= 100 - plain)
    form = F.when(is_plain, "plain").when(F.pmod(draw(F.col("_d"), 4, seed), F.lit(100)) < suffix_first, "spm").otherwise("psm")
    p, q = F.col("_p").cast("int"), F.col("_q").cast("int")
    prefix, middle, suffix = F.substring("_text", F.lit(1), p), F.substring("_text", p + 1, q - p), F.substring("_text", q + 1, F.length("_text"))
    rows = rows.withColumns({"n": F.coalesce("_n", F.lit(0)).cast("long"), "form": form})
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    rows = rows.withColumns({"prefix_chars": F.when(cut, F.col("_p")).cast("long"), "middle_chars": F.when(cut, F.col("_q") - F.col("_p")).cast("long"), "output": F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))})
    return rows.withColumn("restored", restored(F.col("output"), F.col("form"))).drop("_d", "_v", "_n", "_one", "_two", "_text", "_p", "_q")
