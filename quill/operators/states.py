"""Finite-state scans over ordered rows, whatever partitions the rows lie in.

A block of rows maps every state before it to one after it. Maps compose, so the states at the blocks'
borders come from a prefix composition in as many rounds as the count of blocks has bits; then each
block is scanned once more from the state that it really begins in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.operators.budgets import _same
from quill.operators.ordered import totals_before
from quill.session import stored

BLOCK = 4096


def _composed(maps: DataFrame, by: list[str]) -> DataFrame:
    """by, _block, map: from the state before a group's first block to the one after each block."""
    span, most = 1, maps.agg(F.max("_block")).first()[0] or 0
    while span <= most:
        before = maps.select(*by, (F.col("_block") + span).alias("_block"), F.col("map").alias("earlier"))
        met = maps.alias("a").join(before.alias("b"), _same("a", "b", [*by, "_block"]), "left")
        both = F.transform("b.earlier", lambda s: F.get("a.map", s))
        maps = stored(met.select(*(f"a.{n}" for n in [*by, "_block"]), F.coalesce(both, "a.map").alias("map")), "maps")
        span *= 2
    return maps


def scan_states(df: DataFrame, order: list[str], symbol: str, moves: list[list[int]], start: int = 0, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with pos (from 0 in ``order``, within ``by``), before and after: the states around each row.

    ``moves[symbol][state]`` is the state after a row of that symbol, a whole number from 0. A group
    may hold all rows. Rows are stored: leave out what the scan does not need. Null groups are a group.
    """
    by = by or []
    table = np.array(moves, np.int64)
    placed = stored(totals_before(df, order, {"pos": F.lit(1).cast("long")}, by), "placed")
    narrow = placed.select(*by, "pos", F.col(symbol).cast("long").alias("_symbol"), F.floor(F.col("pos") / block).alias("_block"))
    kept = [narrow.schema[n] for n in by]

    def mapped(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("pos").to_numpy())
        state = np.arange(table.shape[1])
        for s in rows.column("_symbol").to_numpy()[order].tolist():
            state = table[s][state]
        one = rows.slice(0, 1)
        return pa.Table.from_arrays([*(one.column(n) for n in [*by, "_block"]), pa.array([state.tolist()], pa.list_(pa.int64()))], names=[*by, "_block", "map"])

    maps = narrow.groupBy(*by, "_block").applyInArrow(mapped, T.StructType([*kept, T.StructField("_block", T.LongType()), T.StructField("map", T.ArrayType(T.LongType()))]))
    borders = _composed(stored(maps, "maps"), by).select(*by, (F.col("_block") + 1).alias("_block"), F.get("map", F.lit(start)).alias("_state"))
    dealt = narrow.alias("a").join(borders.alias("b"), _same("a", "b", [*by, "_block"]), "left").select("a.*", F.coalesce("b._state", F.lit(start).cast("long")).alias("_state"))
    listed = table.tolist()

    def scanned(rows: pa.Table) -> pa.Table:
        pos = rows.column("pos").to_numpy()
        order = np.argsort(pos)
        states = [rows.column("_state")[0].as_py()]
        for s in rows.column("_symbol").to_numpy()[order].tolist():
            states.append(listed[s][states[-1]])
        return pa.Table.from_arrays([*(rows.column(n) for n in by), pa.array(pos[order]), pa.array(states[:-1], pa.int64()), pa.array(states[1:], pa.int64())], names=[*by, "pos", "before", "after"])

    told = dealt.groupBy(*by, "_block").applyInArrow(scanned, T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in ("pos", "before", "after"))]))
    return placed.alias("a").join(told.alias("b"), _same("a", "b", [*by, "pos"])).select("a.*", "b.before", "b.after")


#: Symbols of exam lines: text, an option line of each label, a line that gives the key.
LABELS = "ABCDEFGH"
TEXT, ANSWER = 0, len(LABELS) + 1
#: States: in the prompt; in the option of that number, all labels so far in order; an item whose labels are not.
PROMPT, BROKEN = 0, len(LABELS) + 1


def exam_moves() -> list[list[int]]:
    """A key line ends an item whatever its state; labels run A, B, C and so on, or the item is broken until then."""
    states = range(BROKEN + 1)
    option = lambda k: [k if s == k - 1 else BROKEN for s in states]
    return [list(states), *(option(k) for k in range(1, len(LABELS) + 1)), [PROMPT for _ in states]]


def exam_symbol(line: Column) -> Column:
    label = F.regexp_extract(line, r"^\s*([A-H])[.)]\s*\S", 1)
    key = F.regexp_like(line, F.lit(r"^\s*ANSWER\b"))
    return F.when(key, ANSWER).when(label != "", F.ascii(label) - ord("A") + 1).otherwise(TEXT).cast("long")


def exam_items(lines: DataFrame, order: list[str], by: list[str], line: str = "line", block: int = BLOCK) -> DataFrame:
    """by, item, first, status, reason, prompt, options (array of label, text and correct), answer: what lies between key lines.

    Items go on across pages; lines after the last key line are none. An item is a candidate if its
    option labels run from A on without a gap, there are two at least, its key line names letters
    ("ANSWER: B" or "ANSWER: A, C") and all of them are labels; otherwise it is quarantined with the
    first reason that holds. Texts of an option go on over the lines without a label.
    """
    # the scan moves numbers alone: texts are stored once and come back by their number
    kept = stored(lines.select(*dict.fromkeys([*by, *order, line])).withColumn("_id", F.monotonically_increasing_id()), "lines")
    rows = kept.select(*dict.fromkeys([*by, *order]), "_id", exam_symbol(F.col(line)).alias("_symbol"))
    states = scan_states(rows, order, "_symbol", exam_moves(), PROMPT, by, block)
    keyed = totals_before(states, ["pos"], {"item": (F.col("_symbol") == ANSWER).cast("long")}, by)
    keyed = keyed.select(*by, "_id", "pos", "_symbol", "before", "item").join(kept.select("_id", line).hint("merge"), "_id")
    ended = F.max((F.col("_symbol") == ANSWER).cast("int"))
    part = F.struct("pos", F.when(F.col("_symbol").between(1, len(LABELS)), F.col("_symbol")).alias("label"), F.regexp_replace(F.btrim(F.regexp_replace(line, r"^\s*[A-H][.)]\s*(?=\S)", ""), F.lit(" \t\n\x0b\x0c\r")), r"\s+", " ").alias("text"), F.regexp_replace(F.btrim(F.col(line), F.lit(" \t\n\x0b\x0c\r")), r"\s+", " ").alias("whole"))
    items = keyed.groupBy(*by, "item").agg(
        ended.alias("_ended"),
        F.min("pos").alias("first"),
        F.max(F.when(F.col("_symbol") == ANSWER, F.col("before"))).alias("_state"),
        F.max(F.when(F.col("_symbol") == ANSWER, F.col(line))).alias("answer"),
        F.array_sort(F.collect_list(F.when(F.col("_symbol") != ANSWER, part))).alias("_lines"),
    ).where("_ended = 1")
    opened = F.array_position(F.transform("_lines", lambda x: x["label"].isNotNull()), F.lit(True))
    before = F.when(opened == 0, F.col("_lines")).otherwise(F.slice("_lines", F.lit(1), F.greatest(opened - 1, F.lit(0)).cast("int")))
    prompt = F.array_join(F.transform(before, lambda x: x["whole"]), " ")
    # option k of an item: its own line, and the unlabelled ones up to the next label
    starts = F.filter(F.transform("_lines", lambda x, i: F.when(x["label"].isNotNull(), i)), lambda i: i.isNotNull())
    items = items.withColumns({"_starts": starts, "prompt": prompt, "_n": F.size("_lines")})
    items = items.withColumn("letters", F.split(F.regexp_extract("answer", r"^\s*ANSWER\s*:\s*([A-H](?:\s*[,;]\s*[A-H])*)\s*$", 1), r"\s*[,;]\s*"))
    stop = lambda i: F.coalesce(F.get("_starts", i + 1), F.col("_n"))
    option = lambda s, i: F.struct(F.substring(F.lit(LABELS), F.get("_lines", s)["label"].cast("int"), F.lit(1)).alias("label"), F.array_join(F.concat(F.array(F.get("_lines", s)["text"]), F.transform(F.slice("_lines", s + 2, stop(i) - s - 1), lambda x: x["whole"])), " ").alias("text"))
    items = items.withColumn("_options", F.transform("_starts", option))
    items = items.withColumn("options", F.transform("_options", lambda o: F.struct(o["label"].alias("label"), o["text"].alias("text"), F.array_contains("letters", o["label"]).alias("correct"))))
    unread = F.get("letters", F.lit(0)) == ""
    missing = F.size(F.array_except("letters", F.transform("_options", lambda o: o["label"]))) > 0
    reason = F.when(unread, "unsupported_answer_key_format").when((F.col("_state") == BROKEN) | (F.col("_state") < 2), "nonsequential_or_missing_option_labels").when(missing, "answer_key_label_missing")
    return items.select(*by, "item", "first", F.when(reason.isNull(), "candidate").otherwise("quarantine").alias("status"), reason.alias("reason"), "prompt", "options", "answer")
