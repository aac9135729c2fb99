"""Greedy batches under budgets, cut the same way whatever the partitions.

Where a batch ends depends on where it began, so that no running total gives the cuts. But from every
row the next cut is known, if a batch began there: it follows from totals in a sorted order. Cuts are
the path of these pointers from the first row. Blocks of rows compose their own pointers into one step
out of the block; the steps from block to block are followed by pointer doubling; each block then
walks its part of the path. No task holds more than a block, one group may hold all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.operators.ordered import totals_before
from quill.session import stored

BLOCK = 4096


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names), F.lit(True))


def reach_of_total(placed: DataFrame, by: list[str], before: str, size: str, budget: int) -> DataFrame:
    """by, pos, reach: the first position after ``pos`` that the budget leaves out, for a batch that begins at ``pos``.

    As many rows fit as there are totals, of a row and all before it, up to the budget beyond what lies before the batch.
    """
    ends = placed.select(*by, (F.col(before) + F.col(size)).alias("_value"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("pos"))
    asks = placed.select(*by, (F.col(before) + budget).alias("_value"), F.lit(1).alias("_kind"), "pos")
    met = totals_before(ends.unionByName(asks), ["_value", "_kind"], {"reach": (1 - F.col("_kind")).cast("long")}, by)
    return met.where("_kind = 1").select(*by, "pos", "reach")


def reach_of_distinct(placed: DataFrame, by: list[str], items: str, budget: int, most: int, block: int = BLOCK) -> DataFrame:
    """The same where a batch pays once for each distinct item (array of name and bytes) and holds ``most`` rows at most.

    An item counts for the batches that begin after its last place before, and no more than ``most`` rows back.
    Rows where the budget leaves nothing out are not given.
    """
    used = placed.select(*by, "pos", F.explode(F.array_distinct(items)).alias("item")).select(*by, "pos", F.col("item.name").alias("name"), F.col("item.bytes").alias("bytes"))
    # places by blocks of positions, with what is near enough before the block, so that no task sees all places of an item
    wide = max(block, most)
    dealt = used.withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(F.col("pos") / wide), F.floor((F.col("pos") + most) / wide)))))
    last = Window.partitionBy(*by, "name", "_block").orderBy("pos")
    own = dealt.withColumn("_last", F.lag("pos").over(last)).where(F.col("_block") == F.floor(F.col("pos") / wide)).drop("_block")
    first = F.greatest(F.coalesce(F.col("_last") + 1, F.lit(0)), F.col("pos") - most + 1, F.lit(0))
    paid = own.withColumn("begin", F.explode(F.sequence(first, F.col("pos")))).groupBy(*by, "begin", "pos").agg(F.sum("bytes").alias("bytes"))
    spent = paid.withColumn("spent", F.sum("bytes").over(Window.partitionBy(*by, "begin").orderBy("pos")))
    return spent.where(F.col("spent") > budget).groupBy(*by, "begin").agg(F.min("pos").alias("reach")).select(*by, F.col("begin").alias("pos"), "reach")


def _starts(rows: pa.Table) -> np.ndarray:
    """Where groups begin: positions have no gaps in a group's block, and every block begins with its first one."""
    pos, block = (rows.column(c).to_numpy() for c in ("pos", "_block"))
    return np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (block[1:] != block[:-1])]))


def _over_blocks(rows: DataFrame, by: list[str], done: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """``done`` of whole blocks in the order of positions, with where each begins: many small ones at once, held until the next begins."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            starts = _starts(rows)
            held = rows.slice(int(starts[-1]))
            if len(starts) > 1:
                yield from done(rows.slice(0, int(starts[-1])), starts[:-1]).combine_chunks().to_batches()
        if held is not None:
            yield from done(held, _starts(held)).combine_chunks().to_batches()

    return rows.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "pos").mapInArrow(batches, schema)


def _exits(blocks: DataFrame, by: list[str], block: int) -> DataFrame:
    """by, pos, exit: where the path from each row first leaves its block."""
    kept = [blocks.schema[n] for n in by]
    schema = T.StructType([*kept, T.StructField("pos", T.LongType()), T.StructField("exit", T.LongType())])

    def composed(table: pa.Table, starts: np.ndarray) -> pa.Table:
        pos, step = (table.column(c).to_numpy() for c in ("pos", "next"))
        n = len(pos)
        end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))).tolist()
        out, to = step.tolist(), (np.arange(n) + step - pos).tolist()
        for k in range(n - 1, -1, -1):
            if to[k] < end[k]:
                out[k] = out[to[k]]
        return pa.Table.from_arrays([*(table.column(n) for n in by), table.column("pos"), pa.array(out, pa.int64())], names=schema.names)

    return _over_blocks(blocks, by, composed, schema)


def _reached(exits: DataFrame, by: list[str]) -> DataFrame:
    """by, pos: position 0 of each group and the positions of the path from it where it enters a block, by pointer doubling."""
    start = exits.where("pos = 0").select(*by, "pos")
    entries = start.unionByName(exits.select(*by, F.col("exit").alias("pos"))).distinct()
    hop = lambda a, b: a.alias("a").join(b.alias("b"), _same("a", "b", by) & (F.col("a.exit") == F.col("b.pos"))).select(*(f"a.{n}" for n in by), "a.pos", "b.exit")
    jumps = [stored(exits.alias("a").join(entries.alias("b"), _same("a", "b", [*by, "pos"]), "left_semi"), "steps")]
    while True:  # steps twice as long each time, until none stays within its group
        longer = stored(hop(jumps[-1], jumps[-1]), "steps")
        if longer.isEmpty():
            break
        jumps.append(longer)
    reached = start
    for jump in reversed(jumps):
        there = reached.alias("a").join(jump.alias("b"), _same("a", "b", [*by, "pos"])).select(*(f"b.{n}" for n in by), F.col("b.exit").alias("pos"))
        reached = stored(reached.unionByName(there), "reached")
    # the last step of a group leads beyond its rows
    return reached.alias("a").join(exits.alias("b"), _same("a", "b", [*by, "pos"]), "left_semi")


def _walked(blocks: DataFrame, entries: DataFrame, by: list[str], block: int) -> DataFrame:
    """by, _block, pos, _local: how many batches of its block have begun, up to each row."""
    schema = T.StructType([*(blocks.schema[n] for n in [*by, "_block", "pos"]), T.StructField("_local", T.LongType())])
    entered = entries.withColumns({"_block": F.floor(F.col("pos") / block), "_entry": F.col("pos")}).drop("pos")
    rows = blocks.alias("a").join(entered.alias("b"), _same("a", "b", [*by, "_block"]), "left").select(*(f"a.{n}" for n in [*by, "_block", "pos", "next"]), "b._entry")

    def walk(table: pa.Table, starts: np.ndarray) -> pa.Table:
        pos, step = (table.column(c).to_numpy() for c in ("pos", "next"))
        n, entry = len(pos), table.column("_entry")
        to, begins = (np.arange(n) + step - pos).tolist(), np.zeros(n, np.int64)
        ends = np.append(starts[1:], n)
        for start, stop, at in zip(starts.tolist(), ends.tolist(), entry.take(pa.array(starts)).to_pylist(), strict=True):
            at = stop if at is None else start + at - int(pos[start])
            while at < stop:
                begins[at] = 1
                at = to[at]
        total = np.cumsum(begins)
        local = total - np.repeat(total[starts] - begins[starts], ends - starts)
        return table.select(schema.names[:-1]).append_column("_local", pa.array(local))

    return _over_blocks(rows, by, walk, schema)


def batches_by_reach(placed: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """``placed`` (with pos, from 0 without gaps in each group, and next > pos) with batch, from 0 in each group, instead of next."""
    blocks = stored(placed.select(*by, "pos", "next", F.floor(F.col("pos") / block).alias("_block")), "blocks")
    walked = stored(_walked(blocks, _reached(stored(_exits(blocks, by, block), "exits"), by), by, block), "walked")
    counts = walked.groupBy(*by, "_block").agg(F.max("_local").alias("_n"))
    base = totals_before(counts, ["_block"], {"_base": F.col("_n")}, by).drop("_n")
    numbers = walked.alias("a").join(base.alias("b"), _same("a", "b", [*by, "_block"])).select(*(f"a.{n}" for n in [*by, "pos"]), (F.col("b._base") + F.col("a._local") - 1).alias("batch"))
    return placed.drop("next").alias("a").join(numbers.alias("b"), _same("a", "b", [*by, "pos"])).select("a.*", "b.batch")


def greedy_batches(df: DataFrame, order: list[str], budgets: dict[str, int], by: list[str] | None = None, most: int | None = None, distinct: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with pos (from 0 in ``order``, within the groups ``by``) and batch: the rows in order go into a batch while it stays within its budgets.

    ``budgets``: column of sizes (whole numbers, none below 0; null is 0) -> the most that a batch
    holds of it; ``most``: rows of a batch; ``distinct``: column of items (array of name and bytes)
    -> the most bytes of the distinct items of a batch, with ``most`` only. A row beyond a budget by
    itself is a batch of its own. Null groups are a group. All columns of ``df`` are stored, some of
    them several times: give keys and sizes, and join what is long to the result.
    """
    by, distinct = by or [], distinct or {}
    if distinct and not most:
        raise ValueError("distinct items need a bound on rows")
    sizes = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in budgets}
    placed = totals_before(df, order, {"pos": F.lit(1).cast("long")} | {f"_before_{c}": x for c, x in sizes.items()}, by)
    placed = stored(placed.withColumns({f"_own_{c}": x for c, x in sizes.items()}), "placed")
    found, reaches = placed, []
    for k, (c, budget) in enumerate(budgets.items()):
        reaches.append((f"_reach{k}", reach_of_total(placed, by, f"_before_{c}", f"_own_{c}", budget)))
    for k, (c, budget) in enumerate(distinct.items(), len(reaches)):
        reaches.append((f"_reach{k}", reach_of_distinct(placed, by, c, budget, most, block)))
    for name, reach in reaches:
        found = found.alias("a").join(reach.alias("b"), _same("a", "b", [*by, "pos"]), "left").select("a.*", F.col("b.reach").alias(name))
    ends = [F.col(name) for name, _ in reaches] + ([F.col("pos") + most] if most else [])
    far = F.lit((1 << 62)).cast("long")
    step = F.greatest(F.least(*(F.coalesce(x, far) for x in ends), far), F.col("pos") + 1)
    found = found.withColumn("next", step).drop(*(n for n, _ in reaches), *(f"_before_{c}" for c in budgets), *(f"_own_{c}" for c in budgets))
    return batches_by_reach(found, by, block)


def lines_of(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """key, seg, line_no, line: the lines of a text with their line feeds. Lines longer than ``most`` go, and part the segments before and after."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = docs.select(key, F.size(parts).alias("_n"), F.posexplode(parts).alias("line_no", "line"))
    rows = rows.withColumn("line", F.when(F.col("line_no") < F.col("_n") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))).drop("_n")
    long = (F.length("line") > most).cast("int")
    # a window over the lines of one text
    parted = rows.withColumn("seg", F.sum(long).over(Window.partitionBy(key).orderBy("line_no")))
    return parted.where(F.length("line") <= most)


def pieces_of(lines: DataFrame, key: str, most: int) -> DataFrame:
    """key, seg, piece, text: whole lines up to ``most`` code points, stripped; of equal pieces of a text (case and white space aside) the first one."""
    sizes = lines.select(key, "seg", "line_no", F.length("line").cast("long").alias("size"))
    placed = greedy_batches(sizes, ["line_no"], {"size": most}, [key, "seg"]).select(key, "seg", "line_no", F.col("batch").alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    pieces = lines.join(placed, [key, "seg", "line_no"]).groupBy(key, "seg", "piece").agg(F.btrim(joined, F.lit(" \t\n\x0b\x0c\r")).alias("text")).where("text <> ''")
    same = Window.partitionBy(key, F.sha2(F.lower(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), 256)).orderBy("seg", "piece")
    return pieces.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def contexts_of(pieces: DataFrame, by: list[str], page: str, most: int) -> DataFrame:
    """by, batch, n_pieces, n_pages, text: pieces in the order of pages, with an empty line between, up to ``most`` code points with the line feeds."""
    keys = [page, "seg", "piece"]
    sizes = pieces.select(*by, *keys, (F.length("text") + 2).cast("long").alias("size"))
    placed = greedy_batches(sizes, keys, {"size": most}, by).select(*keys, "pos", "batch")
    rows = pieces.join(placed, keys)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy(*by, "batch").agg(F.count(F.lit(1)).alias("n_pieces"), F.count_distinct(page).alias("n_pages"), text.alias("text"))
