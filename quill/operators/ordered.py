"""Running totals and numbers in an order over many partitions, without a task that sees all rows.

Rows are dealt by ranges of the order. Each range adds up its own rows, the ranges' totals, one row
each, give every range what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.session import stored


def totals_before(df: DataFrame, order: list[str], sizes: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with the sums of ``sizes`` (name -> size) over the rows before each, in ``order``, within the groups ``by``.

    A group is cut into ranges like everything else, so one group may hold all rows. The dealt rows
    are stored once, with all columns of ``df``, since totals and rows have to see the same ranges:
    leave out what is not needed. Equal places in the order come in any order, the same in all sums.
    """
    by = by or []
    held = {f"_size_{name}": size for name, size in sizes.items()}
    dealt = stored(df.withColumns(held).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ranges = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part", *by).agg(*(F.sum(name).alias(f"_n{name}") for name in held))
    # what lies before a range stands as a row of its own before the range's rows: nothing is joined, and
    # nothing is broadcast where groups are many
    heads = sums.select("_part", *by, *(F.coalesce(F.sum(f"_n{name}").over(ranges), F.lit(0)).alias(name) for name in held), F.lit(0).alias("_row"))
    rows = dealt.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    own = Window.partitionBy("_part", *by).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({name: F.sum(f"_size_{name}").over(own) for name in sizes}).where("_row = 1")
    return out.drop("_part", "_row", *held)


def running(df: DataFrame, order: list[str], size: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with one sum over the rows before each."""
    return totals_before(df, order, {name: size}, by)


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the number of each row in ``order``, from 1, within the groups ``by``."""
    return running(df, order, F.lit(1).cast("long"), name, by).withColumn(name, F.col(name) + 1)
