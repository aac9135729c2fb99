"""Order of trees that are given as tables of parents, in as many rounds as the depth has bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.operators.budgets import _same
from quill.operators.ordered import numbered
from quill.session import stored

#: Digits of a place among siblings in a path.
WIDTH = 12


def tree_order(nodes: DataFrame, node: str, parent: str, order: str, by: list[str] | None = None) -> DataFrame:
    """by, node, parent, order, depth, place: the nodes of each group in depth-first order, parents first, from 1.

    Siblings, and roots (null parent), come by ``order``, then ``node``. A path is a node's places
    among siblings, from its root on; each round puts before it the path of the ancestor where it
    begins, which is twice as long as a round earlier. Nodes below a missing parent, and those on or
    below a cycle, come last, by ``order``, then ``node``, with a null depth.
    """
    by = by or []
    own = nodes.select(*dict.fromkeys([*by, node, parent, order]))
    ranked = numbered(own, [order, node], "_rank", [*by, parent])
    paths = ranked.select(*by, F.col(node).alias("_node"), F.col(parent).alias("_up"), F.lpad(F.col("_rank").cast("string"), WIDTH, "0").alias("_path"))
    paths, rounds = stored(paths, "paths"), max(1, own.count()).bit_length() + 1
    for _ in range(rounds):
        open_ = paths.where("_up is not null")
        if open_.isEmpty():
            break
        # a missing ancestor leaves -1 behind it: nothing is above that, and no path is right
        above = paths.select(*by, F.col("_node").alias("_up"), F.col("_up").alias("_next"), F.col("_path").alias("_front"), F.lit(True).alias("_there"))
        met = open_.alias("a").join(above.hint("merge").alias("b"), _same("a", "b", [*by, "_up"]), "left")
        moved = met.select(*(f"a.{n}" for n in [*by, "_node"]), F.col("b._next").alias("_up"), F.when(F.col("b._there"), F.concat("b._front", "a._path")).alias("_path"))
        paths = stored(paths.where("_up is null").unionByName(moved), "paths")
    # after so many rounds whatever still has something above it is on a cycle or below one
    told = paths.select(*by, F.col("_node").alias(node), F.when(F.col("_up").isNull(), F.col("_path")).alias("_path"))
    rows = own.alias("a").join(told.hint("merge").alias("b"), _same("a", "b", [*by, node])).select("a.*", "b._path")
    rows = rows.withColumns({"depth": (F.length("_path") / WIDTH).cast("long"), "_last": F.col("_path").isNull(), "_order": F.when(F.col("_path").isNull(), F.col(order))})
    return numbered(rows, ["_last", "_path", "_order", node], "place", by).select(*dict.fromkeys([*by, node, parent, order]), "depth", "place")


#: Elements that have no content.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
TAG = r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>"


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, node, parent, name: the elements of each page by the number of their opening tag, under the last open one a level above.

    Levels go by opening and closing tags as they come; what is never closed stays open.
    """
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TAG), F.lit(0))).alias("node", "tag"))
    tags = tags.withColumns({"name": F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z0-9]+)", 1)), "closing": F.col("tag").startswith("</")})
    step = F.when(F.col("closing"), -1).when(F.col("name").isin(VOID), 0).otherwise(1)
    own = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    opened = tags.withColumns({"step": step, "level": F.coalesce(F.sum(step).over(own), F.lit(0))}).where(~F.col("closing"))
    # by levels: an element that can hold others, as what the later ones a level below look for
    asks = opened.select(key, "node", "name", (F.col("level") - 1).alias("level"), F.lit(None).cast("int").alias("holder"))
    holds = opened.where("step = 1").select(key, "node", F.lit(None).cast("string").alias("name"), "level", F.col("node").alias("holder"))
    last = Window.partitionBy(key, "level").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    found = asks.unionByName(holds).withColumn("parent", F.last("holder", ignorenulls=True).over(last))
    return found.where("name is not null").select(key, F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "name")
