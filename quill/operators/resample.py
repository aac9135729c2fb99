"""Bootstrap intervals over clusters, and holdouts of whole groups with a wanted number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.operators.ordered import numbered
from quill.session import stored

REPLICATES, SEED = 2000, 42


def _drawn(*parts: Column | str) -> Column:
    """A number of 32 bits from an md5 digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def cluster_interval(rows: DataFrame, cluster: str, value: str, by: list[str] | None = None, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """by, clusters, mean, low, high: the mean of ``value`` and its 95 % interval over resampled clusters.

    A replicate draws as many clusters as there are, with replacement, and has the sum of their values
    over the sum of their rows; low and high are the values at 2.5 and 97.5 % of the replicates in
    order (the 50th and 1950th of 2000). Which cluster the k-th draw of replicate r takes follows from
    a digest of (seed, r, k) alone, so that any number of tasks gives the same interval. Draws are
    counted by cluster and replicate before they meet the clusters' sums. Rows without a value do not
    count; a null cluster is a cluster.
    """
    by = by or []
    units = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).cast("double").alias("_sum"), F.count(value).alias("_rows"))
    units = stored(numbered(units, [cluster], "_unit", by), "units")
    sizes = units.groupBy(*by).agg(F.max("_unit").alias("_n"), (F.sum("_sum") / F.sum("_rows")).alias("mean"))
    same = lambda a, b, names: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in names] or F.lit(True)
    # with no groups the one row of sizes is broadcast; groups are joined by their keys
    slots = units.alias("u").join(sizes.alias("s"), same("u", "s", by)) if by else units.alias("u").crossJoin(F.broadcast(sizes).alias("s"))
    slots = slots.select(*(f"u.{x}" for x in by), "_unit", "_n").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    pick = F.pmod(_drawn(F.lit(str(seed)), F.col("_r").cast("string"), F.col("_unit").cast("string")), F.col("_n")) + 1
    drawn = slots.groupBy(*by, "_r", pick.alias("_unit")).agg(F.count(F.lit(1)).alias("_times"))
    met = drawn.alias("d").join(units.alias("u"), same("d", "u", [*by, "_unit"]))
    means = met.groupBy(*(F.col(f"d.{x}").alias(x) for x in by), F.col("d._r").alias("_r")).agg((F.sum(F.col("_times") * F.col("_sum")) / F.sum(F.col("_times") * F.col("_rows"))).alias("_mean"))
    # as many values as replicates in each group, whatever the rows
    ordered = means.groupBy(*by).agg(F.array_sort(F.collect_list("_mean")).alias("_all"))
    ends = ordered.select(*by, *(F.get("_all", F.lit(max(0, round(replicates * x) - 1))).alias(name) for name, x in (("low", 0.025), ("high", 0.975))))
    both = sizes.alias("s").join(ends.alias("e"), same("s", "e", by)) if by else sizes.alias("s").crossJoin(F.broadcast(ends).alias("e"))
    return both.select(*(f"s.{x}" for x in by), F.col("_n").alias("clusters"), "mean", "low", "high")


def wanted_sizes(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size add up to the reachable total nearest to ``target``.

    ``counts``: size -> groups of that size. Of totals as near the smaller one is taken; zero is none. Reachable
    totals are bits of a number, one number for each doubling of a size's groups; the way back gives the counts.
    """
    limit = max(2 * target, target + 50)
    mask, steps, reach = (1 << limit + 1) - 1, [], 1
    for size in sorted(s for s in counts if 0 < s <= limit):
        left, times = min(counts[size], limit // size), 1
        while left:
            times = min(times, left)
            steps.append((size, times, reach))
            reach |= reach << size * times & mask
            left, times = left - times, 2 * times
    totals = [n for n in range(1, limit + 1) if reach >> n & 1]
    if not totals:  # every group is beyond the limit: the smallest one
        sizes = [s for s in counts if s > 0]
        return {min(sizes): 1} if sizes else {}
    total, taken = min(totals, key=lambda n: (abs(n - target), n > target)), {}
    for size, times, before in reversed(steps):
        if not before >> total & 1:
            total -= size * times
            taken[size] = taken.get(size, 0) + times
    return taken


def held_out_groups(rows: DataFrame, group: str, target: int, seed: int = SEED) -> DataFrame:
    """group, size, held_out: whole groups held out whose rows come as near to ``target`` as any choice of groups does.

    Only how many groups there are of each size reaches the driver: at most max(2 * target, target + 50)
    sizes, which ``target`` bounds. Of the groups of a size those of the smallest digests are taken.
    """
    sizes = stored(rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")), "groups")
    limit = max(2 * target, target + 50)
    counts = {r["size"]: r["n"] for r in sizes.where(F.col("size") <= limit).groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        least = sizes.agg(F.min("size")).first()[0]
        counts = {} if least is None else {least: 1}
    taken = wanted_sizes(counts, target)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    # a short table, one row for each size that is taken
    wanted = F.broadcast(rows.sparkSession.createDataFrame(list(taken.items()), "size bigint, _take bigint"))
    placed = numbered(sizes.join(wanted, "size", "left").withColumns({"_take": F.coalesce("_take", F.lit(0)), "_key": key}), ["_key", group], "_place", ["size"])
    return placed.select(group, "size", (F.col("_place") <= F.col("_take")).alias("held_out"))

