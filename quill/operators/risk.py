"""Risk and trust of accounts, rate limits, and changes of keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.values import clamp


def rolling_risk(events: DataFrame, user: str, ts: str, delta: Column, days: int = 30) -> DataFrame:
    """Of each event its user's risk: positive deltas of the trailing days, in [0, 1]."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(seconds).rangeBetween(-days * 86_400, 0)
    return events.withColumn("risk", clamp(F.round(F.sum(F.greatest(delta, F.lit(0.0))).over(w), 6), 0.0, 1.0))


def trust(verified: Column, good: Column, sessions: Column, age: Column, risk: Column) -> Column:
    """20 to start with, capped points for what speaks for an account, less 60 times its risk; in [0, 100]."""
    points = F.lit(20) + F.when(verified, 15).otherwise(0) + F.least(F.lit(30), good * 3) + F.least(F.lit(15), sessions) + age - F.floor(60 * risk + 0.5).cast("int")
    return clamp(points, 0, 100).cast("int")


def level(score: Column, risk: Column, verified: Column, good: Column) -> Column:
    """By risk first; trust counts only for a verified account with enough activity."""
    by_risk = F.when(risk >= 0.9, "BLOCKED").when(risk >= 0.6, "RESTRICTED").when(risk >= 0.3, "CAUTION")
    return by_risk.when(verified & (good >= 10) & (score >= 75), "TRUSTED").when(verified & (good >= 2), "NORMAL").otherwise("CAUTION")


def over_limit(events: DataFrame, key: str, ts: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Fixed windows of the epoch: the place of each event in its key's window, and whether it is refused."""
    window = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)
    place = F.row_number().over(Window.partitionBy(key, window).orderBy(ts, order))
    return events.withColumn("window", window).withColumn("place", place.cast("long")).withColumn("refused", F.col("place") > limit)


def transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Events with their key's state before; the same state twice in a row counts once."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(state)))
