"""Product analytics over an event table: daily rollups, active users, retention, cost."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.values import guarded_decimal, json_or, ratio
from quill.operators.ordered import running

#: Event kinds as the rollups know them.
REGISTERED, COMPLETED, FAILED = "USER_REGISTERED", "AI_REQUEST_COMPLETED", "LOGIN_FAILED"


def product_events(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """events (event_id, ts, user_id, event_type, value, props) with kinds renamed, day and JSON fields."""
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.upper("event_type"))
    return events.select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", kind.alias("kind"), "value", "props", guarded_decimal(F.get_json_object("props", "$.k")).alias("cost"), json_or(F.col("props"), "$.provider").alias("provider"), json_or(F.col("props"), "$.k").alias("model"))


def daily_user_metrics(pe: DataFrame) -> DataFrame:
    done = F.col("kind") == COMPLETED
    return pe.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(done).alias("ai_requests"), F.count_if(F.col("kind") == FAILED).alias("failed_logins"), F.sum(F.when(done, F.col("cost")).otherwise(0)).alias("ai_cost"))


def calendar(pe: DataFrame, start: dt.date, stop: dt.date) -> DataFrame:
    return pe.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(stop))).alias("day"))


def between(day: Column, start: dt.date, stop: dt.date) -> Column:
    return (day >= F.lit(start)) & (day <= F.lit(stop))


def events_between(pe: DataFrame, start: dt.date, stop: dt.date) -> DataFrame:
    """Inclusive days, as a half-open range of ts: it reaches the scan as a pushed filter."""
    return pe.where((F.col("ts") >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz")) & (F.col("ts") < F.lit(dt.datetime.combine(stop + dt.timedelta(1), dt.time())).cast("timestamp_ntz")))


def daily_platform_metrics(pe: DataFrame, start: dt.date, stop: dt.date) -> DataFrame:
    """Every day of the range, also those without events; registrations alone make nobody active."""
    kinds = {"registrations": REGISTERED, "ai_requests": COMPLETED, "failed_logins": FAILED, "views": "VIEW", "clicks": "CLICK"}
    daily = events_between(pe, start, stop).groupBy("day").agg(F.countDistinct(F.when(F.col("kind") != REGISTERED, F.col("user_id"))).alias("active_users"), *(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))
    return calendar(pe, start, stop).join(daily, "day", "left").fillna(0)


def daily_ai_metrics(pe: DataFrame) -> DataFrame:
    done, failed = F.col("kind") == COMPLETED, F.col("kind") == FAILED
    return pe.where(done | failed).groupBy("day", "provider", "model").agg(F.count_if(done).alias("succeeded"), F.count_if(failed).alias("failed"), F.sum(F.when(done, F.col("cost")).otherwise(0)).alias("cost"), F.lit(0).cast("long").alias("tokens"))


def daily_security_metrics(pe: DataFrame, risk_from: float) -> DataFrame:
    """Failed logins and risky events, each a branch of one union, by day and type."""
    logins = pe.where(F.col("kind") == FAILED).groupBy("day", F.lit("LOGIN_FAILED").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    risky = pe.where(F.col("value") >= risk_from).groupBy("day", F.concat(F.lit("RISK_"), F.col("kind")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return logins.unionByName(risky).groupBy("day", "type").agg(F.sum("n").alias("n"))


def active_users(pe: DataFrame, to: dt.date, spans: dict[str, int]) -> DataFrame:
    """Distinct users in trailing days up to ``to``, all spans in one pass."""
    longest = to - dt.timedelta(max(spans.values()) - 1)
    seen = events_between(pe, longest, to)
    return seen.agg(*(F.countDistinct(F.when(between(F.col("day"), to - dt.timedelta(n - 1), to), F.col("user_id"))).alias(name) for name, n in spans.items()))


def overview(pe: DataFrame, start: dt.date, stop: dt.date) -> DataFrame:
    seen = events_between(pe, start, stop)
    total = seen.agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("kind") == COMPLETED).alias("requests"), F.count_if(F.col("kind") == FAILED).alias("refused"), F.coalesce(F.sum(F.when(F.col("kind") == COMPLETED, F.col("cost"))), F.lit(0)).alias("cost"))
    return total.select("users", "requests", "refused", F.col("cost").cast("double").alias("cost"), ratio(F.col("cost"), F.col("users")).alias("cost_per_user"), ratio(F.col("cost"), F.col("requests")).alias("cost_per_request"), ratio(F.col("refused"), F.col("requests")).alias("refused_per_request"), ratio(F.col("refused"), F.col("requests") + F.col("refused")).alias("refused_share"))


def cohort_retention(pe: DataFrame, n: int, to: dt.date) -> DataFrame:
    """By day of registration: its rows, and those whose user was active exactly n days later."""
    cohort = pe.where((F.col("kind") == REGISTERED) & (F.col("day") <= F.lit(to - dt.timedelta(n)))).select(F.col("day").alias("cohort_day"), "user_id", F.date_add("day", n).alias("day"))
    back = pe.select("user_id", "day").distinct().withColumn("back", F.lit(1))
    return cohort.join(back, ["user_id", "day"], "left").groupBy("cohort_day").agg(F.count(F.lit(1)).alias("registered"), F.count("back").alias("retained")).withColumn("rate", ratio(F.col("retained"), F.col("registered"), 4))


def top_cost_users(daily: DataFrame, limit: int) -> DataFrame:
    limit = min(100, max(1, limit))
    return daily.groupBy("user_id").agg(F.sum("ai_cost").alias("cost")).where("cost > 0").orderBy(F.desc("cost"), "user_id").limit(limit)


def top_share(costs: DataFrame, key: str = "user_id", cost: str = "cost", share: float = 0.01) -> DataFrame:
    """Share of the cost that the dearest ``share`` of payers have (at least one payer).

    The boundary is found by counting payers per cost, so no row order over all payers is needed.
    """
    paid = costs.where(F.col(cost) > 0)
    totals = paid.agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("all"))
    by_cost = paid.groupBy(cost).agg(F.count(F.lit(1)).alias("same"))
    ranked = running(by_cost.withColumn("_down", -F.col(cost)), ["_down"], F.col("same"), "before").crossJoin(F.broadcast(totals))
    taken = F.greatest(F.lit(0), F.least(F.col("same"), F.greatest(F.lit(1), F.ceil(F.col("n") * share)) - F.col("before")))
    top = ranked.agg(F.sum(taken * F.col(cost)).alias("top"), F.max("all").alias("all"))
    return top.select(F.round(F.coalesce(F.col("top").cast("double") / F.col("all").cast("double"), F.lit(0.0)), 9).alias("top_share"))
