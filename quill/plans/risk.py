"""Risk, trust and rate limits on ``events`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.functions.values import age_points
from quill.operators import risk as R
from quill.plans.base import Plans, table

PLANS = Plans()


@PLANS.add("""SELECT event_id, user_id, least(1, greatest(0, round(sum(greatest(CASE WHEN event_type = 'error' THEN value / 1000 ELSE -0.01 END, 0))
 OVER (PARTITION BY user_id ORDER BY epoch_us(ts)::BIGINT // 1000000 RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW), 6)))::DOUBLE AS risk FROM events""")
def win_rolling_risk(spark, d):
    delta = F.when(F.col("event_type") == "error", F.col("value") / 1000).otherwise(-0.01)
    return R.rolling_risk(table(spark, d, "events"), "user_id", "ts", delta, 30).select("event_id", "user_id", "risk")


@PLANS.add("""WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') > 0 AS verified, count(*) FILTER (WHERE event_type = 'purchase') AS good, count(DISTINCT ts::DATE) AS sessions,
 greatest(0, DATE '2024-01-31' - min(ts)::DATE) AS days, round(least(1, count(*) FILTER (WHERE event_type = 'error' AND value > 60) / 20), 5) AS risk FROM events GROUP BY user_id),
t AS (SELECT *, 20 + CASE WHEN verified THEN 15 ELSE 0 END + least(30, good * 3) + least(15, sessions) + least(10, floor(days * 0.10)::INT) AS points FROM s),
u AS (SELECT *, least(100, greatest(0, points - floor(60 * risk + 0.5)))::INT AS trust FROM t)
SELECT user_id, risk::DOUBLE AS risk, trust, CASE WHEN risk >= 0.90 THEN 'BLOCKED' WHEN risk >= 0.60 THEN 'RESTRICTED' WHEN risk >= 0.30 THEN 'CAUTION'
 WHEN verified AND good >= 10 AND trust >= 75 THEN 'TRUSTED' WHEN verified AND good >= 2 THEN 'NORMAL' ELSE 'CAUTION' END AS level FROM u""")
def agg_trust_levels(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "signup") > 0).alias("verified"), F.count_if(F.col("event_type") == "purchase").alias("good"), F.countDistinct(F.to_date("ts")).alias("sessions"), F.min("ts").alias("first"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 60)).alias("bad"))
    s = s.withColumn("risk", F.round(F.least(F.lit(1.0), F.col("bad") / 20), 5))
    s = s.withColumn("trust", R.trust(F.col("verified"), F.col("good"), F.col("sessions"), age_points(F.greatest(F.lit(0), F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("first")))), F.col("risk")))
    return s.select("user_id", "risk", "trust", R.level(F.col("trust"), F.col("risk"), F.col("verified"), F.col("good")).alias("level"))


@PLANS.add("""WITH w AS (SELECT event_id, user_id, ts, epoch_us(ts)::BIGINT // 3600000000 AS "window" FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, "window" ORDER BY ts, event_id) AS place FROM w)
SELECT event_id, user_id, "window", place, place > 1 AS refused FROM p""")
def stm_rate_limit_tumbling(spark, d):
    return R.over_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 3600, 1).select("event_id", "user_id", "window", "place", "refused")


@PLANS.add("""WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type, before FROM l WHERE before IS DISTINCT FROM event_type""")
def win_state_transitions(spark, d):
    return R.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "before")


@PLANS.add("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def win_latest_review(spark, d):
    e = table(spark, d, "events")
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")
    return e.groupBy("user_id").agg(last).select("user_id", "e.event_id", "e.event_type")


@PLANS.add("""SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def top_latest_per_user(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id", "event_type", "ts")


@PLANS.add("""WITH l AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY user_id) SELECT user_id, beat FROM l WHERE beat < TIMESTAMP '2024-01-29 12:00:00'""")
def stm_stale_heartbeats(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("beat")).where(F.col("beat") < F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))


@PLANS.add("""SELECT event_id, user_id, ts FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 101""")
def stm_event_tail(spark, d):
    return table(spark, d, "events").where("event_id > 500").orderBy("event_id").limit(101).select("event_id", "user_id", "ts")
