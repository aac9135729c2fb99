"""Product analytics on ``events``: sign-ups register, purchases are completed requests, errors failed logins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.functions.values import band
from quill.operators import analytics as A
from quill.plans.base import Plans, table

PLANS = Plans()
KINDS = {"signup": A.REGISTERED, "purchase": A.COMPLETED, "error": A.FAILED}
START, TO = dt.date(2024, 1, 1), dt.date(2024, 1, 30)
_PE = r"""
pe AS (
  SELECT event_id, ts, ts::DATE AS day, user_id, value, props,
         CASE event_type WHEN 'signup' THEN 'USER_REGISTERED' WHEN 'purchase' THEN 'AI_REQUEST_COMPLETED' WHEN 'error' THEN 'LOGIN_FAILED' ELSE upper(event_type) END AS kind,
         CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+(\.[0-9]+)?$') THEN json_extract_string(props, '$.k')::DECIMAL(38,6) ELSE 0 END AS cost,
         coalesce(nullif(json_extract_string(props, '$.provider'), ''), 'unknown') AS provider,
         coalesce(nullif(json_extract_string(props, '$.k'), ''), 'unknown') AS model
  FROM events)"""
_DAILY = """, dum AS (
  SELECT day, user_id, count(*) AS n_events, count(*) FILTER (WHERE kind = 'AI_REQUEST_COMPLETED') AS ai_requests,
         count(*) FILTER (WHERE kind = 'LOGIN_FAILED') AS failed_logins,
         sum(CASE WHEN kind = 'AI_REQUEST_COMPLETED' THEN cost ELSE 0 END) AS ai_cost
  FROM pe GROUP BY ALL)"""


def pe(spark, d):
    return A.product_events(table(spark, d, "events"), KINDS)


@PLANS.add(f"WITH {_PE}{_DAILY} SELECT day, user_id, n_events, ai_requests, failed_logins, ai_cost::DOUBLE AS ai_cost FROM dum")
def agg_daily_user_metrics(spark, d):
    return A.daily_user_metrics(pe(spark, d)).withColumn("ai_cost", F.col("ai_cost").cast("double"))


@PLANS.add(f"""WITH {_PE}, spine AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day),
m AS (SELECT day, count(DISTINCT user_id) FILTER (WHERE kind <> 'USER_REGISTERED') AS active_users,
  count(*) FILTER (WHERE kind = 'USER_REGISTERED') AS registrations, count(*) FILTER (WHERE kind = 'AI_REQUEST_COMPLETED') AS ai_requests,
  count(*) FILTER (WHERE kind = 'LOGIN_FAILED') AS failed_logins, count(*) FILTER (WHERE kind = 'VIEW') AS views, count(*) FILTER (WHERE kind = 'CLICK') AS clicks
  FROM pe GROUP BY day)
SELECT day, coalesce(active_users, 0) AS active_users, coalesce(registrations, 0) AS registrations, coalesce(ai_requests, 0) AS ai_requests,
  coalesce(failed_logins, 0) AS failed_logins, coalesce(views, 0) AS views, coalesce(clicks, 0) AS clicks FROM spine LEFT JOIN m USING (day)""")
def agg_daily_platform_metrics(spark, d):
    return A.daily_platform_metrics(pe(spark, d), dt.date(2023, 12, 30), dt.date(2024, 2, 1))


@PLANS.add(f"""WITH {_PE} SELECT day, provider, model, count(*) FILTER (WHERE kind = 'AI_REQUEST_COMPLETED') AS succeeded,
  count(*) FILTER (WHERE kind = 'LOGIN_FAILED') AS failed, sum(CASE WHEN kind = 'AI_REQUEST_COMPLETED' THEN cost ELSE 0 END)::DOUBLE AS cost, 0::BIGINT AS tokens
FROM pe WHERE kind IN ('AI_REQUEST_COMPLETED', 'LOGIN_FAILED') GROUP BY day, provider, model""")
def agg_daily_ai_metrics(spark, d):
    return A.daily_ai_metrics(pe(spark, d)).withColumn("cost", F.col("cost").cast("double"))


@PLANS.add(f"""WITH {_PE}, u AS (SELECT day, 'LOGIN_FAILED' AS type, count(*) AS n FROM pe WHERE kind = 'LOGIN_FAILED' GROUP BY day
UNION ALL SELECT day, 'RISK_' || kind, count(*) FROM pe WHERE value >= 90 GROUP BY day, kind) SELECT day, type, sum(n)::BIGINT AS n FROM u GROUP BY day, type""")
def agg_daily_security_metrics(spark, d):
    return A.daily_security_metrics(pe(spark, d), 90.0)


@PLANS.add(f"""WITH {_PE} SELECT count(DISTINCT user_id) FILTER (WHERE day = DATE '2024-01-30') AS dau,
  count(DISTINCT user_id) FILTER (WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30') AS wau,
  count(DISTINCT user_id) FILTER (WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30') AS mau FROM pe""")
def agg_daily_active_users(spark, d):
    return A.active_users(pe(spark, d), TO, {"dau": 1, "wau": 7, "mau": 30})


@PLANS.add(f"""WITH {_PE}, t AS (SELECT count(DISTINCT user_id) AS users, count(*) FILTER (WHERE kind = 'AI_REQUEST_COMPLETED') AS requests,
  count(*) FILTER (WHERE kind = 'LOGIN_FAILED') AS refused, coalesce(sum(cost) FILTER (WHERE kind = 'AI_REQUEST_COMPLETED'), 0)::DOUBLE AS cost
  FROM pe WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
SELECT users, requests, refused, cost, round(cost / users, 6) AS cost_per_user, round(cost / requests, 6) AS cost_per_request,
  round(refused / requests, 6) AS refused_per_request, round(refused / (requests + refused), 6) AS refused_share FROM t""")
def agg_platform_overview(spark, d):
    return A.overview(pe(spark, d), dt.date(2024, 1, 5), dt.date(2024, 1, 20))


@PLANS.add(f"""WITH {_PE}, m AS (SELECT provider, model, count(*) AS requests, count(*) FILTER (WHERE value >= 10) AS successes, count(*) FILTER (WHERE value < 10) AS failures,
 sum(floor(value * 10))::BIGINT AS input_tokens, sum(floor(value))::BIGINT AS output_tokens, sum((value / 100)::DECIMAL(16,6))::DOUBLE AS estimated_cost, sum(cost)::DOUBLE AS cost FROM pe WHERE kind = 'AI_REQUEST_COMPLETED' GROUP BY provider, model)
SELECT *, row_number() OVER (ORDER BY cost DESC, provider, model) AS place FROM m""")
def agg_ai_model_usage(spark, d):
    """The seven sums of each model, and its place by actual cost."""
    rows = pe(spark, d).where(F.col("kind") == A.COMPLETED)
    total = lambda c: F.sum(c).cast("long")
    m = rows.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") >= 10).alias("successes"), F.count_if(F.col("value") < 10).alias("failures"),
        total(F.floor(F.col("value") * 10)).alias("input_tokens"), total(F.floor("value")).alias("output_tokens"),
        F.sum((F.col("value") / 100).cast("decimal(16,6)")).cast("double").alias("estimated_cost"), F.sum("cost").cast("double").alias("cost"),
    )
    order = Window.orderBy(F.desc("cost"), "provider", "model")  # a row per model
    return m.withColumn("place", F.row_number().over(order).cast("long"))


@PLANS.add(f"WITH {_PE}{_DAILY} SELECT user_id, sum(ai_cost)::DOUBLE AS cost FROM dum GROUP BY user_id HAVING sum(ai_cost) > 0 ORDER BY cost DESC, user_id LIMIT 20")
def agg_top_cost_users(spark, d):
    return A.top_cost_users(A.daily_user_metrics(pe(spark, d)), 20).withColumn("cost", F.col("cost").cast("double"))


@PLANS.add(f"""WITH {_PE}{_DAILY}, c AS (SELECT user_id, sum(ai_cost) AS cost FROM dum GROUP BY user_id HAVING sum(ai_cost) > 0),
r AS (SELECT cost, row_number() OVER (ORDER BY cost DESC, user_id) AS rn, count(*) OVER () AS n FROM c)
SELECT round(coalesce(sum(cost) FILTER (WHERE rn <= greatest(1, ceil(n * 0.01)))::DOUBLE / sum(cost)::DOUBLE, 0), 9) AS top_share FROM r""")
def agg_top1pct_cost_share(spark, d):
    return A.top_share(A.daily_user_metrics(pe(spark, d)).groupBy("user_id").agg(F.sum("ai_cost").alias("cost")))


def _retention_sql(n: int, to: dt.date) -> str:
    return f"""WITH {_PE}, seen AS (SELECT DISTINCT user_id, day FROM pe)
SELECT c.day AS cohort_day, count(*) AS registered, count(s.user_id) AS retained, round(count(s.user_id) / count(*), 4) AS rate
FROM pe c LEFT JOIN seen s ON s.user_id = c.user_id AND s.day = c.day + {n}
WHERE c.kind = 'USER_REGISTERED' AND c.day <= DATE '{to}' - {n} GROUP BY c.day"""


def _retention(n: int, to: dt.date):
    def run(spark, d):
        return A.cohort_retention(pe(spark, d), n, to)

    run.__name__ = f"join_cohort_retention_d{n}"
    return run


#: The tables hold thirty days, so cohorts of thirty days later are asked for after their end.
for _n, _to in ((1, TO), (7, TO), (30, TO + dt.timedelta(15))):
    PLANS.add(_retention_sql(_n, _to))(_retention(_n, _to))


@PLANS.add(f"""WITH {_PE} SELECT CASE WHEN value / 100 >= 0.9 THEN 'CRITICAL' WHEN value / 100 >= 0.6 THEN 'HIGH' WHEN value / 100 >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  count(*) AS n, min(value) AS low, max(value) AS high FROM pe GROUP BY 1""")
def flt_risk_bands(spark, d):
    return pe(spark, d).groupBy(band(F.col("value") / 100).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@PLANS.add(f"WITH {_PE} SELECT event_id, user_id, kind FROM pe WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' AND kind ILIKE '%login%'")
def flt_optional_predicates(spark, d):
    query, kind, start, stop = "login", None, dt.date(2024, 1, 10), dt.date(2024, 1, 12)
    rows = A.events_between(pe(spark, d), start, stop)
    rows = rows.where(F.col("kind").ilike(f"%{query}%")) if query else rows
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.select("event_id", "user_id", "kind")


@PLANS.add(f"WITH {_PE} SELECT event_id, ts, kind FROM pe WHERE (ts, event_id) < (TIMESTAMP '2024-01-15', 0) ORDER BY ts DESC, event_id DESC LIMIT 50")
def flt_keyset_page(spark, d):
    before = F.struct(F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("event_id"))
    return pe(spark, d).where(F.struct("ts", "event_id") < before).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "kind")


@PLANS.add(f"WITH {_PE} SELECT event_id, ts, kind, (SELECT count(*) FROM pe WHERE kind = 'VIEW') AS total FROM pe WHERE kind = 'VIEW' ORDER BY ts, event_id LIMIT 25 OFFSET 50")
def flt_offset_page(spark, d):
    rows = pe(spark, d).where(F.col("kind") == "VIEW")
    page = rows.orderBy("ts", "event_id").offset(50).limit(25).select("event_id", "ts", "kind")
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


@PLANS.add(f"WITH {_PE} SELECT model, count(*) AS n FROM pe GROUP BY model")
def map_json_counts(spark, d):
    """How often each value stands in a JSON field, as pairs; a map of them would be one row of all keys."""
    return pe(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@PLANS.add("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT k FROM l))
SELECT o_orderkey AS k, 'id' AS path, o_orderkey::VARCHAR AS value FROM o UNION ALL SELECT o_orderkey, 'who.customer', o_custkey::VARCHAR FROM o UNION ALL SELECT o_orderkey, 'who["order.state"]', o_orderstatus FROM o
UNION ALL SELECT k, 'items[' || i || '].n', n::VARCHAR FROM l UNION ALL SELECT k, 'items[' || i || '].part', p::VARCHAR FROM l
UNION ALL SELECT k, 'parts', '[' || string_agg(p::VARCHAR, ', ' ORDER BY i) || ']' FROM l GROUP BY k""")
def src_json_flatten_nested(spark, d):
    """Orders with their lines as nested JSON: objects, arrays of objects, an array of numbers, a key that is no identifier."""
    from quill.sources.flatten import flattened

    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")))).alias("items"))
    rows = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("k"))
    who = F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("order.state"))
    return flattened(rows.select("k", F.to_json(F.struct(F.col("o_orderkey").alias("id"), who.alias("who"), "items", F.col("items.part").alias("parts"))).alias("json")), "k", "json")


@PLANS.add("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def src_json_flatten(spark, d):
    from quill.sources.flatten import flattened

    return flattened(table(spark, d, "events"), "event_id", "props")
