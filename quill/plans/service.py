"""Predicates, JSON columns and changes of state of a learning service, on the test tables.

Changes are written as what a table holds after them: inserts as anti-joins, deletes as the rows that
stay, updates as columns by condition, snapshots by the largest version.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.plans.base import Plans, table

PLANS = Plans()


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


@PLANS.add("SELECT p_partkey, p_name FROM part WHERE p_type NOT LIKE '%a%' AND p_size BETWEEN 5 AND 40 AND p_brand <> 'Brand#11' ORDER BY p_partkey")
def flt_visible_topics(spark, d):
    """Not deleted, visible and approved, all three."""
    deleted, visible, approved = F.col("p_type").contains("a"), F.col("p_size").between(5, 40), F.col("p_brand") != "Brand#11"
    return table(spark, d, "part").where(~deleted & visible & approved).select("p_partkey", "p_name").orderBy("p_partkey")


@PLANS.add("SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 90 DAY END AS expires_at FROM orders) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '1998-01-01'")
def flt_unexpired(spark, d):
    o = table(spark, d, "orders").withColumn("expires_at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")))
    return o.where(F.col("expires_at").isNull() | (F.col("expires_at") > _ts("1998-01-01"))).select("o_orderkey")


@PLANS.add("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS decision, arg_max(value, (ts, event_id)) AS seen, max(ts) AS reviewed_at FROM events GROUP BY user_id),
f AS (SELECT *, seen > 50 AS stale FROM l WHERE decision IN ('click', 'view', 'purchase')) SELECT user_id, decision, reviewed_at, stale FROM f ORDER BY user_id LIMIT 20 OFFSET 5""")
def flt_latest_review_page(spark, d):
    """Records by their latest review, its decision and whether it is stale; one page of them."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")).alias("r"))
    rows = last.select("user_id", F.col("r.event_type").alias("decision"), F.col("r.ts").alias("reviewed_at"), (F.col("r.value") > 50).alias("stale"))
    return rows.where(F.col("decision").isin("click", "view", "purchase")).orderBy("user_id").offset(5).limit(20)


@PLANS.add("""SELECT o_orderkey, o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR (o_orderdate + INTERVAL 30 DAY) < TIMESTAMP '1999-01-01') AS released FROM orders""")
def flt_answers_released(spark, d):
    """Answers of a submitted attempt are shown at once, or after the due date."""
    submitted, at_once = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    due = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    return table(spark, d, "orders").select("o_orderkey", (submitted & (at_once | (due < _ts("1999-01-01")))).alias("released"))


@PLANS.add("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN a USING (o_custkey)
WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-01' < o_orderdate + INTERVAL 60 DAY AND n < 20""")
def flt_assignment_open(spark, d):
    """Opens at or before now, is due after now, and the learner has attempts left."""
    o, now = table(spark, d, "orders"), _ts("1998-06-01")
    used = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n < 20")
    return o.where((F.col("o_orderdate") <= now) & (now < F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))).join(used, "o_custkey").select("o_orderkey")


@PLANS.add("""WITH r AS (SELECT unnest([3, 7, 7, 11, 100000007])::BIGINT AS doc_id), own AS (SELECT doc_id FROM documents WHERE lang = 'en' OR lang = 'fr')
SELECT doc_id, CASE WHEN count(*) > 1 THEN 'REPEATED' WHEN min(o) IS NULL THEN 'MISSING' ELSE 'READY' END AS state FROM (SELECT r.doc_id, own.doc_id AS o FROM r LEFT JOIN own USING (doc_id)) GROUP BY doc_id""")
def flt_requested_documents(spark, d):
    """Requested ids against an owner's ready documents: which are there, missing, or asked for twice."""
    asked = spark.createDataFrame([(3,), (7,), (7,), (11,), (100000007,)], "doc_id bigint").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ready = table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", F.lit(True).alias("there"))
    state = F.when(F.col("n") > 1, "REPEATED").when(F.col("there").isNull(), "MISSING").otherwise("READY")
    return asked.join(ready, "doc_id", "left").select("doc_id", state.alias("state"))


@PLANS.add("""SELECT o_orderkey, to_json(struct_pack(orderkey := o_orderkey, status := o_orderstatus))::VARCHAR AS full_,
 CASE WHEN o_orderstatus = 'P' THEN json_object('orderkey', o_orderkey) ELSE json_object('orderkey', o_orderkey, 'status', o_orderstatus) END::VARCHAR AS stripped FROM orders""")
def jsn_row_objects(spark, d):
    """A row as a JSON object, whole and without nulls."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"))).alias("full_"), F.to_json(F.struct(F.col("o_orderkey").alias("orderkey"), status.alias("status"))).alias("stripped"))


@PLANS.add("""SELECT p_partkey, coalesce(json_array_length(j), 0)::INT AS n FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE to_json(string_split(p_name, ' ')) END AS j FROM part)""")
def jsn_array_length(spark, d):
    j = F.when(F.col("p_size") % 5 != 0, F.to_json(F.split("p_name", " ")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.json_array_length(j), F.lit(0)).alias("n"))


@PLANS.add("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '{}' ELSE json_object('k', json_extract(props, '$.k'))::VARCHAR END AS kept FROM events""")
def jsn_allowed_fields(spark, d):
    """Of an event's metadata only the named fields, whatever else it holds."""
    allowed = F.from_json(F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("secret"))), "k bigint")
    return table(spark, d, "events").select("event_id", F.to_json(allowed).alias("kept"))


@PLANS.add("""WITH h AS (SELECT user_id, count(*) AS activities FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-03' GROUP BY 1)
SELECT user_id, activities FROM h UNION ALL SELECT DISTINCT user_id, 0 FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM h)""")
def dml_insert_if_absent(spark, d):
    """Users who view get a row of their own; those who bought before have one and keep it."""
    e = table(spark, d, "events")
    held = e.where("event_type = 'purchase' AND ts < TIMESTAMP_NTZ '2024-01-03'").groupBy("user_id").agg(F.count(F.lit(1)).alias("activities"))
    fresh = e.where("event_type = 'view'").select("user_id").distinct().join(held, "user_id", "left_anti").withColumn("activities", F.lit(0).cast("long"))
    return held.unionByName(fresh)


@PLANS.add("""SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS legitimate, count(*) FILTER (WHERE event_type = 'signup') AS sessions,
 count(*) FILTER (WHERE event_type = 'view') AS ai_operations, coalesce(sum(CASE WHEN event_type = 'view' THEN greatest(value, 0)::DECIMAL(16,6) END), 0)::DOUBLE AS ai_cost FROM events GROUP BY user_id""")
def dml_counters(spark, d):
    """Counters by user, recomputed from the log."""
    is_ = lambda t: F.col("event_type") == t
    cost = F.coalesce(F.sum(F.when(is_("view"), F.greatest(F.col("value"), F.lit(0.0)).cast("decimal(16,6)"))), F.lit(0).cast("decimal(26,6)")).cast("double")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(is_("purchase")).alias("legitimate"), F.count_if(is_("signup")).alias("sessions"), F.count_if(is_("view")).alias("ai_operations"), cost.alias("ai_cost"))


@PLANS.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '1997-01-01')")
def dml_retention(spark, d):
    """What stays after finished jobs from before a day are deleted; a null day is never before it."""
    old = F.coalesce(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") < _ts("1997-01-01")), F.lit(False))
    return table(spark, d, "orders").where(~old).select("o_orderkey", "o_orderstatus")


@PLANS.add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'X' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN TIMESTAMP '1998-01-01' END AS changed_at FROM orders""")
def dml_bulk_transitions(spark, d):
    """Open threads from before a day expire; all others are as they were."""
    late = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < _ts("1998-01-01"))
    return table(spark, d, "orders").select("o_orderkey", F.when(late, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(late, _ts("1998-01-01")).alias("changed_at"))


@PLANS.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS active FROM lineitem""")
def dml_snapshot_supersede(spark, d):
    """The chunks of a source's newest version are active, those of earlier ones are not."""
    newest = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") == newest).alias("active"))


@PLANS.add("""SELECT conv_id, bool_and(ok) AS valid, count(*) AS turns FROM (SELECT conv_id, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ok FROM conversations) GROUP BY conv_id""")
def stm_contiguous_events(spark, d):
    """Whether the numbers of a thread's events run from 0 without a gap."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, d, "conversations").select("conv_id", (F.col("turn") == place).alias("ok")).groupBy("conv_id").agg(F.bool_and("ok").alias("valid"), F.count(F.lit(1)).alias("turns"))
