"""Learning statistics on the order tables: customers take attempts (orders), whose answers are line items about parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.functions.values import age_points, backoff_seconds, hash_bucket, micros, ratio, same_choice, token_cost, whole_seconds
from quill.operators import learning as L
from quill.plans.base import Plans, table

PLANS = Plans()


@PLANS.add("""SELECT count(DISTINCT o_custkey) AS participants, count(*) AS attempts, round(avg(CASE WHEN o_totalprice < 400000 THEN o_totalprice / 4000 END), 2) AS average,
 max(CASE WHEN o_totalprice < 400000 THEN o_totalprice / 4000 END) AS best, min(CASE WHEN o_totalprice < 400000 THEN o_totalprice / 4000 END) AS worst,
 round(avg(CASE WHEN stop IS NULL THEN 0 ELSE greatest(0, epoch_us(stop) // 1000000 - epoch_us(o_orderdate) // 1000000) END))::BIGINT AS mean_seconds
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 HOUR END AS stop FROM orders)""")
def agg_quiz_summary(spark, d):
    o = table(spark, d, "orders").withColumn("percentage", F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice") / 4000)).withColumn("stop", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")))
    return L.summary(o, "o_custkey", "percentage", "o_orderdate", "stop")


@PLANS.add("""SELECT l_partkey AS question, min(p_name) AS prompt, count(*) AS answers, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_correct, min(l_linenumber) AS first_position,
 round(100 * count(*) FILTER (WHERE l_returnflag <> 'R') / count(*), 2) AS accuracy FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey""")
def agg_question_accuracy(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return L.question_accuracy(rows, F.col("l_partkey"), "p_name", "l_linenumber", F.col("l_returnflag") != "R")


@PLANS.add("""SELECT c_custkey, round(coalesce(round(avg(o_totalprice / 5000), 2), 0), 2) AS average FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def agg_learner_average(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg(F.col("o_totalprice") / 5000), 2).alias("average"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0.0, "average")


@PLANS.add("SELECT l_orderkey, l_returnflag AS assignment, (coalesce(max(CASE WHEN l_linenumber <> 2 THEN l_linenumber END), 0) + 1)::BIGINT AS next_number FROM lineitem GROUP BY 1, 2")
def agg_next_attempt_number(spark, d):
    """The largest number so far and one; numbers of deleted attempts (the second ones here) leave gaps."""
    kept = F.max(F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")))
    return table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("assignment")).agg((F.coalesce(kept, F.lit(0)) + 1).cast("long").alias("next_number"))


@PLANS.add("""SELECT l_orderkey, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS score, sum(l_quantity::BIGINT)::BIGINT AS max_score,
 count(*) FILTER (WHERE l_returnflag <> 'R') AS n_correct, count(*) AS n_answers,
 CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE round(100.0::DOUBLE * sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 2) END AS percentage FROM lineitem GROUP BY l_orderkey""")
def agg_attempt_grading(spark, d):
    return L.graded(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") != "R", F.col("l_quantity").cast("long"))


@PLANS.add("""SELECT l_suppkey, count(DISTINCT o_custkey) AS learners, count(*) AS attempts, count(*) FILTER (WHERE l_tax > 0) AS ratings,
 CASE WHEN count(*) FILTER (WHERE l_tax > 0) = 0 THEN NULL ELSE round(sum(l_linenumber) FILTER (WHERE l_tax > 0) / count(*) FILTER (WHERE l_tax > 0), 2) END AS average
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey""")
def agg_rating_statistics(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rated = F.col("l_tax") > 0
    out = rows.groupBy("l_suppkey").agg(F.countDistinct("o_custkey").alias("learners"), F.count(F.lit(1)).alias("attempts"), F.count_if(rated).alias("ratings"), F.sum(F.when(rated, F.col("l_linenumber"))).alias("s"))
    return out.withColumn("average", F.round(F.col("s") / F.nullif(F.col("ratings"), F.lit(0)), 2)).drop("s")


@PLANS.add("SELECT source, coalesce(sum(n_chars) FILTER (WHERE lang = 'en'), 0)::BIGINT AS ready_chars, count(*) AS documents FROM documents GROUP BY source UNION ALL SELECT NULL, coalesce(sum(n_chars) FILTER (WHERE lang = 'en'), 0)::BIGINT, count(*) FROM documents")
def agg_storage_usage(spark, d):
    ready = F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), F.lit(0)).alias("ready_chars")
    return table(spark, d, "documents").groupingSets([["source"], []], "source").agg(ready, F.count(F.lit(1)).alias("documents"))


@PLANS.add("SELECT o_orderstatus, o_orderpriority, count(*) AS waiting, min(o_orderdate) AS oldest FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL")
def agg_queue_metrics(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("waiting"), F.min("o_orderdate").alias("oldest"))


@PLANS.add("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 10")
def top_queue_claim(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "O").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(10).select("o_orderkey", "o_orderpriority", "o_orderdate")


@PLANS.add("""WITH b AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_partkey, p_name, n AS bookmarks FROM part LEFT JOIN b ON l_partkey = p_partkey
ORDER BY n DESC NULLS FIRST, p_retailprice DESC, p_partkey LIMIT 40""")
def top_topics_popular(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("bookmarks"))
    return table(spark, d, "part").join(b, "p_partkey", "left").orderBy(F.desc_nulls_first("bookmarks"), F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", "p_name", "bookmarks")


@PLANS.add("""SELECT o_orderkey, coalesce(c_name, 'deleted user') AS name, o_totalprice FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def join_dashboard_activity(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    recent = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)
    return recent.join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("deleted user")).alias("name"), "o_totalprice")


@PLANS.add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi_active_members(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@PLANS.add("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def join_anti_unreferenced(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@PLANS.add("""SELECT n_name, count(DISTINCT c_custkey) AS learners FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def join_learners_by_topic(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.countDistinct("c_custkey").alias("learners"))


@PLANS.add("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_orderpriority = '1-URGENT'")
def join_batched_lookups(spark, d):
    """The page's rows with what their ids name; nations and regions are small, and Spark sees their size."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@PLANS.add("""SELECT a.l_partkey, count(*) FILTER (WHERE a.bad < b.bad) AS wins, count(*) FILTER (WHERE a.bad > b.bad) AS losses, count(*) FILTER (WHERE a.bad = b.bad) AS ties
FROM (SELECT l_partkey, l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) a
JOIN (SELECT l_partkey, l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2) b USING (l_partkey) GROUP BY 1""")
def agg_paired_wins(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda keep, name: li.where(keep).groupBy("l_partkey", "l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias(name)).groupBy("l_partkey", name).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    pairs = side("l_linenumber <= 3", "x").join(side("l_linenumber > 3", "y"), "l_partkey").withColumn("n", F.col("n_x") * F.col("n_y"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return pairs.groupBy("l_partkey").agg(count(F.col("x") < F.col("y")).alias("wins"), count(F.col("x") > F.col("y")).alias("losses"), count(F.col("x") == F.col("y")).alias("ties"))


@PLANS.add("""WITH w(level, weight) AS (VALUES (1, 0.10), (2, 0.25), (3, 0.35), (4, 0.25), (5, 0.05)), t AS (SELECT source, lang, count(*) AS total FROM documents GROUP BY source, lang),
e AS (SELECT source, lang, total, level, total * weight AS exact, floor(total * weight) AS base FROM w, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY round(exact - base, 9) DESC, level) AS rn, total - sum(base) OVER (PARTITION BY source, lang) AS rest FROM e)
SELECT source, lang, level, (base + CASE WHEN rn <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM r""")
def win_largest_remainder(spark, d):
    """The documents of each source and language, shared out over five levels."""
    level = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(w).alias("weight")) for n, w in ((1, 0.10), (2, 0.25), (3, 0.35), (4, 0.25), (5, 0.05))])).alias("x")
    totals = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("total"))
    weights = totals.select("source", "lang", "total", level).select("source", "lang", "total", "x.*")
    return L.shares(weights, "level", "weight", F.col("total"), ("source", "lang")).select("source", "lang", "level", "share")


@PLANS.add("""WITH k AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part), p AS (SELECT *, row_number() OVER (ORDER BY k, p_type) AS place FROM k)
SELECT p_partkey, p_type, place, (place - 1) // 20 AS batch FROM p""")
def win_batch_plan(spark, d):
    return L.interleaved(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 20).withColumn("place", F.col("place").cast("long"))


@PLANS.add("""SELECT o_orderkey, epoch_us(o_orderdate)::BIGINT // 1000000 % 7919 AS seconds, least(10, floor((DATE '2001-08-02' - o_orderdate::DATE) * 0.10))::INT AS points,
 least(300, pow(2, least(8, o_orderkey % 12)))::INT AS backoff, ceil(greatest(o_totalprice, 0) / 1000 * 1000000)::BIGINT AS micros FROM orders""")
def scalar_dates_and_costs(spark, d):
    o = table(spark, d, "orders")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return o.select("o_orderkey", (whole_seconds(epoch, F.col("o_orderdate")) % 7919).alias("seconds"), age_points(F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate"))).alias("points"), backoff_seconds(F.col("o_orderkey") % 12 + 1).alias("backoff"), micros(F.col("o_totalprice") / 1000).alias("micros"))


@PLANS.add("SELECT p_partkey, (round(p_size::DECIMAL(20,0) * p_retailprice::DECIMAL(16,8) / 1000000, 8))::DOUBLE AS cost FROM part")
def scalar_token_cost(spark, d):
    return table(spark, d, "part").select("p_partkey", token_cost(F.col("p_size"), F.col("p_retailprice")).cast("double").alias("cost"))


@PLANS.add("""SELECT p_partkey, list_sort(sel) = list_sort(cor) AND len(sel) = len(list_distinct(sel)) AS right_ FROM (SELECT p_partkey, string_split(p_name, ' ') AS sel,
 CASE WHEN p_size % 2 = 0 THEN list_reverse(string_split(p_name, ' ')) ELSE [p_brand] END AS cor FROM part)""")
def arr_set_grading(spark, d):
    p = table(spark, d, "part")
    selected = F.split("p_name", " ")
    correct = F.when(F.col("p_size") % 2 == 0, F.reverse(selected)).otherwise(F.array("p_brand"))
    return p.select("p_partkey", same_choice(selected, correct).alias("right_"))


@PLANS.add("SELECT o_orderkey, concat('0x', substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 65 AS train, (concat('0x', substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100)::INT AS bucket FROM orders")
def hsh_bucket(spark, d):
    b = hash_bucket(F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", (b < 65).alias("train"), b.alias("bucket"))


@PLANS.add("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'documents', count(*) FROM documents")
def agg_table_counts(spark, d):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "customer", "documents")])


@PLANS.add("""SELECT c_mktsegment, count(*) AS all_, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p,
 round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS done FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def agg_review_matrix(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    m = rows.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})
    return m.withColumn("all_", F.col("f") + F.col("o") + F.col("p")).withColumn("done", ratio(F.col("f"), F.col("all_")))


@PLANS.add("SELECT o_custkey, count(*) AS n, sum(o_totalprice::BIGINT)::BIGINT AS used, count(*) >= 20 OR sum(o_totalprice::BIGINT) > 4000000 AS refused FROM (SELECT o_custkey, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY 1")
def agg_owner_quota(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice")).alias("used")).withColumn("refused", (F.col("n") >= 20) | (F.col("used") > 4000000))


@PLANS.add("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem WHERE l_returnflag <> 'R'")
def win_positions_after_delete(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(w).cast("long").alias("position"))
