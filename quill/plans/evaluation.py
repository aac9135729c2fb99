"""Evaluation of models and reviews, plans of slots and batches, and audits, on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.functions.values import iou, ratio
from quill.plans.base import Plans, table

PLANS = Plans()
_AREA = "(x1 - x0) * (y1 - y0)"


def _count(c):
    return F.count_if(c)


@PLANS.add("""SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS mean_latency, round(quantile_cont(value, 0.5), 6) AS median_latency,
 round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / sum(value), 6) AS tokens_per_second FROM events GROUP BY event_type""")
def agg_model_summary(spark, d):
    """Latency and throughput by model: tokens per second is the quotient of the sums."""
    e = table(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_latency"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median_latency"), F.round(F.sum("tokens") / F.sum("value"), 6).alias("tokens_per_second"))


@PLANS.add("""WITH m AS (SELECT event_type AS model, round(quantile_cont(value, 0.5), 6) AS median, count(*) FILTER (WHERE value > 20) AS usable, count(*) FILTER (WHERE value > 60) AS correct, round(avg(value), 4) AS quality FROM events GROUP BY 1)
SELECT model, usable, correct, quality, median, row_number() OVER (ORDER BY usable DESC, correct DESC, quality DESC, median, model) AS place FROM m""")
def top_leaderboard(spark, d):
    """Models by usable answers, correct ones, quality, and the shorter median latency."""
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(_count(F.col("value") > 20).alias("usable"), _count(F.col("value") > 60).alias("correct"), F.round(F.avg("value"), 4).alias("quality"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))
    order = Window.orderBy(F.desc("usable"), F.desc("correct"), F.desc("quality"), "median", "model")  # a row per model
    return m.withColumn("place", F.row_number().over(order).cast("long"))


@PLANS.add("SELECT source, round(sum(n_chars / 1000.0::DOUBLE * (1 + doc_id % 7)) / sum(1 + doc_id % 7), 9) AS nll, round(exp(sum(n_chars / 1000.0::DOUBLE * (1 + doc_id % 7)) / sum(1 + doc_id % 7)) / 1000, 6) AS perplexity FROM documents GROUP BY source")
def agg_perplexity(spark, d):
    """Token-weighted mean negative log-likelihood by unit, and its exponential (here in thousands)."""
    x = table(spark, d, "documents").select("source", (F.col("n_chars") / 1000.0).alias("nll"), (F.col("doc_id") % 7 + 1).alias("tokens"))
    mean = F.sum(F.col("nll") * F.col("tokens")) / F.sum("tokens")
    return x.groupBy("source").agg(F.round(mean, 9).alias("nll"), F.round(F.exp(mean) / 1000, 6).alias("perplexity"))


@PLANS.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(100 * (coalesce(l_quantity / 50, 0) * 0.4 + coalesce(CASE WHEN l_tax > 0.02 THEN l_tax / 0.08 END, 0) * 0.35 + coalesce(l_discount / 0.1, 0) * 0.25), 4) AS score,
 l_returnflag <> 'R' AND l_quantity / 50 >= 0.2 AS usable FROM lineitem""")
def agg_rubric(spark, d):
    """Weighted rubric: points of each criterion over its most, missing ones 0; an answer below the gate is not usable."""
    criteria = F.array(*(F.struct(v.alias("value"), F.lit(most).alias("most"), F.lit(w).alias("weight")) for v, most, w in ((F.col("l_quantity"), 50.0, 0.4), (F.when(F.col("l_tax") > 0.02, F.col("l_tax")), 0.08, 0.35), (F.col("l_discount"), 0.1, 0.25))))
    score = F.aggregate(criteria, F.lit(0.0), lambda s, c: s + F.coalesce(c["value"] / c["most"], F.lit(0.0)) * c["weight"])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(100 * score, 4).alias("score"), ((F.col("l_returnflag") != "R") & (F.col("l_quantity") / 50 >= 0.2)).alias("usable"))


@PLANS.add("""WITH r AS (SELECT l_orderkey, l_linenumber AS first, least(8, l_linenumber + l_quantity::INT % 3) AS last FROM lineitem), p AS (SELECT l_orderkey, unnest(range(first, last + 1)) AS page FROM r)
SELECT l_orderkey, count(*) = count(DISTINCT page) AND count(*) = max(page) AS exact, count(*) AS pages, max(page)::INT AS last FROM p GROUP BY l_orderkey""")
def agg_page_coverage(spark, d):
    """Whether the page ranges of a document give each page from 1 to the last exactly once."""
    r = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.sequence("l_linenumber", F.least(F.lit(8), F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3))).alias("page"))
    n = F.count(F.lit(1))
    return r.groupBy("l_orderkey").agg(((n == F.countDistinct("page")) & (n == F.max("page"))).alias("exact"), n.alias("pages"), F.max("page").alias("last"))


@PLANS.add("""WITH c AS (SELECT l_partkey AS slot, l_returnflag AS side, unnest(['quantity', 'discount', 'tax']) AS criterion, unnest([l_quantity, l_discount * 100, l_tax * 100]) AS value, unnest([0.5, 0.3, 0.2]) AS weight FROM lineitem),
m AS (SELECT slot, criterion, side, sum(value * weight) / sum(weight) AS mean FROM c GROUP BY ALL)
SELECT a.slot, a.criterion, round(a.mean, 6) AS before, round(b.mean, 6) AS after_, round(b.mean, 6) > round(a.mean, 6) AS better FROM m a JOIN m b USING (slot, criterion) WHERE a.side = 'R' AND b.side = 'N'""")
def agg_criterion_means(spark, d):
    """Weighted means by criterion, and of each slot the values before beside those after."""
    parts = F.array(*(F.struct(F.lit(n).alias("criterion"), v.alias("value"), F.lit(w).alias("weight")) for n, v, w in (("quantity", F.col("l_quantity"), 0.5), ("discount", F.col("l_discount") * 100, 0.3), ("tax", F.col("l_tax") * 100, 0.2))))
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "N")).select(F.col("l_partkey").alias("slot"), F.col("l_returnflag").alias("side"), F.inline(parts))
    # both sides in one pass: no join of slots with themselves
    mean = lambda side: F.sum(F.when(F.col("side") == side, F.col("value") * F.col("weight"))) / F.sum(F.when(F.col("side") == side, F.col("weight")))
    both = rows.groupBy("slot", "criterion").agg(mean("R").alias("b"), mean("N").alias("a")).where("b is not null and a is not null")
    return both.select("slot", "criterion", F.round("b", 6).alias("before"), F.round("a", 6).alias("after_"), (F.round("a", 6) > F.round("b", 6)).alias("better"))


@PLANS.add("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS confidence FROM events GROUP BY 1)
SELECT kind, CASE WHEN confidence < 20 THEN 'lt20' WHEN confidence < 60 THEN 'lt60' ELSE 'ge60' END AS bin, count(*) AS n FROM l GROUP BY ALL""")
def agg_latest_histogram(spark, d):
    """Counts by category and bin over the latest row of each key."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("r"))
    bins = F.when(F.col("r.value") < 20, "lt20").when(F.col("r.value") < 60, "lt60").otherwise("ge60")
    return last.groupBy(F.col("r.event_type").alias("kind"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@PLANS.add("""SELECT o_orderpriority AS bucket, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_totalprice > 300000) AS high_risk,
 count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01') AS stale FROM orders GROUP BY 1""")
def agg_review_stats(spark, d):
    done, old = F.col("o_orderstatus") == "F", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.count(F.lit(1)).alias("total"), _count(F.col("o_orderstatus") == "O").alias("pending"), _count(F.col("o_totalprice") > 300000).alias("high_risk"), _count(done & old).alias("stale"))


@PLANS.add("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars < 200) AS short_, count(*) FILTER (WHERE n_chars > 10000) AS long_, count(*) FILTER (WHERE contains(text, ' | ')) AS tables_, count(*) FILTER (WHERE quality = 0) AS poor FROM documents LEFT JOIN labels USING (doc_id)")
def agg_feature_counts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), _count(F.col("n_chars") < 200).alias("short_"), _count(F.col("n_chars") > 10000).alias("long_"), _count(F.col("text").contains(" | ")).alias("tables_"), _count(F.col("quality") == 0).alias("poor"))


@PLANS.add("""WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS said, list_distinct(list_concat(string_split(p_name, ' ')[1:1], string_split(p_type, ' ')[1:1])) AS labels, CASE WHEN p_size % 3 = 0 THEN string_split(p_type, ' ') ELSE string_split(p_type, ' ')[1:1] END AS answer FROM part)
SELECT p_partkey, list_has_all(labels, said) AS valid, list_has_all(labels, said) AND list_sort(list_distinct(said)) = list_sort(list_distinct(answer)) AS exact FROM p""")
def arr_label_scoring(spark, d):
    """An answer is valid if it names given labels alone, and right if its set is the answer's."""
    said, name = F.split("p_type", " "), F.split("p_name", " ")
    labels = F.array_union(F.slice(name, 1, 1), F.slice(said, 1, 1))
    answer = F.when(F.col("p_size") % 3 == 0, said).otherwise(F.slice(said, 1, 1))
    valid = F.size(F.array_except(said, labels)) == 0
    same = F.array_sort(F.array_distinct(said)) == F.array_sort(F.array_distinct(answer))
    return table(spark, d, "part").select("p_partkey", valid.alias("valid"), (valid & same).alias("exact"))


_IDS = "list_transform(range(0, (n_chars % 23 + 2)::BIGINT), lambda i: ((doc_id * 31 + i * 7) % 50257))"


@PLANS.add(f"""WITH t AS (SELECT doc_id, {_IDS} AS ids, (doc_id % 5)::BIGINT AS prompt FROM documents), m AS (SELECT doc_id, ids, least(prompt, len(ids)) AS k FROM t)
SELECT doc_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= k THEN -100 ELSE x END), ',') AS labels, (len(ids) - k)::BIGINT AS supervised, k::BIGINT AS masked, len(ids) > k AS valid FROM m""")
def arr_loss_mask(spark, d):
    """Labels of an example: -100 over the prompt, the ids themselves after it. Valid: an active suffix without gaps."""
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_chars") % 23 + 1), lambda i: (F.col("doc_id") * 31 + i * 7) % 50257)
    rows = table(spark, d, "documents").select("doc_id", ids.alias("ids")).withColumn("k", F.least(F.col("doc_id") % 5, F.size("ids")))
    rows = rows.withColumn("labels", F.transform("ids", lambda x, i: F.when(i < F.col("k"), F.lit(-100).cast("long")).otherwise(x)))
    suffix = F.slice("labels", (F.col("k") + 1).cast("int"), F.size("labels"))
    valid = F.forall(F.zip_with(suffix, F.slice("ids", (F.col("k") + 1).cast("int"), F.size("ids")), lambda a, b: a == b), lambda x: x) & (F.size(suffix) > 0)
    active = F.size(F.filter("labels", lambda x: x != -100)).cast("long")
    return rows.select("doc_id", F.array_join("labels", ",").alias("labels"), active.alias("supervised"), (F.size("labels") - active).alias("masked"), valid.alias("valid"))


@PLANS.add(f"""WITH t AS (SELECT doc_id, doc_id // 8 AS batch, {_IDS} AS ids FROM documents), w AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch) / 8) * 8)::BIGINT AS width FROM t)
SELECT doc_id, batch, width, array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: 2::BIGINT)), ',') AS padded, len(ids)::BIGINT AS attended FROM w""")
def arr_pad_batch(spark, d):
    """Examples of a batch padded to its longest, up to a multiple of 8; the mask goes by position, so an end id may pad."""
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_chars") % 23 + 1), lambda i: (F.col("doc_id") * 31 + i * 7) % 50257)
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), ids.alias("ids"))
    width = (F.ceil(F.max(F.size("ids")).over(Window.partitionBy("batch")) / 8) * 8).alias("width")
    rows = rows.select("*", width)
    padded = F.concat("ids", F.array_repeat(F.lit(2).cast("long"), (F.col("width") - F.size("ids")).cast("int")))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), (F.col("width") - F.size("ids")).cast("int")))
    return rows.select("doc_id", "batch", "width", F.array_join(padded, ",").alias("padded"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


def slots_checked(requests, results):
    """l_orderkey, twice, unexpected, missing of results (l_orderkey, slot), where each request (l_orderkey) has the slots 1 to 4.

    Requests are counted, not expanded into slots, and results are dealt by request once: both sums of
    them are made where they are then. A null key is no one's.
    """
    got = results.repartition("l_orderkey").groupBy("l_orderkey", "slot").agg(F.count(F.lit(1)).alias("n"))
    rows = got.select("l_orderkey", "slot", "n", F.lit(0).cast("long").alias("asked"))
    own = requests.select("l_orderkey", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("asked"))
    planned = F.coalesce(F.col("slot").between(1, 4), F.lit(False)) & F.col("l_orderkey").isNotNull()
    result = F.col("n").isNotNull()
    sums = rows.unionByName(own).groupBy("l_orderkey").agg(F.bool_or(F.coalesce(F.col("n") > 1, F.lit(False))).alias("twice"), F.count_if(result).alias("_all"), F.count_if(result & planned).alias("_met"), F.sum("asked").alias("_asked"))
    beyond = F.col("_all") > F.when(F.col("_asked") > 0, F.col("_met")).otherwise(0)
    return sums.select("l_orderkey", "twice", beyond.alias("unexpected"), (F.col("_asked") * (4 - F.col("_met"))).alias("missing"))


@PLANS.add("""WITH r AS (SELECT l_orderkey, l_linenumber AS slot, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT o_orderkey AS l_orderkey, unnest([1, 2, 3, 4]) AS slot FROM orders),
j AS (SELECT coalesce(p.l_orderkey, r.l_orderkey) AS l_orderkey, coalesce(p.slot, r.slot) AS slot, p.slot IS NULL AS unexpected, r.slot IS NULL AS missing, coalesce(n, 0) > 1 AS twice FROM p FULL JOIN r ON p.l_orderkey = r.l_orderkey AND p.slot = r.slot)
SELECT l_orderkey, bool_or(twice) AS twice, bool_or(unexpected) AS unexpected, count(*) FILTER (WHERE missing) AS missing FROM j GROUP BY 1""")
def arr_slot_order(spark, d):
    """Results against the planned slots of each request: repeated, unexpected and missing ones."""
    return slots_checked(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("slot")))


@PLANS.add("""WITH r AS (SELECT p_partkey, p_size, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'EASY' WHEN p_size <= 30 THEN 'MEDIUM' ELSE 'HARD' END AS by_level, ['EASY', 'MEDIUM', 'HARD'][((rn - 1) % 3 + 1)::INT] AS mixed FROM r""")
def arr_difficulty_plan(spark, d):
    """Difficulty by level, and the mixed plan that goes round the three."""
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    three = F.array(F.lit("EASY"), F.lit("MEDIUM"), F.lit("HARD"))
    level = F.when(F.col("p_size") <= 10, "EASY").when(F.col("p_size") <= 30, "MEDIUM").otherwise("HARD")
    return table(spark, d, "part").select("p_partkey", "p_size", rn.alias("rn")).select("p_partkey", level.alias("by_level"), F.element_at(three, F.pmod(F.col("rn") - 1, F.lit(3)) + 1).alias("mixed"))


@PLANS.add("""WITH k AS (SELECT conv_id, turn, substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 500) AS key FROM conversations), old AS (SELECT DISTINCT key FROM k WHERE conv_id % 10 = 0)
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, key) > 1 AS in_batch, key IN (SELECT key FROM old) AS excluded FROM k WHERE conv_id % 10 <> 0""")
def arr_prompt_duplicates(spark, d):
    """Prompts that repeat within their batch or are among those to be left out, by their first 500 characters in plain form."""
    key = F.substring(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 1, 500)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(key, 256).alias("key"))
    old = rows.where("conv_id % 10 = 0").select("key").distinct().withColumn("old", F.lit(True))
    fresh = rows.where("conv_id % 10 <> 0").withColumn("in_batch", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "key")) > 1)
    return fresh.join(old, "key", "left").select("conv_id", "turn", "in_batch", F.col("old").isNotNull().alias("excluded"))


@PLANS.add("""WITH u AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) AS pages FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(pages) OVER (PARTITION BY l_orderkey) AS total FROM u),
e AS (SELECT *, 20 * pages // total AS base, (20 * pages) % total AS rest, 20 - sum(20 * pages // total) OVER (PARTITION BY l_orderkey) AS left_ FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber) AS rn FROM e) SELECT l_orderkey, l_linenumber, (base + CASE WHEN rn <= left_ THEN 1 ELSE 0 END)::BIGINT AS budget FROM r""")
def win_page_budgets(spark, d):
    """Twenty pages a document, dealt to its parts by their size: whole shares, then the largest remainders."""
    u = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("pages"))
    own = Window.partitionBy("l_orderkey")
    e = u.withColumn("total", F.sum("pages").over(own)).withColumns({"base": F.expr("20 * pages div total"), "rest": F.expr("20 * pages % total")}).withColumn("left_", 20 - F.sum("base").over(own))
    rn = F.row_number().over(own.orderBy(F.desc("rest"), "l_linenumber"))
    return e.withColumn("rn", rn).select("l_orderkey", "l_linenumber", (F.col("base") + F.when(F.col("rn") <= F.col("left_"), 1).otherwise(0)).alias("budget"))


@PLANS.add(f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_linenumber % 2 AS page, l_quantity AS x0, l_quantity + 20 AS x1, l_discount * 100 AS y0, l_discount * 100 + 10 + l_tax * 50 AS y1, l_returnflag FROM lineitem),
c AS (SELECT * FROM b WHERE l_returnflag = 'R'), r AS (SELECT * FROM b WHERE l_returnflag <> 'R'),
j AS (SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_extendedprice, greatest(0, least(c.x1, r.x1) - greatest(c.x0, r.x0)) * greatest(0, least(c.y1, r.y1) - greatest(c.y0, r.y0)) AS both_, (c.x1 - c.x0) * (c.y1 - c.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) AS sum_ FROM c JOIN r ON c.l_orderkey = r.l_orderkey AND c.page = r.page),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, max(round(both_ / (sum_ - both_), 6)) AS best FROM j WHERE both_ / (sum_ - both_) >= 0.5 GROUP BY ALL)
SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_extendedprice, best, CASE WHEN best IS NULL THEN 'no_region' ELSE 'matched' END AS state FROM c LEFT JOIN m USING (l_orderkey, l_linenumber, l_partkey, l_extendedprice)""")
def join_spatial(spark, d):
    """Candidates and regions of one page and kind that overlap by half; the best overlap, or why there is none."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    box = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + 20, F.col("l_discount") * 100 + 10 + F.col("l_tax") * 50)
    b = table(spark, d, "lineitem").select(*names, (F.col("l_linenumber") % 2).alias("page"), box.alias("box"), "l_returnflag")
    c, r = b.where("l_returnflag = 'R'"), b.where("l_returnflag <> 'R'").select("l_orderkey", "page", F.col("box").alias("region"))
    met = c.join(r, ["l_orderkey", "page"]).withColumn("over", iou(F.col("box"), F.col("region"))).where(F.col("over") >= 0.5).groupBy(*names).agg(F.max(F.round("over", 6)).alias("best"))
    return c.join(met, names, "left").select(*names, "best", F.when(F.col("best").isNull(), "no_region").otherwise("matched").alias("state"))


@PLANS.add("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line, o_totalprice FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS line FROM customer)
SELECT line, o_orderkey, c_custkey, o_orderkey IS NULL OR c_custkey IS NULL AS unpaired FROM a FULL JOIN b USING (line)""")
def join_positional(spark, d):
    """Two files line by line; a line that only one of them has is an error."""
    from quill.operators.ordered import numbered

    a = numbered(table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey"), ["o_orderkey"], "line")
    b = numbered(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "line")
    return a.join(b, "line", "full").select("line", "o_orderkey", "c_custkey", (F.col("o_orderkey").isNull() | F.col("c_custkey").isNull()).alias("unpaired"))


@PLANS.add("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no_packet' WHEN n_nationkey IS NULL THEN 'no_review' WHEN c_acctbal < 0 THEN 'stale_check' ELSE 'complete' END AS state
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = c_nationkey""")
def join_cascade(spark, d):
    """Mapping, packet, review and check, each by the key the one before names; the first that is missing or stale."""
    packet = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", F.lit(True).alias("packet"))
    review = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("review"))
    rows = table(spark, d, "orders").join(packet, "o_custkey", "left").join(review, "c_nationkey", "left")
    state = F.when(F.col("packet").isNull(), "no_packet").when(F.col("review").isNull(), "no_review").when(F.col("c_acctbal") < 0, "stale_check").otherwise("complete")
    return rows.select("o_orderkey", state.alias("state"))


@PLANS.add("""WITH s AS (SELECT doc_id % 900 AS id, lang, n_chars % 3 AS v FROM documents), c AS (SELECT id, count(*) AS n, count(DISTINCT concat(lang, '|', v)) AS versions FROM s GROUP BY id) SELECT id, n, versions > 1 AS conflict FROM c""")
def set_shard_union(spark, d):
    """Shards put together: rows of one id have to be identical."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 900).alias("id"), "lang", (F.col("n_chars") % 3).alias("v"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_json(F.struct("lang", "v"))).alias("versions")).select("id", "n", (F.col("versions") > 1).alias("conflict"))


@PLANS.add("""WITH e AS (SELECT o_orderkey, list_distinct([1, 2, 3, (o_custkey % 7)::INT]) AS expected, list_distinct([2, (o_orderkey % 5)::INT, 3]) AS covered FROM orders)
SELECT o_orderkey, len(list_intersect(expected, covered))::INT AS n_covered, round(len(list_intersect(expected, covered)) / len(expected), 6) AS share FROM e""")
def set_covered_components(spark, d):
    expected = F.array_distinct(F.array(F.lit(1), F.lit(2), F.lit(3), (F.col("o_custkey") % 7).cast("int")))
    covered = F.array_distinct(F.array(F.lit(2), (F.col("o_orderkey") % 5).cast("int"), F.lit(3)))
    n = F.size(F.array_intersect(expected, covered))
    return table(spark, d, "orders").select("o_orderkey", n.alias("n_covered"), ratio(n, F.size(expected)).alias("share"))


@PLANS.add("""WITH k AS (SELECT conv_id, turn, role, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM conversations WHERE role = 'user') SELECT role, min((conv_id, turn))[1]::BIGINT AS conv_id, count(*) AS n FROM k GROUP BY role, key""")
def set_distinct_prompts(spark, d):
    """The first of the questions with one prompt in plain form."""
    key = F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    rows = table(spark, d, "conversations").where("role = 'user'").select("role", key.alias("key"), "conv_id", "turn")
    return rows.groupBy("role", "key").agg(F.min(F.struct("conv_id", "turn"))["conv_id"].alias("conv_id"), F.count(F.lit(1)).alias("n")).drop("key")


@PLANS.add("""WITH r AS (SELECT l_orderkey AS unit, max(l_linenumber) % 2 AS hash FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1), p AS (SELECT o_orderkey AS unit, o_orderkey % 2 AS hash FROM orders)
SELECT coalesce(p.unit, r.unit) AS unit, CASE WHEN p.unit IS NULL THEN 'adopted' WHEN r.unit IS NULL THEN 'pending' WHEN p.hash <> r.hash THEN 'stale' ELSE 'done' END AS state FROM p FULL JOIN r ON p.unit = r.unit""")
def set_reconcile(spark, d):
    """Planned units against receipts: holes stay pending, results of another plan are stale, orphans are adopted."""
    got = table(spark, d, "lineitem").where("l_orderkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("unit")).agg((F.max("l_linenumber") % 2).alias("got"))
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), (F.col("o_orderkey") % 2).alias("hash"), F.lit(True).alias("planned"))
    state = F.when(F.col("planned").isNull(), "adopted").when(F.col("got").isNull(), "pending").when(F.col("hash") != F.col("got"), "stale").otherwise("done")
    return plan.join(got, "unit", "full").select("unit", state.alias("state"))


@PLANS.add("""WITH c AS (SELECT user_id AS job, arg_max(event_id, (ts, event_id)) AS candidate FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1), r AS (SELECT event_id // 3 AS candidate, arg_max(event_type, (ts, event_id)) AS review FROM events WHERE event_type IN ('view', 'error') GROUP BY 1)
SELECT job, c.candidate, CASE WHEN review IS NULL THEN 'pending' WHEN review = 'view' THEN 'approved' ELSE 'rejected' END AS status FROM c LEFT JOIN r ON r.candidate = c.candidate""")
def win_latest_candidate(spark, d):
    """The latest candidate of each job with its latest review."""
    e = table(spark, d, "events")
    newest = F.struct("ts", "event_id")
    c = e.where(F.col("event_type").isin("click", "purchase")).groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_id", newest).alias("candidate"))
    r = e.where(F.col("event_type").isin("view", "error")).groupBy(F.floor(F.col("event_id") / 3).alias("candidate")).agg(F.max_by("event_type", newest).alias("review"))
    status = F.when(F.col("review").isNull(), "pending").when(F.col("review") == "view", "approved").otherwise("rejected")
    return c.join(r, "candidate", "left").select("job", "candidate", status.alias("status"))


@PLANS.add("""WITH s AS (SELECT source AS document, doc_id AS page, n_chars % 97 AS score, (doc_id * 7919) % 500 AS start FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC, page) AS rn FROM s), w AS (SELECT document, page, score, start FROM b WHERE rn = 1),
x AS (SELECT w.document, w.page, w.score, max(b.score) FILTER (WHERE abs(b.start - w.start) > 50) AS runner_up FROM w JOIN b ON b.document = w.document AND b.page <> w.page GROUP BY ALL)
SELECT document, page, score, runner_up, runner_up IS NULL OR score - runner_up >= 1 AS unique_ FROM x""")
def win_unique_winner(spark, d):
    """The best of each document stands only if it beats the best of those that lie elsewhere by a margin."""
    s = table(spark, d, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), (F.col("n_chars") % 97).alias("score"), (F.col("doc_id") * 7919 % 500).alias("start"))
    best = s.groupBy("document").agg(F.max_by(F.struct("page", "score", "start"), F.struct("score", -F.col("page"))).alias("w"))
    rest = s.join(best, "document").where(F.col("page") != F.col("w.page"))
    out = rest.groupBy("document", F.col("w.page").alias("page"), F.col("w.score").alias("score")).agg(F.max(F.when(F.abs(F.col("start") - F.col("w.start")) > 50, s["score"])).alias("runner_up"))
    return out.withColumn("unique_", F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= 1))


@PLANS.add("""WITH p AS (SELECT source AS document, doc_id AS page, max(n_chars % 89 + 5 * CASE WHEN lang = 'en' THEN 0 ELSE 1 END) AS score FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC, page) AS rn, count(*) OVER (PARTITION BY document) AS n FROM p)
SELECT document, page, score, rn FROM r WHERE rn <= least(greatest(1, ceil(0.05 * n)), greatest(1, ceil(0.08 * n)))""")
def win_page_routing(spark, d):
    """Pages of each document by their best region, the first few percent of them."""
    p = table(spark, d, "documents").groupBy(F.col("source").alias("document"), F.col("doc_id").alias("page")).agg(F.max(F.col("n_chars") % 89 + F.when(F.col("lang") == "en", 0).otherwise(5)).alias("score"))
    n = p.groupBy("document").agg(F.count(F.lit(1)).alias("n"))
    ranked = p.withColumn("rn", F.row_number().over(Window.partitionBy("document").orderBy(F.desc("score"), "page")).cast("long")).join(n, "document")
    most = F.least(F.greatest(F.lit(1), F.ceil(0.05 * F.col("n"))), F.greatest(F.lit(1), F.ceil(0.08 * F.col("n"))))
    return ranked.where(F.col("rn") <= most).select("document", "page", "score", "rn")


@PLANS.add("""WITH p AS (SELECT p_partkey, 'L' || (p_size % 5 + 1) AS level, p_size % 6 + 1 AS k, p_partkey % 5 AS r, p_partkey % 2 = 0 AS scenario, p_size % 7 = 0 AS direct, p_partkey % 3 = 0 AS comparison FROM part),
s AS (SELECT *, k + 2 * r + scenario::INT + comparison::INT AS score FROM p), v(level, k0, k1, r0, r1, s0, s1, n, t, c) AS (VALUES ('L1', 1, 1, 0, 0, 1, 2, FALSE, TRUE, FALSE), ('L2', 1, 2, 1, 1, 3, 4, FALSE, FALSE, FALSE), ('L3', 1, 2, 1, 2, 5, 7, TRUE, FALSE, FALSE), ('L4', 2, 4, 2, 3, 8, 10, TRUE, FALSE, TRUE), ('L5', 3, 6, 3, 5, 11, 99, TRUE, FALSE, TRUE))
SELECT p_partkey, score::INT AS score, array_to_string(list_filter([CASE WHEN k NOT BETWEEN k0 AND k1 THEN 'concepts' END, CASE WHEN r NOT BETWEEN r0 AND r1 THEN 'steps' END, CASE WHEN score NOT BETWEEN s0 AND s1 THEN 'score' END,
 CASE WHEN scenario <> n THEN 'scenario' END, CASE WHEN direct <> t THEN 'direct' END, CASE WHEN comparison <> c THEN 'comparison' END], lambda x: x IS NOT NULL), ',') AS faults FROM s JOIN v USING (level)""")
def arr_level_faults(spark, d):
    """What a question's profile breaks of its level."""
    from quill.functions.values import demand, level_faults

    level = F.concat(F.lit("L"), (F.col("p_size") % 5 + 1).cast("string"))
    p = table(spark, d, "part").select("p_partkey", level.alias("level"), (F.col("p_size") % 6 + 1).alias("k"), (F.col("p_partkey") % 5).cast("int").alias("r"), (F.col("p_partkey") % 2 == 0).alias("new"), (F.col("p_size") % 7 == 0).alias("direct"), (F.col("p_partkey") % 3 == 0).alias("compared"))
    p = p.withColumn("score", demand(F.col("k"), F.col("r"), F.col("new"), F.col("compared")))
    faults = level_faults(F.col("level"), F.col("k"), F.col("r"), F.col("score"), F.col("new"), F.col("direct"), F.col("compared"))
    return p.select("p_partkey", F.col("score").cast("int").alias("score"), F.array_join(faults, ",").alias("faults"))


@PLANS.add("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS first, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderdate::DATE + (o_custkey % 200)::INT) END AS last FROM orders),
b AS (SELECT o_orderkey, coalesce(first, coalesce(last, DATE '2001-08-02') - 29) AS start, coalesce(last, DATE '2001-08-02') AS stop FROM a)
SELECT o_orderkey, start, stop, (stop - start + 1) BETWEEN 1 AND 90 AS valid FROM b""")
def dt_default_range(spark, d):
    """A range of days: up to today and thirty days long where nothing else is said, ninety at most."""
    day = F.to_date("o_orderdate")
    last = F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, (F.col("o_custkey") % 200).cast("int")))
    stop = F.coalesce(last, F.lit("2001-08-02").cast("date"))
    start = F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, day), F.date_sub(stop, 29))
    return table(spark, d, "orders").select("o_orderkey", start.alias("start"), stop.alias("stop"), (F.datediff(stop, start) + 1).between(1, 90).alias("valid"))


@PLANS.add("""WITH c AS (SELECT l_orderkey, l_linenumber AS r, l_partkey AS c, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 1 THEN 'th' ELSE 'td' END AS tag, CASE WHEN l_quantity > 40 THEN ' colspan="2"' ELSE '' END AS span, replace(replace(l_returnflag || '<' || l_linestatus || '&', '&', '&amp;'), '<', '&lt;') AS t FROM lineitem),
w AS (SELECT l_orderkey, r, '<tr>' || string_agg('<' || tag || span || '>' || t || '</' || tag || '>', '' ORDER BY c, l_suppkey, l_extendedprice) || '</tr>' AS row_ FROM c GROUP BY ALL)
SELECT l_orderkey, '<table>' || string_agg(row_, '' ORDER BY r) || '</table>' AS html FROM w GROUP BY 1""")
def src_table_html(spark, d):
    """Cells with their row, column and span as an HTML table, text escaped, head cells marked."""
    li = table(spark, d, "lineitem")
    tag = F.when(F.col("l_linenumber") == 1, "th").otherwise("td")
    text = F.replace(F.replace(F.concat("l_returnflag", F.lit("<"), "l_linestatus", F.lit("&")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = F.concat(F.lit("<"), tag, F.when(F.col("l_quantity") > 40, ' colspan="2"').otherwise(""), F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), "")
    rows = li.groupBy("l_orderkey", "l_linenumber").agg(joined(F.struct("l_partkey", "l_suppkey", "l_extendedprice", cell.alias("t"))).alias("cells"))
    row = F.struct("l_linenumber", F.concat(F.lit("<tr>"), "cells", F.lit("</tr>")).alias("t"))
    return rows.groupBy("l_orderkey").agg(F.concat(F.lit("<table>"), joined(row), F.lit("</table>")).alias("html"))


@PLANS.add("""WITH t AS (SELECT l_suppkey AS page, l_partkey % 50 AS tile, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l.l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem l JOIN t ON t.page = l_suppkey AND t.tile = l_partkey % 50 WHERE n < 4""")
def cor_without_tiles(spark, d):
    """Regions but for those of an image that a page repeats four times or more, which is a background."""
    li = table(spark, d, "lineitem").withColumn("tile", F.col("l_partkey") % 50)
    tiles = li.groupBy("l_suppkey", "tile").agg(F.count(F.lit(1)).alias("n")).where("n < 4").select("l_suppkey", "tile")
    return li.join(tiles, ["l_suppkey", "tile"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
