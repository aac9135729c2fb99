"""Releases of a training corpus: acceptance, exclusions in order, samples, splits, exports and audits, on the test tables.

``documents`` stand for records, ``labels`` for their reviews, ``benchmark`` for protected texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.functions.values import hamming, hash_bucket, ratio
from quill.operators import corpus as C
from quill.plans.base import Plans, table
from quill.session import stored

PLANS = Plans()
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_BUCKET = "(concat('0x', substr(sha256({0}), 1, 8))::BIGINT % 100)"
#: A record: its split, how it was reviewed, whether the review is of an older text, and the text to take.
_RECORDS = f"""r AS (SELECT d.doc_id, source, lang, n_chars, text, CASE WHEN d.doc_id % 11 = 0 THEN 'holdout' WHEN d.doc_id % 13 = 0 THEN 'development' ELSE 'train' END AS split,
 CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'approve' ELSE 'correct' END AS decision, d.doc_id % 17 = 0 AND quality IS NOT NULL AS stale FROM documents d LEFT JOIN labels USING (doc_id)),
a AS (SELECT *, trim(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g')) AS taken, CASE WHEN split <> 'train' THEN 'protected_split' WHEN stale THEN 'stale_review' WHEN decision = 'reject' THEN 'rejected' WHEN trim(text) = '' THEN 'empty' END AS excluded,
 CASE WHEN decision IN ('approve', 'correct') THEN 'human' ELSE 'owner_default' END AS acceptance FROM r)"""


def records(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    split = F.when(F.col("doc_id") % 11 == 0, "holdout").when(F.col("doc_id") % 13 == 0, "development").otherwise("train")
    decision = F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").otherwise("correct")
    return rows.select("doc_id", "source", "lang", "n_chars", "text", split.alias("split"), decision.alias("decision"), ((F.col("doc_id") % 17 == 0) & F.col("quality").isNotNull()).alias("stale"))


def accepted(rows):
    """The text of each record, how it was accepted, and why not: the first reason that holds."""
    excluded = F.when(F.col("split") != "train", "protected_split").when(F.col("stale"), "stale_review").when(F.col("decision") == "reject", "rejected").when(F.trim("text") == "", "empty")
    how = F.when(F.col("decision").isin("approve", "correct"), "human").otherwise("owner_default")
    return rows.withColumns({"taken": F.trim(T.redacted(F.col("text"))), "excluded": excluded, "acceptance": how})


@PLANS.add(f"WITH {_RECORDS} SELECT doc_id, acceptance, excluded, CASE WHEN excluded IS NULL THEN sha256(taken) END AS taken FROM a")
def flt_record_acceptance(spark, d):
    return accepted(records(spark, d)).select("doc_id", "acceptance", "excluded", F.when(F.col("excluded").isNull(), F.sha2("taken", 256)).alias("taken"))


@PLANS.add(f"""WITH {_RECORDS}, p AS (SELECT doc_id, CASE WHEN excluded IS NULL THEN acceptance WHEN excluded = 'rejected' THEN 'rejected' END AS stratum FROM a),
k AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('20261023|' || stratum || '|' || doc_id), doc_id) AS place FROM p WHERE stratum IS NOT NULL) SELECT * FROM k WHERE place <= 6""")
def cor_release_sample(spark, d):
    """Six records of each stratum for an audit, by the smallest digests of seed, stratum and id."""
    rows = accepted(records(spark, d))
    stratum = F.when(F.col("excluded").isNull(), F.col("acceptance")).when(F.col("excluded") == "rejected", "rejected")
    pool = rows.select("doc_id", stratum.alias("stratum")).where("stratum is not null")
    key = F.sha2(F.concat_ws("|", F.lit("20261023"), "stratum", F.col("doc_id").cast("string")), 256)
    # the first few of each range of rows, then the first of those: no task sees a whole stratum
    dealt = pool.withColumns({"key": key, "part": F.pmod(F.xxhash64("doc_id"), F.lit(64))})
    first = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("key", "doc_id"))).where("place <= 6")
    return first(first(dealt, "stratum", "part"), "stratum").select("doc_id", "stratum", F.col("place").cast("long").alias("place"))


_SHINGLES = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: array_to_string({0}[i:i+2], ' ')))"


@PLANS.add(f"""WITH {_RECORDS}, b AS (SELECT DISTINCT trim(text) AS key FROM benchmark), q AS (SELECT DISTINCT trim(text) AS key FROM documents WHERE doc_id % 97 = 0),
c AS (SELECT *, CASE WHEN excluded IS NOT NULL THEN excluded WHEN taken IN (SELECT key FROM q) THEN 'audit_quarantine' WHEN taken IN (SELECT key FROM b) THEN 'protected_exact_text' END AS reason FROM a),
k AS (SELECT doc_id, taken, reason, row_number() OVER (PARTITION BY taken, reason IS NULL ORDER BY acceptance, source, doc_id) AS place, first_value(doc_id) OVER (PARTITION BY taken, reason IS NULL ORDER BY acceptance, source, doc_id) AS first FROM c)
SELECT doc_id, CASE WHEN reason IS NULL AND place > 1 THEN 'exact_duplicate' ELSE coalesce(reason, 'kept') END AS reason, CASE WHEN reason IS NULL AND place > 1 THEN first END AS canonical FROM k""")
def cor_final_release(spark, d):
    """Each record kept or the first reason against it: quarantined, protected, or a copy of a reviewed or earlier one."""
    rows = accepted(records(spark, d)).select("doc_id", "source", "acceptance", "excluded", F.sha2("taken", 256).alias("key"))
    quarantine = table(spark, d, "documents").where("doc_id % 97 = 0").select(F.sha2(F.trim("text"), 256).alias("key")).distinct().withColumn("held", F.lit(True))
    protected = table(spark, d, "benchmark").select(F.sha2(F.trim("text"), 256).alias("key")).distinct().withColumn("known", F.lit(True))
    told = rows.join(quarantine, "key", "left").join(protected, "key", "left")
    told = told.withColumn("reason", F.coalesce("excluded", F.when(F.col("held"), "audit_quarantine"), F.when(F.col("known"), "protected_exact_text")))
    firsts = told.where("reason is null").groupBy("key").agg(F.min(F.struct("acceptance", "source", "doc_id"))["doc_id"].alias("first"))
    out = told.join(firsts, "key", "left").withColumn("copy", F.col("reason").isNull() & (F.col("doc_id") != F.col("first")))
    return out.select("doc_id", F.when(F.col("copy"), "exact_duplicate").otherwise(F.coalesce("reason", F.lit("kept"))).alias("reason"), F.when(F.col("copy"), F.col("first")).alias("canonical"))


#: A picture of a text has so many bits; pictures within four bits agree in one of five pieces of twelve.
_BITS = 60


def _look_sql(key, rows):
    return f"""(SELECT {key}, sum(b << bin)::BIGINT AS look FROM (SELECT {key}, h % {_BITS} AS bin, min(h // {_BITS}) % 2 AS b
 FROM (SELECT {key}, ('0x' || substr(md5(unnest(s)), 1, 8))::BIGINT AS h FROM {rows}) GROUP BY 1, 2) GROUP BY 1)"""


def _looks(rows, key):
    """A bit for each bin of shingle hashes: whether its least one is odd. Texts that share most shingles share most bits."""
    h = F.conv(F.substring(F.md5("one"), 1, 8), 16, 10).cast("long")
    hashed = rows.select(key, F.explode("s").alias("one")).select(key, h.alias("h")).select(key, (F.col("h") % _BITS).cast("int").alias("bin"), F.floor(F.col("h") / _BITS).alias("v"))
    bits = hashed.groupBy(key, "bin").agg((F.min("v") % 2).cast("long").alias("b"))
    return bits.groupBy(key).agg(F.sum(F.expr("shiftleft(b, bin)")).alias(f"h_{key}"))


@PLANS.add(f"""WITH x1 AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM (SELECT doc_id, text FROM documents UNION ALL SELECT item_id + 1000000, text || ' more' FROM benchmark)), p1 AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM benchmark),
x AS (SELECT doc_id, {_SHINGLES.format('words')} AS s FROM x1 WHERE len(words) >= 20), p0 AS (SELECT item_id, {_SHINGLES.format('words')} AS s FROM p1 WHERE len(words) >= 20),
t AS (SELECT * FROM x JOIN {_look_sql("doc_id", "x")} USING (doc_id)), p AS (SELECT * FROM p0 JOIN {_look_sql("item_id", "p0")} USING (item_id))
SELECT DISTINCT doc_id FROM t JOIN p ON bit_count(xor(t.look, p.look)) <= 4 WHERE len(list_intersect(t.s, p.s)) >= 0.85 * len(list_distinct(list_concat(t.s, p.s)))""")
def join_near_protected(spark, d):
    """Records that look like a protected page, in at most four bits, and share 85 % of its word trigrams.

    So many shared trigrams leave one at least among any 15 % and one more of a page's own: only what has
    one of these is compared, and pictures are made of what is left.
    """
    b = table(spark, d, "benchmark").select("item_id", "text")
    docs = table(spark, d, "documents").select("doc_id", "text").unionByName(b.select((F.col("item_id") + 1000000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text")))
    shaped = lambda df, key: df.withColumn("words", T.words(F.col("text"))).where(F.size("words") >= 20).select(key, T.word_shingles(F.col("words"), 3).alias("s"))
    pages = shaped(b, "item_id")
    hashed = lambda df, key: df.withColumn("words", T.words(F.col("text"))).where(F.size("words") >= 20).select(key, T.shingle_hashes(F.col("words"), 3).alias("s")).withColumn("n", F.size("s"))
    some = F.slice(F.array_sort("s"), F.lit(1), (F.col("n") - F.ceil(0.85 * F.col("n") - 1e-9) + 1).cast("int"))
    asked = hashed(b, "item_id").select("item_id", F.col("n").alias("m"), F.explode(some).alias("h"))
    met = hashed(docs, "doc_id").select("doc_id", "n", F.explode("s").alias("h")).join(asked, "h")
    near = stored(met.where(F.least("n", "m") >= 0.85 * F.greatest("n", "m") - 1e-9).select("doc_id", "item_id").distinct(), "near-pages")
    few = shaped(docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    told = near.join(few.withColumnRenamed("s", "s_x"), "doc_id").join(pages.withColumnRenamed("s", "s_y"), "item_id")
    alike = stored(told.where(T.jaccard(F.col("s_x"), F.col("s_y")) >= 0.85).select("doc_id", "item_id"), "alike-pages")
    x = _looks(few.join(alike.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    y = _looks(pages.join(alike.select("item_id").distinct(), "item_id", "left_semi"), "item_id")
    seen = alike.join(x, "doc_id").join(y, "item_id")
    return seen.where(F.bit_count(F.col("h_doc_id").bitwiseXOR(F.col("h_item_id"))) <= 4).select("doc_id").distinct()


@PLANS.add(f"""WITH g AS (SELECT doc_id, lang, source, min(doc_id) OVER (PARTITION BY regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g')) AS family FROM documents), b AS (SELECT *, {_BUCKET.format("family::VARCHAR")} AS bucket FROM g)
SELECT doc_id, family, CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN bucket < 65 THEN 'train' WHEN bucket < 92 THEN 'validation' ELSE 'test' END AS split FROM b""")
def cor_family_split(spark, d):
    """Questions of one template are one family and go into one split; held-out courses are test as a whole."""
    key = F.sha2(F.regexp_replace(F.lower(F.trim("text")), "[0-9]+", "#"), 256)
    rows = C.first_of(table(spark, d, "documents").select("doc_id", "source", key.alias("key")), "key", "doc_id")
    bucket = hash_bucket(F.col("first_id").cast("string"))
    split = F.when(F.col("source").isin("src1", "src2"), "test").when(bucket < 65, "train").when(bucket < 92, "validation").otherwise("test")
    return rows.select("doc_id", F.col("first_id").alias("family"), split.alias("split"))


@PLANS.add(f"""WITH s AS (SELECT doc_id, n_chars, CASE WHEN {_BUCKET.format("doc_id::VARCHAR")} < 90 THEN 'train' ELSE 'test' END AS split FROM documents), r AS (SELECT *, sha256(doc_id::VARCHAR) AS h FROM s)
SELECT split, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(h) AS first, max(h) AS last FROM r GROUP BY split""")
def cor_split_export(spark, d):
    """What an export by split holds: rows, characters, and the digests it begins and ends with."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    split = F.when(hash_bucket(F.col("doc_id").cast("string")) < 90, "train").otherwise("test")
    return table(spark, d, "documents").select("n_chars", split.alias("split"), h.alias("h")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("h").alias("first"), F.max("h").alias("last"))


@PLANS.add(f"""WITH s AS (SELECT doc_id, text, n_chars, lang, CASE WHEN {_BUCKET.format("doc_id::VARCHAR")} < 90 THEN 'train' ELSE 'test' END AS split FROM documents),
f AS (SELECT 'length_differs' AS "check", doc_id::VARCHAR AS id FROM s WHERE n_chars <> length(text) UNION ALL SELECT 'language_unknown', doc_id::VARCHAR FROM s WHERE lang NOT IN ('en', 'fr', 'de')
 UNION ALL SELECT 'too_short', doc_id::VARCHAR FROM s WHERE length(trim(text)) < 40 UNION ALL SELECT 'id_repeats', doc_id::VARCHAR FROM s GROUP BY doc_id HAVING count(*) > 1
 UNION ALL SELECT 'text_in_both_splits', sha256(trim(text)) FROM s GROUP BY trim(text) HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'label_without_record', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT "check", id FROM f""")
def cor_release_audit(spark, d):
    """Every assertion that a release has to pass, as rows (check, id) for what breaks it."""
    split = F.when(hash_bucket(F.col("doc_id").cast("string")) < 90, "train").otherwise("test")
    s = table(spark, d, "documents").select("doc_id", "n_chars", "lang", F.length("text").alias("n"), F.length(F.trim("text")).alias("m"), F.sha2(F.trim("text"), 256).alias("h"), split.alias("split"))
    said = lambda df, name, id_: df.select(F.lit(name).alias("check"), F.col(id_).cast("string").alias("id"))
    parts = [
        said(s.where("n_chars <> n"), "length_differs", "doc_id"),
        said(s.where(~F.col("lang").isin("en", "fr", "de")), "language_unknown", "doc_id"),
        said(s.where("m < 40"), "too_short", "doc_id"),
        said(s.groupBy("doc_id").count().where("count > 1"), "id_repeats", "doc_id"),
        said(s.groupBy("h").agg(F.countDistinct("split").alias("k")).where("k > 1"), "text_in_both_splits", "h"),
        said(table(spark, d, "labels").join(s.select("doc_id"), "doc_id", "left_anti"), "label_without_record", "doc_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@PLANS.add("""WITH a AS (SELECT p_partkey, p_size % 4 AS first, (p_size + p_partkey) % 4 AS second FROM part) SELECT p_partkey, first, 3 - second AS second, first = 3 - second AS agree FROM a""")
def cor_blind_solves(spark, d):
    """Two solves, the second with the options in reverse: its choice counted from the other end has to be the first one's."""
    back = 3 - (F.col("p_size") + F.col("p_partkey")) % 4
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("first"), back.alias("second"), (F.col("p_size") % 4 == back).alias("agree"))


@PLANS.add("""WITH o AS (SELECT doc_id, sha256(text) AS h, 'old' AS origin FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT n.doc_id, n.h, CASE WHEN o.h = n.h THEN 'reused' ELSE 'indexed' END AS state FROM n LEFT JOIN o USING (doc_id)""")
def cor_incremental_index(spark, d):
    """The new index: entries of unchanged files as they were, those of new and changed ones made afresh; deleted ones go."""
    rows = table(spark, d, "documents")
    old = rows.where("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("o"))
    new = rows.where("doc_id % 10 <> 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return new.join(old, "doc_id", "left").select("doc_id", "h", F.when(F.col("o").eqNullSafe(F.col("h")), "reused").otherwise("indexed").alias("state"))


@PLANS.add("SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src7' UNION ALL SELECT doc_id + 5000000, sha256('new ' || text) FROM documents WHERE source = 'src7' AND doc_id % 2 = 0")
def cor_replace_document(spark, d):
    """An index after the chunks of one source have been replaced by others."""
    rows = table(spark, d, "documents")
    fresh = rows.where("source = 'src7' and doc_id % 2 = 0").select((F.col("doc_id") + 5000000).alias("doc_id"), F.sha2(F.concat(F.lit("new "), "text"), 256).alias("h"))
    return rows.where("source <> 'src7'").select("doc_id", F.sha2("text", 256).alias("h")).unionByName(fresh)


@PLANS.add("""SELECT event_type AS checkpoint, round(100 * count(*) FILTER (WHERE value > 20) / count(*) + 10 * count(*) FILTER (WHERE value > 60) / count(*) + avg(value) / 100 - 0.001 * least(avg(value) / 10, 10), 6) AS score FROM events GROUP BY 1""")
def cor_checkpoint_score(spark, d):
    """Checkpoints by usable answers, then correct ones, then structure, less a trace of the loss."""
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    score = 100 * share(F.col("value") > 20) + 10 * share(F.col("value") > 60) + F.avg("value") / 100 - 0.001 * F.least(F.avg("value") / 10, F.lit(10.0))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("checkpoint")).agg(F.round(score, 6).alias("score"))


@PLANS.add("""WITH held AS (SELECT DISTINCT l_suppkey % 10 AS source, l_linenumber AS page FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), dep AS (SELECT l_orderkey, l_suppkey % 10 AS source, l_linenumber AS page FROM lineitem)
SELECT l_orderkey, count(*) AS n FROM dep WHERE l_orderkey NOT IN (SELECT l_orderkey FROM dep JOIN held USING (source, page)) GROUP BY 1""")
def cor_without_pending(spark, d):
    """Records none of whose pages is pending or excluded."""
    li = table(spark, d, "lineitem")
    dep = li.select("l_orderkey", (F.col("l_suppkey") % 10).alias("source"), F.col("l_linenumber").alias("page"))
    held = li.where("l_returnflag = 'R' and l_quantity > 49").select((F.col("l_suppkey") % 10).alias("source"), F.col("l_linenumber").alias("page")).distinct().withColumn("held", F.lit(1))
    return dep.join(held, ["source", "page"], "left").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("k")).where("k = 0").select("l_orderkey", "n")


@PLANS.add("""SELECT d.doc_id, CASE WHEN x.doc_id IS NULL THEN 'open' WHEN x.h = sha256(d.text) THEN 'excluded' ELSE 'ERROR_stale' END AS state
FROM documents d LEFT JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 30 = 0 THEN 'older' ELSE text END) AS h FROM documents WHERE doc_id % 15 = 0) x USING (doc_id)""")
def cor_owner_exclusions(spark, d):
    """Exclusions hold for the very text they were made for; one made for another is an error, not an open page."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    held = table(spark, d, "documents").where("doc_id % 15 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 30 == 0, "older").otherwise(F.col("text")), 256).alias("x"))
    state = F.when(F.col("x").isNull(), "open").when(F.col("x") == F.col("h"), "excluded").otherwise("ERROR_stale")
    return rows.join(held, "doc_id", "left").select("doc_id", state.alias("state"))


@PLANS.add("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('click', 'view')) AS first_stage, arg_max(value, (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'error')) AS second_value,
 arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('purchase', 'error')) AS second_stage FROM events GROUP BY 1) SELECT user_id, first_stage = 'view' AND second_stage = 'purchase' AS approved, second_value FROM s""")
def cor_two_stage_review(spark, d):
    """The latest event of each stage; exported is what both stages approve."""
    newest = F.struct("ts", "event_id")
    of = lambda kinds, c: F.max_by(F.when(F.col("event_type").isin(*kinds), F.col(c)), F.when(F.col("event_type").isin(*kinds), newest))
    s = table(spark, d, "events").groupBy("user_id").agg(of(("click", "view"), "event_type").alias("a"), of(("purchase", "error"), "event_type").alias("b"), of(("purchase", "error"), "value").alias("second_value"))
    return s.select("user_id", ((F.col("a") == "view") & (F.col("b") == "purchase")).alias("approved"), "second_value")


@PLANS.add("""SELECT conv_id, turn, regexp_matches(lower(trim(text)), '^(and|but|why|it|that|this|they|what about)\\b') OR length(trim(text)) < 40 AS follow_up FROM conversations WHERE role = 'user'""")
def ret_follow_ups(spark, d):
    """Questions that only make sense after the ones before."""
    t = F.lower(F.trim("text"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", (t.rlike(r"^(and|but|why|it|that|this|they|what about)\b") | (F.length(F.trim("text")) < 40)).alias("follow_up"))


@PLANS.add("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1 AS i, lang FROM documents) SELECT doc_id, lang, (i % 3)::INT AS part, i // 3 AS slot FROM r""")
def ret_round_robin_parts(spark, d):
    """Sources dealt in turns to three parts of each plan."""
    from quill.operators.ordered import numbered

    i = F.col("i") - 1
    return numbered(table(spark, d, "documents").select("doc_id", "lang", "source"), ["source", "doc_id"], "i", ["lang"]).select("doc_id", "lang", (i % 3).cast("int").alias("part"), F.floor(i / 3).alias("slot"))


@PLANS.add("""WITH s AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT user_id, ts AS started, CASE WHEN next IN ('purchase', 'error') THEN stop END AS ended, CASE WHEN next = 'purchase' THEN 'ok' WHEN next = 'error' THEN 'failed' ELSE 'open' END AS status FROM s WHERE event_type = 'view'""")
def stm_spans(spark, d):
    """Starts paired with the end that follows at once; a start after a start leaves the first one open."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").select("user_id", "ts", "event_type", F.lead("ts").over(w).alias("stop"), F.lead("event_type").over(w).alias("next")).where("event_type = 'view'")
    status = F.when(F.col("next") == "purchase", "ok").when(F.col("next") == "error", "failed").otherwise("open")
    return s.select("user_id", F.col("ts").alias("started"), F.when(F.col("next").isin("purchase", "error"), F.col("stop")).alias("ended"), status.alias("status"))
