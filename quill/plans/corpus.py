"""Corpus preparation on ``documents``, ``benchmark``, ``labels``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.functions.values import hash_bucket, mcnemar, ratio, wilson
from quill.operators import corpus as C
from quill.operators.similar import near_texts
from quill.plans.base import Plans, table

PLANS = Plans()
_BUCKET = "concat('0x', substr(sha256({0}), 1, 8))::BIGINT % 100"


def docs(spark, d):
    return table(spark, d, "documents")


@PLANS.add("""SELECT doc_id, first_id, n, doc_id = first_id AS kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(text)) AS first_id, count(*) OVER (PARTITION BY trim(text)) AS n FROM documents)""")
def cor_exact_dedup(spark, d):
    """Of each content the first document stays; only ids and digests are shuffled, counts are added up before."""
    rows = docs(spark, d).select("doc_id", F.sha2(F.trim("text"), 256).alias("key"))
    return C.first_of(rows, "key", "doc_id").select("doc_id", "first_id", "n", (F.col("doc_id") == F.col("first_id")).alias("kept"))


@PLANS.add("""SELECT sha256(lower(trim(text))) AS content, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS origins FROM documents GROUP BY 1""")
def set_distinct_content(spark, d):
    m = C.merged(docs(spark, d), F.sha2(F.lower(F.trim("text")), 256), "doc_id", F.struct("n_chars", -F.col("doc_id")), "source")
    return m.withColumn("origins", F.array_join("origins", ","))


@PLANS.add("SELECT sha256(lower(trim(text))) AS content, count(DISTINCT source) AS answers, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def set_conflict_groups(spark, d):
    """Texts, case and outer blanks aside, that more than one source answers for."""
    key = F.sha2(F.lower(F.trim("text")), 256)
    return C.conflicts(docs(spark, d).select(key.alias("key"), "source"), F.col("key"), "source")


@PLANS.add("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' WHEN n_chars < 200 THEN 'short' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS reason
FROM (SELECT d.*, quality, toxic, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) AS rn FROM documents d LEFT JOIN labels USING (doc_id))""")
def cor_dedup_reasons(spark, d):
    rows = C.first_of(docs(spark, d).select("doc_id", "n_chars", F.sha2(F.trim("text"), 256).alias("key")), "key", "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", C.first_reason(toxic=F.col("toxic") == 1, low_quality=F.col("quality") == 0, short=F.col("n_chars") < 200, duplicate=F.col("doc_id") > F.col("first_id")).alias("reason"))


@PLANS.add(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' END,
 CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN regexp_matches(text, '!!') THEN 'shouting' END, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.2 * length(text) THEN 'few_letters' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def flt_quality_reasons(spark, d):
    t = F.col("text")
    found = C.reasons(short=F.length(t) < 100, symbols=t.rlike("[#$%&*]{3}"), table=t.contains(" | "), shouting=t.rlike("!!"), few_letters=F.length(F.regexp_replace(t, "[^A-Za-z]", "")) < 0.2 * F.length(t))
    return docs(spark, d).select("doc_id", F.array_join(found, ",").alias("reasons"))


@PLANS.add(r"""SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(text, '[A-Za-z]+')) AS n_words,
 round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(1, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))), 6) AS capitals FROM documents""")
def cor_text_stats(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.length(t).cast("long").alias("n_chars"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"), F.size(F.regexp_extract_all(t, F.lit("([A-Za-z]+)"), 1)).cast("long").alias("n_words"), F.round(F.length(F.regexp_replace(t, "[^A-Z]", "")) / F.greatest(F.lit(1), F.length(F.regexp_replace(t, "[^A-Za-z]", ""))), 6).alias("capitals"))


@PLANS.add(r"SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS redacted_sha256, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM documents")
def str_email_redaction(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("redacted_sha256"), F.size(F.regexp_extract_all("text", F.lit(f"({T.EMAIL})"), 1)).cast("long").alias("n"))


@PLANS.add(f"SELECT doc_id, CASE WHEN {_BUCKET.format('doc_id::VARCHAR')} < 65 THEN 'train' WHEN {_BUCKET.format('doc_id::VARCHAR')} < 92 THEN 'validation' ELSE 'test' END AS split FROM documents")
def cor_hash_split(spark, d):
    b = hash_bucket(F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", F.when(b < 65, "train").when(b < 92, "validation").otherwise("test").alias("split"))


@PLANS.add("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('seed|' || source || '|' || doc_id), 'seed|' || source || '|' || doc_id) AS r FROM documents) WHERE r <= 7")
def win_stratified_sample(spark, d):
    key = F.concat(F.lit("seed|"), "source", F.lit("|"), F.col("doc_id").cast("string"))
    return C.sample_per_stratum(docs(spark, d), "source", key, 7).select("source", "doc_id")


@PLANS.add("SELECT source, doc_id, turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS turn FROM documents) ORDER BY turn, source LIMIT 123")
def win_balanced_round_robin(spark, d):
    return C.balanced(docs(spark, d).select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("digest")), "source", "digest", 123).select("source", "doc_id", F.col("turn").cast("long").alias("turn"))


@PLANS.add(f"SELECT sha256(trim(text)) AS key, count(DISTINCT {_BUCKET.format('doc_id::VARCHAR')} < 50) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT {_BUCKET.format('doc_id::VARCHAR')} < 50) > 1")
def set_split_leakage(spark, d):
    return C.leaked(docs(spark, d), F.sha2(F.trim("text"), 256), hash_bucket(F.col("doc_id").cast("string")) < 50)


@PLANS.add(r"""WITH t AS (SELECT source, doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n FROM documents), r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS stop FROM t WHERE n > 0),
w AS (SELECT *, unnest(range((stop - n) // 512, (stop - 1) // 512 + 1)) AS "window" FROM r)
SELECT source, doc_id, "window", greatest(stop - n, "window" * 512) AS start, least(stop, ("window" + 1) * 512) AS stop FROM w""")
def win_token_packing(spark, d):
    return C.token_spans(docs(spark, d), "doc_id", ["doc_id"], F.size(T.words(F.col("text"))).cast("long"), 512, ["source"])


@PLANS.add(r"""WITH t AS (SELECT source, len(regexp_extract_all(lower(text), '[a-z]+')) AS n FROM documents)
SELECT source, sum(n)::BIGINT AS total, min(n) AS shortest, max(n) AS longest, median(n) AS middle, list_sort(list(n))[ceil(0.95 * count(*))::INT] AS p95 FROM t GROUP BY source""")
def agg_length_stats(spark, d):
    n = docs(spark, d).select("source", F.size(T.words(F.col("text"))).cast("long").alias("n"))
    counts = n.groupBy("source", "n").agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy("source").orderBy("n"))).withColumn("all", F.sum("k").over(Window.partitionBy("source")))
    rank95 = upto.where(F.col("upto") >= F.ceil(0.95 * F.col("all"))).groupBy("source").agg(F.min("n").alias("p95"))
    return n.groupBy("source").agg(F.sum("n").alias("total"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.median("n").alias("middle")).join(rank95, "source")


@PLANS.add("""WITH p AS (SELECT page_id, length(html) // 1000 + 1 AS pages FROM pages), r AS (SELECT *, sum(pages) OVER (ORDER BY page_id)::BIGINT AS stop FROM p)
SELECT page_id, stop - pages AS start, stop, (stop - pages) // 100 AS first_unit, (stop - 1) // 100 AS last_unit FROM r""")
def win_unit_partition(spark, d):
    p = table(spark, d, "pages").select("page_id", (F.floor(F.length("html") / 1000) + 1).alias("pages"))
    return C.running_units(p, ["page_id"], F.col("pages"), 100).drop("pages")


@PLANS.add(r"""WITH t AS (SELECT doc_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM documents)),
l AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS x FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)), u AS (SELECT DISTINCT doc_id, x FROM l WHERE x IS NOT NULL),
g AS (SELECT doc_id, md5(string_agg(x, '|' ORDER BY x)) AS h FROM u GROUP BY doc_id), r AS (SELECT h, min(doc_id) AS doc_id FROM g GROUP BY h), e AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM u WHERE doc_id IN (SELECT doc_id FROM r)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY ALL)
SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM p WHERE k / (na + nb - k) >= 0.85""")
def join_near_dup_pairs(spark, d):
    """Pairs of texts that are nearly equal; of texts with equal shingles the first stands for all."""
    _, pairs = near_texts(docs(spark, d), "doc_id", F.col("text"), 0.85)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@PLANS.add()
def set_near_dup_components(spark, d):
    members, links = near_texts(docs(spark, d), "doc_id", F.col("text"), 0.85, links=True)
    found = C.smallest_reachable(links.select(F.explode(F.array("a", "b")).alias("rep")), links, "rep")
    return members.join(found.hint("merge"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))


@PLANS.add("""WITH m AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS wins, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, wins, n, round((wins / n + 1.959963984540054^2 / (2 * n) - 1.959963984540054 * sqrt(wins / n * (1 - wins / n) / n + 1.959963984540054^2 / (4 * n * n))) / (1 + 1.959963984540054^2 / n), 9) AS low,
 round((wins / n + 1.959963984540054^2 / (2 * n) + 1.959963984540054 * sqrt(wins / n * (1 - wins / n) / n + 1.959963984540054^2 / (4 * n * n))) / (1 + 1.959963984540054^2 / n), 9) AS high FROM m""")
def agg_wilson_by_group(spark, d):
    m = docs(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("wins"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("wins"), F.col("n"))
    return m.select("source", "wins", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@PLANS.add("""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND NOT long_) AS b, count(*) FILTER (WHERE quality = 0 AND long_) AS c FROM (SELECT lang, quality, n_chars > 2000 AS long_ FROM documents JOIN labels USING (doc_id)) GROUP BY lang),
t AS (SELECT *, unnest(range(0, least(b, c) + 1)) AS k FROM c), f AS (SELECT lang, b, c, k, exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) AS p FROM t)
SELECT lang, any_value(b) AS b, any_value(c) AS c, CASE WHEN any_value(b + c) = 0 THEN 1 ELSE round(least(1, 2 * sum(p)), 9) END AS p FROM f GROUP BY lang""")
def agg_mcnemar(spark, d):
    """By language, over all labelled documents."""
    return _mcnemar(docs(spark, d), table(spark, d, "labels"), "lang")


@PLANS.add("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND NOT long_) AS b, count(*) FILTER (WHERE quality = 0 AND long_) AS c FROM (SELECT quality, n_chars > 2000 AS long_ FROM documents JOIN labels USING (doc_id))),
t AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS k FROM c), f AS (SELECT b, c, k, exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) AS p FROM t)
SELECT any_value(b) AS b, any_value(c) AS c, round(least(1, 2 * sum(p)), 9) AS p FROM f""")
def agg_mcnemar_all(spark, d):
    return _mcnemar(docs(spark, d), table(spark, d, "labels"))


def _mcnemar(documents, labels, *by):
    rows = documents.join(labels, "doc_id")
    long_ = F.col("n_chars") > 2000
    c = rows.groupBy(*by).agg(F.count_if((F.col("quality") == 1) & ~long_).alias("b"), F.count_if((F.col("quality") == 0) & long_).alias("c"))
    return c.select(*by, "b", "c", F.round(mcnemar(F.col("b"), F.col("c")), 9).alias("p"))


@PLANS.add("SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality, toxic")
def agg_confusion_labels(spark, d):
    m = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


@PLANS.add("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS turns, sum(length(text)) FILTER (WHERE role = 'assistant')::BIGINT AS supervised,
 string_agg(role, ',' ORDER BY turn) SIMILAR TO '(system,)?user,assistant(,user,assistant)*' AS valid FROM conversations GROUP BY conv_id""")
def arr_chat_schema_check(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"), F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("role") == "assistant", F.length("text"))).alias("supervised"))
    roles = F.array_join(F.transform("m", lambda x: x["role"]), ",")
    return c.select("conv_id", roles.alias("roles"), "turns", "supervised", roles.rlike("^(system,)?user,assistant(,user,assistant)*$").alias("valid"))


def _error_rates(spark, d):
    predictions = docs(spark, d).select("doc_id", F.col("text").alias("prediction"))
    pairs = table(spark, d, "benchmark").select("item_id", F.col("text").alias("reference")).join(predictions, F.col("doc_id") == F.col("item_id"), "left")
    return C.error_rates(pairs, "reference", "prediction").drop("reference", "prediction")


@PLANS.add()
def agg_cer_by_pair(spark, d):
    """Character error rates of whole texts; no SQL, since DuckDB's distance is one of bytes."""
    return _error_rates(spark, d).where("doc_id is not null").select("item_id", "doc_id", F.round("cer", 6).alias("cer"))


@PLANS.add()
def agg_error_rates_by_pair(spark, d):
    return _error_rates(spark, d)


@PLANS.add()
def agg_error_rates(spark, d):
    return C.pooled_error_rates(_error_rates(spark, d))


@PLANS.add("""WITH o AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), n AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.path = n.path""")
def set_manifest_diff(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    old = rows.where("doc_id % 10 <> 1").select("path", F.sha2("text", 256).alias("h"))
    new = rows.where("doc_id % 10 <> 2").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return C.manifest_diff(old, new, "path", "h")
