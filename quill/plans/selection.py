"""Selections over the given tables: distinct related pages, glossary contexts, JSON inside replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.functions.recovered import recovered
from quill.operators import export as E
from quill.operators import related as R
from quill.plans.base import Plans, table
from quill.plans.strings import _SQUASHED

PLANS = Plans()
_PAGE = r"regexp_replace(regexp_replace(coalesce(html, ''), '<(script|style)[^>]*>[^<]*', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_TITLE = "lower(regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1))"
_LANG = "regexp_extract(coalesce(html, ''), '<html lang=\"([a-z]+)', 1)"


def _pages(spark, d):
    """Pages of a language with their titles as names and the words of all their text as terms."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, "<(script|style)[^>]*>[^<]*", " "), "<[^>]*>", " ")
    terms = F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}{3,}"), F.lit(0)))
    names = F.lower(F.regexp_extract(html, "<title>([^<]*)", 1))
    return table(spark, d, "pages").select(F.col("page_id").alias("key"), F.regexp_extract(html, '<html lang="([a-z]+)', 1).alias("lang"), F.col("page_id").alias("place"), names.alias("name"), terms.alias("terms"))


def _rounds_sql(n):
    """Each round's best row, and the rows left that are unlike it."""
    alike = "1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1)"
    out = []
    for r in range(1, n + 1):
        out.append(f"b{r} AS (SELECT query_id, arg_max(key, [likeness::VARCHAR, near::VARCHAR, tie]) AS key FROM (SELECT query_id, key, lpad((likeness * 1e12)::BIGINT::VARCHAR, 14, '0') AS likeness, lpad((1e12 + near)::BIGINT::VARCHAR, 14, '0') AS near, tie FROM l{r}) GROUP BY query_id)")
        if r < n:
            like = alike.format(a="x.name", b="y.name")
            both = "len(list_intersect(x.terms, y.terms))"
            out.append(f"l{r + 1} AS (SELECT l.* FROM l{r} l JOIN b{r} b USING (query_id) JOIN p x ON x.key = l.key JOIN p y ON y.key = b.key WHERE l.key <> b.key AND {like} < {R.APART} AND coalesce({both} / nullif(len(x.terms) + len(y.terms) - {both}, 0), 0) < {R.APART})")
    return ", ".join(out)


@PLANS.add(rf"""WITH p AS (SELECT page_id AS key, {_LANG} AS lang, {_TITLE} AS name, list_distinct(regexp_extract_all(lower({_PAGE}), '\p{{L}}{{3,}}')) AS terms FROM pages),
m AS (SELECT q.key AS query_id, x.key, len(list_intersect(q.terms, x.terms)) AS shared, len(q.terms) + len(x.terms) AS total, q.name AS own, x.name FROM p q JOIN p x ON q.lang = x.lang AND q.key <> x.key WHERE q.key % 20 = 0),
l1 AS (SELECT query_id, key, shared / (total - shared) AS likeness, -abs(query_id - key) AS near, sha256(key::VARCHAR) AS tie FROM m WHERE shared > 0 AND shared / (total - shared) <= {R.MOST_LIKE}
 AND NOT contains(name, own) AND NOT contains(own, name) AND 1 - levenshtein(name, own) / greatest(length(name), length(own), 1) < {R.APART}),
{_rounds_sql(3)}, c AS (SELECT query_id, 1::BIGINT AS rank, key FROM b1 UNION ALL SELECT query_id, 2, key FROM b2 UNION ALL SELECT query_id, 3, key FROM b3)
SELECT query_id, rank, key AS page_id FROM c WHERE query_id IN (SELECT query_id FROM b3)""")
def top_distinct_related(spark, d):
    """Three pages related to each asked one that differ from it and from one another."""
    return R.distinct_related(_pages(spark, d), F.col("key") % 20 == 0, "lang").withColumnRenamed("key", "page_id")


_TERMS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\p{{N}}+'))"
_GLOSSARY = rf"""t AS (SELECT conv_id, turn, role, {_TERMS.format("text")} AS w FROM conversations),
k AS (SELECT conv_id, turn, role, max(w) AS word FROM (SELECT conv_id, turn, role, unnest(list_transform(w, lambda x: lpad(length(x)::VARCHAR, 9, '0') || x)) AS w FROM t) GROUP BY ALL),
g0 AS (SELECT DISTINCT substr(u.word, 10) AS a, substr(v.word, 10) AS b FROM k u JOIN k v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant'),
g AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM g0 UNION ALL SELECT b, a FROM g0) WHERE a <> b)"""


def _terms(text):
    """Words of letters and digits that count: more than two code points, not digits alone."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(every, lambda w: (F.length(w) > 2) & ~F.regexp_like(w, F.lit(r"^\p{N}+$")))


def _glossary(spark, d):
    """The longest word of a user's turn beside that of the answer (of equal ones the last by name)."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_max(F.transform(_terms(F.col("text")), lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"].alias("word"))
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("word").alias("a"))
    answered = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("word").alias("b"))
    return asked.join(answered, ["conv_id", "turn"]).where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()


@PLANS.add(rf"""WITH {_GLOSSARY},
q0 AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE item_id % 20 = 0),
q AS (SELECT query_id, term FROM q0 UNION SELECT query_id, b FROM q0 JOIN g ON a = term),
s AS (SELECT query_id, term FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) <= {R.SEARCHED}),
d AS (SELECT doc_id AS key, lang, length(coalesce(text, '')) AS chars, {_TERMS.format("text")} AS w FROM documents),
z AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT key, lang, dl, term, count(*) AS f FROM (SELECT key, lang, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM s) GROUP BY ALL),
i AS (SELECT term, CASE WHEN n > 2 * count(*) THEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM tf, z GROUP BY term, n),
c AS (SELECT query_id, lang, key, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN i USING (term) JOIN s USING (term), z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, key) AS rank FROM c QUALIFY rank <= {R.LOOKED_AT}),
h0 AS (SELECT DISTINCT key, unnest(w) AS term FROM d WHERE key IN (SELECT key FROM r)), h AS (SELECT key, term FROM h0 UNION SELECT key, b FROM h0 JOIN g ON a = term),
o AS (SELECT query_id, r.lang, key, rank, count(*) AS overlap FROM r JOIN h USING (key) JOIN q USING (query_id, term) GROUP BY ALL),
y AS (SELECT o.*, overlap / n AS coverage, chars, row_number() OVER (PARTITION BY query_id, o.lang ORDER BY rank) AS nth FROM o JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY query_id) USING (query_id) JOIN d USING (key) WHERE overlap >= {R.LEAST_TERMS} AND overlap / n >= {R.LEAST_COVERAGE}),
f AS (SELECT * FROM y WHERE nth = 1), e AS (SELECT y.* FROM y JOIN f USING (query_id, lang) WHERE y.nth > 1 AND y.chars + f.chars <= {R.CONTEXT_CHARS} QUALIFY row_number() OVER (PARTITION BY query_id, lang ORDER BY y.rank) = 1)
SELECT query_id, lang, 1::BIGINT AS place, key AS doc_id, overlap, round(coverage, 6) AS coverage FROM f UNION ALL SELECT query_id, lang, 2, key, overlap, round(coverage, 6) FROM e""")
def ret_glossary_contexts(spark, d):
    """Two documents of each language for a benchmark item, its words widened by pairs of question and answer."""
    queries = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), _terms(F.col("text")).alias("terms"))
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "lang", _terms(F.col("text")).alias("terms"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    found = R.glossary_contexts(queries, corpus, _glossary(spark, d), "lang")
    return found.select("query_id", "lang", "place", F.col("key").alias("doc_id"), "overlap", F.round("coverage", 6).alias("coverage"))


@PLANS.add("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS q, max(text) FILTER (WHERE role = 'assistant') AS said, count(*) AS n, max((role = 'system')::INT) AS led FROM conversations GROUP BY conv_id),
j AS (SELECT conv_id, CASE WHEN led = 1 THEN 'strict_json' WHEN n % 3 = 0 THEN 'unparseable' ELSE 'recovered_object' END AS status, to_json({'questions': coalesce(q, [])}) AS json, len(coalesce(q, [])) AS n FROM c)
SELECT conv_id, status, CASE WHEN status <> 'unparseable' THEN n END AS n_questions, CASE WHEN status <> 'unparseable' THEN sha256(json) END AS json_sha256 FROM j""")
def str_recovered_json(spark, d):
    """Questions of each conversation as a model would give them: alone, between its words, or cut off before the end."""
    turns = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    asked = F.transform(turns, lambda x: x["text"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(asked.alias("questions"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("said"), F.count(F.lit(1)).alias("n"), F.max((F.col("role") == "system").cast("int")).alias("led"))
    given = F.to_json(F.struct("questions"))
    said = F.coalesce("said", F.lit(""))
    whole = F.when(F.col("led") == 1, given).when(F.col("n") % 3 == 0, F.concat(said, F.lit(' {"'), F.expr("left(to_json(struct(questions)), length(to_json(struct(questions))) - 1)"))).otherwise(F.concat(said, F.lit(" {} { "), given, F.lit(" }"), said))
    read = rows.select("conv_id", recovered(whole, "questions").alias("r"))
    listed = F.json_array_length(F.get_json_object("r.json", "$.questions")).cast("long")
    return read.select("conv_id", "r.status", listed.alias("n_questions"), F.sha2("r.json", 256).alias("json_sha256"))


@PLANS.add(rf"""WITH r AS (SELECT doc_id AS id, CASE WHEN substr(sha256(source), 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END AS split, source, text, n_chars, length(text) AS now FROM documents),
v AS (SELECT doc_id AS id, quality = 1 AND coalesce(toxic, 0) <> 1 AS approved FROM labels),
j AS (SELECT id, source, text, CASE WHEN NOT coalesce(approved, false) THEN '{E.NOT_APPROVED}' WHEN split <> '{E.EXPORTED}' THEN 'protected_' || split WHEN n_chars IS NOT NULL AND n_chars IS DISTINCT FROM now THEN '{E.CHANGED}' END AS reason FROM r LEFT JOIN v USING (id)),
t AS (SELECT id, source, reason, CASE WHEN reason IS NULL THEN regexp_replace(nfc_normalize({_SQUASHED.replace("text", "coalesce(text, '')")}), '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}', '{E.ADDRESS}', 'g') END AS text FROM j),
f AS (SELECT *, CASE WHEN reason IS NULL THEN min(id) OVER (PARTITION BY reason IS NULL, source, text) END AS first FROM t)
SELECT id AS doc_id, CASE WHEN first <> id THEN '{E.DUPLICATE}' ELSE reason END AS reason, CASE WHEN first <> id THEN first END AS canonical_id, CASE WHEN first IS NULL OR first = id THEN sha256(text) END AS text_sha256 FROM f""")
def cor_region_export(spark, d):
    """Documents that their labels approve, outside of the sources held back and still as long as recorded; a later review takes toxic ones back."""
    docs = table(spark, d, "documents")
    split = F.when(F.substring(F.sha2("source", 256), 1, 1).isin("0", "1", "2"), "test").otherwise("train")
    records = docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("revision"), split.alias("split"), F.col("source").alias("pixels"), "n_chars", F.length("text").cast("long").alias("now"))
    labels = table(spark, d, "labels")
    first = labels.select(F.col("doc_id").alias("id"), F.lit(1).alias("seq"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"))
    later = labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(2).alias("seq"), F.lit("reject").alias("decision"))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    reviews = first.union(later).join(texts, "id").withColumns({"revision": F.lit(1), "verified": F.lit(True)})
    found = E.region_export(records, reviews, [("n_chars", "now")])
    return found.select(F.col("id").alias("doc_id"), "reason", "canonical_id", F.sha2("text", 256).alias("text_sha256"))
