"""Field-weighted search, paragraphs and change capture over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.operators import fields as S
from quill.plans.base import Plans, table
from quill.streaming.changes import Watch, changes

PLANS = Plans()
_HEAD = r"regexp_extract(coalesce(text, ''), '^[^\n]*')"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _fields(spark, d):
    """Documents with the first line as a heading and the rest as a body."""
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.regexp_extract(text, r"^[^\n]*", 0)
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", S.words(head).alias("heading"), S.words(F.substr(text, F.length(head) + 1)).alias("body"))


@PLANS.add(f"""WITH d AS (SELECT doc_id AS chunk_id, lang, {_WORDS.format(_HEAD)} AS h, {_WORDS.format(f"substr(coalesce(text, ''), length({_HEAD}) + 1)")} AS b FROM documents),
s AS (SELECT count(*) AS n, avg(len(h) + len(b)) AS avgdl FROM d),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_slice(list_filter({_WORDS.format("coalesce(text, '')")}, lambda w: length(w) >= 2), 1, 30)) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
p AS (SELECT chunk_id, lang, len(h) + len(b) AS dl, unnest(h) AS term, 3.0::DOUBLE AS w FROM d UNION ALL SELECT chunk_id, lang, len(h) + len(b), unnest(b), 1.0::DOUBLE FROM d),
tf AS (SELECT chunk_id, lang, dl, term, sum(w) AS f FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, CASE WHEN n > 2 * count(*) THEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM tf, s GROUP BY term, n),
c AS (SELECT query_id, lang, chunk_id, round(sum(qtf * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN i USING (term) JOIN q USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, chunk_id) AS rank FROM c)
SELECT query_id, lang, chunk_id, score, rank FROM r WHERE rank <= 4""")
def ret_weighted_fields(spark, d):
    q = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), S.query_words(F.col("text")).alias("terms"))
    found = S.weighted_top(q, _fields(spark, d), {"heading": 3.0, "body": 1.0}, 4, ("lang",))
    return found.select("query_id", "lang", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@PLANS.add(r"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line, len(a) - 1 AS last FROM (SELECT page_id AS doc_id, string_split(regexp_replace(regexp_replace(html, '</(?:p|h[1-6]|div|nav|ul|article)>', chr(10) || chr(10), 'g'), '<li>', chr(10) || '- ', 'g'), chr(10)) AS a FROM pages WHERE html IS NOT NULL)),
w AS (SELECT doc_id, i, CASE WHEN i < last THEN line || chr(10) ELSE line END AS line FROM l),
p AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) - length(line) AS start, regexp_full_match(line, '[\x09-\x0D\x20]*(?:[0-9]+)?[\x09-\x0D\x20]*') AS parts FROM w),
o AS (SELECT *, regexp_matches(line, '^[\x09-\x0D\x20]*[-*•] ') OR lag(parts, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM p),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM o WHERE NOT parts)
SELECT doc_id AS page_id, place::BIGINT AS place, min(start)::BIGINT AS start, max(start + length(line))::BIGINT AS stop, sha256(string_agg(line, '' ORDER BY i)) AS paragraph_sha256 FROM n GROUP BY doc_id, place""")
def cor_paragraphs(spark, d):
    # ends of blocks are blank lines, items of lists are bullets
    ends = F.regexp_replace("html", "</(?:p|h[1-6]|div|nav|ul|article)>", "\n\n")
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(ends, "<li>", "\n- ").alias("text"))
    found = S.paragraphs(pages, "page_id", "text")
    return found.select("page_id", "place", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.sha2("paragraph", 256).alias("paragraph_sha256"))


WATCHES = [Watch("USER_SEEN"), Watch("KIND_CHANGED", "event_type"), Watch("PURCHASED", "event_type", ("purchase",)), Watch("FAILED", "event_type", ("error",)), Watch("BAND_CHANGED", "band")]


@PLANS.add("""WITH e AS (SELECT user_id, ts, event_id, event_type, floor(value / 50)::BIGINT AS band FROM events),
l AS (SELECT *, lag(1) OVER w AS row, lag(event_type) OVER w AS t, lag(band) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, row IS NOT NULL AND event_type IS DISTINCT FROM t AS differs FROM l)
SELECT user_id, event_id, 'USER_SEEN' AS event, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM x WHERE row IS NULL
UNION ALL SELECT user_id, event_id, 'KIND_CHANGED', t, event_type FROM x WHERE differs
UNION ALL SELECT user_id, event_id, 'PURCHASED', t, event_type FROM x WHERE differs AND event_type = 'purchase'
UNION ALL SELECT user_id, event_id, 'FAILED', t, event_type FROM x WHERE differs AND event_type = 'error'
UNION ALL SELECT user_id, event_id, 'BAND_CHANGED', b::VARCHAR, band::VARCHAR FROM x WHERE row IS NOT NULL AND band IS DISTINCT FROM b""")
def stm_change_events(spark, d):
    versions = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.col("value") / 50).alias("band"))
    return changes(versions, "user_id", ["ts", "event_id"], WATCHES).drop("ts")
