"""Work whose next step depends on the one before: budgets, resamples, subset sums, scans by states, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.operators import agreement as A
from quill.operators import budgets as B
from quill.operators import loss as L
from quill.operators import resample as R
from quill.operators import states as S
from quill.operators import trees as X
from quill.operators.ordered import numbered
from quill.plans.base import Plans, table

PLANS = Plans()
#: Pages, links and bytes of distinct targets in a batch.
PAGES, LINKS, TARGETS = 20, 70, 420
#: Pages of a block, code points of a context at most, code points and words of one at least.
BLOCK_PAGES, MOST_CHARS, LEAST_CHARS, LEAST_WORDS = 8, 3600, 450, 65
_BLANK = r"[\x20\x09-\x0D]+"


@PLANS.add(f"""WITH RECURSIVE p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS rn, len(l) AS links, list_distinct(l) AS names
 FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)),
w AS (SELECT rn, page_id, 0 AS batch, 1 AS n, links, names FROM p WHERE rn = 1
 UNION ALL SELECT rn, page_id, batch + CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN links ELSE own_links END, CASE WHEN fits THEN held ELSE own END FROM (
  SELECT *, n + 1 <= {PAGES} AND links <= {LINKS} AND list_sum(list_transform(held, lambda x: strlen(x))) <= {TARGETS} AS fits FROM (
   SELECT p.rn, p.page_id, batch, n, w.links + p.links AS links, p.links AS own_links, list_distinct(list_concat(w.names, p.names)) AS held, p.names AS own FROM w JOIN p ON p.rn = w.rn + 1)))
SELECT page_id, (rn - 1)::BIGINT AS pos, batch::BIGINT AS batch FROM w""")
def win_greedy_batches(spark, d):
    """Batches of pages in order, within bounds of pages, links and bytes of distinct link targets."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", links.alias("l"))
    rows = rows.select("page_id", F.size("l").alias("links"), F.transform(F.array_distinct("l"), lambda x: F.struct(x.alias("name"), F.octet_length(x).cast("long").alias("bytes"))).alias("targets"))
    return B.greedy_batches(rows, ["page_id"], {"links": LINKS}, most=PAGES, distinct={"targets": TARGETS}).select("page_id", "pos", "batch")


@PLANS.add(rf"""WITH RECURSIVE g AS (SELECT doc_id, source, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {BLOCK_PAGES} AS block FROM documents),
l0 AS (SELECT doc_id, i, CASE WHEN i < len(a) THEN a[i] || chr(10) ELSE a[i] END AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM g))),
l1 AS (SELECT *, sum(CASE WHEN length(line) > {MOST_CHARS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM l0),
l AS (SELECT doc_id, i, line, seg, length(line) AS n, row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) AS rn FROM l1 WHERE length(line) <= {MOST_CHARS}),
w AS (SELECT doc_id, seg, rn, 0 AS piece, n AS held FROM l WHERE rn = 1
 UNION ALL SELECT l.doc_id, l.seg, l.rn, piece + CASE WHEN held + n > {MOST_CHARS} THEN 1 ELSE 0 END, CASE WHEN held + n > {MOST_CHARS} THEN n ELSE held + n END FROM w JOIN l ON l.doc_id = w.doc_id AND l.seg = w.seg AND l.rn = w.rn + 1),
p0 AS (SELECT doc_id, seg, piece, trim(string_agg(line, '' ORDER BY l.rn), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM w JOIN l USING (doc_id, seg, rn) GROUP BY doc_id, seg, piece),
p1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(text, '{_BLANK}', ' ', 'g')) ORDER BY seg, piece) AS nth FROM p0 WHERE text <> ''),
p AS (SELECT source, block, doc_id, p1.text, length(p1.text) + 2 AS n, row_number() OVER (PARTITION BY source, block ORDER BY doc_id, seg, piece) AS rn FROM p1 JOIN g USING (doc_id) WHERE nth = 1) ,
c AS (SELECT source, block, rn, 0 AS context, n AS held FROM p WHERE rn = 1
 UNION ALL SELECT p.source, p.block, p.rn, context + CASE WHEN held + n > {MOST_CHARS} THEN 1 ELSE 0 END, CASE WHEN held + n > {MOST_CHARS} THEN n ELSE held + n END FROM c JOIN p ON p.source = c.source AND p.block = c.block AND p.rn = c.rn + 1),
t AS (SELECT source, block, context, count(*) AS n_pieces, count(DISTINCT doc_id) AS n_pages, string_agg(text, chr(10) || chr(10) ORDER BY rn) AS text FROM c JOIN p USING (source, block, rn) GROUP BY source, block, context)
SELECT source, block::BIGINT AS block, context::BIGINT AS context, n_pieces, n_pages, length(text)::BIGINT AS chars,
 length(text) >= {LEAST_CHARS} AND len(string_split_regex(regexp_replace(text, '{_BLANK}', ' ', 'g'), ' ')) >= {LEAST_WORDS} AS kept, sha256(text) AS text_sha256 FROM t""")
def cor_context_blocks(spark, d):
    """Contexts of the lines of blocks of pages: pieces of whole lines, repeats on a page left out, filled up to a budget of code points."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    placed = numbered(docs.select("doc_id", "source"), ["doc_id"], "page", ["source"]).select("doc_id", "source", F.floor((F.col("page") - 1) / BLOCK_PAGES).alias("block"))
    lines = B.lines_of(docs, "doc_id", "text", MOST_CHARS)
    pieces = B.pieces_of(lines, "doc_id", MOST_CHARS)
    contexts = B.contexts_of(pieces.join(placed, "doc_id"), ["source", "block"], "doc_id", MOST_CHARS)
    n = F.length("text")
    kept = (n >= LEAST_CHARS) & (F.size(F.split(F.regexp_replace("text", _BLANK, " "), " ", -1)) >= LEAST_WORDS)
    return contexts.select("source", "block", F.col("batch").alias("context"), "n_pieces", "n_pages", n.cast("long").alias("chars"), kept.alias("kept"), F.sha2("text", 256).alias("text_sha256"))


def _drawn_sql(n):
    return f"('0x' || substr(md5('42|' || r || '|' || {n}), 1, 8))::BIGINT"


def _interval_sql(by):
    keys = "".join(f"{b}, " for b in by)
    using = f"USING ({', '.join(by)})" if by else "ON TRUE"
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""WITH u AS (SELECT {keys}source, sum(quality)::DOUBLE AS s, count(quality) AS c FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER ({part}ORDER BY source) AS unit, count(*) OVER ({part}) AS n FROM u),
p AS (SELECT {keys}r, {_drawn_sql("unit")} % n + 1 AS unit FROM k, range(2000) t(r)),
m AS (SELECT {keys}r, sum(s) / sum(c) AS m FROM p JOIN k USING ({keys}unit) GROUP BY {keys}r),
o AS (SELECT {keys}m, row_number() OVER ({part}ORDER BY m) AS place FROM m),
e AS (SELECT {keys}min(m) FILTER (WHERE place = 50) AS low, min(m) FILTER (WHERE place = 1950) AS high FROM o {group}),
a AS (SELECT {keys}count(*) AS clusters, sum(s) / sum(c) AS mean FROM u {group}) SELECT {keys}clusters, mean, low, high FROM a JOIN e {using}"""


def _scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@PLANS.add(_interval_sql([]))
def agg_cluster_interval(spark, d):
    """The mean quality of labelled documents and its interval, over resampled sources."""
    return R.cluster_interval(_scored(spark, d), "source", "quality")


@PLANS.add(_interval_sql(["lang"]))
def agg_cluster_interval_by_language(spark, d):
    """The same for every language."""
    return R.cluster_interval(_scored(spark, d), "source", "quality", ["lang"])


@PLANS.add("""WITH RECURSIVE f AS (SELECT source, lang, count(*)::BIGINT AS n, row_number() OVER (ORDER BY source, lang) AS rn FROM documents GROUP BY source, lang),
t AS (SELECT (count(*) // 10)::BIGINT AS target FROM documents), s AS (SELECT 0::BIGINT AS rn, [0::BIGINT] AS l
 UNION ALL SELECT f.rn, list_filter(list_distinct(list_concat(l, list_transform(l, lambda x: x + n))), lambda x: x <= greatest(2 * target, target + 50)) FROM s JOIN f ON f.rn = s.rn + 1, t),
r AS (SELECT unnest(l) AS total FROM s WHERE rn = (SELECT max(rn) FROM f)) SELECT target, arg_min(total, [abs(total - target), CASE WHEN total > target THEN 1 ELSE 0 END]) AS held_out FROM r, t WHERE total > 0 GROUP BY target""")
def top_holdout_total(spark, d):
    """How many documents the best choice of whole (source, language) groups holds out, for a tenth of all."""
    docs = table(spark, d, "documents").select(F.concat_ws("|", "source", "lang").alias("family"))
    target = docs.count() // 10
    return R.held_out_groups(docs, "family", target).agg(F.lit(target).cast("long").alias("target"), F.sum(F.when(F.col("held_out"), F.col("size"))).alias("held_out"))


#: Lines of the documents of a source as pages of an exam: by their number a prompt, four options or the key.
_EXAM = """l AS (SELECT source, doc_id, i, trim(line) AS t FROM (SELECT source, doc_id, unnest(range(0, len(a))) AS i, unnest(a) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(line) <> ''),
e AS (SELECT source, doc_id, i, CASE (i % 6)::INT WHEN 0 THEN t WHEN 5 THEN 'ANSWER: ' || CASE WHEN length(t) % 7 = 0 THEN 'none' ELSE substr('ABCDE', (length(t) % 5 + 1)::INT, 1) END
 ELSE substr('ABCD', (i % 6)::INT, 1) || '. ' || t END AS line FROM l)"""


def _exam(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "t"))
    lines = docs.withColumn("t", F.trim("t")).where("t <> ''")
    n, k = F.length("t"), F.col("i") % 6
    key = F.when(n % 7 == 0, "none").otherwise(F.substring(F.lit("ABCDE"), n % 5 + 1, F.lit(1)))
    return lines.select("source", "doc_id", "i", F.when(k == 0, F.col("t")).when(k == 5, F.concat(F.lit("ANSWER: "), key)).otherwise(F.concat(F.substring(F.lit("ABCD"), k, F.lit(1)), F.lit(". "), "t")).alias("line"))


@PLANS.add(rf"""WITH {_EXAM}, s AS (SELECT *, row_number() OVER w - 1 AS pos, regexp_matches(line, '^\s*ANSWER\b') AS k,
 CASE WHEN NOT regexp_matches(line, '^\s*ANSWER\b') THEN regexp_extract(line, '^\s*([A-H])[.)]\s*\S', 1) ELSE '' END AS label FROM e WINDOW w AS (PARTITION BY source ORDER BY doc_id, i)),
n AS (SELECT *, coalesce(sum(k::INT) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS item FROM s),
o AS (SELECT *, sum((label <> '')::INT) OVER (PARTITION BY source, item ORDER BY pos) AS part, regexp_replace(trim(line), '\s+', ' ', 'g') AS whole, regexp_replace(trim(regexp_replace(line, '^\s*[A-H][.)]\s*', '')), '\s+', ' ', 'g') AS bare FROM n),
q AS (SELECT source, item, min(pos) AS first, max(line) FILTER (WHERE k) AS answer, coalesce(string_agg(whole, ' ' ORDER BY pos) FILTER (WHERE part = 0 AND NOT k), '') AS prompt, list(label ORDER BY pos) FILTER (WHERE label <> '') AS labels FROM o GROUP BY source, item HAVING bool_or(k)),
p AS (SELECT source, item, part, max(label) AS label, string_agg(CASE WHEN label <> '' THEN bare ELSE whole END, ' ' ORDER BY pos) AS text FROM o WHERE part > 0 AND NOT k GROUP BY source, item, part),
t AS (SELECT source, item, string_agg(label || '=' || text, '|' ORDER BY part) AS options FROM p GROUP BY source, item),
r AS (SELECT q.*, coalesce(options, '') AS options, coalesce(len(labels), 0) AS n, string_split_regex(regexp_extract(answer, '^\s*ANSWER\s*:\s*([A-H](?:\s*[,;]\s*[A-H])*)\s*$', 1), '\s*[,;]\s*') AS letters FROM q LEFT JOIN t USING (source, item)),
c AS (SELECT *, CASE WHEN letters[1] = '' THEN 'unsupported_answer_key_format' WHEN n < 2 OR array_to_string(labels, '') <> substr('ABCDEFGH', 1, n) THEN 'nonsequential_or_missing_option_labels'
 WHEN NOT list_has_all(labels, letters) THEN 'answer_key_label_missing' END AS reason FROM r)
SELECT source, item::BIGINT AS item, first::BIGINT AS first, CASE WHEN reason IS NULL THEN 'candidate' ELSE 'quarantine' END AS status, reason, sha256(prompt) AS prompt, n::BIGINT AS n_options, sha256(options) AS options, answer FROM c""")
def cor_exam_items(spark, d):
    """Items with a key of letters, over the pages of each source; an item may begin on one page and end on another."""
    items = S.exam_items(_exam(spark, d), ["doc_id", "i"], ["source"])
    listed = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|")
    return items.select("source", "item", "first", "status", "reason", F.sha2("prompt", 256).alias("prompt"), F.size("options").cast("long").alias("n_options"), F.sha2(listed, 256).alias("options"), "answer")


@PLANS.add(rf"""WITH RECURSIVE t AS (SELECT page_id, unnest(range(0, len(a)))::BIGINT AS node, unnest(a) AS tag FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{X.TAG}') AS a FROM pages)),
m AS (SELECT page_id, node, lower(regexp_extract(tag, '^</?([a-zA-Z0-9]+)', 1)) AS name, starts_with(tag, '</') AS closing FROM t),
v AS (SELECT *, CASE WHEN closing THEN -1 WHEN name IN ({", ".join(f"'{x}'" for x in X.VOID)}) THEN 0 ELSE 1 END AS step FROM m),
o AS (SELECT * FROM (SELECT *, coalesce(sum(step) OVER (PARTITION BY page_id ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM v) WHERE NOT closing),
n AS (SELECT a.page_id, a.node, a.name, max(b.node) AS parent FROM o a LEFT JOIN o b ON b.page_id = a.page_id AND b.step = 1 AND b.level = a.level - 1 AND b.node < a.node GROUP BY a.page_id, a.node, a.name),
w AS (SELECT page_id, node, parent, name, 1::BIGINT AS depth, [name || chr(1) || lpad(node::VARCHAR, 9, '0')] AS path FROM n WHERE parent IS NULL
 UNION ALL SELECT n.page_id, n.node, n.parent, n.name, depth + 1, list_append(path, n.name || chr(1) || lpad(n.node::VARCHAR, 9, '0')) FROM w JOIN n ON n.page_id = w.page_id AND n.parent = w.node)
SELECT page_id, node, parent, name, depth, row_number() OVER (PARTITION BY page_id ORDER BY path) AS place FROM w""")
def src_document_tree(spark, d):
    """The elements of each page in depth-first order, siblings by name, with their depths."""
    nodes = X.elements(table(spark, d, "pages"), "page_id", "html")
    return X.tree_order(nodes, "node", "parent", "name", ["page_id"]).select("page_id", "node", "parent", "name", "depth", "place")


def _tokens_file():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _listed(column):
    return F.sha2(F.array_join(F.transform(column, lambda x: x.cast("string")), ","), 256)


@PLANS.add()
def cor_loss_encoding(spark, d):
    """Ids and labels of every turn, the loss on the last turn of its conversation."""
    turns = L.encoded_turns(table(spark, d, "conversations"), _tokens_file())
    return turns.select("conv_id", "turn", "start", F.size("ids").cast("long").alias("n_ids"), _listed("ids").alias("ids_sha256"), _listed("labels").alias("labels_sha256"), "reason")


@PLANS.add()
def arr_loss_mask_tokens(spark, d):
    """What the loss masks of whole conversations hold, with a loss on every turn of the assistant."""
    return L.mask_stats(L.encoded_turns(table(spark, d, "conversations"), _tokens_file(), every=True))


@PLANS.add()
def arr_pad_tokens(spark, d):
    """Conversations without a fault in batches of eight, padded with the end token."""
    turns = L.encoded_turns(table(spark, d, "conversations"), _tokens_file())
    whole = turns.groupBy("conv_id").agg(F.bool_and(F.col("reason").isNull()).alias("ok")).where("ok")
    batches = numbered(whole.select("conv_id"), ["conv_id"], "n").select("conv_id", F.floor((F.col("n") - 1) / 8).alias("batch"))
    rows = L.padded(turns.join(batches, "conv_id"), "batch", 50256)
    return rows.select("batch", "conv_id", "width", "tokens", _listed("ids").alias("ids_sha256"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"), _listed("labels").alias("labels_sha256"))


#: Readings of documents as regions: the text itself, an optical one with faults by its length, and for some a description.
_READINGS = r"""b AS (SELECT doc_id AS record, CASE WHEN n_chars % 10 < 6 THEN 'text' WHEN n_chars % 10 = 6 THEN 'code' WHEN n_chars % 10 = 7 THEN 'table' WHEN n_chars % 10 = 8 THEN 'diagram' ELSE 'formula' END AS kind, n_chars AS n, text FROM documents),
r AS (SELECT record, kind, 0 AS index, 'pymupdf_native' AS engine, NULL AS family, text, CASE WHEN n % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, true AS same_source, n % 11 <> 0 AS bound, []::VARCHAR[] AS faults FROM b
 UNION ALL SELECT record, kind, 1, 'paddleocr', 'paddle_v5', CASE WHEN n % 4 = 1 THEN replace(text, 'e', 'c') WHEN n % 4 = 2 THEN text || ' = 7' ELSE '  ' || replace(text, chr(10), '  ') END,
  CASE WHEN n % 13 = 0 THEN 'pending' WHEN n % 8 = 0 THEN 'failed' ELSE 'ok' END, n % 19 <> 0, true, CASE WHEN n % 23 = 0 THEN ['mojibake'] ELSE [] END FROM b
 UNION ALL SELECT record, kind, 2, 'qwen_vl', NULL, substr(text, 1, 40), 'ok', true, n % 2 = 0, [] FROM b WHERE kind = 'diagram' OR n % 5 = 0)"""


def _readings(spark, d):
    n = F.col("n_chars")
    kind = F.when(n % 10 < 6, "text").when(n % 10 == 6, "code").when(n % 10 == 7, "table").when(n % 10 == 8, "diagram").otherwise("formula")
    none = F.expr("cast(array() as array<string>)")
    reading = lambda index, engine, family, text, status, same, bound, faults: F.struct(F.lit(index).alias("index"), F.lit(engine).alias("engine"), F.lit(family).cast("string").alias("family"), text.alias("text"), status.alias("status"), same.alias("same_source"), bound.alias("bound"), faults.alias("faults"))
    optical = F.when(n % 4 == 1, F.replace(F.col("text"), F.lit("e"), F.lit("c"))).when(n % 4 == 2, F.concat("text", F.lit(" = 7"))).otherwise(F.concat(F.lit("  "), F.replace(F.col("text"), F.lit("\n"), F.lit("  "))))
    yes = F.lit(True)
    native = reading(0, "pymupdf_native", None, F.col("text"), F.when(n % 9 == 0, "failed").otherwise("ok"), yes, n % 11 != 0, none)
    ocr = reading(1, "paddleocr", "paddle_v5", optical, F.when(n % 13 == 0, "pending").when(n % 8 == 0, "failed").otherwise("ok"), n % 19 != 0, yes, F.when(n % 23 == 0, F.array(F.lit("mojibake"))).otherwise(none))
    seen = F.when((kind == "diagram") | (n % 5 == 0), reading(2, "qwen_vl", None, F.substring("text", 1, 40), F.lit("ok"), yes, n % 2 == 0, none))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("record"), kind.alias("kind"), F.explode(F.array(native, ocr, seen)).alias("r")).where("r is not null")
    return rows.select("record", "kind", "r.*")


def _place_sql(names):
    return f"coalesce(nullif(list_position([{', '.join(repr(x) for x in names)}], role), 0), {len(names) + 1})"


@PLANS.add(rf"""WITH {_READINGS}, o AS (SELECT *, CASE engine WHEN 'pymupdf_native' THEN 'native_pdf' WHEN 'paddleocr' THEN 'ocr' ELSE 'vlm' END AS role,
 CASE engine WHEN 'pymupdf_native' THEN 'native_pdf' WHEN 'paddleocr' THEN 'paddle' ELSE 'vlm' END AS fam, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM r),
u AS (SELECT *, status = 'ok' AND plain <> '' AND len(faults) = 0 AND same_source AS ok, CASE WHEN kind = 'diagram' THEN {_place_sql(A.TRUST["picture"])} WHEN kind = 'formula' THEN {_place_sql(A.TRUST["formula"])}
 WHEN kind = 'table' THEN {_place_sql(A.TRUST["table"])} ELSE {_place_sql(A.TRUST["text"])} END AS place FROM o),
t AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY ok DESC, place, index) AS rn FROM u), s AS (SELECT record, ok AS tok, index AS tindex, engine AS tengine, fam AS tfam, role AS trole, plain AS tplain, trim(text) AS ttext, bound AS tbound FROM t WHERE rn = 1),
c AS (SELECT *, ok AND tok AND index <> tindex AND role <> 'vlm' AND kind IN ('text', 'code') AS cmp, plain = tplain AS eq FROM t JOIN s USING (record)),
g AS (SELECT record, any_value(kind) AS kind, any_value(tengine) AS tengine, any_value(tfam) AS tfam, any_value(trole) AS trole, any_value(ttext) AS ttext, any_value(tbound) AS tbound, count(*) FILTER (WHERE ok) AS usable, count(*) FILTER (WHERE NOT ok) AS rejected,
 count(*) FILTER (WHERE cmp AND eq AND bound AND tbound AND fam <> tfam) AS agreeing, count(*) FILTER (WHERE cmp AND NOT eq) AS conflicts,
 count(*) FILTER (WHERE cmp AND NOT eq AND (regexp_extract_all(plain, '\d+(?:[.,]\d+)*') <> regexp_extract_all(tplain, '\d+(?:[.,]\d+)*') OR regexp_extract_all(plain, '[-+=<>×÷±≤≥]') <> regexp_extract_all(tplain, '[-+=<>×÷±≤≥]'))) AS numeric_,
 bool_or(NOT same_source) AS alien, bool_or(status = 'pending') AS pending, bool_or(len(faults) > 0) AS faulty FROM c GROUP BY record),
h AS (SELECT *, usable > 0 AS usable_, kind IN ('formula', 'table', 'diagram', 'code') AS high FROM g)
SELECT record, CASE WHEN usable_ THEN tengine END AS engine, CASE WHEN usable_ THEN tfam END AS family, CASE WHEN usable_ THEN sha256(ttext) END AS proposed,
 CASE WHEN alien OR (NOT usable_ AND NOT pending) THEN 'critical' WHEN usable_ AND agreeing > 0 AND conflicts = 0 AND rejected = 0 AND NOT high THEN 'trusted' ELSE 'uncertain' END AS bucket, usable, rejected, agreeing, conflicts,
 array_to_string(list_sort(list_filter([CASE WHEN alien THEN 'candidate_source_identity_mismatch' END, CASE WHEN conflicts > 0 THEN 'independent_extractors_disagree' END, CASE WHEN numeric_ > 0 THEN 'numeric_or_sign_disagreement' END,
 CASE WHEN usable_ AND high THEN 'high_risk_requires_human_review' END, CASE WHEN usable_ AND trole = 'vlm' THEN 'vlm_description_requires_source_review' END, CASE WHEN usable_ AND agreeing = 0 AND kind IN ('text', 'code') THEN 'no_independent_exact_transcript_confirmation' END,
 CASE WHEN usable_ AND NOT tbound THEN 'selected_candidate_region_evidence_unbound' END, CASE WHEN NOT usable_ AND pending THEN 'extraction_pending' END, CASE WHEN NOT usable_ AND NOT pending THEN 'no_usable_extraction' END,
 CASE WHEN usable_ AND pending THEN 'extractors_pending' END, CASE WHEN faulty THEN 'candidate_mojibake' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM h""")
def cor_cross_validation(spark, d):
    """Readings of regions against each other: what is proposed, how far it is trusted, and why."""
    rows = A.cross_validated(_readings(spark, d))
    return rows.withColumns({"proposed": F.sha2("proposed", 256), "reasons": F.array_join("reasons", ",")})
