"""Text, geometry, hash and JSON functions over whole tables, each against SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.functions import text as T
from quill.functions.values import hamming, iou, json_int, unit_box
from quill.plans.base import Plans, table

PLANS = Plans()
_TOKENS = """regexp_extract_all(lower(text), '([^\\s\\x0b,;!?()\\[\\]{}"''<>]+)', 1)"""
_SQUASHED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _sha(column):
    return F.sha2(column, 256)


@PLANS.add(f"SELECT doc_id, len({_TOKENS})::INT AS n, sha256(array_to_string({_TOKENS}, ' ')) AS tokens FROM documents")
def str_tokens(spark, d):
    tokens = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), _sha(F.array_join("t", " ")).alias("tokens"))


@PLANS.add(f"""SELECT doc_id, sha256({_SQUASHED}) AS collapsed, sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS answer, sha256(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '', 'g')) AS bare FROM documents""")
def str_keys(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", _sha(T.collapsed(t)).alias("collapsed"), _sha(T.answer_key(t)).alias("answer"), _sha(T.bare_key(t)).alias("bare"))


@PLANS.add(f"""SELECT doc_id, sha256(nfc_normalize({_SQUASHED})) AS composed, sha256(replace(lower(nfc_normalize({_SQUASHED})), 'ß', 'ss')) AS folded,
 sha256(array_to_string(regexp_extract_all(replace(replace(strip_accents(lower(text)), 'ß', 'ss'), 'đ', 'd'), '[a-z0-9]+'), ' ')) AS unaccented FROM documents""")
def str_normal_forms(spark, d):
    """NFC and folded keys; the tables' characters have the same NFKC as NFC."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", _sha(T.nfkc(t)).alias("composed"), _sha(T.folded(t)).alias("folded"), _sha(T.unaccented(t)).alias("unaccented"))


_GRAMS = "list_distinct(CASE WHEN length({0}) < {1} THEN [{0}] ELSE list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1})) END)"


@PLANS.add(f"""WITH g AS (SELECT p_partkey, {_GRAMS.format('p_name', 3)} AS a, {_GRAMS.format('p_type', 3)} AS b, {_GRAMS.format("regexp_replace(lower(p_name || p_partkey), '[0-9]+', '#', 'g')", 5)} AS m FROM part)
SELECT p_partkey, len(a)::INT AS n_grams, array_to_string(list_sort(m), '|') AS masked, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS similarity FROM g""")
def str_grams(spark, d):
    a, b = T.char_grams(F.col("p_name")), T.char_grams(F.col("p_type"))
    masked = T.masked_shingles(F.concat("p_name", F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", F.size(a).alias("n_grams"), F.array_join(F.array_sort(masked), "|").alias("masked"), F.round(T.jaccard(a, b), 9).alias("similarity"))


@PLANS.add(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, chr(65533)) THEN 'replacement' END, CASE WHEN regexp_matches(text, '[\x{E000}-\x{F8FF}]') THEN 'private_use' END,
 CASE WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'control' END, CASE WHEN regexp_matches(text, 'Ã[\x{80}-\x{BF}]|â€') THEN 'mojibake' END], lambda x: x IS NOT NULL), ',') AS broken,
 array_to_string(list_sort(regexp_extract_all(text, '\d+(?:\.\d+)?')), ' ') AS numbers, len(regexp_extract_all(text, '[+*/=<>^-]'))::INT AS n_operators FROM documents""")
def str_checks(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.corruption(t), ",").alias("broken"), F.array_join(T.numbers(t), " ").alias("numbers"), F.size(T.operators(t)).alias("n_operators"))


@PLANS.add(r"""WITH h AS (SELECT page_id, list_transform(regexp_extract_all(html, '[{}]'), lambda c: CASE WHEN c = '{' THEN 1 ELSE -1 END) AS s FROM pages)
SELECT page_id, CASE WHEN len(s) = 0 THEN 0 ELSE list_reduce(s, lambda a, x: CASE WHEN a < 0 THEN a ELSE a + x END) END::INT AS balance FROM h""")
def str_brace_balance(spark, d):
    return table(spark, d, "pages").select("page_id", T.brace_balance(F.col("html")).alias("balance"))


@PLANS.add(r"""WITH u AS (SELECT page_id, '/api/pages/' || substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12) || '/' || page_id % 7 AS path FROM pages)
SELECT page_id, '/api/pages/{id}/' || page_id % 7 AS template FROM u""")
def str_templated_path(spark, d):
    """Paths with identifiers as placeholders."""
    h = F.md5("url")
    path = F.concat(F.lit("/api/pages/"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit("/"), (F.col("page_id") % 7).cast("string"))
    return table(spark, d, "pages").select("page_id", T.templated_path(path).alias("template"))


@PLANS.add("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' ;  '), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part""")
def str_listed(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.listed(F.replace("p_name", F.lit(" "), F.lit(" ;  ")), ";"), "|").alias("parts"))


@PLANS.add("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity AS a0, l_quantity + 10 AS a2, l_tax * 100 AS b0, l_tax * 100 + 12 AS b2, l_discount * 100 AS c0 FROM lineitem),
o AS (SELECT *, greatest(0, least(a2, b2) - greatest(a0, b0)) * greatest(0, least(c0 + 10, c0 + 12) - greatest(c0, c0 + 2)) AS both_ FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(both_ / (10 * 10 + 12 * 10 - both_), 9) AS iou FROM o""")
def mth_box_overlap(spark, d):
    c = F.col("l_discount") * 100
    a = F.array(F.col("l_quantity"), c, F.col("l_quantity") + 10, c + 10)
    b = F.array(F.col("l_tax") * 100, c + 2, F.col("l_tax") * 100 + 12, c + 12)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(iou(a, b), 9).alias("iou"))


@PLANS.add("""WITH b AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice % 300 AS y FROM part), u AS (SELECT *, [round(x * 1000 / 600, 5), round((800 - (y + 50)) * 1000 / 800, 5), round((x + 40) * 1000 / 600, 5), round((800 - y) * 1000 / 800, 5)] AS box FROM b)
SELECT p_partkey, box[1] AS x0, box[2] AS y0, box[3] AS x1, box[4] AS y1 FROM u""")
def mth_unit_box(spark, d):
    """Boxes in page units from below, as thousandths from above."""
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice") % 300
    box = unit_box(F.array(x, y, x + 40, y + 50), F.lit(600.0), F.lit(800.0), flipped=True)
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", *(F.col("b")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


@PLANS.add("""SELECT doc_id, bit_count(xor(('0x' || substr(sha256(text), 1, 15))::BIGINT, ('0x' || substr(sha256(source), 1, 15))::BIGINT))::INT AS differing FROM documents""")
def hsh_hamming(spark, d):
    return table(spark, d, "documents").select("doc_id", hamming(F.substring(_sha(F.col("text")), 1, 15), F.substring(_sha(F.col("source")), 1, 15)).alias("differing"))


@PLANS.add("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k, 0 AS missing FROM events")
def jsn_int(spark, d):
    return table(spark, d, "events").select("event_id", json_int(F.col("props"), "$.k").alias("k"), json_int(F.col("props"), "$.none").alias("missing"))


@PLANS.add("""WITH t AS (SELECT conv_id, turn, string_split('# ' || role || chr(10) || replace(text, chr(10) || '#', chr(10)) || chr(10) || '## end' || chr(10) || 'tail ' || turn, chr(10)) AS lines FROM conversations),
l AS (SELECT conv_id, turn, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM t), h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS section FROM l)
SELECT conv_id, turn, section::BIGINT AS section, trim(regexp_replace(max(line) FILTER (WHERE regexp_matches(line, '^#{1,6}\\s+\\S')), '^#+\\s+', '')) AS heading, sha256(trim(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT regexp_matches(line, '^#{1,6}\\s+\\S')), ' ' || chr(10))) AS body FROM h GROUP BY ALL""")
def src_markdown_sections(spark, d):
    from quill.sources.text import markdown_sections

    body = F.concat(F.lit("# "), "role", F.lit("\n"), F.replace("text", F.lit("\n#"), F.lit("\n")), F.lit("\n## end\ntail "), F.col("turn").cast("string"))
    docs = table(spark, d, "conversations").select("conv_id", "turn", body.alias("text"))
    return markdown_sections(docs, ["conv_id", "turn"], "text").select("conv_id", "turn", "section", "heading", _sha(F.col("body")).alias("body"))


@PLANS.add("""WITH w AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 4 ELSE 5 END AS level, l_linenumber % 2 AS block, l_partkey, l_suppkey, l_extendedprice, l_discount * 1000 - 5 AS conf, CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN ' ' ELSE l_returnflag || l_partkey END AS text FROM lineitem),
k AS (SELECT * FROM w WHERE level = 5 AND trim(text) <> '' AND conf >= 0), l AS (SELECT l_orderkey, block, string_agg(text, ' ' ORDER BY l_partkey, l_suppkey, l_extendedprice, text) AS t FROM k GROUP BY ALL)
SELECT l_orderkey, text, n_lines, n_words, weighted, mean, ge80, lt40 FROM (SELECT l_orderkey, string_agg(t, chr(10) ORDER BY block) AS text, count(*) AS n_lines FROM l GROUP BY 1)
JOIN (SELECT l_orderkey, count(*) AS n_words, round(sum(conf * length(text)) / sum(length(text)), 3) AS weighted, round(avg(conf), 3) AS mean, round(count(*) FILTER (WHERE conf >= 80) / count(*), 4) AS ge80, round(count(*) FILTER (WHERE conf < 40) / count(*), 4) AS lt40 FROM k GROUP BY 1) USING (l_orderkey)""")
def src_recognised_words(spark, d):
    from quill.sources.text import recognised_words

    li = table(spark, d, "lineitem")
    text = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0), " ").otherwise(F.concat("l_returnflag", F.col("l_partkey").cast("string")))
    rows = li.select("l_orderkey", F.when(F.col("l_linenumber") == 7, 4).otherwise(5).alias("level"), (F.col("l_linenumber") % 2).alias("block"), F.lit(1).alias("par"), F.lit(1).alias("line"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("word"), (F.col("l_discount") * 1000 - 5).alias("conf"), text.alias("text"))
    return recognised_words(rows, "l_orderkey")


@PLANS.add(r"""WITH x AS (SELECT p_partkey, '\frac{' || p_size || '}{' || p_partkey || CASE WHEN p_size % 4 = 0 THEN '' ELSE '}' END AS latex, p_size || ' over ' || (p_partkey + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS raw FROM part)
SELECT p_partkey, p_partkey IN (SELECT p_partkey FROM part WHERE p_size % 4 <> 0) AND list_has_all(regexp_extract_all(latex, '\d+(?:[.,]\d+)?'), regexp_extract_all(raw, '\d+(?:[.,]\d+)?')) AS valid FROM x""")
def str_latex_valid(spark, d):
    """A formula is taken if its braces close and it has all numbers of the raw text."""
    latex = F.concat(F.lit(r"\frac{"), F.col("p_size").cast("string"), F.lit("}{"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 4 == 0, "").otherwise("}"))
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" over "), (F.col("p_partkey") + F.when(F.col("p_size") % 3 == 0, 1).otherwise(0)).cast("string"))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1)
    valid = (T.brace_balance(latex) == 0) & (F.length(F.trim(latex)).between(1, 2000)) & (F.size(F.array_except(numbers(raw), numbers(latex))) == 0)
    return table(spark, d, "part").select("p_partkey", valid.alias("valid"))


@PLANS.add(r"""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'plain words' WHEN p_size % 5 = 1 THEN '\alpha = ' || p_size WHEN p_size % 5 = 2 THEN '$\beta$ ' || p_size WHEN p_size % 5 = 3 THEN '\frac{1}{' ELSE '\gamma as said' END AS field FROM part)
SELECT p_partkey, CASE WHEN p % 5 = 1 THEN '$' || field || '$' ELSE field END AS field, CASE WHEN p % 5 IN (3, 4) THEN 'MATH_FORMAT_UNVERIFIED' END AS warning FROM (SELECT x.*, p_size AS p FROM x JOIN part USING (p_partkey))""")
def str_math_fields(spark, d):
    """A whole field that is surely a formula goes between dollars; what may be one is marked."""
    n = F.col("p_size").cast("string")
    kind = F.col("p_size") % 5
    field = F.when(kind == 0, "plain words").when(kind == 1, F.concat(F.lit(r"\alpha = "), n)).when(kind == 2, F.concat(F.lit(r"$\beta$ "), n)).when(kind == 3, r"\frac{1}{").otherwise(r"\gamma as said")
    return table(spark, d, "part").select("p_partkey", T.math_field(field).alias("m")).select("p_partkey", "m.field", "m.warning")


@PLANS.add("""WITH c AS (SELECT doc_id, text, length(text) AS n, length(text) // 3 AS a, length(text) // 2 AS b, n_chars % 7 + 1 AS k FROM documents WHERE n_chars > 100)
SELECT doc_id, sha256(trim(substr(text, round(a * (n - k) / n)::BIGINT + 1, round(b * (n - k) / n)::BIGINT - round(a * (n - k) / n)::BIGINT))) AS slice FROM c""")
def ret_raw_slices(spark, d):
    """The part of a raw text that lies where a part of its longer, enhanced form does."""
    c = table(spark, d, "documents").where("n_chars > 100").select("doc_id", "text", F.length("text").alias("n"), (F.col("n_chars") % 7 + 1).alias("k"))
    place = lambda part: F.round(F.floor(F.col("n") / part) * (F.col("n") - F.col("k")) / F.col("n")).cast("int")
    start, stop = place(3), place(2)
    return c.select("doc_id", _sha(F.trim(F.substring("text", start + 1, stop - start))).alias("slice"))
