"""Files that are written to the shared folder and read back, against SQL over the tables they come from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quill.plans.base import Plans, table
from quill.session import shared_dir
from quill.sources import files, jsonl
from quill.streaming.rollup import replacing_days

PLANS = Plans()


def _folder(spark, what):
    return f"{shared_dir(spark)}/quill-{what}-{uuid.uuid4().hex}"


@PLANS.add("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def src_jsonl_records(spark, d):
    path = _folder(spark, "jsonl")
    jsonl.written_lines(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return jsonl.records(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@PLANS.add("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'repeated' WHEN 2 THEN 'constant' WHEN 3 THEN 'malformed' ELSE 'none' END AS fault,
 CASE WHEN o_orderkey % 6 NOT IN (1, 2, 3) THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 6 <> 4""")
def src_jsonl_faults(spark, d):
    """What is wrong with each line of a file with repeated keys, NaN, cut lines and blank ones; the others are read."""
    k, path = F.col("o_orderkey") % 6, _folder(spark, "jsonl")
    whole = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    body = F.substring(whole, F.lit(2), F.length(whole) - 2)
    line = F.when(k == 1, F.concat(F.lit('{"o_orderkey":0,'), body, F.lit("}"))).when(k == 2, F.concat(F.lit("{"), body, F.lit(',"x":NaN}'))).when(k == 3, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(k == 4, F.lit("  ")).otherwise(whole)
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    rows = jsonl.scanned(spark, path)
    fault = F.when(F.col("error").isNull(), "none").when(F.contains("error", F.lit("twice")), "repeated").when(F.contains("error", F.lit("NaN")), "constant").otherwise("malformed")
    # the last key of a line is the order's own
    key = F.element_at(F.regexp_extract_all("value", F.lit('"o_orderkey":(\\d+)'), F.lit(1)), -1).cast("long")
    return rows.select(key.alias("o_orderkey"), fault.alias("fault"), F.when(F.col("error").isNull(), F.get_json_object("value", "$.o_totalprice").cast("double")).alias("price"))


@PLANS.add("SELECT count(*) AS n, 0::BIGINT AS bad, count(*) AS numbered FROM documents")
def src_jsonl_lines(spark, d):
    """Texts with any character inside are one line each, none is broken, and lines have numbers of their own."""
    path = _folder(spark, "jsonl")
    jsonl.written_lines(table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" \u0085")).alias("text")), path)
    return jsonl.scanned(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.countDistinct("file", "line").alias("numbered"))


@PLANS.add("SELECT p_partkey::VARCHAR AS key, p_name AS name, p_brand AS \"name (2)\", p_size::VARCHAR AS column_4 FROM part")
def src_delimited(spark, d):
    """A file with semicolons, a repeated name in its header, and a blank one."""
    path = _folder(spark, "csv")
    p = table(spark, d, "part").select(F.concat_ws(";", F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_size").cast("string")).alias("value"))
    # the header stands before the rows of each part file
    head = spark.createDataFrame([("key;name;name;",)], "value string")
    head.unionByName(p).coalesce(1).write.text(path)
    return files.delimited(spark, path)


_FILES = "f AS (SELECT r_regionkey + k AS key, r_name || chr(10) AS content FROM region, (SELECT unnest([0, 10]) AS k))"


def _bundle(spark, d, name, changed=None):
    path = _folder(spark, name)
    r = table(spark, d, "region").select(F.explode(F.array(F.col("r_regionkey"), F.col("r_regionkey") + 10)).alias("key"), F.col("r_name").alias("value"))
    if changed is not None:
        r = r.withColumn("value", F.when(changed, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    r.repartition("key").write.partitionBy("key").text(path)
    found = files.inventory(spark, path, "part-*")
    return found.withColumn("name", F.regexp_extract("path", "key=([0-9]+)/", 1)).withColumn("first", F.regexp_extract("first", "key=([0-9]+)/", 1))


@PLANS.add(f"WITH {_FILES} SELECT key::VARCHAR AS name, length(content)::BIGINT AS bytes, sha256(content) AS sha256, min(key::VARCHAR) OVER (PARTITION BY content) AS first FROM f")
def src_file_inventory(spark, d):
    """Files below a folder with their digests, and the first one of the same content."""
    return _bundle(spark, d, "files").select("name", "bytes", "sha256", "first")


@PLANS.add(f"WITH {_FILES} SELECT key::VARCHAR AS name, 'updated' AS status FROM f WHERE key % 3 = 1 AND key <> 4 UNION ALL SELECT '4', 'deleted'")
def snk_manifest_check(spark, d):
    """What a bundle breaks of its manifest: changed files and missing ones."""
    manifest = _bundle(spark, d, "bundle").select("name", "sha256")
    found = _bundle(spark, d, "bundle", F.col("key") % 3 == 1).where("name <> '4'")
    return files.verified(manifest, found)


@PLANS.add(f"WITH {_FILES} SELECT key::VARCHAR AS name FROM f WHERE key % 4 = 2")
def snk_delta_checkpoint(spark, d):
    """The files that changed since the index was made."""
    index = _bundle(spark, d, "index").select("name", "sha256")
    return files.changed(_bundle(spark, d, "index", F.col("key") % 4 == 2), index).select("name")


@PLANS.add("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def snk_days_replaced(spark, d):
    """A table of days after its last two days have been computed again: replaced, not added to."""
    path = _folder(spark, "days")
    e = table(spark, d, "events")
    daily = lambda rows: rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    sink = replacing_days(path)
    sink(daily(e.where("event_id % 2 = 0 or ts < timestamp_ntz '2024-01-29'")), 0)
    sink(daily(e.where("ts >= timestamp_ntz '2024-01-29'")), 1)
    return spark.read.parquet(path).select("day", "event_type", "n")
