"""The thin queries opN_<name>: one operator each over its whole table, as the contracts have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.fim import fill_in_middle
from quill.llm.htmltext import main_text
from quill.llm.jaccard import similar_documents
from quill.llm.language import language_id
from quill.llm.leaks import SLACK, decontaminate
from quill.llm.lines import line_dedup
from quill.llm.packing import pack
from quill.llm.quality import quality
from quill.llm.repeats import without_repeats
from quill.llm.runs import periodic_runs
from quill.llm.simhash import near_duplicates
from quill.llm.transport import media_columns
from quill.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "votes", "posterior", "quality", "keep")


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "n_shingles", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slack=SLACK)
    ids = lambda c: F.sha2(F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ","), 256)
    count = lambda c: F.size(c).cast("long")
    return marked.select("doc_id", "n_words", "n_hit", count("items").alias("n_items"), ids("items").alias("items_sha256"), "contaminated", count("near_items").alias("n_near_items"), ids("near_items").alias("near_items_sha256"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def with_periods(docs: DataFrame) -> DataFrame:
    """The documents, those whose crc32 ends in 0 with the words from one place on in a cycle, as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("_g", F.floor(h / 10)).withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int")).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    cycle = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(cycle, F.lit(1), rest)), " ")
    return rows.withColumn("text", F.coalesce(text, "text")).drop("_g", "_w", "_n", "_a", "_p")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs come by start, then period: the first of the highest exponent stays
    better = lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b)
    found = found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), better))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_repeats": op5_repeats,
    "op6_quality": op6_quality,
    "op7_transport_stream": op7_transport_stream,
    "op8_warc": op8_warc,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op11_fim": op11_fim,
    "op12_simhash": op12_simhash,
    "op13_runs": op13_runs,
}

from quill.llm.oracles import ORACLES  # noqa: E402

__all__ = ["ORACLES", "QUERIES"]
