"""Strict scans of line-delimited JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quill.functions.batches import by_slices


def _pairs(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is given twice")
    return out


def _refuse(name):
    raise ValueError(f"{name} is no JSON")


def checked(text: str | None) -> str | None:
    """What is wrong with a line, or nothing: malformed, a repeated key, NaN or an infinity."""
    try:
        json.loads((text or "").removeprefix("﻿"), object_pairs_hook=_pairs, parse_constant=_refuse, parse_float=str)
    except ValueError as e:
        return str(e)
    return None


@F.arrow_udf(StringType())
def _error(value: pa.Array) -> pa.Array:
    return by_slices(checked, pa.string(), value)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value, error: one row per line that is not blank.

    Only line feeds end a line, so other separators inside strings are content; a carriage return
    before one and a byte order mark at the start of a file are dropped. Numbers keep their digits as
    text in ``value``. Files are read in blocks; the lines of each block are counted, so that a line
    has its number in its file wherever it is read.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = read.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = read.join(blocks.withColumn("before", before), ["file", "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1)
    plain = F.regexp_replace(F.when(F.col("line") == 1, F.regexp_replace("value", "^\\x{FEFF}", "")).otherwise(F.col("value")), "\r$", "")
    return lines.select("file", "line", plain.alias("value")).where(F.trim("value") != "").withColumn("error", _error("value"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``schema``; the first bad line ends the query with its file and number."""
    rows = scanned(spark, path)
    said = F.concat_ws(":", "file", F.col("line").cast("string"), "error")
    good = rows.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(said).cast("boolean")))
    return good.select(F.from_json("value", schema).alias("r")).select("r.*")


def written_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls stay."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
