"""Delimited files with a sniffed separator; inventories of files, manifests and what changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.operators.corpus import manifest_diff

SEPARATORS = (",", ";", "\t", "|")
#: Lines that the separator is guessed from.
SNIFFED = 50


def separator(lines: list[str]) -> str:
    """The mark that stands equally often, and most often, in the lines; a comma if none does."""
    counts = {s: [line.count(s) for line in lines if line.strip()] for s in SEPARATORS}
    good = {s: c[0] for s, c in counts.items() if c and c[0] and all(x == c[0] for x in c)}
    return max(good, key=good.get) if good else ","


def named(header: list[str]) -> list[str]:
    """Names of columns: blank ones by their number, repeated ones with how often they came before."""
    used: list[str] = []
    for i, name in enumerate(header, 1):
        base = name or f"column_{i}"
        fresh, k = base, 2
        while fresh in used:
            fresh, k = f"{base} ({k})", k + 1
        used.append(fresh)
    return used


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text; a row with more or fewer cells than the header is an error."""
    head = [r["value"] for r in spark.read.text(path).limit(SNIFFED).collect()]
    sep = sep or separator(head)
    first = spark.read.csv(path, sep=sep, header=False).limit(1).collect()
    names = named([x or "" for x in first[0]]) if first else []
    if not names:
        return spark.createDataFrame([], "column_1 string")
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, sep=sep, header=True, schema=schema, mode="FAILFAST", enforceSchema=True, multiLine=False)


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, bytes, sha256, first: every file below a folder, and the first one of the same content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    each = files.select("path", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return each.withColumn("first", F.min("path").over(Window.partitionBy("sha256")))


def verified(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """name, status of what is missing, changed or not listed; an error if there is anything."""
    return manifest_diff(manifest, found, "name", "sha256").where("status <> 'unchanged'")


def changed(found: DataFrame, index: DataFrame) -> DataFrame:
    """The files whose content the index (name, sha256) does not have under their name."""
    return found.join(index.select("name", "sha256"), ["name", "sha256"], "left_anti")
