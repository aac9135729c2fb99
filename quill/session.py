"""Sessions for tests and benches, and workers that find this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find(spark: SparkSession) -> None:
    """Put the repository on the path of Python workers, whatever folder the driver was started in."""
    seen = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in seen.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, seen) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A temporary one is set only on a local master, as in tests; on a cluster no other machine sees it.
    """
    context = spark.sparkContext
    set_dir = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir and context._jsc.sc().getCheckpointDir().isDefined():
        set_dir = context._jsc.sc().getCheckpointDir().get()
    if not set_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors see")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quill-"))
        set_dir = context._jsc.sc().getCheckpointDir().get()
    return set_dir.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder: a lost executor loses nothing, and the plan ends here."""
    context, folder = df.sparkSession.sparkContext, shared_dir(df.sparkSession)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: cuts the plan, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/quill-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, count: int, *keys: str) -> DataFrame:
    """``df`` as a table of the session's catalog, bucketed by the keys: grouping it by them moves no row of it again."""
    spark, name = df.sparkSession, f"quill_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(count, *keys).write.bucketBy(count, *keys).sortBy(*keys).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def local(cores: str = "4", partitions: int = 8, memory: str = "6g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    workers_find(spark)
    return spark
