"""Tables in the shared folder, and Arrow text as flat byte arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quill.session import shared_dir

#: Bytes of text that one vectorised step works on; temporaries take some 60 times as much.
STEP_BYTES = 1 << 20


def table_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quill-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor loses nothing."""
    spark, path = df.sparkSession, table_path(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads, and let Spark free the shuffles behind them."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # what the first round finds unused may hold a shuffle that only the second one does
        gc.collect()
        jvm.System.gc()
        time.sleep(0.2)


@dataclass
class Bucketed:
    """A table bucketed and sorted by keys: joins on them move the other side only."""

    spark: SparkSession
    name: str
    path: str

    @classmethod
    def of(cls, df: DataFrame, what: str, *keys: str) -> Bucketed:
        """``df`` should be dealt by the keys already, into as many partitions as Spark shuffles into."""
        spark = df.sparkSession
        made = cls(spark, f"quill_{what}_{uuid.uuid4().hex}", table_path(spark, what))
        df.write.bucketBy(partitions(spark), *keys).sortBy(*keys).option("compression", "zstd").option("path", made.path).saveAsTable(made.name)
        return made

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        dropped(self.spark, self.path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null rows are empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most so many bytes of text, or one row."""
    _, offsets = flat(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def stops(first: np.ndarray, n: int) -> np.ndarray:
    """Where runs end that begin at ``first`` among n entries."""
    return np.append(first[1:], n)[: len(first)]


def released() -> None:
    """Give what a task's batches have freed back to the system: workers stay alive beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def lean(batches: Callable) -> Callable:
    """A function of ``mapInArrow`` that gives its memory back when its task ends, and now and then before."""

    @functools.wraps(batches)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, out in enumerate(batches(it)):
                yield out
                del out
                if k % 64 == 63:
                    pa.default_memory_pool().release_unused()
        finally:
            released()

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any ranges of a byte array, from one running sum.

    Bytes stand for random 64-bit values, so that equal hashes of unequal ranges are as rare as
    64 bits allow; two seeds give 128 bits.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, 256).astype(np.uint64)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.base, self.inverse = base % (1 << 64), pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        """Tables of n powers at least; those for a longer step than usual go with the next step."""
        if len(self.up) < n or len(self.up) > STEP_BYTES + 1 >= n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Of every window of so many bytes, by its start."""
        n = len(sums) - length
        return mixed((sums[length:] - sums[:-length]) * self.down[:n] + np.uint64(length)) if n > 0 else np.zeros(0, np.uint64)
