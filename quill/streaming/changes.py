"""Change capture: events for what is new or different in the rows of a key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Watch:
    """An event for a key's first row (no ``column``), or for a row whose column differs from the row before.

    ``to`` are the values that the column must now have (any, if empty); with ``from_null`` the value
    before must be null. Null is a value like any other: from or to null is a difference.
    """

    event: str
    column: str | None = None
    to: tuple = ()
    from_null: bool = False

    def told(self) -> Column:
        old, new = F.col("_before"), (lambda c: F.col(c))
        if self.column is None:
            return old.isNull()
        differs = old.isNotNull() & ~old[self.column].eqNullSafe(new(self.column))
        if self.to:
            differs = differs & F.coalesce(new(self.column).isin(*self.to), F.lit(False))
        return differs & old[self.column].isNull() if self.from_null else differs


def _told(rows: DataFrame, key: str, order: list, ids: list[str], watches: list[Watch]) -> DataFrame:
    columns = sorted({w.column for w in watches if w.column})
    before = F.lag(F.struct(F.lit(1).alias("_row"), *columns)).over(Window.partitionBy(key).orderBy(*order))
    text = lambda c: c.cast("string")
    events = []
    for w in watches:
        old = text(F.col("_before")[w.column]) if w.column else F.lit(None).cast("string")
        new = text(F.col(w.column)) if w.column else F.lit(None).cast("string")
        events.append(F.when(w.told(), F.struct(F.lit(w.event).alias("event"), old.alias("old_value"), new.alias("new_value"))))
    kept = [c for c in ("_image",) if c in rows.columns]
    return rows.withColumn("_before", before).select(key, *ids, *kept, F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")).select(key, *ids, *kept, "e.*")


def changes(rows: DataFrame, key: str, order: list[str], watches: list[Watch]) -> DataFrame:
    """key, the order columns, event, old_value, new_value: every event of a table of versions.

    Rows of a key follow each other by ``order``, which must tell them apart; rows of a null key are
    those of one key. A hot key is sorted, with spill, in one task; nothing of it is held in memory.
    """
    return _told(rows, key, order, order, watches)


def capturing(path: str, key: str, order: list[str], watches: list[Watch]):
    """A foreachBatch sink: events under ``path``/events/batch=n, the last row of every key under ``path``/images/version=n.

    A batch meets the images that the batch before has left. A batch that is run again after a failure
    reads those same images and overwrites what it wrote, so events come once. What comes in a later
    batch follows what came in earlier ones, whatever its order columns say.
    """
    columns = sorted({w.column for w in watches if w.column})

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key, *order, *columns).withColumn("_image", F.lit(False))
        if n > 0:
            held = spark.read.schema(new.drop("_image").schema).parquet(f"{path}/images/version={n - 1}")
            new = held.withColumn("_image", F.lit(True)).unionByName(new)
        # an image is the row before all rows of its key
        first = [F.desc("_image"), *order]
        told = _told(new, key, first, order, watches).where(~F.col("_image")).drop("_image")
        told.write.mode("overwrite").parquet(f"{path}/events/batch={n}")
        last = F.row_number().over(Window.partitionBy(key).orderBy("_image", *[F.desc(c) for c in order]))
        new.withColumn("_last", last).where("_last = 1").drop("_last", "_image").write.mode("overwrite").parquet(f"{path}/images/version={n}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/images/version={n - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return sink
