"""Tables of a directory, and the pairs of a query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Plans(dict):
    """name -> (query, SQL or None)"""

    def add(self, sql: str | None = None) -> Callable[[Plan], Plan]:
        def keep(f: Plan) -> Plan:
            self[f.__name__] = (f, sql)
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
