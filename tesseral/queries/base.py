"""How a query is registered, and how it reads its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import scratch

__all__ = ["Registry", "scratch", "table"]


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None):
        """Registers a function of (spark, sf_dir) with the SQL that gives the same rows."""

        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
