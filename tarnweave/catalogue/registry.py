"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views


class Tables:
    """The tables and views of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def register(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        queries[name] = lambda spark, folder: run(Tables(spark, folder))
        if sql:
            oracles[name] = with_views(sql.strip())

    return queries, oracles, register
