"""What the registered queries share: tables and a decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(queries: dict) -> Callable:
    """Decorator: registers a function of (read) under its name, with its SQL; read(name) gives a table."""

    def add(sql: str | None = None) -> Callable:
        def keep(make):
            queries[make.__name__] = (lambda spark, sf_dir: make(lambda name: table(spark, sf_dir, name)), sql)
            return make

        return keep

    return add
