"""Registered queries of the operators over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    from tidemark.registry import planning, postings, texts

    return {**texts.QUERIES, **postings.QUERIES, **planning.QUERIES}
