"""Rows in the order of their key, without a task that holds all rows of a key.

A key's rows are cut into chunks, mostly by spans of time. Windows run inside a chunk;
what has to pass from chunk to chunk, the last value or the rows at the edge, is one
small row for each chunk, and a second window runs over those only. So a key with a
third of all rows is as many tasks as it has chunks. Null keys are a key of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"


def _joined(rows: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """rows with what their chunk's edge row knows."""
    named = edges.select(*(F.col(k).alias(f"__edge_{k}") for k in (*key, _CHUNK)), *(c for c in edges.columns if c not in (*key, _CHUNK)))
    on = [F.col(k).eqNullSafe(F.col(f"__edge_{k}")) for k in (*key, _CHUNK)]
    return rows.join(named, on).drop(*(f"__edge_{k}" for k in (*key, _CHUNK)))


def carried(df: DataFrame, key: list[str], order: list[str], chunk: Column, value: Column, name: str) -> DataFrame:
    """df with the last value that is not null at or before each row of its key. chunk rises with order."""
    rows = df.withColumns({_CHUNK: chunk, "__value": value})
    inside = Window.partitionBy(*key, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("__value is not null").groupBy(*key, _CHUNK).agg(F.max_by("__value", F.struct(*order)).alias("__last"))
    chunks = rows.select(*key, _CHUNK).distinct().join(last.select(*(F.col(k).alias(f"__l_{k}") for k in (*key, _CHUNK)), "__last"), [F.col(k).eqNullSafe(F.col(f"__l_{k}")) for k in (*key, _CHUNK)], "left")
    before = Window.partitionBy(*key).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    edges = chunks.select(*key, _CHUNK, F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    found = _joined(rows.withColumn(name, F.last("__value", ignorenulls=True).over(inside)), edges, key)
    return found.withColumn(name, F.coalesce(name, "__carried")).drop(_CHUNK, "__value", "__carried")


def neighbours(df: DataFrame, key: list[str], order: list[str], chunk: Column, what: list[str], back: int, ahead: int) -> DataFrame:
    """df with before and after: arrays of `what` of the rows next to each in its key, at most so many, in order. chunk rises with order."""
    rows = df.withColumn(_CHUNK, chunk)
    inside = Window.partitionBy(*key, _CHUNK).orderBy(*order)
    cell = F.struct(*what)
    rows = rows.withColumns({"before": F.collect_list(cell).over(inside.rowsBetween(-back, -1) if back else inside.rowsBetween(1, 0)), "after": F.collect_list(cell).over(inside.rowsBetween(1, ahead) if ahead else inside.rowsBetween(1, 0))})
    final = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) if n else F.slice(a, 1, 0)
    place = F.struct(*order)
    ends = rows.groupBy(*key, _CHUNK).agg(
        F.max_by(final(F.concat("before", F.array(cell)), back), place).alias("__lasts"),
        F.min_by(F.slice(F.concat(F.array(cell), "after"), 1, ahead), place).alias("__firsts"),
    )
    over = Window.partitionBy(*key).orderBy(_CHUNK)
    none = F.slice("__lasts", 1, 0)
    # each chunk has a row or more, so as many chunks as rows are enough
    earlier = [F.coalesce(F.lag("__lasts", i).over(over), none) for i in range(back, 0, -1)]
    later = [F.coalesce(F.lead("__firsts", i).over(over), none) for i in range(1, ahead + 1)]
    edges = ends.select(*key, _CHUNK, F.concat(*earlier, none).alias("__earlier"), F.concat(*later, none).alias("__later"))
    found = _joined(rows, edges, key)
    return found.withColumns({"before": final(F.concat("__earlier", "before"), back), "after": F.slice(F.concat("after", "__later"), 1, ahead)}).drop(_CHUNK, "__earlier", "__later")
