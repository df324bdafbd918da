"""Stop rules of page sequences and lists, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_hash(items: Column) -> Column:
    """Hash of the texts of a page's items."""
    return F.sha2(F.array_join(items, "\n"), 256)


def truncate_pagination(pages: DataFrame, mode: str, max_pages: int, run: str = "run_id") -> DataFrame:
    """The pages that a run reads: pages with page_no (from 1), page_hash, items, loaded and has_next.

    urlPattern: ends before a page behind the first that doesn't load, has no
    items, or repeats earlier ones. nextButton: a page that repeats is still read,
    then the run ends; it also ends where there is no next page.
    """
    w = Window.partitionBy(run).orderBy("page_no")
    repeat = F.row_number().over(Window.partitionBy(run, "page_hash").orderBy("page_no")) > 1
    flagged = pages.withColumn("__repeat", repeat)
    if mode == "urlPattern":
        ends = (F.col("page_no") > 1) & (~F.col("loaded") | (F.col("items") == 0) | F.col("__repeat"))
        stop = F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif mode == "nextButton":
        ends = F.col("__repeat") | ~F.col("has_next")
        stop = F.coalesce(F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        raise ValueError(f"unknown mode {mode}")
    return flagged.withColumn("__stop", stop).where((F.col("__stop") == 0) & (F.col("page_no") <= max_pages)).drop("__stop", "__repeat")


def infinite_scroll(rounds: DataFrame, run: str = "run_id") -> DataFrame:
    """rounds(page_no, items) with from_item: each round reads only what is beyond the rounds before; ends when nothing is."""
    w = Window.partitionBy(run).orderBy("page_no")
    before = F.coalesce(F.max("items").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grown = rounds.withColumn("from_item", before).withColumn("__still", (F.col("items") <= F.col("from_item")).cast("int"))
    return grown.withColumn("__end", F.max("__still").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__end = 0").drop("__end", "__still")


def cut_after_errors(items: DataFrame, k: int = 5, run: str = "run_id", order: list[str] | None = None) -> DataFrame:
    """Items up to the k-th failure in a row (is_error); a success begins anew."""
    order = order or ["item_idx"]
    w = Window.partitionBy(run).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    island = items.withColumn("__island", F.sum(F.when(F.col("is_error"), 0).otherwise(1)).over(so_far))
    row = island.withColumn("__row", F.sum(F.col("is_error").cast("int")).over(Window.partitionBy(run, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    done = F.coalesce(F.max((F.col("__row") >= k).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return row.withColumn("__done", done).where("__done = 0").drop("__island", "__row", "__done")


def merge_list_detail(items: DataFrame, details: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records of a list with what their detail pages add.

    items: keys, page_fields, fields; details: keys, fields. A later value wins, a
    missing one wipes nothing; records without any value are not given.
    """
    keys = keys or ["run_id", "item_idx"]
    none = F.create_map().cast("map<string,string>")
    joined = items.join(details.select(*keys, F.col("fields").alias("__detail")), keys, "left")
    over = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    merged = over(over(F.coalesce("page_fields", none), F.coalesce("fields", none)), F.coalesce("__detail", none))
    return joined.withColumn("fields", merged).drop("__detail", "page_fields").where(F.exists(F.map_values("fields"), lambda v: v.isNotNull()))
