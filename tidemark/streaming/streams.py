"""The log and the tracker as streams.

Sources are streaming DataFrames with the columns of their batch forms. State that
outlives a batch is a table whose versions name the folder of each bucket of keys,
so a batch rewrites only the buckets that it touches. Each version knows the last
batch of every source, so a batch that is run again changes nothing, and tracker
and closer take turns on one table.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import track
from tidemark.shared import Versions

# Statuses that a run keeps.
FINAL = ("succeeded", "partial", "failed", "blocked", "cancelled")


def stream_run_log(events: DataFrame, run_id: str | None = None, after: int | None = None) -> DataFrame:
    """Events of a run (or all) behind a place in the log; the checkpoint of the query keeps what was given out."""
    some = events if run_id is None else events.where(F.col("run_id") == run_id)
    return some if after is None else some.where(F.col("event_id") > after)


def follow_run(events: DataFrame, run_id: str, runs: Callable[[], DataFrame], give: Callable[[DataFrame, int], None], checkpoint: str, *, after: int | None = None, wait: float = 1.0) -> Row:
    """Give out a run's events, stored ones and then new ones, each once, until the run is final; its row is the end.

    runs gives the table of runs as it is now (run_id, status). A run is looked up before
    each pass over the log, so what was logged before it ended is given out before the end.
    """
    while True:
        ended = runs().where((F.col("run_id") == run_id) & F.col("status").isin(*FINAL)).limit(1).collect()
        stream_run_log(events, run_id, after).writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if ended:
            return ended[0]
        time.sleep(wait)


def stream_dedupe(sightings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first sighting of each key of a run; arrived_at bounds the state."""
    return sightings.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["run_id", "dedup_key"])


def stream_timeline(events: DataFrame) -> DataFrame:
    """Per run and step: starts, warnings and errors so far. For output mode update or complete."""
    note = lambda level: F.count_if((F.col("level") == level) & (F.col("type") != "step_start"))
    return events.where("step_id is not null").groupBy("run_id", "step_id").agg(F.count_if(F.col("type") == "step_start").alias("starts"), note("warn").alias("warnings"), note("error").alias("errors"), F.min("event_id").alias("first_event"))


class StateTable:
    """Postings by key in buckets; a version (see shared.Versions) names the folder of each bucket."""

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame, buckets: int = 64) -> None:
        self.spark, self.path, self._empty, self.buckets = spark, path, empty, buckets
        self._versions = Versions(spark, path)

    def versions(self) -> list[int]:
        return self._versions.numbers()

    def _newest(self) -> dict:
        return self._versions.newest({"applied": {}, "folders": {}})

    def _bucket(self):
        return F.pmod(F.xxhash64(*track.KEY), F.lit(self.buckets)).cast("int")

    def _rows(self, newest: dict, buckets: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in newest["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(self._empty.schema).parquet(*paths) if paths else self._empty

    def read(self) -> DataFrame:
        return self._rows(self._newest())

    def update(self, source: str, batch: int, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows in the buckets of keys by change(rows); nothing if this batch of the source is in already."""
        newest = self._newest()
        if newest["applied"].get(source, -1) >= batch:
            return
        touched = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # so many buckets at most
        folder = uuid.uuid4().hex
        rows = change(self._rows(newest, touched)).select(self._empty.columns).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        made = {n.removeprefix("bucket=") for n in self._versions.names(f"data/{folder}") if n.startswith("bucket=")}
        folders = {b: f for b, f in newest["folders"].items() if b not in touched} | dict.fromkeys(sorted(made), folder)
        after = {"version": newest["version"] + 1, "applied": newest["applied"] | {source: batch}, "folders": folders}
        self._versions.publish(after)

    def prune(self, keep: int = 5) -> None:
        """Remove all but the newest versions, and folders that none of them names. Not while a batch is being written."""
        used = {f for v in self._versions.keep_newest(keep) for f in v["folders"].values()}
        for folder in set(self._versions.names("data")) - used:
            self._versions.remove(f"data/{folder}")


def track_batch(table: StateTable, batch: DataFrame, batch_id: int) -> None:
    """Merge a batch's sightings into the state, whatever number of runs it holds."""
    batch = batch.persist()
    table.update("track", batch_id, batch, lambda state: track.merge_runs(state, batch))
    batch.unpersist()


def stream_track_jobs(sightings: DataFrame, table: StateTable, checkpoint: str) -> StreamingQuery:
    """Keep the state of all postings up to date with a stream of sightings (one row per key and run)."""
    return sightings.writeStream.foreachBatch(lambda batch, i: track_batch(table, batch, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close_batch(table: StateTable, sightings: DataFrame, runs: DataFrame, finished: DataFrame, batch_id: int, n: int = 3) -> None:
    """Close what the last n succeeded runs of the boards in finished missed."""
    boards = finished.where("status = 'succeeded'").select("recording_id").distinct()
    own = lambda df: df.join(boards, "recording_id", "left_semi")
    when = finished.groupBy("recording_id").agg(F.max("finished_at").alias("__at"))
    closing = track.close_missing(own(table.read()), own(sightings), own(runs), n).join(when, "recording_id").select(*track.KEY, "__at").persist()
    table.update("close", batch_id, closing, lambda state: state.join(closing, track.KEY, "left").withColumn("closed_at", F.coalesce("__at", "closed_at")))
    closing.unpersist()


def stream_close(run_events: DataFrame, table: StateTable, sightings: DataFrame, runs: DataFrame, checkpoint: str, n: int = 3) -> StreamingQuery:
    """Close postings as finished runs (recording_id, status, finished_at) arrive."""
    return run_events.writeStream.foreachBatch(lambda batch, i: close_batch(table, sightings, runs, batch, i, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
