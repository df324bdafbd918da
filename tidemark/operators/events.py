"""The run log: timelines, drift, suggestions.

events: run_id, event_id (order of the log), ts, level (info, warn, error),
step_id, type, message, data_json.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCATOR = "struct<kind: string, value: string, role: string, name: string, exact: boolean, level: int>"
SUGGESTION = f"struct<stepId: string, failed: array<{_LOCATOR}>, locator: {_LOCATOR}, source: string>"


def step_timeline(events: DataFrame) -> DataFrame:
    """Per run and step: starts, warnings and errors in the order of the log, and the step's place in its run."""
    noted = lambda level: F.transform(F.array_sort(F.collect_list(F.when((F.col("level") == level) & (F.col("type") != "step_start"), F.struct("event_id", "message")))), lambda x: x["message"])
    steps = events.where("step_id is not null").groupBy("run_id", "step_id").agg(F.count_if(F.col("type") == "step_start").alias("starts"), noted("warn").alias("warnings"), noted("error").alias("errors"), F.min("event_id").alias("first_event"))
    return steps.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("first_event"))).drop("first_event")


def event_positions(events: DataFrame) -> DataFrame:
    """events with their position in their run's log, from 0."""
    return events.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")) - 1)


def events_after(events: DataFrame, run_id: str, position: int) -> DataFrame:
    return event_positions(events.where(F.col("run_id") == run_id)).where(F.col("position") > position).orderBy("position")


def distinct_suggestions(events: DataFrame) -> DataFrame:
    """Valid suggestions of other locators, each once per run, at the place of the first; malformed ones are dropped."""
    said = events.where("type = 'locator_suggestion'").withColumn("s", F.from_json("data_json", SUGGESTION))
    valid = said.where("s.stepId is not null and s.locator.kind is not null and size(s.failed) > 0")
    w = Window.partitionBy("run_id", "s.stepId", F.to_json("s.failed"), F.to_json("s.locator")).orderBy("event_id")
    return valid.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("run_id", "event_id", F.col("s.stepId").alias("step_id"), F.col("s.failed").alias("failed"), F.col("s.locator").alias("locator"), F.coalesce("s.source", F.lit("unknown")).alias("source"))


def suggestion_state(suggestions: DataFrame, targets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """suggestions with state: open, applied or stale.

    targets: recording_id, step_id, locators (array). Open if some target of the
    step still has exactly the locators that failed; applied if one begins with
    the suggested locator and has the failed ones behind it.
    """
    keys = keys or ["recording_id", "step_id"]
    text = F.to_json
    # to_json of each locator, so that arrays compare whatever their fields' nulls
    joined = suggestions.withColumn("__id", F.xxhash64(*keys, text("failed"), text("locator"))).join(targets.select(*keys, "locators"), keys, "left")
    same = text("locators") == text("failed")
    rest = F.slice("locators", 2, F.greatest(F.size("locators") - 1, F.lit(0)))
    without = lambda arr: F.filter(arr, lambda x: F.to_json(x) != F.to_json(F.col("locator")))
    applied = (text(F.try_element_at("locators", F.lit(1))) == text("locator")) & (F.to_json(rest) == F.to_json(without(F.col("failed"))))
    state = F.max(F.when(same, 2).when(applied, 1).otherwise(0)).over(Window.partitionBy("__id"))
    ranked = joined.withColumn("__state", state).withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy(F.lit(1))))
    return ranked.where("__n = 1").withColumn("state", F.when(F.col("__state") == 2, "open").when(F.col("__state") == 1, "applied").otherwise("stale")).drop("__id", "__state", "__n", "locators")


def apply_suggestions(targets: DataFrame, suggestions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """targets with open suggestions put first; the other locators stay as fallbacks, none twice."""
    keys = keys or ["recording_id", "step_id"]
    opened = suggestions.where("state = 'open'").select(*keys, F.to_json("failed").alias("__failed"), "locator")
    joined = targets.withColumn("__failed", F.to_json("locators")).join(opened, [*keys, "__failed"], "left")
    rest = F.filter("locators", lambda x: F.to_json(x) != F.to_json(F.col("locator")))
    return joined.withColumn("locators", F.when(F.col("locator").isNotNull(), F.concat(F.array("locator"), rest)).otherwise(F.col("locators"))).drop("__failed", "locator")


def locator_drift_report(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Per board and step: how often a fallback locator was used, by its kind."""
    drift = events.where("type = 'locator_drift'").select("run_id", "step_id", F.get_json_object("data_json", "$.used.kind").alias("used"))
    return drift.join(runs.select("run_id", "recording_id"), "run_id").groupBy("recording_id", "step_id", "used").agg(F.count("*").alias("times"))


def level_of(kind: Column) -> Column:
    """Level of an event by its kind, where the log has none."""
    return F.when(kind.contains("error"), "error").when(kind.contains("warn"), "warn").otherwise("info")
