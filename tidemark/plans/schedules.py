"""When boards are read: fire times, validation, what is due.

schedules: schedule_id, schedule_seq, recording_id, cron, timezone, enabled,
last_run_at, next_run_at.

A schedule whose day of month and day of week are both restricted fires where
either matches. A local time that a clock change skips doesn't fire; one that it
repeats fires once, at the first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cron import RANGES, describe_cron, field_numbers

SHORTEST_MINUTES = 15


#: Days are sought through at most so many years for each time that is wanted: a 29 February that is a certain day of the week recurs within 40.
RARE_YEARS = 40


def _zones(spark) -> DataFrame:
    """Names of time zones that the JVM knows: some hundred, so they may be broadcast."""
    return spark.createDataFrame([(z,) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds()], "zone string")


def _parsed(schedules: DataFrame) -> DataFrame:
    """schedules with spaced (the expression with single spaces), a column of numbers for each field, zone (null if unknown)."""
    spaced = F.regexp_replace(F.trim("cron"), r"\s+", " ")
    parts = F.split(spaced, " ")
    fields = {f"__{f}": field_numbers(F.try_element_at(parts, F.lit(i)), f) for i, f in enumerate(RANGES, 1)}
    named = schedules.withColumn("__zone", F.coalesce("timezone", F.lit("UTC"))).join(F.broadcast(_zones(schedules.sparkSession)), F.col("__zone") == F.col("zone"), "left").drop("__zone")
    return named.withColumns({"spaced": spaced, "__parts": F.size(parts), **fields, "__any_dom": F.try_element_at(parts, F.lit(3)).startswith("*"), "__any_dow": F.try_element_at(parts, F.lit(5)).startswith("*")})


def _fires_on(day: Column) -> Column:
    in_month = F.array_contains("__dom", F.dayofmonth(day))
    in_week = F.array_contains("__dow", F.dayofweek(day) - 1)
    return F.when(F.col("__any_dom") | F.col("__any_dow"), in_month & in_week).otherwise(in_month | in_week)


def _possible() -> Column:
    """Whether some day of the allowed months can have an allowed number; where either kind of day will do, the days of the week can."""
    longest = F.array(*(F.lit(n) for n in (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))
    in_month = F.exists("__month", lambda m: F.element_at("__dom", 1) <= F.element_at(longest, m))
    return F.when(F.col("__any_dom") | F.col("__any_dow"), in_month).otherwise(F.lit(True))


def _valid_times(day: Column, after: Column) -> Column:
    """The fire times of a day: local times that exist, at their first occurrence, behind a moment."""
    of_day = F.flatten(F.transform("__hour", lambda h: F.transform("__minute", lambda m: F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), h, m, F.lit(0).cast("decimal(16,6)")))))
    both = F.transform(of_day, lambda local: F.struct(local.alias("local"), F.to_utc_timestamp(local, F.col("zone")).alias("at")))
    kept = F.filter(both, lambda t: (F.from_utc_timestamp(t["at"], F.col("zone")) == t["local"]) & (t["at"] > after))
    return F.transform(kept, lambda t: t["at"])


def _first_times(start: Column, after: Column, most: int) -> Column:
    """The first `most` fire times from a day on, by carrying on from time to day, month and year until there are enough."""
    enough = lambda found, more: F.when(F.size(found) >= most, found).otherwise(more)

    def of_month(found: Column, first: Column) -> Column:
        days = F.filter(F.sequence(first, F.last_day(first), F.expr("interval 1 day")), lambda d: (d >= start) & _fires_on(d))
        return enough(found, F.aggregate(days, found, lambda so_far, d: enough(so_far, F.concat(so_far, _valid_times(d, after)))))

    def of_year(found: Column, year: Column) -> Column:
        months = F.transform("__month", lambda m: F.make_date(year, m, F.lit(1)))
        return enough(found, F.aggregate(months, found, of_month))

    years = F.when(_possible(), F.sequence(F.year(start), F.year(start) + RARE_YEARS * most)).otherwise(F.array().cast("array<int>"))
    return F.slice(F.aggregate(years, F.array().cast("array<timestamp>"), of_year), 1, most)


def fire_times(schedules: DataFrame, after: Column | datetime, days: int | None = None, most: int | None = None) -> DataFrame:
    """schedule_id, fire_at: times strictly after a moment; within some days, or the first `most` of each schedule (with n from 1), or both.

    Each schedule's times are an array, found on its own row: nothing is shuffled,
    and a time that a clock change skips is passed over before it counts. Without
    days there is no horizon.
    """
    if days is None and most is None:
        raise ValueError("give days or most")
    after = after if isinstance(after, Column) else F.lit(after).cast("timestamp")
    valid = _parsed(schedules).where("__parts = 5 and zone is not null and __minute is not null and __hour is not null and __dom is not null and __month is not null and __dow is not null")
    # a day before, for zones; its and this day's times may have gone by
    start = F.to_date(F.from_utc_timestamp(after, F.col("zone"))) - 1
    if days is None:
        times = _first_times(start, after, most)
    else:
        dates = F.filter(F.sequence(start, start + days + 1, F.expr("interval 1 day")), lambda d: F.array_contains("__month", F.month(d)) & _fires_on(d))
        times = F.flatten(F.transform(dates, lambda d: _valid_times(d, after)))
        times = times if most is None else F.slice(times, 1, most)
    if most is None:
        return valid.select("schedule_id", F.explode(times).alias("fire_at"))
    return valid.select("schedule_id", F.posexplode(times).alias("n", "fire_at")).select("schedule_id", "fire_at", (F.col("n") + 1).alias("n"))


def validate_schedules(schedules: DataFrame, now: Column | datetime) -> DataFrame:
    """schedule_id, cron (with single spaces), error (null if it is fine)."""
    parsed = _parsed(schedules)
    fires = fire_times(schedules, now, most=25)
    gap = (F.unix_timestamp(F.lead("fire_at").over(Window.partitionBy("schedule_id").orderBy("fire_at"))) - F.unix_timestamp("fire_at")) / 60
    gaps = fires.withColumn("gap", gap).groupBy("schedule_id").agg(F.min("gap").alias("gap"), F.count("*").alias("fires"))
    bad_field = F.coalesce(*(F.when(F.col(f"__{f}").isNull(), f"invalid {f} field") for f in RANGES))
    error = (
        F.when(F.col("__parts") != 5, "not five fields").when(bad_field.isNotNull(), bad_field).when(F.col("zone").isNull(), "unknown time zone")
        .when(F.coalesce("fires", F.lit(0)) == 0, "never fires").when(F.col("gap") < SHORTEST_MINUTES, f"fires more often than every {SHORTEST_MINUTES} minutes")
    )
    return parsed.join(gaps, "schedule_id", "left").select("schedule_id", F.col("spaced").alias("cron"), error.alias("error"))


def schedule_view(schedules: DataFrame, now: Column | datetime, times: int = 5) -> DataFrame:
    """schedules with description, zone and next_times (none for disabled ones)."""
    following = fire_times(schedules.where("enabled"), now, most=times).groupBy("schedule_id").agg(F.array_sort(F.collect_list("fire_at")).alias("next_times"))
    shown = schedules.withColumns({"description": describe_cron(F.col("cron"), F.col("timezone")), "zone": F.coalesce("timezone", F.lit("UTC"))})
    return shown.join(following, "schedule_id", "left").withColumn("next_times", F.coalesce("next_times", F.array().cast("array<timestamp>")))


def upcoming_runs(schedules: DataFrame, now: Column | datetime, per: int = 3, total: int = 5) -> DataFrame:
    """The soonest fire times overall, of the next few of each enabled schedule."""
    return fire_times(schedules.where("enabled"), now, most=per).drop("n").join(schedules.select("schedule_id", "recording_id"), "schedule_id").orderBy("fire_at", "schedule_id").limit(total)


def missed_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    """Enabled schedules whose time has gone by: reported, never run for the past."""
    return schedules.where(F.col("enabled") & (F.col("next_run_at") < now))


def due_runs(schedules: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Queued runs for schedules that are due, one per board, none for a board with an active run."""
    due = schedules.where(F.col("enabled") & (F.col("next_run_at") <= now))
    free = due.join(runs.where(F.col("status").isin("queued", "running")).select("recording_id"), "recording_id", "left_anti")
    first = Window.partitionBy("recording_id").orderBy("schedule_seq")
    return free.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("recording_id", "schedule_id", F.lit("queued").alias("status"), F.lit("schedule").alias("trigger"), now.alias("created_at"))


def after_firing(schedules: DataFrame, now: Column) -> DataFrame:
    """schedules with last_run_at and next_run_at moved on where they were due."""
    due = F.col("enabled") & (F.col("next_run_at") <= now)
    following = fire_times(schedules.where(due), now, most=1).select("schedule_id", F.col("fire_at").alias("__next"))
    return schedules.join(following, "schedule_id", "left").withColumns({"last_run_at": F.when(due, now).otherwise(F.col("last_run_at")), "next_run_at": F.when(due, F.col("__next")).otherwise(F.col("next_run_at"))}).drop("__next")
