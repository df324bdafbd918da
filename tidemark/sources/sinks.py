"""Writers: exports of postings, the event log, snapshots of state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import job_cells

# Columns of an export, and the most rows of one.
EXPORT_COLUMNS = {
    "title": "title", "company": "company", "location": "location", "remote": "remote", "salary_text": "salaryText", "salary_min": "salaryMin", "salary_max": "salaryMax", "salary_currency": "salaryCurrency",
    "salary_period": "salaryPeriod", "employment_type": "employmentType", "posted_at": "postedAt", "url": "url", "first_seen_at": "firstSeenAt", "last_seen_at": "lastSeenAt", "closed_at": "closedAt", "recording_id": "recordingId",
}
EXPORT_LIMIT = 10_000


def _newest(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc("first_seen_at"), F.desc("job_seq")).limit(limit)


def write_jobs_csv(jobs: DataFrame, path: str, limit: int = EXPORT_LIMIT, blank: tuple[str, ...] = ()) -> None:
    """The newest postings as one CSV file with CRLF line ends. The limit is what an export holds; columns in blank are left empty."""
    header = jobs.sparkSession.createDataFrame([(0, ",".join(EXPORT_COLUMNS.values()))], "n long, line string")
    shown = _newest(jobs, limit).withColumns({c: F.lit(None).cast("string") for c in blank}) if blank else _newest(jobs, limit)
    lines = job_cells(shown, list(EXPORT_COLUMNS)).select((F.monotonically_increasing_id() + 1).alias("n"), "line")
    header.unionByName(lines).coalesce(1).sortWithinPartitions("n").select("line").write.text(path, lineSep="\r\n")


def write_jobs_json(jobs: DataFrame, path: str, limit: int = EXPORT_LIMIT) -> None:
    """The same rows as JSON lines, nulls written out."""
    _newest(jobs, limit).select(*(F.col(c).alias(name) for c, name in EXPORT_COLUMNS.items())).write.json(path, ignoreNullFields=False)


def append_events(events: DataFrame, path: str) -> None:
    """Add to the log: run_id, event_id (order of the log), ts, level, step_id, type, message, data_json."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_events(log: DataFrame, run_id: str | None = None) -> DataFrame:
    """A run's events in the order of the log, whatever their times say."""
    some = log if run_id is None else log.where(F.col("run_id") == run_id)
    return some.orderBy("run_id", "event_id")


def write_snapshot(state: DataFrame, path: str, version: int) -> str:
    """A new version of a state table beside the ones that may still be read; returns its path."""
    to = f"{path}/version={version}"
    state.write.mode("errorifexists").parquet(to)
    return to


def upsert_jobs(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a run's sightings; closed postings that were seen are open again."""
    from tidemark.operators.track import merge_job_state

    return merge_job_state(state, batch).drop("flag")
