"""Tracking of postings over runs: new, changed, closed and reopened ones.

sightings: recording_id, dedup_key, run_id, run_seq, content_hash (and content).
runs: recording_id, run_id, run_seq, status, and what a query needs besides.
Everything is keyed by (recording_id, dedup_key), never by the board alone, so a
large board is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["recording_id", "dedup_key"]


def job_id(recording: Column, key: Column) -> Column:
    """The same id whenever the same posting of the same board is seen."""
    return F.concat(F.lit("job_"), F.substring(F.sha2(F.concat(recording, F.lit("\u0001"), key), 256), 1, 26))


def latest_runs(runs: DataFrame, n: int, statuses: list[str] | None = None) -> DataFrame:
    """The n newest runs of each board, of some statuses only if any are named."""
    some = runs.where(F.col("status").isin(statuses)) if statuses else runs
    w = Window.partitionBy("recording_id").orderBy(F.desc("run_seq"))
    return some.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def flag_new_changed(sightings: DataFrame) -> DataFrame:
    """Sightings with is_new, is_changed, first_seen_run_id, first_seen_at and last_seen_at (of sightings with seen_at)."""
    w = Window.partitionBy(*KEY).orderBy("run_seq")
    before = F.lag("content_hash").over(w)
    first = F.row_number().over(w) == 1
    out = sightings.withColumns({"is_new": first, "is_changed": ~first & ~before.eqNullSafe(F.col("content_hash")), "first_seen_run_id": F.first("run_id").over(w)})
    if "seen_at" in sightings.columns:
        out = out.withColumns({"first_seen_at": F.first("seen_at").over(w), "last_seen_at": F.col("seen_at")})
    return out


def merge_job_state(state: DataFrame, batch: DataFrame, content: list[str] | None = None) -> DataFrame:
    """State after one run's sightings, and what became of each: flag new, changed, same or unseen.

    state: recording_id, dedup_key, content_hash, the content columns, posted_at,
    first_seen_at, last_seen_at, first_seen_run_id, closed_at. batch: one row per
    key with content_hash, content, posted_at, run_id, seen_at. posted_at follows
    every sighting, content only a changed hash; a sighting reopens.
    """
    content = [c for c in state.columns if c not in (*KEY, "content_hash", "posted_at", "first_seen_at", "last_seen_at", "first_seen_run_id", "closed_at", "flag")] if content is None else content
    s, b = state.alias("s"), batch.alias("b")
    joined = s.join(b, [F.col(f"s.{k}") == F.col(f"b.{k}") for k in KEY], "full_outer")
    seen, known = F.col("b.dedup_key").isNotNull(), F.col("s.dedup_key").isNotNull()
    changed = seen & known & ~F.col("s.content_hash").eqNullSafe(F.col("b.content_hash"))
    rewritten = (seen & ~known) | changed
    pick = lambda test, c: F.when(test, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}"))
    return joined.select(
        *(F.coalesce(f"s.{k}", f"b.{k}").alias(k) for k in KEY),
        *(pick(rewritten, c).alias(c) for c in ["content_hash", *content]),
        pick(seen, "posted_at").alias("posted_at"),
        F.coalesce("s.first_seen_at", "b.seen_at").alias("first_seen_at"),
        F.coalesce("b.seen_at", "s.last_seen_at").alias("last_seen_at"),
        F.when(known, F.col("s.first_seen_run_id")).otherwise(F.col("b.run_id")).alias("first_seen_run_id"),
        F.when(~seen, F.col("s.closed_at")).alias("closed_at"),
        F.when(~seen, "unseen").when(~known, "new").when(changed, "changed").otherwise("same").alias("flag"),
    )


def merge_runs(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after the sightings of any number of runs, which merge_job_state would take run by run in the order of run_seq.

    The state's row is the first of each key's history; windows find where the
    content last changed, so that all runs are merged at once.
    """
    content = [c for c in state.columns if c not in (*KEY, "posted_at", "first_seen_at", "last_seen_at", "first_seen_run_id", "closed_at")]
    known = state.select(*KEY, F.lit(None).cast("long").alias("run_seq"), F.struct(*content).alias("content"), "posted_at", "first_seen_at", "last_seen_at", "first_seen_run_id", "closed_at")
    seen = batch.select(*KEY, F.col("run_seq").cast("long"), F.struct(*content).alias("content"), "posted_at", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), F.col("run_id").alias("first_seen_run_id"), F.lit(None).cast("timestamp").alias("closed_at"))
    w = Window.partitionBy(*KEY).orderBy(F.asc_nulls_first("run_seq"))
    before = F.lag("content.content_hash").over(w)
    kept = F.when((F.row_number().over(w) == 1) | ~before.eqNullSafe(F.col("content.content_hash")), F.col("content"))
    history = known.unionByName(seen).withColumn("__kept", kept).withColumn("__place", F.row_number().over(w))
    first, last = (lambda c: F.min_by(c, "__place")), (lambda c: F.max_by(c, "__place"))
    merged = history.groupBy(*KEY).agg(
        F.max_by(F.col("__kept"), F.when(F.col("__kept").isNotNull(), F.col("__place"))).alias("content"), last("posted_at").alias("posted_at"), first("first_seen_at").alias("first_seen_at"),
        last("last_seen_at").alias("last_seen_at"), first("first_seen_run_id").alias("first_seen_run_id"), last("closed_at").alias("closed_at"),
    )
    return merged.select(*KEY, "content.*", "posted_at", "first_seen_at", "last_seen_at", "first_seen_run_id", "closed_at").select(state.columns)


def diff_snapshots(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """change: added, changed, same or gone, by key and content_hash."""
    keys = keys or KEY
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, [F.col(f"b.{k}") == F.col(f"a.{k}") for k in keys], "full_outer")
    change = F.when(F.col(f"b.{keys[-1]}").isNull(), "added").when(F.col(f"a.{keys[-1]}").isNull(), "gone").when(F.col("b.content_hash").eqNullSafe(F.col("a.content_hash")), "same").otherwise("changed")
    return both.select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys), change.alias("change"))


def jobs_for_run(sightings: DataFrame, jobs: DataFrame, run_id: str) -> DataFrame:
    """Postings of one run with its flags, in the order of sighting."""
    return sightings.where(F.col("run_id") == run_id).join(jobs, "job_id").orderBy("item_idx")


def new_in_latest_run(jobs: DataFrame, sightings: DataFrame, runs: DataFrame) -> DataFrame:
    """Postings that were new in their board's latest finished run. Running runs don't count, failed ones do."""
    latest = runs.where("finished_at is not null").groupBy("recording_id").agg(F.max_by("run_id", "run_seq").alias("run_id"))
    new = sightings.where("is_new").join(latest.select("run_id"), "run_id", "left_semi")
    return jobs.join(new.select("job_id"), "job_id", "left_semi")


def recent_successes(runs: DataFrame, n: int) -> DataFrame:
    """The n newest succeeded runs of boards that have so many; none for n < 1."""
    newest = latest_runs(runs, max(n, 0), ["succeeded"])
    enough = newest.groupBy("recording_id").agg(F.count("*").alias("have")).where(F.col("have") >= max(n, 1))
    return newest.join(enough.select("recording_id"), "recording_id", "left_semi")


def close_missing(jobs: DataFrame, sightings: DataFrame, runs: DataFrame, n: int = 3) -> DataFrame:
    """Open postings that none of their board's n newest succeeded runs saw."""
    recent = recent_successes(runs, n)
    watched = jobs.where("closed_at is null").join(recent.select("recording_id").distinct(), "recording_id", "left_semi")
    seen = sightings.join(recent.select("run_id"), "run_id", "left_semi")
    return unseen_keys(watched, seen)


def unseen_keys(jobs: DataFrame, seen: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Jobs without a row of the same key in seen."""
    keys = keys or KEY
    return jobs.join(seen.select(*keys), keys, "left_anti")


def closed_intervals(sightings: DataFrame, runs: DataFrame, n: int = 3) -> DataFrame:
    """Every closing over the whole history: closed_run_seq, and reopened_run_seq of the sighting that ends it.

    The same as closing after each succeeded run, without a loop: after sighting s
    a posting closes at the succeeded run of rank max(n, L + n, A), where L is the
    rank of the last succeeded run that saw it and A that of the first succeeded
    run behind s, if there is such a run before the next sighting.
    """
    if n < 1:
        return sightings.select(*KEY).limit(0).selectExpr(*KEY, "cast(null as bigint) closed_run_seq", "cast(null as bigint) reopened_run_seq")
    by_run = Window.partitionBy("recording_id").orderBy("run_seq")
    ok = F.when(F.col("status") == "succeeded", 1).otherwise(0)
    ranked = runs.select("recording_id", "run_seq", "status", F.sum(ok).over(by_run).alias("upto"))
    succeeded = ranked.where("status = 'succeeded'").select("recording_id", F.col("upto").alias("rank"), F.col("run_seq").alias("closed_run_seq"))
    w = Window.partitionBy(*KEY).orderBy("run_seq")
    seen = sightings.select(*KEY, "run_seq").join(ranked, ["recording_id", "run_seq"])
    spans = seen.withColumns(
        {"last": F.coalesce(F.max(F.when(F.col("status") == "succeeded", F.col("upto"))).over(w), F.lit(0)), "reopened_run_seq": F.lead("run_seq").over(w)}
    ).withColumn("rank", F.greatest(F.lit(n), F.col("last") + n, F.col("upto") + 1))
    closed = spans.join(succeeded, ["recording_id", "rank"])
    return closed.where(F.col("reopened_run_seq").isNull() | (F.col("closed_run_seq") < F.col("reopened_run_seq"))).select(*KEY, F.col("closed_run_seq").cast("long"), F.col("reopened_run_seq").cast("long"))


# --- runs


def final_status(error: Column, item_errors: Column, jobs: Column) -> Column:
    """Status of a page run."""
    # Failures by which a run can't have done its job, whatever it read.
    always = error.isin("AUTH_EXPIRED", "ROBOTS_DISALLOWED", "TEMPLATE_ERROR")
    some = jobs > 0
    return (
        F.when(error == "RUN_CANCELLED", "cancelled").when(error == "BOT_WALL", "blocked")
        .when(error.isNotNull(), F.when(some & ~always, "partial").otherwise("failed"))
        .when(item_errors > 0, F.when(some, "partial").otherwise("failed")).otherwise("succeeded")
    )


def feed_status(error: Column, item_errors: Column, jobs: Column) -> Column:
    """Status of a feed run: an error never leaves it partial."""
    return (
        F.when(error == "RUN_CANCELLED", "cancelled").when(error == "BOT_WALL", "blocked").when(error.isNotNull(), "failed")
        .when(item_errors > 0, F.when(jobs > 0, "partial").otherwise("failed")).otherwise("succeeded")
    )


def status_reason(error: Column, item_errors: Column) -> Column:
    return F.coalesce(F.lower(error), F.when(item_errors > 0, "item_errors"))


def run_stats(flagged: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Per run: items_seen, item_errors, jobs, new_jobs, changed_jobs, of rows with is_new, is_changed, is_error."""
    return flagged.groupBy(*(run or ["run_id"])).agg(
        F.count("*").alias("items_seen"),
        F.count_if("is_error").alias("item_errors"),
        F.count_if(~F.col("is_error")).alias("jobs"),
        F.count_if(F.col("is_new") & ~F.col("is_error")).alias("new_jobs"),
        F.count_if(F.col("is_changed") & ~F.col("is_error")).alias("changed_jobs"),
    )


def has_active(runs: DataFrame) -> DataFrame:
    """Per board whether a run is queued or running."""
    return runs.groupBy("recording_id").agg(F.max(F.col("status").isin("queued", "running")).alias("active"))


def board_overview(recordings: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Boards with their number of open postings and their last run: two aggregates and two joins."""
    open_jobs = jobs.where("closed_at is null").groupBy("recording_id").agg(F.count("*").alias("open_jobs"))
    last = runs.groupBy("recording_id").agg(F.max_by(F.struct("run_id", "status"), "run_seq").alias("last"))
    return recordings.join(open_jobs, "recording_id", "left").join(last, "recording_id", "left").select(recordings["*"], F.coalesce("open_jobs", F.lit(0)).alias("open_jobs"), F.col("last.run_id").alias("last_run_id"), F.col("last.status").alias("last_status"))


def claimable_runs(runs: DataFrame, limit: int) -> DataFrame:
    """Queued runs to start next: oldest first, one per domain, none on a busy domain, limit with those that run.

    runs carry the domain of their board.
    """
    running = runs.where("status = 'running'")
    free = runs.where("status = 'queued'").join(running.select("domain"), "domain", "left_anti")
    w = Window.partitionBy("domain").orderBy("run_seq")
    # one row: how many may still start
    room = running.agg(F.greatest(F.lit(0), F.lit(limit) - F.count("*")).alias("room"))
    first = free.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").orderBy("run_seq").limit(limit)
    place = F.row_number().over(Window.orderBy("run_seq"))  # of limit rows at most
    return first.withColumn("__place", place).join(F.broadcast(room), F.col("__place") <= F.col("room")).drop("__place", "room")


def prune_artifacts(artifacts: DataFrame, runs: DataFrame, keep: int) -> DataFrame:
    """Artifacts of all but a board's newest runs; runs without artifacts count as well."""
    return artifacts.join(latest_runs(runs, keep).select("run_id"), "run_id", "left_anti")


def fail_interrupted(runs: DataFrame) -> DataFrame:
    """Runs that were running when the service stopped have failed."""
    running = F.col("status") == "running"
    return runs.withColumns({"reason": F.when(running, "interrupted").otherwise(F.col("reason")), "status": F.when(running, "failed").otherwise(F.col("status"))})


def cancel_queued(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("status") == "queued", "cancelled").otherwise(F.col("status")))


def cascade_delete(recording_ids: DataFrame, tables: dict[str, DataFrame], runs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows of some boards (by recording_id, or by run_id), and the run ids that went."""
    gone = runs.join(recording_ids, "recording_id", "left_semi").select("run_id")
    left = {name: t.join(recording_ids, "recording_id", "left_anti") if "recording_id" in t.columns else t.join(gone, "run_id", "left_anti") for name, t in tables.items()}
    return left, gone


def list_runs(runs: DataFrame, recording: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    some = runs if recording is None else runs.where(F.col("recording_id") == recording)
    some = some if status is None else some.where(F.col("status") == status)
    return some.orderBy(F.desc("run_seq")).limit(limit)
