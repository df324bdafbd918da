"""Queries of tracking, runs, logs and paging, on events, lineitem, orders and customer."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clicks, events, normalize, paging, search, track
from tidemark.registry.common import registry
from tidemark.shared import shared_dir
from tidemark.sources import sinks

QUERIES: dict = {}
query = registry(QUERIES)

# --- events as sightings: a board is a fifth hundredth of users, a run is a day

_EV = """ev as (select event_id, ts, user_id, event_type, value, 'rec_' || (user_id % 20) as recording_id, 'k' || json_extract_string(props, '$.k') as dedup_key, cast(day(ts) as bigint) as run_seq,
 'rec_' || (user_id % 20) || '_' || day(ts) as run_id, sha256(cast(cast(round(value / 50) as bigint) as varchar)) as content_hash from events)"""
_S = f"with {_EV}, s as (select * from ev qualify row_number() over (partition by recording_id, run_seq, dedup_key order by event_id) = 1), " + (
    "runs as (select distinct recording_id, run_seq, run_id, case when run_seq % 7 = 0 then 'failed' when run_seq % 5 = 0 then 'partial' else 'succeeded' end as status from ev) "
)


def _events(read):
    e = read("events")
    board = F.concat(F.lit("rec_"), (F.col("user_id") % 20).cast("string"))
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", board.alias("recording_id"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dedup_key"), F.dayofmonth("ts").cast("long").alias("run_seq"),
        F.concat(board, F.lit("_"), F.dayofmonth("ts").cast("string")).alias("run_id"), F.sha2(F.round(F.col("value") / 50).cast("long").cast("string"), 256).alias("content_hash"),
    )


def _sightings(read):
    return normalize.dedupe_in_run(_events(read), run=["recording_id", "run_seq"], order=["event_id"]).withColumn("job_id", track.job_id(F.col("recording_id"), F.col("dedup_key")))


def _runs(read):
    n = F.col("run_seq")
    status = F.when(n % 7 == 0, "failed").when(n % 5 == 0, "partial").otherwise("succeeded")
    return _events(read).select("recording_id", "run_seq", "run_id").distinct().withColumns({"status": status, "finished_at": F.lit("2024-02-01").cast("timestamp")})


def _state(read, upto: int):
    """State after the runs up to a day, from the history."""
    flagged = track.flag_new_changed(_sightings(read).where(F.col("run_seq") <= upto).withColumn("seen_at", F.col("ts")))
    last = flagged.groupBy(*track.KEY).agg(F.max_by(F.struct("content_hash", "value", "seen_at", "first_seen_at", "first_seen_run_id"), "run_seq").alias("l"))
    return last.select(*track.KEY, "l.content_hash", "l.value", F.col("l.seen_at").alias("posted_at"), "l.first_seen_at", F.col("l.seen_at").alias("last_seen_at"), "l.first_seen_run_id", F.when(F.crc32("dedup_key") % 3 == 0, F.lit("2024-01-20").cast("timestamp")).alias("closed_at"))


_FLAGS = "select *, row_number() over w = 1 as is_new, row_number() over w > 1 and lag(content_hash) over w is distinct from content_hash as is_changed from s window w as (partition by recording_id, dedup_key order by run_seq)"


@query(_S + f"select recording_id, dedup_key, run_seq, is_new, is_changed, first_value(run_id) over (partition by recording_id, dedup_key order by run_seq) as first_seen_run_id from ({_FLAGS})")
def w2_new_and_changed(read):
    return track.flag_new_changed(_sightings(read)).select(*track.KEY, "run_seq", "is_new", "is_changed", "first_seen_run_id")


@query(_S + f"select run_id, count(*) as items_seen, count(*) filter (value > 90) as item_errors, count(*) filter (value <= 90) as jobs, count(*) filter (is_new and value <= 90) as new_jobs, count(*) filter (is_changed and value <= 90) as changed_jobs from ({_FLAGS}) group by run_id")
def a2_run_stats(read):
    return track.run_stats(track.flag_new_changed(_sightings(read)).withColumn("is_error", F.col("value") > 90))


_BEFORE = "before as (select recording_id, dedup_key, arg_max(content_hash, run_seq) as content_hash, arg_max(value, run_seq) as value, min(ts) as first_seen_at, max(run_seq) as last_run from s where run_seq <= 29 group by all)"


@query(_S + f""", {_BEFORE}, batch as (select * from s where run_seq >= 30) select coalesce(b.recording_id, x.recording_id) as recording_id, coalesce(b.dedup_key, x.dedup_key) as dedup_key,
 case when x.run_id is null then 'unseen' when b.content_hash is null then 'new' when b.content_hash <> x.content_hash then 'changed' else 'same' end as flag, case when x.run_id is not null and b.content_hash is distinct from x.content_hash then x.value else b.value end as value,
 coalesce(b.first_seen_at, x.ts) as first_seen_at, x.run_id is null and cast(substr(coalesce(b.dedup_key, x.dedup_key), 2) as int) % 4 = 0 as closed from before b full join batch x on b.recording_id = x.recording_id and b.dedup_key = x.dedup_key""")
def w3_merged_state(read):
    state = _state(read, 29).withColumn("closed_at", F.when(F.substring("dedup_key", 2, 9).cast("int") % 4 == 0, F.lit("2024-01-20").cast("timestamp")))
    batch = _sightings(read).where("run_seq >= 30").withColumns({"seen_at": F.col("ts"), "posted_at": F.col("ts")})
    return track.merge_job_state(state, batch).select(*track.KEY, "flag", "value", "first_seen_at", F.col("closed_at").isNotNull().alias("closed"))


# all days but the newest as the state, the newest as the batch
@query(_S + "select recording_id, dedup_key, arg_max(content_hash, run_seq) as content_hash, min(ts) as first_seen_at, max(ts) as last_seen_at, max(run_seq) = 30 as seen from s group by all")
def s12_upserted(read):
    state = _state(read, 29)
    batch = _sightings(read).where("run_seq >= 30").withColumns({"seen_at": F.col("ts"), "posted_at": F.col("ts")})
    after = sinks.upsert_jobs(state, batch)
    return after.select(*track.KEY, "content_hash", "first_seen_at", "last_seen_at", (F.dayofmonth("last_seen_at") == 30).alias("seen"))


_CLOSED = """, r as (select *, sum(case when status = 'succeeded' then 1 else 0 end) over (partition by recording_id order by run_seq) as upto from runs),
 x as (select s.recording_id, s.dedup_key, s.run_seq, lead(s.run_seq) over w as reopened, coalesce(max(case when r.status = 'succeeded' then r.upto end) over w, 0) as last_rank, r.upto from s join r using (recording_id, run_seq) window w as (partition by s.recording_id, s.dedup_key order by s.run_seq)),
 closings as (select x.recording_id, x.dedup_key, r.run_seq as closed_run_seq, x.reopened as reopened_run_seq from x join r on r.recording_id = x.recording_id and r.status = 'succeeded' and r.upto = greatest(3, x.last_rank + 3, x.upto + 1) where x.reopened is null or r.run_seq < x.reopened) """


@query(_S + _CLOSED + "select * from closings")
def w4_closed_intervals(read):
    return track.closed_intervals(_sightings(read), _runs(read))


_RECENT = ", recent as (select * from runs where status = 'succeeded' qualify row_number() over (partition by recording_id order by run_seq desc) <= 3) "


@query(_S + _RECENT + "select distinct recording_id, dedup_key from s where (recording_id, dedup_key) not in (select (recording_id, dedup_key) from s join recent using (recording_id, run_seq))")
def j3_close_missing(read):
    jobs = _sightings(read).select(*track.KEY).distinct().withColumn("closed_at", F.lit(None).cast("timestamp"))
    return track.close_missing(jobs, _sightings(read), _runs(read)).select(*track.KEY)


@query(_S + "select distinct recording_id, dedup_key from s where run_seq <= 10 and (recording_id, dedup_key) not in (select (recording_id, dedup_key) from s where run_seq > 10)")
def u2_unseen_keys(read):
    s = _sightings(read)
    return track.unseen_keys(s.where("run_seq <= 10").select(*track.KEY).distinct(), s.where("run_seq > 10"))


@query(_S + "select recording_id, run_id, status from runs where status in ('succeeded', 'partial') qualify row_number() over (partition by recording_id order by run_seq desc) <= 4")
def w1_latest_runs(read):
    return track.latest_runs(_runs(read), 4, ["succeeded", "partial"]).select("recording_id", "run_id", "status")


@query(_S + f"select f.recording_id, f.dedup_key from ({_FLAGS}) f where f.is_new and f.run_seq = (select max(r.run_seq) from runs r where r.recording_id = f.recording_id and r.run_seq < 21)")
def j2_new_in_latest_run(read):
    runs = _runs(read).withColumn("finished_at", F.when(F.col("run_seq") < 21, F.col("finished_at")))
    flagged = track.flag_new_changed(_sightings(read))
    jobs = flagged.select("job_id", *track.KEY).distinct()
    return track.new_in_latest_run(jobs, flagged, runs).select(*track.KEY)


@query(_S + f"select dedup_key, is_new, is_changed from ({_FLAGS}) where run_id = 'rec_3_9'")
def j1_jobs_for_run(read):
    flagged = track.flag_new_changed(_sightings(read)).select("run_id", "job_id", F.col("event_id").alias("item_idx"), "is_new", "is_changed")
    jobs = _sightings(read).select("job_id", "dedup_key").distinct()
    return track.jobs_for_run(flagged, jobs, "rec_3_9").select("dedup_key", "is_new", "is_changed")


@query(_S + """select coalesce(b.dedup_key, a.dedup_key) as dedup_key, coalesce(b.recording_id, a.recording_id) as recording_id, case when b.run_id is null then 'added' when a.run_id is null then 'gone' when a.content_hash = b.content_hash then 'same' else 'changed' end as change
from (select * from s where run_seq = 9) b full join (select * from s where run_seq = 10) a on a.recording_id = b.recording_id and a.dedup_key = b.dedup_key""")
def j12_diff_snapshots(read):
    s = _sightings(read)
    return track.diff_snapshots(s.where("run_seq = 9"), s.where("run_seq = 10"))


@query(_S + ", act as (select recording_id, max(run_seq) as m from runs group by 1) select recording_id, m % 2 = 0 as active from act")
def a8_has_active(read):
    last = F.max("run_seq").over(Window.partitionBy("recording_id"))
    runs = _runs(read).withColumn("status", F.when((F.col("run_seq") == last) & (F.col("run_seq") % 2 == 0), "running").otherwise(F.col("status")))
    return track.has_active(runs)


@query("""select o_orderkey, case when o_orderkey % 11 = 0 then 'cancelled' when o_orderkey % 11 = 1 then 'blocked' when o_orderkey % 11 = 2 then 'failed' when o_orderkey % 11 = 3 then (case when o_custkey % 4 > 0 then 'partial' else 'failed' end) when o_orderkey % 3 > 0 then (case when o_custkey % 4 > 0 then 'partial' else 'failed' end) else 'succeeded' end as page_status,
 case when o_orderkey % 11 = 0 then 'cancelled' when o_orderkey % 11 = 1 then 'blocked' when o_orderkey % 11 in (2, 3) then 'failed' when o_orderkey % 3 > 0 then (case when o_custkey % 4 > 0 then 'partial' else 'failed' end) else 'succeeded' end as feed_status,
 case o_orderkey % 11 when 0 then 'run_cancelled' when 1 then 'bot_wall' when 2 then 'auth_expired' when 3 then 'navigation_failed' else case when o_orderkey % 3 > 0 then 'item_errors' end end as reason from orders""")
def a3_final_statuses(read):
    k = F.col("o_orderkey")
    code = F.try_element_at(F.array(*map(F.lit, ["RUN_CANCELLED", "BOT_WALL", "AUTH_EXPIRED", "NAVIGATION_FAILED"])), (k % 11 + 1).cast("int"))
    bad, jobs = k % 3, F.col("o_custkey") % 4
    return read("orders").select("o_orderkey", track.final_status(code, bad, jobs).alias("page_status"), track.feed_status(code, bad, jobs).alias("feed_status"), track.status_reason(code, bad).alias("reason"))


# --- customers as boards, orders as runs


def _boards(read):
    return read("customer").select(F.col("c_custkey").alias("recording_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 500).cast("string").alias("domain"))


def _order_runs(read):
    o = read("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("run_seq"), F.col("o_custkey").alias("recording_id"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderkey") % 3 == 0, "queued").otherwise("succeeded").alias("status"))
    return o.join(_boards(read).select("recording_id", "domain"), "recording_id")


_ORDERS = "with r as (select o_orderkey as run_seq, o_custkey as recording_id, case when o_orderstatus = 'P' then 'running' when o_orderkey % 3 = 0 then 'queued' else 'succeeded' end as status, cast(c_custkey % 500 as varchar) as domain from orders join customer on c_custkey = o_custkey) "


@query("""select c_custkey as recording_id, coalesce(n, 0) as open_jobs, last_run_id, last_status from customer left join (select o_custkey, count(*) filter (o_orderkey % 2 = 0) as n, max(o_orderkey) as last_run_id,
 arg_max(case when o_orderstatus = 'P' then 'running' when o_orderkey % 3 = 0 then 'queued' else 'succeeded' end, o_orderkey) as last_status from orders group by 1) on c_custkey = o_custkey""")
def j5_board_overview(read):
    jobs = read("orders").select(F.col("o_custkey").alias("recording_id"), F.when(F.col("o_orderkey") % 2 == 1, F.lit("2024-01-01")).alias("closed_at"))
    return track.board_overview(_boards(read), jobs, _order_runs(read)).select("recording_id", "open_jobs", "last_run_id", "last_status")


# a board's run is running while its newest order is one that is still being worked on
@query("""with r as (select o_orderkey as run_seq, cast(c_custkey % 500 as varchar) as domain, case when o_orderstatus = 'P' and o_orderkey = max(o_orderkey) over (partition by o_custkey) then 'running' when o_orderkey % 3 = 0 then 'queued' else 'succeeded' end as status from orders join customer on c_custkey = o_custkey)
 select min(run_seq) as run_seq from r where status = 'queued' and domain not in (select domain from r where status = 'running') group by domain order by 1 limit 30""")
def j6_claimable_runs(read):
    newest = F.max("run_seq").over(Window.partitionBy("recording_id"))
    status = F.when((F.col("status") == "running") & (F.col("run_seq") < newest), F.when(F.col("run_seq") % 3 == 0, "queued").otherwise("succeeded")).otherwise(F.col("status"))
    runs = _order_runs(read).withColumn("status", status)
    # room for all that are running and for 30 more
    return track.claimable_runs(runs, 30 + runs.where("status = 'running'").count()).select("run_seq")


@query(_ORDERS + "select distinct run_seq as run_id from r where run_seq % 2 = 0 and run_seq not in (select run_seq from r qualify row_number() over (partition by recording_id order by run_seq desc) <= 3)")
def j4_prunable_runs(read):
    artifacts = read("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("trace").alias("type"))
    return track.prune_artifacts(artifacts, _order_runs(read), 3).select("run_id").distinct()


@query(_ORDERS + "select run_seq, status from r where status = 'queued' order by run_seq desc limit 50")
def o2_list_runs(read):
    return track.list_runs(_order_runs(read), status="queued").select("run_seq", "status")


@query("select c_custkey as recording_id, c_name as name from customer")
def o3_list_recordings(read):
    return search.list_recordings(_boards(read)).select("recording_id", "name")


@query(_ORDERS + "select status, count(*) as runs, count(*) filter (reason = 'interrupted') as interrupted from (select case status when 'running' then 'failed' when 'queued' then 'cancelled' else status end as status, case when status = 'running' then 'interrupted' end as reason from r) group by 1")
def k6_interrupted_and_cancelled(read):
    runs = track.cancel_queued(track.fail_interrupted(_order_runs(read).withColumn("reason", F.lit(None).cast("string"))))
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.count_if(F.col("reason") == "interrupted").alias("interrupted"))


@query("select 'runs' as name, count(*) as n from orders where o_custkey % 10 <> 0 union all select 'artifacts', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 10 = 0) union all select 'gone', count(*) from orders where o_custkey % 10 = 0")
def u4_cascade_delete(read):
    runs = _order_runs(read)
    gone = _boards(read).where("recording_id % 10 = 0").select("recording_id")
    left, ids = track.cascade_delete(gone, {"runs": runs, "artifacts": read("lineitem").select(F.col("l_orderkey").alias("run_id"))}, runs)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n(left["runs"], "runs").unionByName(n(left["artifacts"], "artifacts")).unionByName(n(ids, "gone"))


# --- events as a run log: a run is a user's day, a step is the kind of event

_LOG = "with log as (select event_id, user_id || '_' || day(ts) as run_id, case when event_type <> 'view' then event_type end as step_id, case event_type when 'error' then 'error' when 'signup' then 'warn' else 'info' end as level, case when event_type = 'click' then 'step_start' else 'note' end as type, 'm' || event_id as message from events) "


def _log(read):
    kind = F.col("event_type")
    return read("events").select(
        "event_id", "ts", F.concat(F.col("user_id").cast("string"), F.lit("_"), F.dayofmonth("ts").cast("string")).alias("run_id"), F.when(kind != "view", kind).alias("step_id"),
        F.when(kind == "error", "error").when(kind == "signup", "warn").otherwise("info").alias("level"), F.when(kind == "click", "step_start").otherwise("note").alias("type"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"),
    )


@query(_LOG + """select *, cast(row_number() over (partition by run_id order by f) as integer) as place from (select run_id, step_id, count(*) filter (type = 'step_start') as starts, coalesce(list(message order by event_id) filter (level = 'warn' and type <> 'step_start'), []) as warnings,
 coalesce(list(message order by event_id) filter (level = 'error' and type <> 'step_start'), []) as errors, min(event_id) as f from log where step_id is not null group by all)""".replace("select *,", "select run_id, step_id, starts, warnings, errors,"))
def a5_step_timeline(read):
    return events.step_timeline(_log(read))


@query(_LOG + "select event_id, cast(row_number() over (partition by run_id order by event_id) - 1 as integer) as position from log")
def w11_event_positions(read):
    return events.event_positions(_log(read)).select("event_id", "position")


@query("select 'rec_' || (user_id % 20) as recording_id, event_type as step_id, case when value > 50 then 'css' else 'text' end as used, count(*) as times from events where value > 25 group by all")
def a9_locator_drift(read):
    data = F.to_json(F.struct(F.struct(F.when(F.col("value") > 50, "css").otherwise("text").alias("kind")).alias("used")))
    log = _events(read).select("run_id", F.col("event_type").alias("step_id"), F.when(F.col("value") > 25, "locator_drift").otherwise("note").alias("type"), data.alias("data_json"))
    return events.locator_drift_report(log, _runs(read))


def _locator(kind: str, value):
    value = F.lit(value) if isinstance(value, str) else value
    none = F.lit(None).cast
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), none("string").alias("role"), none("string").alias("name"), none("boolean").alias("exact"), none("int").alias("level"))


def _suggested(read):
    n = F.col("event_id") % 3
    value = F.concat(F.lit("v"), n.cast("string"))
    said = F.to_json(F.struct(F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("stepId"), F.array(_locator("css", F.concat(F.lit("old"), (F.col("event_id") % 2).cast("string")))).alias("failed"), _locator("css", value).alias("locator")))
    return _events(read).select("event_id", "run_id", "recording_id", F.lit("locator_suggestion").alias("type"), said.alias("data_json"))


_SUGGESTED = f"with {_EV}, d as (select run_id, recording_id, event_type as step_id, event_id, event_id % 2 as old, event_id % 3 as new from ev where event_id % 10 <> 0 qualify row_number() over (partition by run_id, event_type, event_id % 2, event_id % 3 order by event_id) = 1) "


@query(_SUGGESTED + "select run_id, event_id, step_id, 'old' || old as failed, 'v' || new as value, 'unknown' as source from d")
def a7_distinct_suggestions(read):
    got = events.distinct_suggestions(_suggested(read))
    return got.select("run_id", "event_id", "step_id", F.col("failed")[0]["value"].alias("failed"), F.col("locator")["value"].alias("value"), "source")


def _board_suggestions(read):
    got = events.distinct_suggestions(_suggested(read)).join(_runs(read).select("run_id", "recording_id"), "run_id")
    return got.select("recording_id", "step_id", "failed", "locator").distinct()


def _targets(read):
    """A target of each step: the one that failed on clicks, the suggested one first on views, another one else."""
    steps = _events(read).select("recording_id", F.col("event_type").alias("step_id")).distinct()
    old, new = _locator("css", "old0"), _locator("css", "v1")
    return steps.withColumn("locators", F.when(F.col("step_id") == "click", F.array(old)).when(F.col("step_id") == "view", F.array(new, old)).otherwise(F.array(_locator("css", "other"))))


_STATES = "select distinct recording_id, step_id, old, new, case when step_id = 'click' and old = 0 then 'open' when step_id = 'view' and old = 0 and new = 1 then 'applied' else 'stale' end as state from d"


@query(_SUGGESTED + f"select recording_id, step_id, 'old' || old as failed, 'v' || new as value, state from ({_STATES})")
def j13_suggestion_states(read):
    got = events.suggestion_state(_board_suggestions(read), _targets(read))
    return got.select("recording_id", "step_id", F.col("failed")[0]["value"].alias("failed"), F.col("locator")["value"].alias("value"), "state")


@query(_SUGGESTED + f", o as (select recording_id, step_id, new from ({_STATES}) where state = 'open' and new = 2) select t.recording_id, t.step_id, case when o.new is not null then ['v2', 'old0'] when t.step_id = 'click' then ['old0'] when t.step_id = 'view' then ['v1', 'old0'] else ['other'] end as locators from (select distinct recording_id, event_type as step_id from ev) t left join o using (recording_id, step_id)")
def j14_applied_suggestions(read):
    judged = events.suggestion_state(_board_suggestions(read).where("locator.value = 'v2'"), _targets(read))
    return events.apply_suggestions(_targets(read), judged).select("recording_id", "step_id", F.transform("locators", lambda x: x["value"]).alias("locators"))


# --- lineitem as pages and items of a run

_ITEMS = "with li as (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as integer) as page_no from lineitem) "


def _pages(read):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read("lineitem").select(F.col("l_orderkey").alias("run_id"), F.row_number().over(w).alias("page_no"), (F.col("l_partkey") % 7).cast("string").alias("page_hash"), (F.col("l_suppkey") % 9).alias("items"), (F.col("l_quantity") < 48).alias("loaded"), (F.col("l_discount") < 0.09).alias("has_next"), (F.col("l_returnflag") == "R").alias("is_error"), F.col("l_partkey").alias("part"))


@query(_ITEMS + """, f as (select *, page_no > 1 and (not l_quantity < 48 or l_suppkey % 9 = 0 or row_number() over (partition by l_orderkey, l_partkey % 7 order by page_no) > 1) as ends from li) select run_id, count(*) as pages from (select l_orderkey as run_id, page_no, max(ends::int) over (partition by l_orderkey order by page_no) as stop from f) where stop = 0 and page_no <= 4 group by 1""")
def w6_url_pages(read):
    return paging.truncate_pagination(_pages(read), "urlPattern", 4).groupBy("run_id").agg(F.count("*").alias("pages"))


@query(_ITEMS + """, f as (select *, not l_discount < 0.09 or row_number() over (partition by l_orderkey, l_partkey % 7 order by page_no) > 1 as ends from li) select run_id, count(*) as pages from (select l_orderkey as run_id, page_no, coalesce(max(ends::int) over (partition by l_orderkey order by page_no rows between unbounded preceding and 1 preceding), 0) as stop from f) where stop = 0 and page_no <= 5 group by 1""")
def w6_next_button_pages(read):
    return paging.truncate_pagination(_pages(read), "nextButton", 5).groupBy("run_id").agg(F.count("*").alias("pages"))


@query(_ITEMS + """, f as (select l_orderkey as run_id, page_no, l_suppkey % 9 as items, coalesce(max(l_suppkey % 9) over (partition by l_orderkey order by page_no rows between unbounded preceding and 1 preceding), 0) as from_item from li) select run_id, page_no, from_item, items from (select *, max((items <= from_item)::int) over (partition by run_id order by page_no) as stop from f) where stop = 0""")
def w6_infinite_scroll(read):
    return paging.infinite_scroll(_pages(read)).select("run_id", "page_no", "from_item", "items")


@query(_ITEMS + """, a as (select l_orderkey as run_id, page_no, l_returnflag = 'R' as e, sum(case when l_returnflag = 'R' then 0 else 1 end) over (partition by l_orderkey order by page_no) as g from li), b as (select *, sum(e::int) over (partition by run_id, g order by page_no) as n from a)
 select run_id, count(*) as kept from (select *, coalesce(max((n >= 2)::int) over (partition by run_id order by page_no rows between unbounded preceding and 1 preceding), 0) as done from b) where done = 0 group by 1""")
def w7_cut_after_errors(read):
    return paging.cut_after_errors(_pages(read), 2, order=["page_no"]).groupBy("run_id").agg(F.count("*").alias("kept"))


@query(_ITEMS + "select l_orderkey as run_id, page_no, count(*) over (partition by l_orderkey) > 3 as limited from li qualify page_no <= 3")
def w8_cap_items(read):
    return normalize.cap_items(_pages(read), 3, order=["page_no"]).select("run_id", "page_no", "limited")


@query(_ITEMS + "select l_orderkey as run_id, page_no, case when page_no % 2 = 0 then 'detail' else 'list' end as title, 'page' as company, cast(l_partkey as varchar) as location from li")
def j7_list_and_detail(read):
    p = _pages(read)
    items = p.select("run_id", "page_no", F.create_map(F.lit("company"), F.lit("page"), F.lit("title"), F.lit("page")).alias("page_fields"), F.create_map(F.lit("title"), F.lit("list"), F.lit("location"), F.col("part").cast("string")).alias("fields"))
    details = p.where("page_no % 2 = 0").select("run_id", "page_no", F.create_map(F.lit("title"), F.lit("detail"), F.lit("location"), F.lit(None).cast("string")).alias("fields"))
    got = paging.merge_list_detail(items, details, ["run_id", "page_no"])
    f = F.col("fields")
    return got.select("run_id", "page_no", f["title"].alias("title"), f["company"].alias("company"), f["location"].alias("location"))


# --- events as captured actions

_KINDS = {"click": "click", "view": "scroll", "signup": "fill", "purchase": "press", "error": "navigate"}


def _actions(read):
    e = read("events")
    kinds = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))
    step = kinds[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("int").alias("idx"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.when(k == 99, "scopeEnd").otherwise("step").alias("kind"), step.alias("step_type"),
        F.when(step == "navigate", F.concat(F.lit("https://x.example/"), (k % 3).cast("string"))).alias("url"), F.when(step == "fill", k.cast("string")).alias("value"), F.when(k % 2 == 0, "Tab").otherwise("Enter").alias("key"), F.when(k % 5 == 0, "toBottom").otherwise("by").alias("mode"),
        F.when(step == "scroll", k.cast("double")).alias("amount"), F.concat(F.lit("e"), (k % 4).cast("string")).alias("element_key"), (k % 3 == 0).alias("has_target"), (k % 4 == 0).alias("interactive"), (k % 8 == 1).alias("mutated"), F.lit(False).alias("replaces_click"), F.lit(None).cast("long").alias("seq"),
        F.when(k % 10 == 0, "password").otherwise("text").alias("input_type"), F.when(k % 10 == 1, "cc-number").alias("autocomplete"), F.when(k % 10 == 2, "user_pin").otherwise("opinion").alias("field_name"), F.lit(None).cast("string").alias("field_id"),
    )


def _navigations(read):
    n = F.unix_millis(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 2 == 0, 3000).otherwise(20_000)
    return read("events").where("event_id % 5 = 0").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("https://x.example/n"), F.col("event_id").cast("string")).alias("url"), n.alias("at"), F.lit(None).cast("long").alias("seq"))


@query("""with a as (select cast(user_id as varchar) as session_id, event_id as idx, epoch_ms(ts) as t, case when json_extract_string(props, '$.k') = '99' then 'reset' when event_type = 'error' then 'typed' else 'act' end as what from events),
 n as (select cast(user_id as varchar) as session_id, 'https://x.example/n' || event_id as url, epoch_ms(ts) + case when event_id % 2 = 0 then 3000 else 20000 end as t from events where event_id % 5 = 0),
 j as (select n.session_id, n.url, n.t, a.what, a.idx, a.t as cause_t from n join a on a.session_id = n.session_id and a.t <= n.t + case when a.what = 'typed' then 0 else 5 end qualify row_number() over (partition by n.url order by a.t desc, a.idx desc) = 1)
 select session_id, cast(idx as integer) as idx, arg_max(url, t) as url from j where what = 'act' and t - cause_t <= 10000 group by all""")
def j11_attributed_navigations(read):
    return clicks.attribute_navigations(_actions(read), _navigations(read))


# a session's month in ten minutes, so that clicks open pages and rows meet; every other address replaces the click before it
_SPED = 7200


@query(f"""with e as (select cast(user_id as varchar) as s, event_id as idx, epoch_us(ts) // 1000 // {_SPED} as t, cast(json_extract_string(props, '$.k') as integer) as k, event_type from events),
 a as (select s, idx, t, case when k = 99 then 'scopeEnd' else 'step' end as kind, case event_type when 'click' then 'click' when 'view' then 'scroll' when 'signup' then 'fill' when 'purchase' then 'press' else 'navigate' end as step_type,
  case when event_type = 'error' then 'https://x.example/' || k % 3 end as url, case when event_type = 'signup' then cast(k as varchar) end as value, case when k % 5 = 0 then 'toBottom' else 'by' end as mode, case when event_type = 'view' then k::double end as amount, 'e' || k % 4 as element, k from e),
 n as (select s, idx as n, t + case when idx % 2 = 0 then 1 else 20000 end as t from e where idx % 5 = 0),
 caused as (select s, idx from (select n.s, a.idx, n.t, a.t as cause_t, a.kind = 'step' and a.step_type <> 'navigate' as act from n join a on a.s = n.s and a.t <= n.t + case when a.kind = 'step' and a.step_type = 'navigate' then 0 else 5 end
  qualify row_number() over (partition by n.n order by case when a.kind = 'step' and a.step_type = 'navigate' then a.t + 5 else a.t end desc, a.idx desc) = 1) where act and t - cause_t <= 10000 group by all),
 b as (select a.*, c.idx is not null as went, lead(kind) over o = 'step' and lead(k) over o % 3 = 0 as targeted from a left join caused c on c.s = a.s and c.idx = a.idx window o as (partition by a.s order by a.t, a.idx)),
 r as (select *, kind = 'step' and step_type = 'click' as click, kind = 'step' and step_type = 'fill' as fill, kind = 'step' and step_type = 'navigate' as address, kind = 'step' and step_type = 'scroll' as scroll from b
  where not (kind = 'step' and step_type = 'press' and k % 2 = 0 and coalesce(targeted, false)) and not (kind = 'step' and step_type = 'click' and k % 4 <> 0 and k % 8 <> 1 and not went)),
 w as (select *, coalesce(address and lag(click) over o and k % 2 = 1 and t - lag(t) over o <= 5000, false) as opens,
  coalesce((click and lead(address) over o and lead(k) over o % 2 = 1 and lead(t) over o - t <= 5000) or ((click or fill) and lead(fill) over o and lead(element) over o = element and not went), false) as goes,
  coalesce(scroll and lag(scroll) over o and lag(element) over o = element, false) as same, lag(address) over o as a1, lag(url) over o as u1, lag(address, 2) over o as a2, lag(url, 2) over o as u2 from r window o as (partition by s order by t, idx)),
 x as (select *, sum(case when same then 0 else 1 end) over (partition by s order by t, idx) as run from w)
 select s as session_id, cast(arg_min(idx, (t, idx)) as integer) as idx, max(t) as at, any_value(step_type) as step_type, arg_min(value, (t, idx)) as value, case when count(*) = 1 then any_value(amount) when not bool_or(mode = 'toBottom') then sum(amount) end as amount,
  case when bool_or(mode = 'toBottom') then 'toBottom' else 'by' end as mode
 from x where not goes and not coalesce(address and case when opens then a2 and u2 = url else a1 and u1 = url end, false) group by s, run""")
def w9_coalesced_actions(read):
    sped = lambda df: df.withColumn("at", F.floor(F.col("at") / _SPED))
    actions = sped(_actions(read)).withColumn("replaces_click", F.col("element_key").isin("e1", "e3"))
    navigations = sped(read("events").where("event_id % 5 = 0").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("https://x.example/n"), F.col("event_id").cast("string")).alias("url"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(None).cast("long").alias("seq"), "event_id"))
    navigations = navigations.withColumn("at", F.col("at") + F.when(F.col("event_id") % 2 == 0, 1).otherwise(20_000)).drop("event_id")
    return clicks.coalesce_actions(actions, navigations).select("session_id", "idx", "at", "step_type", "value", "amount", "mode")


@query("""with a as (select user_id, event_id, ts, cast(json_extract_string(props, '$.k') as integer) as k, event_type from events) select event_id as idx, case when event_type = 'signup' and not ever then cast(k as varchar) end as value
from (select *, max(k % 10 in (0, 1, 2)) over (partition by user_id, k % 4 order by epoch_ms(ts), event_id) as ever from a)""")
def c31_redacted(read):
    return clicks.redact_sensitive(_actions(read)).select(F.col("idx").cast("long").alias("idx"), "value")


# --- sinks and streams: written with the operator, read again


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


@query(_LOG + "select event_id, run_id, level, type from log")
def s11_event_log(read):
    log = _log(read)
    path = _folder(log.sparkSession)
    sinks.append_events(log.where("event_id % 2 = 0"), path)
    sinks.append_events(log.where("event_id % 2 = 1"), path)
    return sinks.read_events(log.sparkSession.read.parquet(path)).select("event_id", "run_id", "level", "type")


@query(_LOG + "select run_id, step_id, count(*) filter (type = 'step_start') as starts, count(*) filter (level = 'warn' and type <> 'step_start') as warnings, count(*) filter (level = 'error' and type <> 'step_start') as errors from log where step_id is not null group by all")
def t5_streamed_timeline(read):
    from tidemark.streaming import streams

    log = _log(read)
    spark, path = log.sparkSession, _folder(log.sparkSession)
    for odd in (0, 1):  # two batches
        log.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(f"{path}/log")
        source = spark.readStream.schema(log.schema).parquet(f"{path}/log")
        timeline = streams.stream_timeline(source).writeStream.outputMode("complete").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}"))
        timeline.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    # each batch holds the whole result so far
    batches = spark.read.parquet(f"{path}/out")
    return batches.join(F.broadcast(batches.agg(F.max("batch").alias("batch"))), "batch").select("run_id", "step_id", "starts", "warnings", "errors")


@query(_LOG + "select event_id, run_id from log where event_id > 500")
def t1_streamed_log(read):
    from tidemark.streaming import streams

    log = _log(read)
    spark, path = log.sparkSession, _folder(log.sparkSession)
    log.write.parquet(f"{path}/log")
    source = streams.stream_run_log(spark.readStream.schema(log.schema).parquet(f"{path}/log"), after=500)
    source.select("event_id", "run_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, run_id string").parquet(f"{path}/out")


@query(_S + "select run_id, dedup_key from s")
def t3_streamed_dedupe(read):
    from tidemark.streaming import streams

    rows = _events(read).withColumn("arrived_at", F.col("ts").cast("timestamp"))
    spark, path = rows.sparkSession, _folder(rows.sparkSession)
    rows.write.parquet(f"{path}/rows")
    source = streams.stream_dedupe(spark.readStream.schema(rows.schema).parquet(f"{path}/rows"), "40 days")
    source.select("run_id", "dedup_key").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run_id string, dedup_key string").parquet(f"{path}/out")


_EMPTY = "recording_id string, dedup_key string, content_hash string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, first_seen_run_id string, closed_at timestamp"


def _streamed(read, closed: bool):
    """Sightings of all days as a stream of three batches; with closed, the finished runs up to each close what they missed."""
    from tidemark.streaming import streams

    seen = _sightings(read).select(*track.KEY, "run_id", "run_seq", "content_hash", F.col("ts").alias("posted_at"), F.col("ts").alias("seen_at"))
    spark, path = seen.sparkSession, _folder(seen.sparkSession)
    table = streams.StateTable(spark, f"{path}/table", spark.createDataFrame([], _EMPTY), buckets=8)
    runs = _runs(read)
    for low, high in ((0, 9), (9, 21), (21, 31)):
        seen.where((F.col("run_seq") > low) & (F.col("run_seq") <= high)).write.mode("append").parquet(f"{path}/seen")
        source = spark.readStream.schema(seen.schema).parquet(f"{path}/seen")
        streams.stream_track_jobs(source, table, f"{path}/tracked").awaitTermination()
        if closed:
            past = F.col("run_seq") <= high
            last = runs.where(past).groupBy("recording_id").agg(F.max_by("status", "run_seq").alias("status"), F.lit(f"2024-03-{high:02d}").cast("timestamp").alias("finished_at"))
            last.write.mode("append").parquet(f"{path}/finished")
            finished = spark.readStream.schema(last.schema).parquet(f"{path}/finished")
            streams.stream_close(finished, table, seen.where(past), runs.where(past), f"{path}/closed", n=3).awaitTermination()
    return table.read()


@query(_S + "select recording_id, dedup_key, arg_max(content_hash, run_seq) as content_hash, min(run_seq) as first_day, max(run_seq) as last_day from s group by all")
def t2_streamed_tracking(read):
    return _streamed(read, closed=False).select(*track.KEY, "content_hash", F.dayofmonth("first_seen_at").cast("long").alias("first_day"), F.dayofmonth("last_seen_at").cast("long").alias("last_day"))


# a look counts if the board's newest run succeeded; closed at the first that finds a posting in none of its three newest runs that did, if it isn't seen after that
@query(_S + """, looks as (select unnest([9, 21, 31]) as look), fine as (select recording_id, look from runs, looks where run_seq <= look group by all having arg_max(status, run_seq) = 'succeeded'),
 newest as (select recording_id, look, run_seq, count(*) over (partition by recording_id, look) as n from (select runs.*, look from runs join fine using (recording_id) where status = 'succeeded' and run_seq <= look qualify row_number() over (partition by recording_id, look order by run_seq desc) <= 3)),
 last as (select recording_id, dedup_key, max(run_seq) as last_day from s group by all),
 shut as (select l.recording_id, l.dedup_key, min(f.look) as look from last l join (select distinct recording_id, look from newest where n = 3) f on f.recording_id = l.recording_id and l.last_day <= f.look
  where not exists (select 1 from s join newest n using (recording_id, run_seq) where s.recording_id = l.recording_id and s.dedup_key = l.dedup_key and n.look = f.look) group by all)
 select recording_id, dedup_key, timestamp '2024-03-01' + to_days(cast(look as integer) - 1) as closed_at from last left join shut using (recording_id, dedup_key)""")
def t4_streamed_closing(read):
    return _streamed(read, closed=True).select(*track.KEY, "closed_at")
