"""Operators on small tables with known results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import clicks, events, extract, normalize, paging, search, track
from tidemark.plans import definitions, politeness, schedules
from tidemark.sources import feeds, sinks
from tidemark.streaming import streams

T0 = dt.datetime(2026, 10, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


# --- normalization


def test_normalized_record(spark):
    fields = {"title": "\tData  Steward\n", "location": "Hybrid, Turin", "salaryText": "from £2,150 monthly", "url": "../role/77?ref=feed&lang=it", "postedAt": "yesterday", "team": " Maps", "grade": None, "description": " "}
    raw = spark.createDataFrame([("rec_1", "run", 1, 0, fields, "https://tern.example/boards/open?page=1"), ("rec_1", "run", 1, 1, {"title": "  ", "x": "y"}, "https://a.example")], "recording_id string, run_id string, run_seq long, item_idx int, fields map<string,string>, source_url string")
    now = F.lit("2026-10-06 15:30:00").cast("timestamp")
    (job,) = normalize.normalize_records(raw, now, F.lit("Tern Maps")).collect()
    assert (job.title, job.company, job.remote, job.dedup_key) == ("Data Steward", "Tern Maps", "hybrid", "https://tern.example/role/77?lang=it")
    assert (job.salary_min, job.salary_max, job.salary_currency, job.salary_period) == (2150, None, "GBP", "month")
    assert job.posted_at == dt.datetime(2026, 10, 5) and job.custom == {"team": "Maps", "grade": None} and job.description is None
    (left,) = normalize.untitled(raw).collect()
    assert (left.item_idx, left.field_names) == (1, ["title", "x"])


def test_keys_and_hashes(spark):
    rows = [("r", None, "A", None, "Rome"), ("r", None, "a", None, "ROME"), ("s", None, "A", None, "Rome")]
    df = spark.createDataFrame(rows, "r string, u string, t string, c string, l string")
    a, b, c = (r.k for r in df.select(normalize.dedup_key(*(F.col(x) for x in "rutcl")).alias("k")).collect())
    assert a == b != c and a.startswith("sha256:") and len(a) == 71
    hashes = spark.createDataFrame([("x", {"a": "1", "b": None}), ("x", {"b": None, "a": "1"}), ("x", {"a": "1"})], "title string, custom map<string,string>").select(normalize.content_hash(F.col("custom"), ["title"]).alias("h")).collect()
    assert hashes[0].h == hashes[1].h != hashes[2].h


def test_capped(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0)], "run_id string, item_idx int")
    assert sorted(tuple(r) for r in normalize.cap_items(df, 2).collect()) == [("a", 0, True), ("a", 1, True), ("b", 0, False)]


# --- tracking

STATE = "recording_id string, dedup_key string, content_hash string, title string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, first_seen_run_id string, closed_at timestamp"


def test_merge_reopens_and_keeps_content(spark):
    state = spark.createDataFrame([("r", "a", "h", "old", day(0), day(0), day(0), "1", day(1)), ("r", "b", "h", "old", day(0), day(0), day(0), "1", None), ("r", "c", "h", "old", None, day(0), day(0), "1", day(1))], STATE)
    batch = spark.createDataFrame([("r", "a", "h", "new", None, day(2), "2"), ("r", "b", "x", "new", None, day(2), "2"), ("r", "d", "h", "new", None, day(2), "2")], "recording_id string, dedup_key string, content_hash string, title string, posted_at timestamp, seen_at timestamp, run_id string")
    got = {r.dedup_key: r for r in track.merge_job_state(state, batch).collect()}
    assert {k: r.flag for k, r in got.items()} == {"a": "same", "b": "changed", "c": "unseen", "d": "new"}
    assert got["a"].title == "old" and got["a"].closed_at is None and got["a"].posted_at is None and got["a"].last_seen_at == day(2) and got["a"].first_seen_at == day(0)
    assert got["b"].title == "new" and got["b"].first_seen_run_id == "1" and got["c"].closed_at == day(1) and got["d"].first_seen_run_id == "2"


def replayed(runs, seen, n):
    """Closings run by run, as a tracker does it that has no history at hand."""
    closed, out, known = {}, [], set()
    for i, (seq, status) in enumerate(runs):
        for k in seen.get(seq, ()):
            known.add(k)
            if k in closed:
                out.append((k, closed.pop(k), seq))
        if status != "succeeded":
            continue
        good = [s for s, st in runs[: i + 1] if st == "succeeded"][-n:]
        if n < 1 or len(good) < n:
            continue
        recent = {k for s in good for k in seen.get(s, ())}
        for k in known - recent - set(closed):
            closed[k] = seq
    return sorted(out + [(k, s, None) for k, s in closed.items()], key=repr)


def test_closed_intervals_equal_replay(spark):
    rng = random.Random(4)
    for n in (1, 2, 3):
        runs = [(i, rng.choice(["succeeded", "succeeded", "partial", "failed"])) for i in range(1, 25)]
        seen = {i: {k for k in "abcdefgh" if rng.random() < 0.3} for i, _ in runs}
        sightings = spark.createDataFrame([("r", k, i) for i, ks in seen.items() for k in sorted(ks)], "recording_id string, dedup_key string, run_seq long")
        table = spark.createDataFrame([("r", i, s) for i, s in runs], "recording_id string, run_seq long, status string")
        got = sorted(((r.dedup_key, r.closed_run_seq, r.reopened_run_seq) for r in track.closed_intervals(sightings, table, n).collect()), key=repr)
        assert got == replayed(runs, seen, n)
    assert track.closed_intervals(sightings, table, 0).count() == 0


def test_close_missing_needs_enough_runs(spark):
    jobs = spark.createDataFrame([("r", "a", None), ("r", "b", None), ("r", "c", day(0))], "recording_id string, dedup_key string, closed_at timestamp")
    runs = spark.createDataFrame([("r", f"run{i}", i, "succeeded") for i in (1, 2, 3)] + [("r", "run4", 4, "partial")], "recording_id string, run_id string, run_seq long, status string")
    sightings = spark.createDataFrame([("r", "a", "run1"), ("r", "b", "run4")], "recording_id string, dedup_key string, run_id string")
    assert [r.dedup_key for r in track.close_missing(jobs, sightings, runs, 3).collect()] == ["b"]
    assert sorted(r.dedup_key for r in track.close_missing(jobs, sightings, runs, 2).collect()) == ["a", "b"]
    assert track.close_missing(jobs, sightings, runs, 4).count() == 0 and track.close_missing(jobs, sightings, runs, 0).count() == 0


def test_claimable(spark):
    runs = spark.createDataFrame([("a", 1, "running"), ("a", 2, "queued"), ("b", 4, "queued"), ("b", 3, "queued"), ("c", 5, "queued")], "domain string, run_seq long, status string")
    assert [r.run_seq for r in track.claimable_runs(runs, 3).collect()] == [3, 5]
    assert [r.run_seq for r in track.claimable_runs(runs, 2).collect()] == [3]
    assert track.claimable_runs(runs, 1).count() == 0


# --- search and export


def jobs_table(spark):
    rows = [(1, "Front-end Engineer", "Acme", "Zürich", "We use C++ and Go", None), (2, "Backend Engineer", "Beta", "Remote", "front of end", None), (3, "Ingénieur", "Acme", "Paris", "=cmd", day(2))]
    return spark.createDataFrame([(f"job_{i:08d}", i, "rec", *r, day(i)) for i, *r in rows], "job_id string, job_seq long, recording_id string, title string, company string, location string, description string, closed_at timestamp, first_seen_at timestamp")


def test_search(spark):
    jobs = jobs_table(spark)
    ids = lambda q: sorted(r.job_seq for r in search.search_jobs(jobs, q).collect())
    assert ids("engin") == [1, 2] and ids("INGENIEUR") == [3] and ids("zur eng") == [1]
    assert ids("front-end") == [1] and ids("front end") == [1, 2] and ids("acme front-en") == [1]
    assert ids("c++") == [1, 3] and ids("+++") == [] and ids("acme nothing") == []


def test_search_index_in_segments(spark, tmp_path):
    """The same hits as without an index, before and after refreshes, removals and merges; a refresh writes its own rows only."""
    jobs = jobs_table(spark)
    index = search.SearchIndex(spark, f"file://{tmp_path}/index")
    assert search.search_jobs(jobs, "engin", index=index).count() == 0
    index.refresh(jobs.withColumn("description", F.lit("an older text of zebras")))
    asked = ["engin", "INGENIEUR", "zur eng", "front-end", "front end", "acme front-en", "c++", "+++", "acme nothing", "zebra", "we-use-c", "e"]

    def agree(now):
        for q in asked:
            want = sorted(r.job_seq for r in search.search_jobs(now, q).collect())
            assert sorted(r.job_seq for r in search.search_jobs(jobs, q, index=index).collect()) == want, q

    agree(jobs.withColumn("description", F.lit("an older text of zebras")))
    index.refresh(jobs.where("job_seq < 3"))
    newest = spark.read.parquet(f"file://{tmp_path}/index/lists/{index.segments()[-1]}")
    assert {r.job_id[-1] for r in newest.select("job_id").distinct().collect()} == {"1", "2"} and newest.where("token = 'end'").count() == 2
    now = jobs.where("job_seq < 3").unionByName(jobs.where("job_seq = 3").withColumn("description", F.lit("an older text of zebras")))
    agree(now)
    index.merge()
    index.prune()
    assert len(index.segments()) == 1 and len(list((tmp_path / "index/lists").iterdir())) == 1
    agree(now)
    index.remove(jobs.where("job_seq = 2").select("job_id"))
    agree(now.where("job_seq <> 2"))
    index.refresh(jobs.where("job_seq = 2"))
    agree(now)


def test_refs(spark):
    jobs = jobs_table(spark)
    got = lambda ref: [(r.job_seq, r.status) for r in search.resolve_ref(jobs, ref, key="job_id", name="title").collect()]
    assert got("job_00000002") == [(2, "found")] and got("backend engineer") == [(2, "found")] and len(got("job_")) == 3 and got("job_")[0][1] == "ambiguous"
    assert got("job") == [] and got("job_%") == []


def test_export(spark, tmp_path):
    jobs = jobs_table(spark)
    full = jobs.withColumns({c: F.lit(None).cast("double" if c in ("salary_min", "salary_max") else "timestamp" if c in ("posted_at", "last_seen_at") else "string") for c in sinks.EXPORT_COLUMNS if c not in jobs.columns})
    sinks.write_jobs_csv(full.withColumn("salary_min", F.lit(85000.0)), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    lines = part.read_bytes().decode().split("\r\n")
    assert lines[0].startswith("title,company,location,remote,salaryText,salaryMin") and len(lines) == 5 and lines[-1] == ""
    assert lines[1].startswith("Ingénieur,Acme,Paris,,,85000,") and lines[1].endswith(",rec") and "2026-10-03T00:00:00.000Z" in lines[1]
    sinks.write_jobs_json(full, str(tmp_path / "json"), limit=2)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    path = sinks.write_snapshot(jobs, str(tmp_path / "state"), 3)
    assert spark.read.parquet(path).count() == 3


# --- feeds


def test_feed_quarantine(spark):
    body = '{"jobs": [{"id": 1, "title": "A", "location": {"name": "Rome"}}, {"id": 999, "location": {"name": "Nowhere"}}, "text", {"id": 2, "title": 5}], "meta": {}}'
    payloads = spark.createDataFrame([("r", "run", 1, "https://x.example", body), ("r2", "run2", 1, "https://x.example", "[]"), ("r3", "run3", 1, "https://x.example", "oops"), ("r4", "run4", 1, "https://x.example", None)], "recording_id string, run_id string, run_seq long, source_url string, body string")
    assert [(r.item_idx, r.fields["title"]) for r in feeds.read_feeds(payloads, "greenhouse").collect()] == [(0, "A")]
    assert sorted((r.item_idx, r.reason) for r in feeds.quarantined_entries(payloads, "greenhouse").collect())[:2] == [(1, "title: missing or empty"), (2, "not an object")]
    assert sorted(r.recording_id for r in feeds.feed_shape_errors(payloads, "greenhouse").collect()) == ["r2", "r3", "r4"]


# --- events and suggestions


def test_timeline(spark):
    rows = [(1, "s1", "info", "step_start", "a"), (2, "s2", "warn", "step_start", "b"), (3, "s1", "warn", "note", "w1"), (4, None, "error", "note", "x"), (5, "s1", "error", "note", "e1"), (6, "s1", "info", "step_start", "c")]
    df = spark.createDataFrame([("r", *r) for r in rows], "run_id string, event_id long, step_id string, level string, type string, message string")
    assert [tuple(r) for r in events.step_timeline(df).orderBy("place").collect()] == [("r", "s1", 2, ["w1"], ["e1"], 1), ("r", "s2", 1, [], [], 2)]
    assert [r.event_id for r in events.events_after(df, "r", 3).collect()] == [5, 6]


# --- clicks

ACTION = "session_id string, idx int, at long, kind string, step_type string, url string, value string, key string, mode string, amount double, element_key string, has_target boolean, interactive boolean, mutated boolean, replaces_click boolean, seq long"


def actions(spark, *rows):
    names = [c.split()[0] for c in ACTION.split(", ")]
    return spark.createDataFrame([tuple({"session_id": "s", "idx": i, "kind": "step", **r}.get(n) for n in names) for i, r in enumerate(rows)], ACTION)


def coalesced(spark, navs, *rows):
    navigations = spark.createDataFrame([("s", f"https://n/{t}", t, None) for t in navs], "session_id string, url string, at long, seq long")
    return clicks.coalesce_actions(actions(spark, *rows), navigations).orderBy("at", "idx").collect()


def test_coalesced_fills_and_scrolls(spark):
    got = coalesced(spark, [], {"at": 1, "step_type": "click", "element_key": "e"}, {"at": 2, "step_type": "fill", "element_key": "e", "value": "a"}, {"at": 3, "step_type": "fill", "element_key": "e", "value": "ab"}, {"at": 4, "step_type": "scroll", "mode": "by", "amount": 3.0}, {"at": 5, "step_type": "scroll", "mode": "by", "amount": 4.0}, {"at": 6, "step_type": "press", "key": "Tab"}, {"at": 7, "step_type": "fill", "element_key": "f", "value": "x", "has_target": True})
    assert [(r.step_type, r.value, r.amount) for r in got] == [("fill", "ab", None), ("scroll", None, 7.0), ("fill", "x", None)]


def test_coalesced_clicks_and_navigations(spark):
    got = coalesced(spark, [1500], {"at": 1000, "step_type": "click", "element_key": "a", "interactive": False, "mutated": False}, {"at": 9000, "step_type": "click", "element_key": "b", "interactive": False, "mutated": False}, {"at": 20000, "step_type": "click", "element_key": "c"}, {"at": 21000, "step_type": "navigate", "url": "u", "replaces_click": True}, {"at": 22000, "step_type": "navigate", "url": "u"})
    assert [(r.step_type, r.element_key) for r in got] == [("click", "a"), ("navigate", None)]


def test_navigation_causes(spark):
    acts = actions(spark, {"at": 1000, "step_type": "click"}, {"at": 2000, "step_type": "navigate", "url": "u"}, {"at": 5000, "step_type": "click"}, {"at": 6000, "kind": "scopeEnd"}, {"at": 30000, "step_type": "click"})
    navs = spark.createDataFrame([("s", f"n{t}", t, None) for t in (995, 2500, 5100, 6500, 29996, 41000)], "session_id string, url string, at long, seq long")
    assert sorted((r.idx, r.url) for r in clicks.attribute_navigations(acts, navs).collect()) == [(0, "n995"), (2, "n5100"), (4, "n29996")]


# --- paging, extraction


def test_infinite_scroll_and_merge(spark):
    rounds = spark.createDataFrame([("r", 1, 5), ("r", 2, 9), ("r", 3, 9), ("r", 4, 12)], "run_id string, page_no int, items int")
    assert [(r.page_no, r.from_item) for r in paging.infinite_scroll(rounds).orderBy("page_no").collect()] == [(1, 0), (2, 5)]


PAGE = """<main><ul class="jobs"><li data-testid="job"><h2><a href="/1">One &amp; only</a></h2><span class="loc">Rome</span></li>
<li data-testid="job"><h2><a href="/2">Two</a></h2><p class="loc old">Oslo</p><p class="loc">x</p></li><li data-testid="job"></li></ul></main>"""


def test_extract(spark):
    spec = {"list": [{"kind": "css", "value": ".none"}, {"kind": "testId", "value": "job"}], "fields": [{"name": "title", "locators": [{"kind": "role", "role": "heading", "level": 2}], "required": True}, {"name": "url", "locators": [{"kind": "xpath", "value": ".//h2[1]/a"}], "read": "attr:href"}, {"name": "location", "locators": [{"kind": "css", "value": "li > .loc"}, {"kind": "css", "value": "p.old"}]}]}
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = extract.extract_records(pages, spec).orderBy("item_idx").collect()
    assert [(r.fields["title"], r.fields["url"], r.fields["location"], r.item_error) for r in rows] == [("One & only", "/1", "Rome", None), ("Two", "/2", "Oslo", None), (None, None, None, "empty: title")]
    assert [[(d.field, d.used) for d in r.drift] for r in rows] == [[], [("location", 1)], []]


# --- plans


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 3\n\nUser-agent: special\nDisallow: /\n"
    robots = spark.createDataFrame([("https://a.example", 200, body), ("https://b.example", 404, None), ("https://c.example", 500, None), ("https://d.example:8080", None, None)], "origin string, status int, body string")
    asked = ["https://a.example/x", "https://a.example/private/1", "https://a.example/private/open/1", "https://a.example/f.pdf", "https://a.example/f.pdf?x", "https://b.example/", "https://c.example/", "https://d.example:8080/", "mailto:x", "https://e.example/"]
    urls = spark.createDataFrame([(u,) for u in asked], "url string")
    got = {r.url: r for r in politeness.robots_verdict(urls, robots, "tidemark/1").collect()}
    assert [got[u].allowed for u in asked] == [True, False, True, False, True, True, False, False, True, True]
    assert got[asked[0]].crawl_delay_ms == 3000 and "disallows /private/1" in got[asked[1]].reason and "could not be retrieved" in got[asked[6]].reason
    assert not any(r.allowed for r in politeness.robots_verdict(urls.where("url like '%a.example%'"), robots, "Special/2").collect())


def test_robots_rules_equal_regular_expressions(spark):
    """Random rules with stars and ends against a pattern for each; many rules of one origin make no rows of URLs by rules."""
    import re

    deal = random.Random(6)
    word = lambda: "".join(deal.choice("ab/") for _ in range(deal.randrange(4)))
    rules = [(deal.choice([True, False]), "/" + deal.choice(["", "*"]).join([word(), word(), word()]) + deal.choice(["", "", "$", "*", "*$", "$a"])) for _ in range(60)]
    targets = ["/" + word() + word() + deal.choice(["", "?a", "$a"]) for _ in range(200)]
    body = "User-agent: *\n" + "\n".join(f"{'Allow' if allow else 'Disallow'}: {value}" for allow, value in rules)
    robots = spark.createDataFrame([("https://a.example", 200, body)], "origin string, status int, body string")
    urls = spark.createDataFrame([(f"https://a.example{t}",) for t in targets], "url string")
    got = {r.url: r.allowed for r in politeness.robots_verdict(urls, robots, "tidemark/1").collect()}
    for t in targets:
        fits = []
        for allow, value in rules:
            pattern = "^" + ".*".join(re.escape(p) for p in value.removesuffix("$").split("*")) + ("$" if value.endswith("$") else "")
            if re.search(pattern, t):
                fits.append((len(value), allow))
        assert got[f"https://a.example{t}"] == (max(fits)[1] if fits else True), t


def test_schedule_rules(spark):
    rows = [("day or week", "0 0 13 * 5", None), ("skipped", "30 2 31 3 *", "Europe/Madrid"), ("bad", "0 25 * * *", None), ("short", "0 0 * *", None), ("often", "*/10 * * * *", None), ("never", "0 0 31 2 *", None), ("step", "0 9-17/4 * * mon-fri", "UTC")]
    df = spark.createDataFrame(rows, "schedule_id string, cron string, timezone string")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    got = {}
    for r in schedules.fire_times(df, now, days=45).collect():
        got.setdefault(r.schedule_id, []).append(r.fire_at)
    assert {d.day for d in got["day or week"] if d.month == 3} == {8, 13, 15, 22, 29} | {1} - {1}
    assert "skipped" not in got and "bad" not in got and [d.hour for d in sorted(got["step"])[:3]] == [9, 13, 17]
    errors = {r.schedule_id: r.error for r in schedules.validate_schedules(df, now).collect()}
    assert errors["bad"] == "invalid hour field" and errors["short"] == "not five fields" and "15 minutes" in errors["often"] and errors["never"] == "never fires" and errors["step"] is None


def test_as_many_fire_times_as_asked(spark):
    crons = {"sundays of march": "30 2 * 3 0", "last days of march": "30 2 25-31 3 *", "either": "30 2 31 3 0", "often": "*/5 * * * *", "rare": "0 0 29 2 *", "never": "0 0 30 2 *", "stepped": "0 0 31 4,6 */2"}
    df = spark.createDataFrame([(k, c, "Europe/Madrid") for k, c in crons.items()] + [("no zone", "0 0 * * *", "Nowhere/Land")], "schedule_id string, cron string, timezone string")
    got = {}
    for r in schedules.fire_times(df, dt.datetime(2024, 1, 1), most=25).orderBy("schedule_id", "n").collect():
        got.setdefault(r.schedule_id, []).append((r.n, r.fire_at))
    assert set(got) == set(crons) - {"never", "stepped"} and all([n for n, _ in v] == list(range(1, 26)) for v in got.values())
    for key, fires in got.items():
        times = [t for _, t in fires]
        assert times == sorted(set(times))
        if "2 " in crons[key][:5]:  # 01:30 in UTC in winter, never in the hour that is skipped
            assert all(t.minute == 30 and t.hour in (0, 1) for t in times)
    assert got["rare"][-1][1].year == 2024 + 4 * 25 - 4 + 4 - 1 or got["rare"][-1][1].year > 2115


def test_templates(spark):
    df = spark.createDataFrame([("a {{x}} {{ y }} {{x}}", {"x": "1", "y": "$2"}), ("{{z}}", {"x": "1"}), ("plain", {})], "t string, v map<string,string>")
    got = [(r.g.text, r.g.error) for r in df.select(definitions.render_template(F.col("t"), F.col("v")).alias("g")).collect()]
    assert got == [("a 1 $2 1", None), (None, "unknown parameter: z"), ("plain", None)]


# --- streams


def test_stream_close_and_track(spark, tmp_path):
    base = f"file://{tmp_path}"
    empty = spark.createDataFrame([], "recording_id string, dedup_key string, content_hash string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, first_seen_run_id string, closed_at timestamp")
    schema = "recording_id string, dedup_key string, run_id string, run_seq long, content_hash string, posted_at timestamp, seen_at timestamp"
    seen = spark.createDataFrame([("r", "a", "run1", 1, "h", None, day(1)), ("r", "b", "run1", 1, "h", None, day(1)), ("r", "b", "run2", 2, "x", None, day(2))], schema)
    seen.coalesce(1).write.parquet(f"{base}/seen")
    table = streams.StateTable(spark, f"{base}/table", empty)
    streams.stream_track_jobs(spark.readStream.schema(schema).parquet(f"{base}/seen"), table, f"{base}/c1").awaitTermination()
    assert {(r.dedup_key, r.content_hash, r.closed_at) for r in table.read().collect()} == {("a", "h", None), ("b", "x", None)}
    runs = spark.createDataFrame([("r", "run1", 1, "succeeded"), ("r", "run2", 2, "succeeded")], "recording_id string, run_id string, run_seq long, status string")
    done = "recording_id string, status string, finished_at timestamp"
    spark.createDataFrame([("r", "succeeded", day(3))], done).write.parquet(f"{base}/done")
    streams.stream_close(spark.readStream.schema(done).parquet(f"{base}/done"), table, seen, runs, f"{base}/c2", n=1).awaitTermination()
    assert {r.dedup_key: r.closed_at for r in table.read().collect()} == {"a": day(3), "b": None}


def test_a_runs_stream_ends_with_the_run(spark, tmp_path):
    """Stored events, new ones while it runs, the last ones before the end; resumed, nothing comes twice."""
    log = "run_id string, event_id long"
    write = lambda *ids: spark.createDataFrame([("r", i) for i in ids] + [("other", i) for i in ids], log).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    write(1, 2, 3)
    statuses, given = ["running", "running", "blocked"], []

    def runs():
        status = statuses.pop(0)
        df = spark.createDataFrame([("r", status), ("other", "failed")], "run_id string, status string")
        write(10 + len(statuses))  # logged after the run was looked up
        return df

    events_ = spark.readStream.schema(log).parquet(f"{tmp_path}/log")
    give = lambda batch, _: given.append(sorted(r.event_id for r in batch.collect()))
    end = streams.follow_run(events_, "r", runs, give, f"{tmp_path}/state", after=1, wait=0)
    assert end.status == "blocked" and [x for b in given for x in b] == [2, 3, 12, 11, 10]
    write(20)
    statuses.append("blocked")
    given.clear()
    streams.follow_run(events_, "r", runs, give, f"{tmp_path}/state", after=1, wait=0)
    assert [x for b in given for x in b] == [10, 20]


def test_state_table_after_a_crash_and_with_two_writers(spark, tmp_path):
    """A writer that died half-way leaves nothing in the way; of two writers of one version one fails and can be run again."""
    table = streams.StateTable(spark, f"file://{tmp_path}/table", spark.createDataFrame([], STATE), buckets=2)
    schema = "recording_id string, dedup_key string, run_id string, run_seq long, content_hash string, title string, posted_at timestamp, seen_at timestamp"
    batch = lambda n: spark.createDataFrame([("r", f"k{n}", f"run{n}", n, "x", "t", None, day(n))], schema)
    (tmp_path / "table/versions").mkdir(parents=True)
    (tmp_path / "table/versions/_half.json").write_text('{"version"')
    (tmp_path / "table/data/orphan/bucket=0").mkdir(parents=True)
    streams.track_batch(table, batch(1), 0)
    assert table.versions() == [1] and table.read().count() == 1

    def meanwhile(state):  # another writer is first while this one works
        streams.track_batch(streams.StateTable(spark, table.path, spark.createDataFrame([], STATE), buckets=2), batch(2), 1)
        return state

    try:
        table.update("other", 0, batch(3), meanwhile)
    except Exception as e:
        assert "version 2" in str(e)
    else:
        raise AssertionError("two writers of one version")
    assert {r.dedup_key for r in table.read().collect()} == {"k1", "k2"}
    table.update("other", 0, batch(3), lambda state: state)
    assert table.versions() == [1, 2, 3] and {r.dedup_key for r in table.read().collect()} == {"k1", "k2"}
    table.prune(keep=1)
    assert table.versions() == [3] and table.read().count() == 2 and not (tmp_path / "table/data/orphan").exists()


def test_tracker_and_closer_take_turns(spark, tmp_path):
    """Three rounds on one table, each batch run twice, with pruning, against the run-by-run merge."""
    base = f"file://{tmp_path}"
    table = streams.StateTable(spark, f"{base}/table", spark.createDataFrame([], STATE), buckets=4)
    schema = "recording_id string, dedup_key string, run_id string, run_seq long, content_hash string, title string, posted_at timestamp, seen_at timestamp"
    deal, rows = random.Random(2), []
    for n in range(1, 10):
        rows += [("r", f"k{k}", f"run{n}", n, deal.choice("xy"), f"t{n}", None, day(n)) for k in range(12) if deal.random() < 0.5]
    runs = spark.createDataFrame([("r", f"run{n}", n, "succeeded") for n in range(1, 10)], "recording_id string, run_id string, run_seq long, status string")
    all_seen, want = spark.createDataFrame(rows, schema), {}
    for turn in range(3):
        high = 3 * turn + 3
        batch = all_seen.where((F.col("run_seq") > high - 3) & (F.col("run_seq") <= high))
        past = F.col("run_seq") <= high
        done = spark.createDataFrame([("r", "succeeded", day(high))], "recording_id string, status string, finished_at timestamp")
        for _ in range(2):
            streams.track_batch(table, batch, turn)
        for _ in range(2):
            streams.close_batch(table, all_seen.where(past), runs.where(past), done, turn, n=2)
        for n in range(high - 2, high + 1):
            for _, key, run, _, content, title, posted, at in (r for r in rows if r[3] == n):
                old = want.get(key)
                same = old and old["content_hash"] == content
                want[key] = {"content_hash": content, "title": old["title"] if same else title, "first": old["first"] if old else at, "last": at, "run": old["run"] if old else run, "closed": None}
        for key, x in want.items():
            if x["closed"] is None and not any(r[1] == key and high - 2 < r[3] <= high for r in rows):
                x["closed"] = day(high)
        got = {r.dedup_key: {"content_hash": r.content_hash, "title": r.title, "first": r.first_seen_at, "last": r.last_seen_at, "run": r.first_seen_run_id, "closed": r.closed_at} for r in table.read().collect()}
        assert got == want
        table.prune(keep=2)
        assert len(table.versions()) == 2 and table.read().count() == len(want)
    assert any(x["closed"] for x in want.values())


def test_merging_many_runs_at_once(spark):
    deal = random.Random(7)
    state = spark.createDataFrame([("r", f"k{i}", "h0", "t0", None, day(0), day(0), "run0", day(1) if i % 3 else None) for i in range(10)], STATE)
    schema = "recording_id string, dedup_key string, run_id string, run_seq long, content_hash string, title string, posted_at timestamp, seen_at timestamp"
    rows = [("r", f"k{i}", f"run{n}", n, deal.choice(["h0", "h1"]), f"t{n}", day(n) if n % 2 else None, day(n)) for n in range(1, 6) for i in range(14) if deal.random() < 0.6]
    batch = spark.createDataFrame(rows, schema)
    one_by_one = state
    for n in range(1, 6):
        one_by_one = track.merge_job_state(one_by_one, batch.where(F.col("run_seq") == n)).drop("flag")
    assert sorted(map(tuple, track.merge_runs(state, batch).collect()), key=str) == sorted(map(tuple, one_by_one.select(state.columns).collect()), key=str)


def test_deep_steps(spark):
    """Twelve levels, odd values, and what is no definition."""
    import json

    step = {"id": "s12", "type": "click"}
    for i in range(11, 0, -1):
        step = {"id": f"s{i}", "type": "group", ["body", "steps", "detail"][i % 3]: [step, {"id": i, "type": None}]}
    texts = [("a", json.dumps({"steps": [step, "odd", {"id": "é"}]})), ("b", "{"), ("c", None), ("d", "[1]"), ("e", '{"steps": {"id": 1}}')]
    got = definitions.walk_steps(spark.createDataFrame(texts, "recording_id string, definition_json string")).collect()
    assert {r.recording_id for r in got} == {"a"} and max(r.depth for r in got) == 11
    assert [r.step_id for r in got if r.type == "group"] == [f"s{i}" for i in range(1, 12)]
    assert {r.step_id: r.parent_id for r in got}["s12"] == "s11" and {r.step_id: r.parent_id for r in got}["11"] == "s11"
    assert [(r.path, r.step_id, r.step_json) for r in got if r.depth == 0][1:] == [([1], None, "odd"), ([2], "é", '{"id":"é"}')]
    twice = [("x", json.dumps({"steps": [step, {"id": "s12", "type": "scroll", "mode": "by"}]}))]
    problems = {(r.step_id, r.problem) for r in definitions.lint_definitions(spark.createDataFrame(twice, "recording_id string, definition_json string")).collect()}
    assert problems == {("s12", "step id is used twice"), ("s12", "scroll by needs an amount")}


def test_rare_schedules(spark):
    rows = [("leap", "0 0 29 2 *"), ("leap sunday", "0 0 29 2 */7"), ("never", "0 0 30 2 *"), ("monthly", "5 4 31 * *")]
    df = spark.createDataFrame([(i, c, None) for i, c in rows], "schedule_id string, cron string, timezone string")
    got = {}
    for r in schedules.fire_times(df, F.lit("2024-03-01").cast("timestamp"), most=2).collect():
        got.setdefault(r.schedule_id, []).append(r.fire_at)
    assert sorted(got["leap"]) == [dt.datetime(2028, 2, 29), dt.datetime(2032, 2, 29)] and "never" not in got
    assert sorted(got["leap sunday"])[0] == dt.datetime(2032, 2, 29) and sorted(got["monthly"]) == [dt.datetime(2024, 3, 31, 4, 5), dt.datetime(2024, 5, 31, 4, 5)]


def test_selectors(spark):
    """Chains, places, attributes and nested elements; what isn't understood is an error."""
    html = "<div id=top><section class='a b'><p>one</p><p data-x='1'>two <b>bold</b></p></section><section class=b><div><p>three</p></div></section></div><br>tail"
    nodes = extract.with_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))

    def found(kind, value, **more):
        scope = F.element_at("nodes", 1)
        of = extract.page()
        return nodes.select(F.transform(extract.matches(of, scope, {"kind": kind, "value": value, **more}), lambda k: extract.text_of(of, extract.node_at(of, k)))).first()[0]

    assert found("css", "section.a > p") == ["one", "two bold"] and found("css", "#top p") == ["one", "two bold", "three"] and found("css", "section > p:nth-child(2)[data-x='1']") == ["two bold"]
    assert found("css", ".b div p") == ["three"] and found("css", "div > p") == ["three"] and found("css", "b p") == [] and found("css", "*[data-x]") == ["two bold"]
    assert found("xpath", "//section[2]//p") == ["three"] and found("xpath", "./div/section[1]/p[1]") == ["one"]
    assert found("text", "BOLD") == ["bold"] and found("text", "three", exact=True) == ["three"]
    for kind, value in (("css", "p:hover"), ("css", "a ~ b"), ("xpath", "//p[@x]"), ("odd", "x")):
        try:
            found(kind, value)
        except ValueError:
            continue
        raise AssertionError(value)
    deep = extract.with_nodes(spark.createDataFrame([(1, "<div>" * 3000 + "x")], "page_id long, html string")).select(F.size("nodes"), F.length("said")).first()
    assert tuple(deep) == (3001, 2)


def test_texts_inner_html_roles_and_names(spark):
    html = """<h1> Ünï <b>code</b>\n x</h1><label for=q>Find  it</label><input id=q type=search><input type=submit value=Go><label>Age <input type=number></label><p id=t>Titled</p><textarea aria-labelledby=t>own</textarea>
<summary>More</summary><a>no link</a><a href=/x aria-label='The link'>é</a><img alt=Pic><img><select multiple></select><div role='button extra'>Press</div>"""
    of = extract.page()
    rows = extract.with_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = rows.select(F.inline(F.transform("nodes", lambda n: F.struct(n["tag"].alias("tag"), extract.text_of(of, n).alias("text"), extract.inner_of(of, n).alias("inner"), extract.role_of(n).alias("role"), extract.name_of(of, n).alias("name"))))).collect()
    told = [(r.tag, r.role, r.name) for r in got if r.role]
    assert ("h1", "heading", "Ünï code x") in told and got[1].inner == " Ünï <b>code</b>\n x" and got[2].text == "code"
    assert [t for t in told if t[0] != "h1"] == [
        ("input", "searchbox", "Find it"), ("input", "button", "Go"), ("input", "spinbutton", "Age"), ("textarea", "textbox", "Titled"), ("summary", "button", "More"), ("a", "link", "The link"), ("img", "img", "Pic"), ("select", "listbox", ""), ("div", "button", "Press"),
    ]


def rewritten(rows):
    """A session by rules on neighbours, the leftmost pair first, until none fits."""
    step = lambda r, *kinds: r["kind"] == "step" and r["step_type"] in kinds
    idle = lambda r: step(r, "click") and r["interactive"] is False and r["mutated"] is False and not r["navigated"]
    tab = lambda r, n: step(r, "press") and r["key"] == "Tab" and n and n["kind"] == "step" and n["has_target"]
    left = [dict(r) for r, n in zip(rows, [*rows[1:], None]) if not idle(r) and not tab(r, n)]
    while True:
        for i, (a, b) in enumerate(zip(left, left[1:])):
            if step(a, "click", "fill") and step(b, "fill") and b["element_key"] and a["element_key"] == b["element_key"] and not a["navigated"]:
                left[i : i + 2] = [b]
            elif step(a, "click") and step(b, "navigate") and b["replaces_click"] and b["at"] - a["at"] <= 5000:
                left[i : i + 2] = [{**b, "replaces_click": False}]
            elif step(a, "navigate") and step(b, "navigate") and a["url"] == b["url"]:
                left[i : i + 2] = [a]
            elif step(a, "scroll") and step(b, "scroll") and a["element_key"] == b["element_key"]:
                bottom = "toBottom" in (a["mode"], b["mode"])
                left[i : i + 2] = [{**a, "at": b["at"], "mode": "toBottom" if bottom else a["mode"], "amount": None if bottom else (a["amount"] or 0) + (b["amount"] or 0)}]
            else:
                continue
            break
        else:
            return left


def test_coalesced_actions_equal_rewriting(spark):
    """Random sessions, one of half of all rows, in spans from a few rows to all of them."""
    deal = random.Random(4)
    rows, at = [], {}
    for idx in range(900):
        s = deal.choice(["hot", "hot", "hot", "a", "b", None])
        at[s] = at.get(s, 0) + deal.choice([0, 1, 900, 4000, 7000])
        rows.append({
            "session_id": s, "idx": idx, "at": at[s], "kind": deal.choice(["step"] * 9 + ["field", "scopeEnd"]), "step_type": deal.choice(["click", "fill", "navigate", "scroll", "scroll", "press", "hover"]), "url": deal.choice(["u", "v", None]), "value": str(idx), "key": deal.choice(["Tab", "Enter"]),
            "mode": deal.choice(["by", "by", "by", "toBottom"]), "amount": deal.choice([1.0, 2.5, None]), "element_key": deal.choice(["e", "f", "", None]), "has_target": deal.choice([True, False, None]), "interactive": deal.choice([True, False, False, None]), "mutated": deal.choice([True, False, False]),
            "replaces_click": deal.choice([True, False, None]), "seq": None,
        })
    names = [c.split()[0] for c in ACTION.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ACTION)
    navigations = spark.createDataFrame([(r["session_id"], f"n{r['idx']}", r["at"] + deal.choice([0, 3, 400]), None) for r in rows if r["session_id"] and deal.random() < 0.2], "session_id string, url string, at long, seq long")
    for span in (1500, 40_000, 10**9):
        caused = {(r.session_id, r.idx) for r in clicks.attribute_navigations(df, navigations, span).collect()}
        if span == 1500:
            first = caused
        assert caused == first and len(caused) > 20
        want = []
        for s in ("hot", "a", "b", None):
            own = sorted(({**r, "navigated": (s, r["idx"]) in caused} for r in rows if r["session_id"] == s), key=lambda r: (r["at"], r["idx"]))
            want += [(s, r["idx"], r["at"], r["amount"], r["mode"]) for r in rewritten(own)]
        got = [(r.session_id, r.idx, r.at, r.amount, r["mode"]) for r in clicks.coalesce_actions(df, navigations, span).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_no_task_has_a_whole_key(spark):
    """As-of joins of one key with half of all rows: windows over rows are by key and span, those by key alone over one row for each span."""
    from tidemark.operators import ordered

    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    got = ordered.carried(df, ["k"], ["t"], F.floor(F.col("t") / 100), F.col("v"), "last")
    want = {}
    for r in df.orderBy("t").collect():
        want[r.k] = r.v if r.v is not None else want.get(r.k)
        want[r.k, r.t] = want[r.k]
    assert all(want[r.k, r.t] == r["last"] for r in got.collect())
    near = ordered.neighbours(df.where("k = 'hot'"), ["k"], ["t"], F.floor(F.col("t") / 7), ["t"], 3, 2)
    for r in near.collect():
        assert [x.t for x in r.before] == [t for t in range(r.t - 6, r.t, 2) if t >= 0] and [x.t for x in r.after] == [t for t in range(r.t + 2, r.t + 5, 2) if t < 4000]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "windowspecdefinition(k#" in plan
