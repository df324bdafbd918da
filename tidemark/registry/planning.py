"""Queries of schedules, politeness and definitions, on customer, pages, events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import cron, text, urls
from tidemark.operators import search
from tidemark.plans import definitions, politeness, schedules, step_trees
from tidemark.registry.common import registry

QUERIES: dict = {}
query = registry(QUERIES)

NOW = "2024-03-05 10:30:00"


def _at(t: str):
    return F.lit(t).cast("timestamp")


# --- schedules: one for each customer, at an hour and on a day that its key gives


def _schedules(read):
    k = F.col("c_custkey")
    hour, day = (k % 24).cast("string"), (k % 7).cast("string")
    expression = (
        F.when(k % 6 == 0, F.concat(F.lit("0 "), hour, F.lit(" * * *"))).when(k % 6 == 1, F.concat(F.lit("30  "), hour, F.lit(" * * "), day)).when(k % 6 == 2, F.lit("*/5 * * * *"))
        .when(k % 6 == 3, F.concat(F.lit("15 "), hour, F.lit(" * * 1-5"))).when(k % 6 == 4, F.concat(F.lit("61 "), hour, F.lit(" * * *"))).otherwise(F.concat(F.lit("0 "), hour, F.lit(" "), (k % 28 + 1).cast("string"), F.lit(" * *")))
    )
    return read("customer").select(k.alias("schedule_id"), k.alias("schedule_seq"), (k % 100).alias("recording_id"), expression.alias("cron"), F.when(k % 10 == 3, "Nowhere/Land").alias("timezone"), (k % 4 != 0).alias("enabled"), F.lit(None).cast("timestamp").alias("last_run_at"), F.timestamp_seconds(F.lit(1_709_634_600) + (k % 21 - 10) * 60).alias("next_run_at"))


# fire times up to the fifth of each schedule, behind a moment; those of every five minutes within a day and a half
_FIRES = f"""with k as (select c_custkey as schedule_id, c_custkey % 24 as h, c_custkey % 6 as kind, c_custkey % 7 as dow, c_custkey % 28 + 1 as dom from customer where c_custkey % 6 <> 4 and c_custkey % 10 <> 3),
 days as (select unnest(generate_series(timestamp '2024-03-05', timestamp '2024-10-10', interval 1 day)) as d), soon as (select unnest(generate_series(timestamp '{NOW}' - interval 30 minute, timestamp '{NOW}' + interval 2 hour, interval 5 minute)) as t),
 times as (select schedule_id, d + to_hours(cast(h as integer)) + to_minutes(case kind when 1 then 30 when 3 then 15 else 0 end) as fire_at from k, days where kind <> 2 and case kind when 0 then true when 1 then dayofweek(d) = dow when 3 then dayofweek(d) between 1 and 5 else day(d) = dom end
  union all select schedule_id, t from k, soon where kind = 2),
 f as (select schedule_id, fire_at, cast(row_number() over (partition by schedule_id order by fire_at) as integer) as n from times where fire_at > timestamp '{NOW}') """


@query(_FIRES + "select schedule_id, fire_at, n from f where n <= 2")
def k1_fire_times(read):
    return schedules.fire_times(_schedules(read), _at(NOW), most=2)


@query("""select schedule_id, timezone('UTC', timezone('Europe/Madrid', d + to_hours(h))) as fire_at from (select c_custkey as schedule_id, cast(c_custkey % 24 as integer) as h from customer), (select unnest(generate_series(timestamp '2024-03-28', timestamp '2024-04-03', interval 1 day)) as d)
 where not (h = 2 and d = timestamp '2024-03-31') and timezone('UTC', timezone('Europe/Madrid', d + to_hours(h))) > timestamp '2024-03-29 00:00:00' and d <= timestamp '2024-04-02'""")
def k1_fire_times_over_clock_change(read):
    hour = (F.col("c_custkey") % 24).cast("string")
    all_of = read("customer").select(F.col("c_custkey").alias("schedule_id"), F.concat(F.lit("0 "), hour, F.lit(" * * *")).alias("cron"), F.lit("Europe/Madrid").alias("timezone"))
    return schedules.fire_times(all_of, _at("2024-03-29 00:00:00"), days=4)


# the first 25 of schedules that a clock change hits: Sundays of March, and the last days of March, at each hour
@query("""with d as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2032-12-31', interval 1 day)) as d), k as (select c_custkey as schedule_id, c_custkey % 24 as h, c_custkey % 2 as kind from customer),
 t as (select schedule_id, d, h, d + to_hours(cast(h as integer)) + interval 30 minute as local from k, d where month(d) = 3 and case kind when 0 then dayofweek(d) = 0 else day(d) >= 25 end),
 f as (select schedule_id, timezone('UTC', timezone('Europe/Madrid', local)) as fire_at from t where not (h = 2 and dayofweek(d) = 0 and day(d) >= 25))
 select schedule_id, fire_at, cast(row_number() over (partition by schedule_id order by fire_at) as integer) as n from f qualify n <= 25""")
def k1_fire_times_behind_clock_changes(read):
    days = F.when(F.col("c_custkey") % 2 == 0, " * 3 0").otherwise(" 25-31 3 *")
    all_of = read("customer").select(F.col("c_custkey").alias("schedule_id"), F.concat(F.lit("30 "), (F.col("c_custkey") % 24).cast("string"), days).alias("cron"), F.lit("Europe/Madrid").alias("timezone"))
    return schedules.fire_times(all_of, _at("2024-01-01 00:00:00"), most=25)


# schedules of every 29 February: further apart than any fixed horizon
@query("""select schedule_id, fire_at, cast(row_number() over (partition by schedule_id order by fire_at) as integer) as n from (select c_custkey as schedule_id, make_timestamp(y, 2, 29, c_custkey % 24, 0, 0) as fire_at from customer, (values (2024), (2028), (2032), (2036)) t(y)) where fire_at > timestamp '2024-02-29 10:30:00' qualify n <= 3""")
def k1_rare_fire_times(read):
    hour = (F.col("c_custkey") % 24).cast("string")
    all_of = read("customer").select(F.col("c_custkey").alias("schedule_id"), F.concat(F.lit("0 "), hour, F.lit(" 29 2 *")).alias("cron"), F.lit(None).cast("string").alias("timezone"))
    return schedules.fire_times(all_of, _at("2024-02-29 10:30:00"), most=3)


@query("""select c_custkey as schedule_id, case c_custkey % 6 when 2 then '*/5 * * * *' when 0 then '0 ' || c_custkey % 24 || ' * * *' when 1 then '30 ' || c_custkey % 24 || ' * * ' || c_custkey % 7 when 3 then '15 ' || c_custkey % 24 || ' * * 1-5' when 4 then '61 ' || c_custkey % 24 || ' * * *' else '0 ' || c_custkey % 24 || ' ' || (c_custkey % 28 + 1) || ' * *' end as cron,
 case when c_custkey % 6 = 4 then 'invalid minute field' when c_custkey % 10 = 3 then 'unknown time zone' when c_custkey % 6 = 2 then 'fires more often than every 15 minutes' end as error from customer""")
def k2_validated(read):
    return schedules.validate_schedules(_schedules(read), _at(NOW))


@query("""select c_custkey as schedule_id, case c_custkey % 6 when 2 then 'Every 5 minutes' when 0 then 'Every day at ' || hh || ':00' when 1 then ['Sundays','Mondays','Tuesdays','Wednesdays','Thursdays','Fridays','Saturdays'][c_custkey % 7 + 1] || ' at ' || hh || ':30' when 3 then 'Weekdays at ' || hh || ':15' when 4 then 'Every day at ' || hh || ':61' else 'On day ' || (c_custkey % 28 + 1) || ' of every month at ' || hh || ':00' end
 || ' ' || case when c_custkey % 10 = 3 then 'Nowhere/Land' else 'UTC' end as description from (select *, lpad(cast(c_custkey % 24 as varchar), 2, '0') as hh from customer)""")
def c26_described(read):
    return _schedules(read).select("schedule_id", cron.describe_cron(F.col("cron"), F.col("timezone")).alias("description"))


@query(_FIRES + "select c_custkey as schedule_id, c_custkey % 4 <> 0 as enabled, n, fire_at from customer left join (select * from f where n <= 5 and schedule_id % 4 <> 0) on schedule_id = c_custkey")
def k3_schedule_view(read):
    view = schedules.schedule_view(_schedules(read), _at(NOW))
    return view.select("schedule_id", "enabled", F.posexplode_outer("next_times").alias("n", "fire_at")).withColumn("n", F.col("n") + 1)


@query(_FIRES + "select schedule_id, schedule_id % 100 as recording_id, fire_at from f where n <= 3 and schedule_id % 4 <> 0 order by fire_at, schedule_id limit 5")
def w10_upcoming(read):
    return schedules.upcoming_runs(_schedules(read), _at(NOW))


@query("select c_custkey as schedule_id from customer where c_custkey % 4 <> 0 and c_custkey % 21 - 10 < 0")
def k5_missed(read):
    return schedules.missed_schedules(_schedules(read), _at(NOW)).select("schedule_id")


# a board's run is active while its newest order is one that is still being worked on
@query("""with newest as (select o_custkey % 100 as recording_id, arg_max(o_orderstatus, o_orderkey) as status from orders group by 1) select c_custkey % 100 as recording_id, min(c_custkey) as schedule_id, 'queued' as status from customer where c_custkey % 4 <> 0 and c_custkey % 21 - 10 <= 0 and c_custkey % 100 not in (select recording_id from newest where status = 'P') group by 1""")
def k4_due_runs(read):
    board = F.col("o_custkey") % 100
    last = F.max("o_orderkey").over(Window.partitionBy(board))
    status = F.when((F.col("o_orderkey") == last) & (F.col("o_orderstatus") == "P"), "running").otherwise("succeeded")
    runs = read("orders").select(board.alias("recording_id"), status.alias("status"))
    return schedules.due_runs(_schedules(read), runs, _at(NOW)).select("recording_id", "schedule_id", "status")


@query(_FIRES + """select c_custkey as schedule_id, due as fired, case when due then fire_at else to_timestamp(1709634600 + (c_custkey % 21 - 10) * 60)::timestamp end as next_run_at from (select c_custkey, c_custkey % 4 <> 0 and c_custkey % 21 - 10 <= 0 as due from customer) left join (select * from f where n = 1) on schedule_id = c_custkey""")
def k4_after_firing(read):
    return schedules.after_firing(_schedules(read), _at(NOW)).select("schedule_id", F.col("last_run_at").isNotNull().alias("fired"), "next_run_at")


@query("select c_custkey as schedule_id from customer where c_custkey % 4 = 0 and c_custkey % 100 = 8")
def o4_list_schedules(read):
    return search.list_schedules(_schedules(read).withColumn("recording_id", F.col("recording_id").cast("string")), recording="8", enabled=False).select("schedule_id")


# --- politeness: a robots.txt for each host of pages

_ROBOTS = "# all\nUser-agent: *\nDisallow: /en/7\nAllow: /en/77\nDisallow: /*.html$\nCrawl-delay: 2\n\nUser-agent: other\nUser-agent: tidemark\nDisallow: /fr/\nAllow: /fr/7*9\n"


def _robots(read):
    hosts = read("pages").select(urls.url_origin(F.col("url")).alias("origin")).distinct()
    n = F.length("origin") % 5
    body = F.when(n == 2, F.substring_index(F.lit(_ROBOTS), "\n\n", 1)).otherwise(F.lit(_ROBOTS))
    return hosts.select("origin", F.when(n == 0, 404).when(n == 1, 503).otherwise(200).alias("status"), body.alias("body"), _at(NOW).alias("fetched_at"))


_ORIGIN = "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"


@query(rf"""select distinct url, case n when 0 then true when 1 then false when 2 then case when regexp_matches(t, '^/.*\.html$') then false when regexp_matches(t, '^/en/77') then true else not regexp_matches(t, '^/en/7') end
 else case when regexp_matches(t, '^/fr/7.*9') then true else not regexp_matches(t, '^/fr/') end end as allowed, case when n = 2 and not regexp_matches(t, '^/.*\.html$') and (regexp_matches(t, '^/en/77') or not regexp_matches(t, '^/en/7')) then 2000::bigint end as crawl_delay_ms
 from (select url, length({_ORIGIN}) % 5 as n, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) as t from pages)""")
def j8_robots_verdicts(read):
    # of the rules that fit the longest decides: /*.html$ is longer than /en/77, and that than /en/7
    return politeness.robots_verdict(read("pages"), _robots(read), "tidemark/1.0").select("url", "allowed", "crawl_delay_ms")


@query("select o_orderkey, greatest(o_orderkey % 5000, least(o_custkey % 50 * 1000, 30000)) as low, greatest(3000, o_orderkey % 5000, least(o_custkey % 50 * 1000, 30000)) as high from orders")
def j9_delays(read):
    low, high = politeness.effective_delay(F.col("o_orderkey") % 5000, F.lit(3000), F.col("o_custkey") % 50 * 1000)
    return read("orders").select("o_orderkey", low.alias("low"), high.alias("high"))


@query("""with f as (select 'o' || (user_id % 10) as origin, ts, case when event_id % 7 = 0 then 503 else 200 end as status, 'b' || event_id as body, event_id from events where event_type = 'purchase'),
 c as (select 'o' || (user_id % 10) as origin, ts from events where event_type = 'click') select c.origin, c.ts, case when f.ts is not null and c.ts <= f.ts + interval 24 hour then f.body end as body, coalesce(f.ts is not null and c.ts <= f.ts + interval 24 hour, false) as cached
 from c asof left join (select * from f where status < 500) f on c.origin = f.origin and c.ts >= f.ts""")
def j10_cached_robots(read):
    e = read("events").withColumns({"origin": F.concat(F.lit("o"), (F.col("user_id") % 10).cast("string")), "ts": F.col("ts").cast("timestamp")})
    fetched = e.where("event_type = 'purchase'").select("origin", F.when(F.col("event_id") % 7 == 0, 503).otherwise(200).alias("status"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("body"), F.col("ts").alias("fetched_at"))
    return politeness.robots_cache_asof(e.where("event_type = 'click'").select("origin", "ts"), fetched)


@query("""select o_orderkey, case when again then 'retry' when s between 200 and 299 then 'ok' when s in (403, 429) then 'blocked' else 'fail' end as action, case when again then case when feed then coalesce(w, 2000) else w end end as wait_ms, case when again or s between 200 and 299 then null when s in (403, 429) then 'BOT_WALL' when feed and s = 404 then 'NOT_FOUND' else 'NAVIGATION_FAILED' end as code
from (select *, case when feed then s in (429, 503) and a < 2 and coalesce(w, 2000) <= 60000 else s = 429 and a < 1 and coalesce(w, 60001) <= 60000 end as again from (select o_orderkey, o_orderkey % 2 = 0 as feed, [200, 403, 404, 429, 503, 500][o_custkey % 6 + 1] as s, case when o_orderkey % 3 > 0 then o_orderkey % 3 * 40000 end as w, o_custkey % 4 as a from orders))""")
def c18_classified(read):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    got = politeness.classify_response(F.when(k % 2 == 0, "feed").otherwise("page"), F.array(*map(F.lit, [200, 403, 404, 429, 503, 500]))[c % 6], F.when(k % 3 > 0, k % 3 * 40000), c % 4)
    return read("orders").select("o_orderkey", got.alias("g")).select("o_orderkey", "g.action", "g.wait_ms", "g.code")


@query("""select page_id, case when page_id % 5 = 0 then 'page title "Just a moment..."' when page_id % 5 = 1 then 'an active CAPTCHA challenge (www.google.com)' when length(html) >= 3000 then null when page_id % 5 = 2 then 'a CAPTCHA on an otherwise empty page' when page_id % 5 = 3 then 'challenge wording (Verify you are human)' end as signal from pages""")
def c19_bot_walls(read):
    n = F.col("page_id") % 5
    title = F.when(n == 0, " Just a moment... ").otherwise(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    frames = F.when(n == 1, F.array(F.lit("https://www.google.com/recaptcha/api2/bframe?x"))).otherwise(F.array().cast("array<string>"))
    markers = F.when(n == 2, F.array(F.lit("https://challenges.cloudflare.com/x"))).otherwise(F.array().cast("array<string>"))
    body = F.when(n == 3, F.concat(F.lit("Verify you are human. "), F.col("html"))).otherwise(F.col("html"))
    return read("pages").select("page_id", politeness.detect_bot_wall(title, body, F.length("html") / 2, frames, markers).alias("signal"))


# what someone typed in front of a page: in a form, and in an element that holds others, the page's own text among it
_FORM = '<form><textarea rows=2>typed</textarea><input type="text" value="mine" checked></form>'
_OPEN, _SHUT = ("<div contenteditable='true'><div>", "<section contentEditable><p>"), ("</div>secret<DIV><br>2</DIV></div>", "</p><section>3</section>secret</section>")
_BARE = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>', '', 'g')"""


@query(rf"""select page_id, ('<form><textarea rows=2></textarea><input type="text"></form>' || case when page_id % 2 = 0 then '<div contenteditable=''true''></div>' else '<section contentEditable></section>' end || {_BARE})[1:60000] as scrubbed from pages""")
def c30_scrubbed(read):
    even = F.col("page_id") % 2 == 0
    said = F.regexp_extract("html", r"(?s)<p>([^<]*)", 1)
    typed = F.concat(F.when(even, _OPEN[0]).otherwise(_OPEN[1]), said, F.when(even, _SHUT[0]).otherwise(_SHUT[1]))
    return read("pages").select("page_id", text.scrub_html(F.concat(F.lit(_FORM), typed, "html")).alias("scrubbed"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'Stopped by a bot check' when 1 then 'code ' || o_orderkey else '' end as words from orders")
def c29_reasons(read):
    k = F.col("o_orderkey")
    return read("orders").select("o_orderkey", text.reason_text(F.when(k % 3 == 0, "bot_wall").when(k % 3 == 1, F.concat(F.lit("code_"), k.cast("string")))).alias("words"))


# the words of a part's type written together, each with a capital
@query("""select p_partkey, upper(p_type[1]) || lower(p_type[2:]) || '-' || ['time', 'shift', 'night'][p_partkey % 3 + 1] || case when p_partkey % 2 = 0 then '-' || lower(p_type) else '' end as words, p_partkey % 4 <> 1 as alike from part""")
def c27_hyphens_and_resemblance(read):
    k = F.col("p_partkey")
    own = F.initcap("p_type")
    word = F.concat(own, F.element_at(F.array(F.lit("Time"), F.lit("Shift"), F.lit("Night")), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, own).otherwise(""))
    tag = F.when(k % 4 == 0, "a").when(k % 4 == 1, "b").when(k % 4 == 2, "b")
    said = F.when(k % 4 == 2, "Apply now").when(k % 4 < 2, "Other")
    return read("part").select("p_partkey", text.hyphen_case(word).alias("words"), text.resembles(tag, said, F.lit("a"), F.lit("apply NOW")).alias("alike"))


# --- definitions: one for each nation's board, from its customers


def _definitions(read):
    k = F.col("c_custkey")
    step = lambda i, kind, *more: F.concat(F.lit('{"id": "'), i, F.lit(f'", "type": "{kind}"'), *more, F.lit("}"))
    inner = step(F.concat(F.lit("i"), k.cast("string")), "extract", F.lit(', "target": {"locators": []}'))
    loop = step(F.lit("loop"), "forEach", F.lit(', "body": ['), inner, F.lit(", "), step(F.when(k % 5 == 0, "loop").otherwise("sub"), "scroll", F.when(k % 3 == 0, ', "mode": "by"').otherwise(', "mode": "by", "amount": 3')), F.lit("]"))
    settings = F.when(k % 7 == 0, '{"minDelayMs": 9, "maxDelayMs": 2}').otherwise('{"minDelayMs": 1, "maxDelayMs": 2}')
    body = F.concat(F.lit('{"kind": "'), F.when(k % 11 == 0, "api").otherwise("browser"), F.lit('", "boardToken": "'), F.when(k % 22 == 0, "a b").otherwise("acme"), F.lit('", "startUrl": "https://X'), (k % 9).cast("string"), F.lit('.example/a", "settings": '), settings, F.lit(', "steps": ['), step(F.lit("open"), "navigate"), F.lit(", "), loop, F.lit("]}"))
    return read("customer").select(k.alias("recording_id"), body.alias("definition_json"))


@query("""select c_custkey as recording_id, unnest([struct_pack(step_id := 'open', parent_id := null, depth := 0, type := 'navigate'), struct_pack(step_id := 'loop', parent_id := null, depth := 0, type := 'forEach'), struct_pack(step_id := 'i' || c_custkey, parent_id := 'loop', depth := 1, type := 'extract'), struct_pack(step_id := case when c_custkey % 5 = 0 then 'loop' else 'sub' end, parent_id := 'loop', depth := 1, type := 'scroll')], recursive := true) from customer""")
def d5_steps(read):
    return definitions.walk_steps(_definitions(read)).select("recording_id", "step_id", "parent_id", "depth", "type")


@query("""select c_custkey as recording_id, null as step_id, 'minDelayMs is above maxDelayMs' as problem from customer where c_custkey % 7 = 0 union all select c_custkey, null, 'board token has odd characters' from customer where c_custkey % 22 = 0
 union all select c_custkey, 'loop', 'step id is used twice' from customer where c_custkey % 5 = 0 union all select c_custkey, case when c_custkey % 5 = 0 then 'loop' else 'sub' end, 'scroll by needs an amount' from customer where c_custkey % 3 = 0""")
def d6_lint(read):
    return definitions.lint_definitions(_definitions(read))


def _versions(read):
    return read("orders").select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version_id"), F.col("o_orderkey").alias("version_seq"), F.col("o_custkey").alias("recording_id"), F.lit("{}").alias("definition_json"), F.lit(None).cast("string").alias("note"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query("""select c_custkey as recording_id, coalesce(m, 0) + 1 as version_seq, m is null as created, 'x' || c_custkey % 9 || '.example' as domain from customer left join (select o_custkey, max(o_orderkey) as m from orders group by 1) on o_custkey = c_custkey""")
def s13_saved_definitions(read):
    new = _definitions(read).withColumns({"note": F.lit("edited"), "created_at": _at(NOW)})
    return definitions.save_definition(_versions(read), new).where("note = 'edited'").select("recording_id", "version_seq", "created", "domain")


@query("select o_custkey as recording_id, max(o_orderkey) as version_seq from orders group by 1")
def w5_latest_versions(read):
    return definitions.latest_version(_versions(read)).select("recording_id", "version_seq")


@query("""select o_orderkey, case when o_orderkey % 3 > 0 then 'Hi ' || o_custkey || ', ' || o_orderpriority || '!' end as text, case when o_orderkey % 3 = 0 then 'unknown parameter: who' end as error from orders""")
def c24_templates(read):
    k = F.col("o_orderkey")
    template = F.concat(F.lit("Hi {{ "), F.when(k % 3 == 0, "who").otherwise("name"), F.lit(" }}, {{prio}}!"))
    got = definitions.render_template(template, F.create_map(F.lit("name"), F.col("o_custkey").cast("string"), F.lit("prio"), F.col("o_orderpriority")))
    return read("orders").select("o_orderkey", got.alias("g")).select("o_orderkey", "g.text", "g.error")


@query("""select o_orderkey, case o_orderkey % 3 when 0 then o_orderpriority end as city, case o_orderkey % 3 when 1 then 'undeclared: zip' when 2 then 'missing: city' end as error from orders""")
def c24_params(read):
    k = F.col("o_orderkey")
    declared = F.create_map(F.lit("city"), F.lit(None).cast("string"), F.lit("lang"), F.lit("en"))
    over = F.when(k % 3 == 0, F.create_map(F.lit("city"), F.col("o_orderpriority"))).when(k % 3 == 1, F.create_map(F.lit("zip"), F.lit("1")))
    return read("orders").select("o_orderkey", definitions.resolve_params(declared, over).alias("g")).select("o_orderkey", F.col("g.params")["city"].alias("city"), "g.error")


@query("select o_orderkey as version_seq, (o_orderkey = (select max(o_orderkey) from orders where o_custkey = 1)) as restored from orders where o_custkey = 1")
def w5_version_history(read):
    versions = _versions(read)
    last = definitions.latest_version(versions.where("recording_id = 1")).select("version_id")
    history = definitions.version_history(versions, 1)
    newest = last.first()
    restored = definitions.version_at(versions, 1, newest[0] if newest else "").select("version_id", F.lit(True).alias("restored"))
    return history.join(restored, "version_id", "left").select("version_seq", F.coalesce("restored", F.lit(False)).alias("restored"))


# --- trees of steps: each user's events as captured actions and markers


@query("""with recursive e as (select cast(user_id as varchar) as s, cast(json_extract_string(props, '$.k') as integer) as k, event_type, row_number() over (partition by user_id order by epoch_ms(ts), event_id) as pos from events),
 a as (select *, case when k % 20 = 0 then 'listStart' when k % 20 = 1 then 'detailStart' when k % 20 in (2, 3) then 'scopeEnd' when k % 20 in (4, 5, 6) then 'field' when k % 20 = 7 then 'paginate' else 'step' end as kind from e),
 b as (select *, sum(case when kind in ('listStart', 'detailStart') then 1 when kind = 'scopeEnd' then -1 else 0 end) over (partition by s order by pos) as total from a),
 c as (select *, total - least(min(total) over (partition by s order by pos), 0) as depth from b),
 d as (select *, kind in ('listStart', 'detailStart') as opens, depth - case when kind in ('listStart', 'detailStart') then 1 else 0 end as level from c),
 raw as (select r.s, r.pos, any_value(r.k) as k, any_value(r.kind) as kind, any_value(r.event_type) as event_type, max(o.pos) as scope from d r left join d o on o.s = r.s and o.opens and o.depth = r.level and o.pos < r.pos and r.level > 0 group by r.s, r.pos),
 through as (select d.s, d.pos, d.scope from raw d left join raw o on o.s = d.s and o.pos = d.scope where d.kind = 'detailStart' and coalesce(o.kind, '') <> 'listStart'),
 up(s, pos, scope) as (select s, pos, scope from raw union all select u.s, u.pos, t.scope from up u join through t on t.s = u.s and t.pos = u.scope),
 real as (select raw.s, raw.pos, raw.k, raw.kind, raw.event_type, u.scope from up u join raw using (s, pos) where not exists (select 1 from through t where t.s = u.s and t.pos = u.scope) and not exists (select 1 from through t where t.s = u.s and t.pos = u.pos)),
 placed as (select r.*, o.kind as around, o.scope as outer_scope, coalesce(r.kind = 'step' and o.kind = 'listStart' and r.k % 2 = 1, false) as hoisted,
  coalesce(r.kind = 'field' and lag(r.kind) over (partition by r.s order by r.pos) = 'field' and lag(r.pos) over (partition by r.s order by r.pos) = r.pos - 1, false) as goes_on from real r left join real o on o.s = r.s and o.pos = r.scope),
 pagers as (select distinct p.s, (select max(l.pos) from real l where l.s = p.s and l.kind = 'listStart' and l.pos < p.pos) as pos from real p where p.kind = 'paginate'),
 nodes as (select p.s, p.pos, case when hoisted then outer_scope else scope end as parent, case when hoisted then [scope, 0, p.pos] else [p.pos, 1, p.pos] end as place,
  case kind when 'listStart' then 'forEach' when 'detailStart' then 'openDetail' when 'field' then 'extract' else event_type end as type, g.pos is not null as paged from placed p left join pagers g on g.s = p.s and g.pos = p.pos where kind not in ('scopeEnd', 'paginate') and not goes_on),
 tree(s, pos, parent, type, paged, path) as (select s, pos, parent, type, paged, [place] from nodes where parent is null union all select n.s, n.pos, n.parent, n.type, n.paged, list_append(t.path, n.place) from nodes n join tree t on t.s = n.s and t.pos = n.parent),
 told as (select *, sum(case when paged then 2 else 1 end) over (partition by s order by path) as number from tree)
 select t.s as recording_id, 's' || (case when w then t.number - 1 else t.number end) as step_id, case when t.paged and not w then 's' || (t.number - 1) else 's' || p.number end as parent_id, case when w then 'paginate' else t.type end as type
 from told t left join told p on p.s = t.s and p.pos = t.parent, (values (true), (false)) as ways(w) where t.paged or not w""")
def d11_step_trees(read):
    k = F.get_json_object("props", "$.k").cast("int")
    at = lambda *n: (k % 20).isin(*n)
    kind = F.when(at(0), "listStart").when(at(1), "detailStart").when(at(2, 3), "scopeEnd").when(at(4, 5, 6), "field").when(at(7), "paginate").otherwise("step")
    actions = read("events").select(
        F.col("user_id").cast("string").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("idx"), kind.alias("kind"), F.col("event_type").alias("step_type"), (k % 2 == 0).alias("for_item"), F.concat(F.lit("f"), k.cast("string")).alias("name"),
        F.to_json(F.struct(k.alias("value"))).alias("payload"), F.lit(None).cast("string").alias("wait_pattern"),
    )
    return definitions.walk_steps(step_trees.step_trees(actions)).select("recording_id", "step_id", "parent_id", "type")
