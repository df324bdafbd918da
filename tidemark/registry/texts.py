"""Queries of column functions, sources and search, on pages, documents, part, orders, supplier."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import money_dates, text, urls
from tidemark.operators import discover, extract, heal, normalize, search
from tidemark.plans import definitions
from tidemark.registry.common import registry
from tidemark.shared import shared_dir
from tidemark.sources import feeds

QUERIES: dict = {}
query = registry(QUERIES)

_PATH = r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_ORIGIN = r"lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"
_KEPT = r"array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]*|gh_src|source|ref|fbclid|gclid|mc_cid|mc_eid)='))), '&')"
_CANONICAL = rf"{_ORIGIN} || case when regexp_replace({_PATH}, '/+$', '') = '' then '/' else regexp_replace({_PATH}, '/+$', '') end || case when {_KEPT} = '' then '' else '?' || {_KEPT} end"


@query(f"select page_id, {_CANONICAL} as canonical, regexp_extract({_ORIGIN}, '://(.*)$', 1) as domain, {_ORIGIN} || {_PATH} as public_url from pages")
def c7_canonical_urls(read):
    url = F.col("url")
    return read("pages").select("page_id", urls.canonicalize_url(url).alias("canonical"), urls.domain_of(url).alias("domain"), urls.publicise_url(url).alias("public_url"))


@query(rf"""select page_id, '**' || p || case when url like '%?%' then '?*' when url like '%#_%' then '#**' when p like '%*' then '' else '*' end as pattern
from (select page_id, url, array_to_string(list_transform(string_split({_PATH}, '/'), lambda s: case when regexp_matches(s, '^[0-9]+$|[0-9]{{4,}}|^[0-9a-fA-F]{{8,}}$') or length(s) > 40 then '*' else s end), '/') as p from pages)""")
def c22_url_patterns(read):
    return read("pages").select("page_id", urls.url_wait_pattern(F.col("url")).alias("pattern"))


# a * is anything but a slash, ** anything, all else stands for itself
@query(rf"""select page_id, regexp_full_match(url, '.*/en/[^/]*') as hit, regexp_full_match(url, replace(replace(replace(regexp_escape(pattern), '\*\*', chr(1)), '\*', '[^/]*'), chr(1), '.*')) as own
from (select page_id, url, '**' || p || case when url like '%?%' then '?*' when url like '%#_%' then '#**' when p like '%*' then '' else '*' end as pattern
from (select page_id, url, array_to_string(list_transform(string_split({_PATH}, '/'), lambda s: case when regexp_matches(s, '^[0-9]+$|[0-9]{{4,}}|^[0-9a-fA-F]{{8,}}$') or length(s) > 40 then '*' else s end), '/') as p from pages))""")
def c23_glob_matches(read):
    url = F.col("url")
    return read("pages").select("page_id", urls.glob_matches(F.lit("**/en/*"), url).alias("hit"), urls.glob_matches(urls.url_wait_pattern(url), url).alias("own"))


_BLOCKS = "|".join(text.BLOCK_TAGS)
_STRIPPED = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'),
 '(?i)<br\s*/?>', chr(10), 'g'), '(?i)<li\b[^>]*>', chr(10) || '- ', 'g'), '(?i)</?(?:{_BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"""


@query(rf"""select page_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), chr(10)),
 lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as body from (select page_id, {_STRIPPED} as t from pages)""")
def c5_html_to_text(read):
    return read("pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query(r"""select doc_id, nullif(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') as block,
 nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') as line from documents""")
def c3_clean_text(read):
    return read("documents").select("doc_id", text.clean_block(F.col("text")).alias("block"), text.clean_line(F.col("text")).alias("line"))


@query(r"""select doc_id, case when g = '' then '' when regexp_matches(g, '[",\n\r]') then '"' || replace(g, '"', '""') || '"' else g end as cell
from (select doc_id, case when regexp_matches(text, '^[=+\-@\t\r]') then '''' || text else text end as g from documents)""")
def c25_csv_cells(read):
    return read("documents").select("doc_id", text.csv_cell(F.col("text")).alias("cell"))


# the words of each text's first half against those of its second
@query(r"""select doc_id, case when len(a) = 0 or len(b) = 0 then 0.0 else round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 9) end as similarity from (select doc_id,
 list_distinct(regexp_extract_all(lower(text[1:length(text) // 2]), '[\p{L}\p{N}]+')) as a, list_distinct(regexp_extract_all(lower(text[length(text) // 2 + 1:]), '[\p{L}\p{N}]+')) as b from documents)""")
def c20_text_similarity(read):
    middle = F.floor(F.length("text") / 2).cast("int")
    a, b = F.substring("text", F.lit(1), middle), F.substring("text", middle + 1, F.length("text"))
    return read("documents").select("doc_id", F.round(text.text_similarity(a, b), 9).alias("similarity"))


@query(r"""select doc_id, case when regexp_matches(t, '(?i)\bhybrid\b') then 'hybrid' when regexp_matches(t, '(?i)\b(remote|work from home|wfh|distributed)\b|\btelecommut') then 'remote' when regexp_matches(t, '(?i)\bon[-\s]?site\b|\bin[-\s]office\b|\bin[-\s]person\b') then 'onsite' else 'unknown' end as remote
from (select doc_id, case doc_id % 5 when 0 then 'Remote (' || lang || ')' when 1 then 'Hybrid - ' || source when 2 then 'On-site, ' || source when 3 then 'Telecommuting' else source end as t from documents)""")
def c11_infer_remote(read):
    n = F.col("doc_id") % 5
    place = F.when(n == 0, F.concat(F.lit("Remote ("), "lang", F.lit(")"))).when(n == 1, F.concat(F.lit("Hybrid - "), "source")).when(n == 2, F.concat(F.lit("On-site, "), "source")).when(n == 3, "Telecommuting").otherwise(F.col("source"))
    return read("documents").select("doc_id", normalize.infer_remote(F.lit(None).cast("string"), place).alias("remote"))


@query("""select p_partkey, lo as salary_min, lo + 500 as salary_max, cur as currency, per as period, cast(cast(lo as bigint) as varchar) || '-' || cast(cast(lo + 500 as bigint) as varchar) || ' ' || cur || '/' || per as shown
from (select p_partkey, floor(p_retailprice) + 1000 as lo, case p_partkey % 3 when 0 then 'EUR' when 1 then 'USD' else 'GBP' end as cur, case p_partkey % 5 when 0 then 'hour' when 1 then 'day' when 2 then 'week' when 3 then 'month' else 'year' end as per from part)""")
def c8_salaries(read):
    low = F.floor("p_retailprice") + 1000
    sign = F.when(F.col("p_partkey") % 3 == 0, "€").when(F.col("p_partkey") % 3 == 1, "$").otherwise("£")
    per = F.array(*map(F.lit, ["per hour", "/ day", "weekly", "a month", "per annum"]))[F.col("p_partkey") % 5]
    said = F.concat(sign, F.format_number(low, 0), F.lit(" - "), sign, (low + 500).cast("string"), F.lit(" "), per)
    pay = money_dates.parse_salary(said)
    return read("part").select("p_partkey", pay.alias("pay")).select("p_partkey", F.col("pay.min").alias("salary_min"), F.col("pay.max").alias("salary_max"), F.col("pay.currency").alias("currency"), F.col("pay.period").alias("period"), money_dates.format_salary(F.col("pay")).alias("shown"))


@query("""select o_orderkey, case o_orderkey % 6 when 4 then timestamp '2026-10-06 00:00:00' - to_days(cast(o_orderkey % 40 as integer)) when 5 then o_orderdate + interval 90 minute else date_trunc('day', o_orderdate) end as posted_at from orders""")
def c10_dates(read):
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 6
    said = (
        F.when(n == 0, F.date_format(d, "'Posted' yyyy-MM-dd")).when(n == 1, F.date_format(d, "d MMM. yyyy")).when(n == 2, F.date_format(d, "dd.MM.yyyy")).when(n == 3, F.date_format(d, "MM/dd/yyyy"))
        .when(n == 4, F.concat(F.lit("Posted "), (F.col("o_orderkey") % 40).cast("string"), F.lit("+ days ago"))).otherwise(F.date_format(d + F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return read("orders").select("o_orderkey", money_dates.parse_date(said, F.lit("2026-10-06 15:30:00").cast("timestamp")).alias("posted_at"))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then (o_orderkey % 100) * 1000 else greatest(0, epoch_ms(o_orderdate) - epoch_ms(timestamp '1996-01-01')) end as wait_ms,
 case o_orderkey % 3 when 0 then timestamp '2026-10-06 15:30:00' - to_hours(cast(o_orderkey % 50 as integer)) when 1 then timestamp '2026-10-06 15:30:00' - to_days(cast(o_orderkey % 50 as integer)) else null end as since from orders""")
def c17_waits_and_spans(read):
    k = F.col("o_orderkey")
    header = F.when(k % 2 == 0, (k % 100).cast("string")).otherwise(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    span = F.when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit("h"))).when(k % 3 == 1, F.concat((k % 50).cast("string"), F.lit("D"))).otherwise("soon")
    now = lambda t: F.lit(t).cast("timestamp")
    return read("orders").select("o_orderkey", money_dates.retry_after_ms(header, now("1996-01-01")).alias("wait_ms"), money_dates.parse_since(span, now("2026-10-06 15:30:00")).alias("since"))


def _raw_pages(read):
    """Pages as raw records: title, url and two custom fields."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    fields = F.create_map(F.lit("title"), F.when(F.col("page_id") % 11 != 0, title), F.lit("url"), F.concat("url", F.when(F.col("page_id") % 2 == 0, "").otherwise("")), F.lit("location"), F.lit("  Remote  (EU) "), F.lit("salaryText"), F.lit("€85,000 - €110,000 per year"), F.lit("department"), F.lit(" Platform "), F.lit("reqId"), F.lit(None).cast("string"))
    return read("pages").select(F.lit("rec").alias("recording_id"), urls.domain_of(F.col("url")).alias("run_id"), F.lit(1).cast("long").alias("run_seq"), F.col("page_id").alias("item_idx"), fields.alias("fields"), F.col("url").alias("source_url"))


def _postings(read):
    return normalize.normalize_records(_raw_pages(read), F.lit("2026-10-06 15:30:00").cast("timestamp"), F.lit("Acme Robotics"))


_TITLE = r"nullif(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g')), '')"


@query(f"""select page_id as item_idx, {_TITLE} as title, 'Acme Robotics' as company, 'Remote (EU)' as location, 'remote' as remote, 85000.0::double as salary_min, 110000.0::double as salary_max, 'EUR' as salary_currency, 'year' as salary_period,
 {_CANONICAL} as dedup_key, 'Platform' as department, 64 as hash_length from pages where page_id % 11 <> 0 and {_TITLE} is not null""")
def c14_normalized_postings(read):
    return _postings(read).select("item_idx", "title", "company", "location", "remote", "salary_min", "salary_max", "salary_currency", "salary_period", "dedup_key", F.col("custom")["department"].alias("department"), F.length("content_hash").alias("hash_length"))


@query(f"select page_id as item_idx, ['department','location','reqId','salaryText','title','url'] as field_names from pages where page_id % 11 = 0 or {_TITLE} is null")
def f5_untitled(read):
    return normalize.untitled(_raw_pages(read)).select(F.col("item_idx"), "field_names")


_IN_RUN = f"select page_id, regexp_extract({_ORIGIN}, '://(.*)$', 1) as run_id, {_CANONICAL} as k from pages where page_id % 11 <> 0 and {_TITLE} is not null"


@query(f"select run_id, count(distinct k) as jobs, count(*) - count(distinct k) as dropped from ({_IN_RUN}) group by run_id")
def a6_dedupe_in_run(read):
    jobs = _postings(read)
    kept = normalize.dedupe_in_run(jobs).groupBy("run_id").agg(F.count("*").alias("jobs"))
    return kept.join(normalize.dropped_in_run(jobs), "run_id").select("run_id", "jobs", "dropped")


_LINK = {"list": [{"kind": "css", "value": "nav.none li"}, {"kind": "css", "value": "nav > ul > li"}], "fields": [{"name": "label", "locators": [{"kind": "role", "role": "link", "value": "link"}], "required": True}, {"name": "href", "locators": [{"kind": "testId", "value": "x"}, {"kind": "xpath", "value": ".//a"}], "read": "attr:href"}]}


@query(r"""select page_id, cast(i - 1 as integer) as item_idx, regexp_extract(x, '<a href="([^"]*)">', 1) as href, nullif(trim(regexp_replace(regexp_extract(x, '">(.*)</a>', 1), '\s+', ' ', 'g')), '') as label, 1 as drifted
from (select page_id, unnest(l) as x, generate_subscripts(l, 1) as i from (select page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1) as l from pages))""")
def d3_extracted_records(read):
    got = extract.extract_records(read("pages"), _LINK)
    return got.select("page_id", "item_idx", F.col("fields")["href"].alias("href"), text.null_if_empty(F.col("fields")["label"]).alias("label"), F.size("drift").alias("drifted"))


@query(r"""with items as (select unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1)) as x from pages),
 tried as (select 'href' as target, 0 as locator, len(regexp_extract_all(x, 'data-testid="x"')) as n from items union all select 'href', 1, len(regexp_extract_all(x, '<a ')) from items union all select 'label', 0, len(regexp_extract_all(x, '<a |role="link"')) from items),
 shares as (select target, locator, avg(case when n = 1 then 1.0 else 0.0 end)::double as share from tried group by all) select target, locator, share, share >= 0.6 or max(share) over (partition by target) < 0.6 as kept from shares""")
def d4_locator_coverage(read):
    return extract.locator_coverage(extract.locator_attempts(read("pages"), _LINK))


# the menu is the list whose items are links; the texts' own lists (of unclosed tags) are found too, but SQL can't nest elements
_MENU = r"(select page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1) as l from pages)"


def _menus(read):
    return discover.list_groups(read("pages")).where("look = 'li>a'")


@query(rf"select page_id, len(l) as size, 'li>a' as look from {_MENU} where len(l) >= 2")
def d8_found_lists(read):
    return _menus(read).select("page_id", F.col("size").cast("long").alias("size"), "look")


@query(rf"""select page_id, i, k as kind, v as value from {_MENU}, (values (0, 'role', 'listitem'), (1, 'css', 'li'), (2, 'css', 'ul > li'), (3, 'css', 'nav > ul > li'), (4, 'xpath', '/html[1]/body[1]/nav[1]/ul[1]/li')) as t(i, k, v) where len(l) >= 2""")
def d9_list_locators(read):
    found = discover.located_lists(read("pages"), "li>a")
    return found.select("page_id", F.posexplode("locators").alias("i", "l")).select("page_id", "i", "l.kind", "l.value")


@query(rf"""select page_id, 'a' as value, len(l) as items, len(list_filter(l, lambda x: len(regexp_extract_all(x, '<a ')) = 1)) / len(l) as share from {_MENU} where len(l) >= 2""")
def d10_field_locators(read):
    return discover.field_locators(read("pages"), _menus(read)).select("page_id", "value", F.col("items").cast("long").alias("items"), "share")


# steps that know a page's parts, and the page after a redesign: classes renamed, the menu in a wrapper, a banner in front
_STEPS = ["nav", "h1", "footer"]


def _redesigned(read):
    html = F.replace(F.replace("html", F.lit("<nav>"), F.lit('<div class="bar"><nav class="menu">')), F.lit("</nav>"), F.lit("</nav></div>"))
    html = F.replace(F.replace(html, F.lit("<body>"), F.lit("<body><div class=banner><p>New look</p></div>")), F.lit('class="ad"'), F.lit('class="promo"'))
    return read("pages").select("page_id", html.alias("html"))


def _fingerprints(read):
    page = extract.with_nodes(read("pages"))
    first = F.filter("nodes", lambda n: n["tag"].isin(*_STEPS) & (n["kin"] == 1))
    wanted = page.select("page_id", F.inline(F.transform(first, lambda n: F.struct(n["tag"].alias("step_id"), n["node"].alias("node")))))
    return heal.fingerprints_of(read("pages"), wanted)


@query(rf"""select page_id, unnest(['nav', 'h1', 'footer']) as step_id, unnest(['nav.menu', 'h1', 'footer']) as found from pages""")
def a10_healed(read):
    found = heal.heal(_redesigned(read), _fingerprints(read))
    named = heal.element_locators(_redesigned(read), found)
    return named.select("page_id", "step_id", F.element_at("locators", 1)["value"].alias("found"))


@query(r"select doc_id, regexp_replace(source, '[^0-9]', '', 'g') as digits, trim(regexp_replace(text, '\s+', ' ', 'g')) as line from documents")
def d1_transform_chain(read):
    return read("documents").select("doc_id", definitions.transform_chain(F.col("source"), ["trim", r"regex:src(\d+)"]).alias("digits"), definitions.transform_chain(F.col("text"), ["collapseWhitespace", "trim"]).alias("line"))


@query(f"select page_id, {_ORIGIN} || '/jobs/' || page_id as url, case when page_id % 11 = 0 then 'empty: title' end as item_error from pages")
def d2_field_specs(read):
    fields = F.create_map(F.lit("title"), F.when(F.col("page_id") % 11 != 0, "t"), F.lit("url"), F.concat(F.lit("/jobs/"), F.col("page_id").cast("string")))
    rows = read("pages").select("page_id", fields.alias("fields"), F.col("url").alias("source_url"))
    got = definitions.apply_field_specs(rows, [{"name": "title", "required": True}, {"name": "url", "kind": "url", "transforms": ["trim"]}])
    return got.select("page_id", F.col("fields")["url"].alias("url"), "item_error")


# --- feeds, built from suppliers and parts


def _payloads(read, provider: str):
    n = F.col("s_suppkey")
    key = n.cast("string")
    if provider == "greenhouse":
        entry = F.struct(n.alias("id"), F.when(n % 9 != 0, F.col("s_name")).alias("title"), F.concat(F.lit("https://x.example/jobs/"), key).alias("absolute_url"), F.struct(F.concat(F.lit("City "), F.col("s_nationkey").cast("string")).alias("name")).alias("location"), F.lit("&lt;p&gt;Tom &amp;amp; co&lt;/p&gt;").alias("content"), F.array(F.struct(F.lit("A").alias("name")), F.struct(F.lit("B").alias("name"))).alias("departments"), F.array(F.struct((n * 100).cast("double").alias("min_cents"), (n * 100 + 149).cast("double").alias("max_cents"), F.lit("EUR").alias("currency_type"))).alias("pay_input_ranges"), F.lit("2026-09-14").alias("updated_at"))
    elif provider == "lever":
        entry = F.struct(key.alias("id"), F.when(n % 9 != 0, F.col("s_name")).alias("text"), F.lit(1_700_000_000_000).alias("createdAt"), F.struct(F.lit("Rome").alias("location"), F.when(n % 2 == 0, F.array(F.lit("Rome"), F.lit("Oslo"))).otherwise(F.array(F.lit("Rome"))).alias("allLocations")).alias("categories"), F.when(n % 3 == 0, "unspecified").otherwise("hybrid").alias("workplaceType"), F.lit("Plain").alias("descriptionPlain"), F.array(F.struct(F.lit("Needs").alias("text"), F.lit("<li>a &amp; b</li>").alias("content"))).alias("lists"), F.struct(n.cast("double").alias("min"), (n + 1).cast("double").alias("max"), F.lit("USD").alias("currency"), F.lit("per-hour-wage").alias("interval")).alias("salaryRange"))
    else:
        entry = F.struct(key.alias("id"), F.when(n % 9 != 0, F.col("s_name")).alias("title"), F.lit("Rome").alias("location"), F.array(F.struct(F.lit("Oslo").alias("location"))).alias("secondaryLocations"), F.lit("FullTime").alias("employmentType"), F.when(n % 2 == 0, "OnSite").alias("workplaceType"), (n % 3 == 0).alias("isRemote"), (n % 4 != 0).alias("isListed"), F.lit("<p>One</p><p>Two</p>").alias("descriptionHtml"), F.struct(F.lit("$1 - $2").alias("compensationTierSummary")).alias("compensation"))
    one = F.to_json(entry)
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, one.alias("j")))), lambda s: s["j"]), ","), F.lit("]"))
    boards = read("supplier").groupBy("s_nationkey").agg(listed.alias("a"))
    broken = F.when(F.col("s_nationkey") % 7 == 3, F.lit('{"nothing": 1}')).otherwise(F.col("a") if provider == "lever" else F.concat(F.lit('{"jobs": '), "a", F.lit("}")))
    return boards.select(F.col("s_nationkey").cast("string").alias("recording_id"), F.lit("run").alias("run_id"), F.lit(1).cast("long").alias("run_seq"), F.lit("https://x.example/feed").alias("source_url"), broken.alias("body"))


_BOARD = "select *, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as i, cast(s_suppkey as varchar) as k from supplier where s_nationkey % 7 <> 3"


@query(f"""select cast(s_nationkey as varchar) as recording_id, cast(i as integer) as item_idx, s_name as title, 'https://x.example/jobs/' || k as url, 'City ' || s_nationkey as location, 'Tom & co' as description, 'EUR ' || k || ' - ' || (s_suppkey + 1) as salary, 'A, B' as department from ({_BOARD}) where s_suppkey % 9 <> 0""")
def s1_greenhouse(read):
    f = F.col("fields")
    return feeds.read_feeds(_payloads(read, "greenhouse"), "greenhouse").select("recording_id", "item_idx", f["title"].alias("title"), f["url"].alias("url"), f["location"].alias("location"), f["description"].alias("description"), f["salaryText"].alias("salary"), f["department"].alias("department"))


@query(f"""select cast(s_nationkey as varchar) as recording_id, cast(i as integer) as item_idx, s_name as title, case when s_suppkey % 2 = 0 then 'Rome; Oslo' else 'Rome' end as location, case when s_suppkey % 3 <> 0 then 'hybrid' end as remote,
 '2023-11-14T22:13:20.000Z' as posted_at, 'USD ' || k || ' - ' || (s_suppkey + 1) || ' per hour' as salary, 'Plain' || chr(10) || chr(10) || 'Needs' || chr(10) || '- a & b' as description from ({_BOARD}) where s_suppkey % 9 <> 0""")
def s2_lever(read):
    f = F.col("fields")
    got = feeds.read_feeds(_payloads(read, "lever"), "lever")
    return got.select("recording_id", "item_idx", f["title"].alias("title"), f["location"].alias("location"), F.try_element_at(f, F.lit("remote")).alias("remote"), f["postedAt"].alias("posted_at"), f["salaryText"].alias("salary"), f["description"].alias("description"))


@query(f"""select cast(s_nationkey as varchar) as recording_id, cast(i as integer) as item_idx, s_name as title, 'Rome; Oslo' as location, case when s_suppkey % 2 = 0 then 'on-site' when s_suppkey % 3 = 0 then 'remote' end as remote, 'Full-time' as kind, '$1 - $2' as salary, 'One' || chr(10) || chr(10) || 'Two' as description from ({_BOARD}) where s_suppkey % 9 <> 0 and s_suppkey % 4 <> 0""")
def s3_ashby(read):
    f = F.col("fields")
    got = feeds.read_feeds(_payloads(read, "ashby"), "ashby")
    return got.select("recording_id", "item_idx", f["title"].alias("title"), f["location"].alias("location"), F.try_element_at(f, F.lit("remote")).alias("remote"), f["employmentType"].alias("kind"), f["salaryText"].alias("salary"), f["description"].alias("description"))


@query(f"select cast(s_nationkey as varchar) as recording_id, cast(i as integer) as item_idx, 'title: missing or empty' as reason from ({_BOARD}) where s_suppkey % 9 = 0")
def s6_quarantined(read):
    return feeds.quarantined_entries(_payloads(read, "greenhouse"), "greenhouse").select("recording_id", "item_idx", "reason")


@query("select distinct cast(s_nationkey as varchar) as recording_id, 'unexpected shape' as reason from supplier where s_nationkey % 7 = 3")
def s7_shape_errors(read):
    return feeds.feed_shape_errors(_payloads(read, "ashby"), "ashby").select("recording_id", "reason")


@query("select cast(s_nationkey as varchar) as recording_id, count(*) as records from supplier where s_nationkey % 7 <> 3 group by 1")
def d7_registered_adapter(read):
    """A provider that comes with its own reader: entries are names only."""

    def names(payloads):
        return payloads.select("recording_id", F.posexplode(F.from_json("body", "array<struct<id: string, text: string>>")).alias("item_idx", "entry"))

    feeds.register_adapter("names", names)
    return feeds.read_feeds(_payloads(read, "lever").where("recording_id % 7 <> 3"), "names").groupBy("recording_id").agg(F.count("*").alias("records"))


@query("""select s_suppkey, case s_suppkey % 3 when 0 then 'https://boards-api.greenhouse.io/v1/boards/a%20b' || s_suppkey || '/jobs?content=true&pay_transparency=true' when 1 then 'https://api.lever.co/v0/postings/a%20b' || s_suppkey || '?mode=json' else 'https://api.ashbyhq.com/posting-api/job-board/a%20b' || s_suppkey || '?includeCompensation=true' end as feed_url from supplier""")
def s8_feed_urls(read):
    k = F.col("s_suppkey")
    provider = F.when(k % 3 == 0, "greenhouse").when(k % 3 == 1, "lever").otherwise("ashby")
    return read("supplier").select("s_suppkey", feeds.feed_url(provider, F.concat(F.lit("a b"), k.cast("string"))).alias("feed_url"))


@query(f"""select src, count(*) as records from (select 'feed' as src from ({_BOARD}) where s_suppkey % 9 <> 0 union all select 'page' from pages) group by src""")
def u1_union_sources(read):
    feed = feeds.read_greenhouse(_payloads(read, "greenhouse")).withColumn("src", F.lit("feed"))
    pages = _raw_pages(read).withColumn("item_idx", F.col("item_idx").cast("int")).withColumn("src", F.lit("page"))
    return feeds.union_sources(feed, pages).groupBy("src").agg(F.count("*").alias("records"))


# --- search, on documents as postings


def _jobs(read):
    d = read("documents")
    return d.select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("job_seq"), F.col("source").alias("recording_id"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("company"), F.col("lang").alias("location"), F.col("text").alias("description"), F.when(F.col("doc_id") % 3 == 0, "remote").otherwise("onsite").alias("remote"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 97 * 3600).alias("first_seen_at"), F.when(F.col("doc_id") % 4 == 0, F.timestamp_seconds(F.lit(1_700_500_000))).alias("closed_at"))


_FOLDED = r"strip_accents(lower(text))"


@query(rf"select doc_id as job_id from documents where regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])the') and regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])er')")
def f2_search_words(read):
    return search.search_jobs(_jobs(read), "THE ér").select("job_id")


@query(rf"select doc_id as job_id from documents where regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])public[^\p{{L}}\p{{N}}]+license') and regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])gen')")
def f2_search_phrase(read):
    return search.search_jobs(_jobs(read), "Public-Licen gén").select("job_id")


@query(rf"select doc_id as job_id from documents where regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])of[^\p{{L}}\p{{N}}]+th') and regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])er') and regexp_matches({_FOLDED}, '(^|[^\p{{L}}\p{{N}}])t')")
def f3_refreshed_index(read):
    """A stored index of older texts, taken in anew in two parts, some of them removed and put back, and merged: the same hits as without one."""
    jobs = _jobs(read)
    index = search.SearchIndex(jobs.sparkSession, f"{shared_dir(jobs.sparkSession)}/index-{uuid.uuid4().hex}")
    index.refresh(jobs.withColumn("description", F.lit("of the er at first")))
    index.refresh(jobs.where("job_id % 2 = 0"))
    index.merge()
    index.refresh(jobs.where("job_id % 2 = 1"))
    index.remove(jobs.where("job_id % 5 = 0"))
    index.refresh(jobs.where("job_id % 5 = 0"))
    return search.search_jobs(jobs, "Of-th ér T", index=index).select("job_id")


_SEEN = "to_timestamp(1700000000 + doc_id % 97 * 3600)::timestamp"


@query("select doc_id as job_id from documents where doc_id % 4 <> 0 and doc_id % 3 = 0 and source = 'src3' and 1700000000 + doc_id % 97 * 3600 >= epoch(timestamp '2023-11-15') and 1700000000 + doc_id % 97 * 3600 < epoch(timestamp '2023-11-18')")
def f1_filtered(read):
    from datetime import datetime

    return search.filter_jobs(_jobs(read), recording="src3", remote="remote", since=datetime(2023, 11, 15), until=datetime(2023, 11, 18)).select("job_id")


@query("select count(*) as total from documents where doc_id % 4 <> 0")
def a1_count(read):
    return search.count_jobs(search.filter_jobs(_jobs(read)))


@query("select doc_id as job_id from documents order by doc_id % 97 desc, doc_id desc limit 50 offset 100")
def o1_page_of_jobs(read):
    return search.list_jobs(_jobs(read), page=3).select("job_id")


@query("select s_suppkey, s_name, 'found' as status from supplier where s_name = (select s_name from supplier order by s_suppkey limit 1)")
def f8_resolved_ref(read):
    suppliers = read("supplier").withColumn("id", F.concat(F.lit("sup_"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")))
    first = suppliers.orderBy("s_suppkey").limit(1).select(F.upper("s_name")).first()
    return search.resolve_ref(suppliers, first[0] if first else "", name="s_name").select("s_suppkey", "s_name", "status")


# the newest rows of an export (its limit is a feature) as lines of the file; a line feed inside a title is no line's end
@query(r"""select case when regexp_matches(g, '[",\n\r]') then '"' || replace(g, '"', '""') || '"' else g end || ',' || source || ',' || lang || ',' || case when doc_id % 3 = 0 then 'remote' else 'onsite' end || ',,,,,,,,' || doc_id || ',,,,' || source as line
from (select *, case when regexp_matches(t, '^[=+\-@\t\r]') then '''' || t else t end as g from (select *, text[1:60] as t from documents) order by doc_id % 97 desc, doc_id desc limit 5000)
union all select 'title,company,location,remote,salaryText,salaryMin,salaryMax,salaryCurrency,salaryPeriod,employmentType,postedAt,url,firstSeenAt,lastSeenAt,closedAt,recordingId'""")
def s9_csv_lines(read):
    from tidemark.sources import sinks

    jobs = _jobs(read)
    full = jobs.withColumns({c: F.lit(None).cast("string") for c in sinks.EXPORT_COLUMNS if c not in jobs.columns}).withColumn("url", F.col("job_seq").cast("string"))
    path = f"{shared_dir(jobs.sparkSession)}/query-{uuid.uuid4().hex}"
    # times are left out of the comparison, not of the order
    sinks.write_jobs_csv(full, path, limit=5000, blank=("first_seen_at", "closed_at"))
    return jobs.sparkSession.read.option("lineSep", "\r\n").text(path).select(F.col("value").alias("line"))


@query(f"""select page_id, {_ORIGIN} || '/up' as above, {_ORIGIN} || '/jobs/' || page_id || '?a=1' as rooted, {_ORIGIN} || {_PATH} || '?next' as asked, cast(null as varchar) as mail from pages""")
def c6_absolute_urls(read):
    url, own = F.col("url"), F.col("page_id").cast("string")
    origin = F.regexp_extract(url, r"^(https?://[^/]+)", 1)
    return read("pages").select("page_id", urls.absolute_url(F.lit("../up"), F.concat(origin, F.lit("/a/b"))).alias("above"), urls.absolute_url(F.concat(F.lit(" /jobs/"), own, F.lit("?a=1")), url).alias("rooted"), urls.absolute_url(F.lit("?next"), url).alias("asked"), urls.absolute_url(F.lit("mailto:x@y.example"), url).alias("mail"))


# whole texts with some letters written as references, decimal and hexadecimal, and whole pages with the references that they hold
@query(r"""select doc_id as id, 'text' as kind, text as decoded from documents union all select page_id, 'page', replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') from pages""")
def c4_decoded_entities(read):
    coded = F.replace(F.replace(F.replace("text", F.lit("e"), F.lit("&#101;")), F.lit("a"), F.lit("&#x61;")), F.lit("é"), F.lit("&#xE9;"))
    both = read("documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), coded.alias("t")).unionByName(read("pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("t")))
    return both.select("id", "kind", text.decode_entities(F.col("t")).alias("decoded"))


@query("select doc_id, case when doc_id % 2 = 0 then ['lang', 'source'] else ['source'] end as names from documents")
def f6_compact_fields(read):
    d = read("documents")
    fields = normalize.compact_fields(F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("source"), F.col("source"), F.lit("empty"), F.lit("")))
    return d.select("doc_id", F.array_sort(F.map_keys(fields)).alias("names"))


# the hash is of JSON text with the columns and the sorted custom fields, nulls included
@query(r"""select page_id, sha256('{"title":' || to_json(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) || ',"custom":[{"key":"a","value":null},{"key":"b","value":"' || page_id % 3 || '"}]}') as content_hash from pages""")
def c13_content_hashes(read):
    rows = read("pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.create_map(F.lit("b"), (F.col("page_id") % 3).cast("string"), F.lit("a"), F.lit(None).cast("string")).alias("custom"))
    return rows.select("page_id", normalize.content_hash(F.col("custom"), ["title"]).alias("content_hash"))


@query("select doc_id as job_seq, source as recording_id from documents order by doc_id % 97 desc, doc_id desc limit 200")
def s10_json_export(read):
    from tidemark.sources import sinks

    jobs = _jobs(read)
    full = jobs.withColumns({c: F.lit(None).cast("string") for c in sinks.EXPORT_COLUMNS if c not in jobs.columns}).withColumn("url", F.col("job_seq").cast("string"))
    path = f"{shared_dir(jobs.sparkSession)}/query-{uuid.uuid4().hex}"
    sinks.write_jobs_json(full, path, limit=200)
    return jobs.sparkSession.read.schema("url string, recordingId string").json(path).select(F.col("url").cast("long").alias("job_seq"), F.col("recordingId").alias("recording_id"))
