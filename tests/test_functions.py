"""Literal tables for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import money_dates, text, urls


def now():
    return F.lit("2026-10-06 15:30:00").cast("timestamp")


def run(spark, rows, make, schema="s string"):
    """make(columns of the row) for each row, in one DataFrame."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"__i int, {schema}")
    return [r.v for r in df.select("__i", make(*(F.col(c) for c in df.columns[1:])).alias("v")).orderBy("__i").collect()]


def test_white_space(spark):
    assert run(spark, ["\tNight shift\r\n  baker\u00a0", "\u3000x\ufeffy\u2003", " \n", None], text.clean_line) == ["Night shift baker", "x y", None, None]
    assert run(spark, ["first\u00a0 line\t\r\n \r\n\r\n\n\n  second \x0b line\n", "\r\n\u2028"], text.clean_block) == ["first line\n\nsecond line", None]


def test_entities_and_html(spark):
    raw = ["&amp;lt; &#8211; &#x2014; &nope; &#0; &AMP; &euro;", "no reference", None, "&#1114112; &amp"]
    assert run(spark, raw, text.decode_entities) == ["&lt; – — &nope; &#0; & €", "no reference", None, "&#1114112; &amp"]
    pages = ["<p>One<br/>two</p><!-- x --><script>bad()</script><ul><li>a</li><li class='q'>b &amp; c</li></ul>", "plain", "<style>p{}</style><h1>T</h1><p>x</p>"]
    assert run(spark, pages, text.html_to_text) == ["One\ntwo\n\n- a\n- b & c", "plain", "T\n\nx"]


def test_regex_and_similarity(spark):
    assert run(spark, ["ref. K-902/b of May", "none here"], lambda s: text.regex_extract_first(s, r"K-(\d+)/")) == ["902", None]
    assert run(spark, ["ref. K-902/b of May"], lambda s: text.regex_extract_first(s, r"K-\d+/[a-z]")) == ["K-902/b"]
    pairs = [("Apply now", "apply NOW"), ("a b", "b c"), ("", "x"), ("one", "two")]
    assert run(spark, pairs, text.text_similarity, "a string, b string") == [1.0, 0.5, 0.0, 0.0]
    assert run(spark, ["FullTime", "PartTimeJob", "x", None], text.hyphen_case) == ["Full-time", "Part-time-job", "x", None]
    assert run(spark, ["Café Ångström", "ABC", None], text.fold_accents) == ["cafe angstrom", "abc", None]


def test_csv_cell_and_reason(spark):
    cells = ["plain", "a,b", 'say "hi"', "=1+1", "-x", "@a,b", "two\nlines", None, "", "\tx"]
    assert run(spark, cells, text.csv_cell) == ["plain", '"a,b"', '"say ""hi"""', "'=1+1", "'-x", '"\'@a,b"', '"two\nlines"', "", "", "'\tx"]
    assert run(spark, ["bot_wall", "some_new_code", None], text.reason_text) == [text.REASONS["bot_wall"], "some new code", ""]


def test_scrub_html(spark):
    got = run(spark, ['<script>x</script><input type="text" value="secret" checked><textarea>mine</textarea><div contenteditable="true">typed</div><p>kept</p>'], text.scrub_html)[0]
    nested = ['<div contenteditable="true"><div>line one</div>my typed secret</div><p>kept</p>', "<b CONTENTEDITABLE=''><b>a</b><i>typed</i></b><p>kept</p>", '<div contenteditable>typed <p>kept', '<div contenteditable="false">kept</div>', "<!-- <div contenteditable> --><p>kept</p>", "<textarea>typed", None]
    told = run(spark, nested, text.scrub_html)
    assert all("typed" not in x and "secret" not in x for x in told[:6]) and "kept" in told[0] and "kept" in told[3] and "kept" in told[4] and "kept" not in told[2] and told[6] is None
    assert "secret" not in got and "mine" not in got and "typed" not in got and "<script" not in got and "checked" not in got and "<p>kept</p>" in got


#: rule, URL, canonical form
CANONICAL = [
    ("host in lower case, path as it is", "HTTPS://Boards.Tern.Example/Open/Role-7", "https://boards.tern.example/Open/Role-7"),
    ("no slash at the end", "http://tern.example/open///", "http://tern.example/open"),
    ("a root keeps its slash", "https://tern.example", "https://tern.example/"),
    ("tracking goes, the rest stays", "https://tern.example/r?page=4&utm_medium=mail&fbclid=z9", "https://tern.example/r?page=4"),
    ("nothing but tracking", "https://tern.example/r?gclid=1&mc_eid=2&ref=3", "https://tern.example/r"),
    ("parameters sorted, fragment gone", "https://tern.example/r?z=1&k=2#top", "https://tern.example/r?k=2&z=1"),
    ("the scheme's own port", "http://tern.example:80/r", "http://tern.example/r"),
    ("no user or password", "https://me:pass@tern.example/r", "https://tern.example/r"),
    ("another scheme", "tel:+4912345", None),
    ("no address", "see below", None),
    ("null", None, None),
]


def test_urls(spark):
    assert {r[0]: g for r, g in zip(CANONICAL, run(spark, [r[1] for r in CANONICAL], urls.canonicalize_url))} == {r[0]: r[2] for r in CANONICAL}
    bases = [("/open/9?utm_term=q", "https://x.example/list?page=2", "https://x.example/open/9"), ("../a", "https://x.example/b/c", "https://x.example/a"), ("?q=1", "https://x.example/b/c", "https://x.example/b/c?q=1")]
    assert run(spark, [b[:2] for b in bases], urls.canonicalize_url, "v string, b string") == [b[2] for b in bases]
    assert run(spark, ["https://X.example/a?b#c", "x"], urls.publicise_url) == ["https://x.example/a", ""]
    assert run(spark, ["https://X.example/a", "x", None], urls.domain_of) == ["x.example", "", ""]


def test_patterns(spark):
    rows = ["https://x.example/jobs/123", "https://x.example/jobs", "https://x.example/jobs?q=a", "https://x.example/a#part", "https://x.example/", "nothing"]
    assert run(spark, rows, urls.url_wait_pattern) == ["**/jobs/*", "**/jobs*", "**/jobs?*", "**/a#**", "**/*", None]
    globs = [("**/jobs/*", "https://x.example/jobs/1", True), ("**/jobs/*", "https://x.example/jobs/1/2", False), ("**/jobs?*", "https://x.example/jobs?q=1", True), ("**/a.b", "https://x/aXb", False)]
    assert run(spark, [g[:2] for g in globs], urls.glob_matches, "p string, u string") == [g[2] for g in globs]


def test_waiting_times(spark):
    headers = ["30", "0.5", "Tue, 06 Oct 2026 15:30:10 GMT", "Tue, 06 Oct 2026 15:00:00 GMT", "soon", None]
    assert run(spark, headers, lambda s: money_dates.retry_after_ms(s, now())) == [30000, 500, 10000, 0, None, None]
    since = run(spark, ["36h", "7D", "2w", "2026-01-02", "x"], lambda s: money_dates.parse_since(s, now()))
    assert since == [dt.datetime(2026, 10, 5, 3, 30), dt.datetime(2026, 9, 29, 15, 30), dt.datetime(2026, 9, 22, 15, 30), dt.datetime(2026, 1, 2), None]


def test_described_schedules(spark):
    from tidemark.functions import cron

    told = {"*/7 * * * *": "Every 7 minutes", "4 * * * *": "Every hour at :04", "30 */6 * * *": "Every 6 hours at :30", "5 7,19 * * *": "Every day at 07:05 and 19:05", "0 9 * * 1-5": "Weekdays at 09:00", "0 9 * * 6,0": "Weekends at 09:00", "15 8 * * 2,4,7": "Tuesdays, Thursdays and Sundays at 08:15",
        "0 6 1,15 * *": "On day 1 and 15 of every month at 06:00", "0 6 1 * 2": "Custom schedule (0 6 1 * 2)", "0 6 * 3 *": "Custom schedule (0 6 * 3 *)", "0 9 * * 8": "Custom schedule (0 9 * * 8)", "a * * * *": "Custom schedule (a * * * *)"}
    got = run(spark, [(c, None) for c in told] + [("  4   * * * * ", "Asia/Tokyo")], cron.describe_cron, "c string, z string")
    assert got == [f"{v} UTC" for v in told.values()] + ["Every hour at :04 Asia/Tokyo"]
