"""What may be fetched: robots.txt, bot walls, answers of servers, delays.

robots: origin, status (null: no answer), body, fetched_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import url_origin
from tidemark.operators import ordered

CACHED_HOURS = 24
BODY_CHARS = 500_000
LONGEST_DELAY_MS = 30_000


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, field, value, allow, crawl_delay: the lines that hold for an agent.

    Each body is read once per origin. Consecutive user-agent lines share a group;
    the groups that name the agent's product are taken, else those of *.
    """
    product = agent.split("/")[0].lower()
    lines = F.split(F.substring("body", 1, BODY_CHARS), r"\r\n?|\n")
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = robots.where("status between 200 and 299").select("origin", F.posexplode(lines).alias("i", "line")).select("origin", "i", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("origin").orderBy("i")
    is_agent = F.col("field") == "user-agent"
    begins = is_agent & ~F.coalesce(F.lag("field").over(w) == "user-agent", F.lit(False))
    grouped = rows.withColumn("group", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_group = Window.partitionBy("origin", "group")
    name = F.lower(F.substring_index("value", "/", 1))
    ranked = grouped.withColumn("rank", F.max(F.when(is_agent & (name == product), 2).when(is_agent & (name == "*"), 1).otherwise(0)).over(of_group))
    best = ranked.withColumn("best", F.max("rank").over(Window.partitionBy("origin"))).where("rank > 0 and rank = best and field <> 'user-agent'")
    return best.select("origin", "field", "value", (F.col("field") == "allow").alias("allow"), F.when(F.col("field") == "crawl-delay", F.col("value").try_cast("double")).alias("crawl_delay"))


def _goes_on(target: Column, rule: Column) -> Column:
    """Whether a target that begins with a rule's literal start fits the rest of it: parts between stars, each behind the one before, and an end."""
    parts = rule["rest"]
    middle = F.slice(parts, 1, F.size(parts) - rule["anchored"].cast("int"))

    def further(at: Column, part: Column) -> Column:  # 0: not found
        found = F.when(part == "", at).otherwise(F.call_function("locate", part, target, at))
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(part))

    behind = F.aggregate(middle, F.length(rule["start"]) + 1, further)
    last = F.element_at(parts, -1)
    ended = target.endswith(last) & (F.length(target) - F.length(last) + 1 >= behind)
    return F.when(~rule["anchored"], behind > 0).when(F.size(parts) == 0, target == rule["start"]).otherwise((behind > 0) & ended)


def _decided(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """url, by_rule: what the longest rule that fits says, allow before disallow.

    Rules are one row for each origin and literal start (what is before the first
    star), longest rule first. A URL looks up those of its own beginnings that have the
    length of some start, so its cost follows the number of different lengths, not of
    rules; only rules with stars under one start are tried one by one.
    """
    plain = F.regexp_replace("value", r"\$$", "")
    parts = F.split(plain, r"\*")
    rule = F.struct(F.length("value").alias("length"), "allow", F.element_at(parts, 1).alias("start"), F.slice(parts, 2, F.size(parts)).alias("rest"), F.col("value").endswith("$").alias("anchored"))
    started = rules.where("field <> 'crawl-delay' and value <> ''").select("origin", rule.alias("rule")).withColumn("start", F.col("rule.start"))
    at_start = started.groupBy("origin", "start").agg(F.sort_array(F.collect_set("rule"), asc=False).alias("rules"))
    lengths = started.groupBy("origin").agg(F.collect_set(F.length("start")).alias("lengths"))
    own = F.explode(F.filter("lengths", lambda n: n <= F.length("target")))
    tried = asked.join(lengths, "origin").select("url", "origin", "target", own.alias("n")).withColumn("start", F.substring("target", F.lit(1), F.col("n"))).join(at_start, ["origin", "start"])
    first = F.aggregate("rules", F.lit(None).cast("struct<length: int, allow: boolean>"), lambda found, r: F.when(found.isNotNull(), found).otherwise(F.when(_goes_on(F.col("target"), r), F.struct(r["length"].alias("length"), r["allow"].alias("allow")))))
    fits = tried.select("url", first.alias("rule")).where("rule is not null")
    return fits.groupBy("url").agg(F.max_by("rule.allow", "rule").alias("by_rule"))


def robots_verdict(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """url, allowed, crawl_delay_ms and reason of every different URL.

    4xx: no rules, allowed. 5xx or no answer: the site is off limits. Else the
    longest rule that fits decides, allow before disallow. What is no http(s) URL,
    and an origin that robots doesn't hold, is allowed.
    """
    asked = urls.select(F.col(url).alias("url")).distinct().withColumns({"origin": url_origin(F.col("url"))})
    target = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    asked = asked.withColumn("target", F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)))
    rules = robots_rules(robots, agent)
    decided = _decided(asked, rules)
    delays = rules.where("crawl_delay > 0").groupBy("origin").agg(F.min("crawl_delay").alias("delay"))
    known = asked.join(robots.select("origin", "status", F.lit(True).alias("asked")), "origin", "left").join(delays, "origin", "left").join(decided, "url", "left")
    unreachable = F.col("asked") & (F.col("status").isNull() | (F.col("status") >= 500))
    allowed = F.when(unreachable, False).otherwise(F.coalesce("by_rule", F.lit(True)))
    allowed = F.coalesce(allowed, F.lit(True))
    reason = F.when(~allowed, F.when(F.coalesce(unreachable, F.lit(False)), F.concat("origin", F.lit("/robots.txt could not be retrieved"))).otherwise(F.concat("origin", F.lit("/robots.txt disallows "), "target")))
    return known.select("url", allowed.alias("allowed"), F.when(allowed, (F.col("delay") * 1000).cast("long")).alias("crawl_delay_ms"), reason.alias("reason"))


def effective_delay(least: Column, most: Column, crawl_delay: Column) -> tuple[Column, Column]:
    """Least and most delay: the least not under the crawl delay (30 s of it at most), the most not under the least."""
    low = F.greatest(least, F.least(F.coalesce(crawl_delay, F.lit(0)), F.lit(LONGEST_DELAY_MS)))
    return low, F.greatest(most, low)


def robots_cache_asof(checks: DataFrame, fetches: DataFrame) -> DataFrame:
    """checks(origin, ts) with the body that was cached then; null where it has to be fetched.

    An as-of join: the last fetch up to the check, if no older than 24 hours; an
    answer that could not be had is never cached.
    """
    good = fetches.where("status < 500").select("origin", F.col("fetched_at").alias("ts"), F.struct("body", "status", "fetched_at").alias("got"), F.lit(0).alias("order"))
    asked = checks.select("origin", "ts", F.lit(None).cast(good.schema["got"].dataType).alias("got"), F.lit(1).alias("order"))
    # a day of an origin is a task of its own; a fetch and a check at one time: the fetch first
    last = ordered.carried(good.unionByName(asked), ["origin"], ["ts", "order"], F.date_trunc("day", "ts"), F.col("got"), "last").where("order = 1")
    fresh = F.col("ts") <= F.col("last.fetched_at") + F.expr(f"interval {CACHED_HOURS} hours")
    return last.select("origin", "ts", F.when(fresh, F.col("last.body")).alias("body"), F.coalesce(fresh, F.lit(False)).alias("cached"))


def classify_response(kind: Column, status: Column, retry_after: Column, attempt: Column) -> Column:
    """struct(action, wait_ms, code) for an answer to a feed or page request; attempts count from 0.

    retry_after is in milliseconds, null without the header.
    """
    wait = F.coalesce(retry_after, F.lit(2000).cast("long"))
    feed_again = status.isin(429, 503) & (attempt < 2) & (wait <= 60_000)
    page_again = (status == 429) & (attempt < 1) & (F.coalesce(retry_after, F.lit(60_001)) <= 60_000)
    again = F.when(kind == "feed", feed_again).otherwise(page_again)
    ok = (status >= 200) & (status < 300)
    code = F.when(ok, F.lit(None)).when(status.isin(403, 429), "BOT_WALL").when((kind == "feed") & (status == 404), "NOT_FOUND").otherwise("NAVIGATION_FAILED")
    again = F.coalesce(again, F.lit(False))
    return F.struct(
        F.when(again, "retry").when(ok, "ok").when(status.isin(403, 429), "blocked").otherwise("fail").alias("action"),
        F.when(again, F.when(kind == "feed", wait).otherwise(retry_after)).alias("wait_ms"),
        F.when(~again, code).alias("code"),
    )


# What gives a bot wall away.
BOT_WALL = {
    "titles": ["^just a moment", "attention required", "^access denied", "pardon our interruption", "are you a (robot|human)", "security check(point)?$", "^verif(y|ying) (you are|that you('| a)re) (a )?human", "^robot check", "bot verification"],
    "frames": [r"/recaptcha/(api2|enterprise)/bframe", r"hcaptcha\.com/.*challenge", r"geo\.captcha-delivery\.com"],
    "widgets": [r"(google\.com|recaptcha\.net)/recaptcha/", r"hcaptcha\.com", r"challenges\.cloudflare\.com", r"captcha-delivery\.com", r"arkoselabs\.com|funcaptcha\.com", "px-captcha|perimeterx"],
    "phrases": ["verify (that )?you are (a )?human", "checking (if the site connection is secure|your browser)", "needs to review the security of your connection", "unusual traffic from your (computer )?network", "enable javascript and cookies to continue", "press (and|&) hold", "prove you('| a)re not a robot", "complete the security check"],
}
SPARSE_TEXT = 1500


def detect_bot_wall(title: Column, text: Column, text_length: Column, frames: Column, markers: Column, rules: dict[str, list[str]] = BOT_WALL, sparse: int = SPARSE_TEXT) -> Column:
    """What gives a page away as a bot wall; null if it is none."""
    some = lambda name: "(?i)" + "|".join(f"(?:{p})" for p in rules[name])
    empty = F.array().cast("array<string>")
    frames, markers, title = F.coalesce(frames, empty), F.coalesce(markers, empty), F.trim(F.coalesce(title, F.lit("")))
    active = F.filter(frames, lambda u: u.rlike(some("frames")))
    host = F.coalesce(F.lower(F.try_parse_url(F.try_element_at(active, F.lit(1)), F.lit("HOST"))), F.lit(""))
    phrase = F.coalesce(*(F.when(text.rlike(f"(?i){p}"), F.regexp_extract(text, f"(?i){p}", 0)) for p in rules["phrases"]))
    return (
        F.when(title.rlike(some("titles")), F.concat(F.lit('page title "'), title, F.lit('"')))
        .when(F.size(active) > 0, F.concat(F.lit("an active CAPTCHA challenge ("), host, F.lit(")")))
        .when(text_length >= sparse, F.lit(None))
        .when(F.exists(F.concat(frames, markers), lambda u: u.rlike(some("widgets"))), F.lit("a CAPTCHA on an otherwise empty page"))
        .when(phrase.isNotNull(), F.concat(F.lit("challenge wording ("), phrase, F.lit(")")))
    )
