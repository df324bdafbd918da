"""URL filtering by rules and by trust and distrust that spread over links between hosts.

Rules name a host and a path beginning; the longest that fits decides. Other URLs
are judged by their host: personalised PageRank spreads trust from hosts with
allowed pages along links, and distrust from hosts with blocked pages against the
links (a host that links to bad ones is suspect). A host is blocked if its
distrust, in shares of all distrust, exceeds its share of trust.

All of it is DataFrame operations. Links, seeds and ranks have a row for each host
or pair of hosts, never one for each link of a page.

A host without links passes its mass back to the seeds of its kind, so that trust
and distrust keep a sum of 1 each and their shares can be compared. Rounds go on
until no rank can change by more than the tolerance.

Defined cases: a URL that is null or without :// has an empty host and path and
fits no rule; the empty host is no node and is allowed, as is every host that
neither trust nor distrust reaches. Links without a host are links to the page's
own host and carry nothing.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule of (verdict, 'host/path') that fits, and its verdict; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """a, b, n: links of pages of host a to another host b."""
    href = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^\s"'>]+)"""
    links = pages.select(host(F.col(url)).alias("a"), F.explode(F.regexp_extract_all(F.col(html), F.lit(href), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return links.select("a", host(to).alias("b")).where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Personalised PageRank of every kind of seeds(kind, node, mass) over links(kind, a, b, share), as a written table.

    share: of a's mass that goes to b. Each kind's mass sums to 1, at the start and
    always. Ends as soon as four rounds change a kind's masses by less than the
    tolerance in all, and at last when damping alone makes any change smaller.
    """
    with Scratch(seeds.sparkSession) as scratch:
        rank = seeds
        for _ in range(ceil(log(tolerance / 2) / log(damping) / 4)):
            before = rank
            for _ in range(4):
                moved = rank.join(links, (rank.kind == links.kind) & (rank.node == links.a)).select(rank.kind, F.col("b").alias("node"), (F.col("mass") * F.col("share") * damping).alias("mass"))
                moved = moved.groupBy("kind", "node").agg(F.sum("mass").alias("mass"))
                # what the links don't carry goes to the seeds: a row for each kind, so it may be broadcast
                carried = moved.groupBy(F.col("kind").alias("of")).agg(F.sum("mass").alias("carried"))
                back = seeds.join(F.broadcast(carried), F.col("kind") == F.col("of"), "left").select("kind", "node", (F.col("mass") * (1 - F.coalesce("carried", F.lit(0.0)))).alias("mass"))
                rank = moved.unionByName(back).groupBy("kind", "node").agg(F.sum("mass").alias("mass"))
            rank = scratch.written(rank, "ranks")
            change = rank.unionByName(before.withColumn("mass", -F.col("mass"))).groupBy("kind", "node").agg(F.sum("mass").alias("by"))
            if not change.groupBy("kind").agg(F.sum(F.abs("by")).alias("by")).where(F.col("by") > tolerance).take(1):
                break
        return written(rank, "ranks")


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, key: str = "page_id", url: str = "url", html: str = "html", damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """key, host, path, rule and verdict of every page."""
    parsed = pages.select(F.col(key).alias("__key"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "says": says})

    by_host = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("says") == "allow").alias("allow"), F.count_if(F.col("says") == "block").alias("block"))
    seeds = written(by_host.selectExpr("host as node", "stack(2, 'trust', allow, 'distrust', block) as (kind, n)").where("n > 0"), "seeds")
    totals = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = seeds.join(F.broadcast(totals), "kind").select("kind", "node", (F.col("n") / F.col("total")).alias("mass"))

    found = host_links(pages, url=url, html=html)
    ways = written(found.select(F.lit("trust").alias("kind"), "a", "b", "n").unionByName(found.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n")), "links")
    out = ways.groupBy("kind", "a").agg(F.sum("n").alias("out"))
    ranks = spread(written(seeds, "seeds"), written(ways.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("out")).alias("share")), "shares"), damping=damping, tolerance=tolerance)
    hosts = ranks.groupBy("node").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust"))
    bad = hosts.where(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0))).select(F.col("node").alias("host"), F.lit("block").alias("by_links"))
    return ruled.join(bad, "host", "left").select(F.col("__key").alias(key), "host", "path", "rule", F.coalesce("says", "by_links", F.lit("allow")).alias("verdict"))
