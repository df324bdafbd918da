"""Elements found again by what is known of them, when a page's locators fail.

A fingerprint is an element's tag, the beginning of its text, its telling attributes
and its ancestors, nearest first. On a changed page the elements that share a rare
enough token with it (an attribute, a class, a word, or its tag under its parent's)
are compared with it; the best one is it if it is like enough and clearly ahead of the
second. Nothing is guessed: without a margin there is no winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import let, text_similarity, words
from tidemark.operators import discover, extract
from tidemark.operators.extract import Page

#: Attributes of a fingerprint, and what an equal one weighs.
WEIGHTS = {"data-testid": 4.0, "id": 4.0, "name": 3.0, "aria-label": 3.0, "placeholder": 2.0, "href": 2.0, "role": 1.0, "type": 1.0}
#: What the tag, the text, the classes and the ancestors weigh; how much less each further ancestor does.
TAG, TEXT, CLASSES, TRAIL, FURTHER = 2.0, 3.0, 1.0, 3.0, 0.8
SAME_WORDS = 0.8
TEXT_CHARS, ANCESTORS, MOST_LEVELS = 200, 5, 4


def _fingerprint(of: Page, node: Column) -> Column:
    """tag, text, attrs, classes and trail of an element."""
    attrs = F.map_filter(node["attrs"], lambda k, v: k.isin(*WEIGHTS) & (v != ""))
    trail = F.array_compact(F.array(*(F.when(a.isNotNull(), F.concat_ws(".", F.array(a["tag"]), F.slice(discover.stable_classes(a), 1, 2))) for a in discover._above(of, node, ANCESTORS))))
    return F.struct(node["tag"].alias("tag"), F.substring(extract.text_of(of, node), 1, TEXT_CHARS).alias("text"), F.transform_values(attrs, lambda k, v: F.substring(v, 1, TEXT_CHARS)).alias("attrs"), discover.stable_classes(node).alias("classes"), trail.alias("trail"))


def fingerprints_of(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (page_id, node, and what else there is) with the fingerprint of each element."""
    of = extract.page()
    kept = [c for c in wanted.columns if c != "page_id"]
    found = extract.with_nodes(pages).join(wanted, "page_id").withColumn("__n", F.try_element_at("nodes", F.col("node") + 1)).where("__n is not null")
    return found.select("page_id", *kept, _fingerprint(of, F.col("__n")).alias("fingerprint"))


def _tokens(f: Column) -> Column:
    """What a fingerprint can be looked up by."""
    attrs = F.transform(F.map_entries(f["attrs"]), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    around = F.concat(F.lit(">"), F.coalesce(F.substring_index(F.try_element_at(f["trail"], F.lit(1)), ".", 1), F.lit("")), F.lit(">"), f["tag"])
    return F.array_distinct(F.concat(attrs, F.transform(f["classes"], lambda c: F.concat(F.lit("."), c)), F.transform(words(f["text"]), lambda w: F.concat(F.lit(" "), w)), F.array(around)))


def _trail_likeness(a: Column, b: Column) -> Column:
    """How well two rows of ancestors agree, the near ones more, whichever of them has one ancestor more at its begin; a tag alone is half."""

    def along(x: Column, y: Column) -> Column:
        alike = F.zip_with(x, y, lambda p, q: F.coalesce(F.when(p == q, 1.0).when(F.substring_index(p, ".", 1) == F.substring_index(q, ".", 1), 0.5), F.lit(0.0)))
        return F.aggregate(alike, F.struct(F.lit(0.0).alias("got"), F.lit(1.0).alias("weight")), lambda s, v: F.struct((s["got"] + v * s["weight"]).alias("got"), (s["weight"] * FURTHER).alias("weight")), lambda s: s["got"])

    rest = lambda x: F.slice(x, 2, ANCESTORS)
    most = F.aggregate(a, F.struct(F.lit(0.0).alias("got"), F.lit(1.0).alias("weight")), lambda s, _: F.struct((s["got"] + s["weight"]).alias("got"), (s["weight"] * FURTHER).alias("weight")), lambda s: s["got"])
    best = F.greatest(along(a, b), FURTHER * along(a, rest(b)), FURTHER * along(rest(a), b))
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.least(best / most, F.lit(1.0)))


def likeness(known: Column, now: Column) -> Column:
    """From 0 to 1: the share of what is known of an element that another one has."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    total = lambda entries: F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.element_at(weight, e["key"]))
    entries = F.map_entries(known["attrs"])
    same = F.filter(entries, lambda e: F.coalesce(F.try_element_at(now["attrs"], e["key"]) == e["value"], F.lit(False)))
    said, classed = known["text"] != "", F.size(known["classes"]) > 0
    classes = F.size(F.array_intersect(known["classes"], now["classes"])) / F.greatest(F.size(F.array_union(known["classes"], now["classes"])), F.lit(1))
    # the same text is worth more than the same words
    text = F.when(known["text"] == now["text"], 1.0).otherwise(SAME_WORDS * text_similarity(known["text"], now["text"]))
    got = F.when(known["tag"] == now["tag"], TAG).otherwise(0.0) + total(same) + F.when(said, TEXT * text).otherwise(0.0) + F.when(classed, CLASSES * classes).otherwise(0.0) + TRAIL * _trail_likeness(known["trail"], now["trail"])
    return got / (F.lit(TAG + TRAIL) + total(entries) + F.when(said, TEXT).otherwise(0.0) + F.when(classed, CLASSES).otherwise(0.0))


def heal(pages: DataFrame, fingerprints: DataFrame, least: float = 0.5, margin: float = 0.08) -> DataFrame:
    """page_id, step_id, node, score, ahead: for each fingerprint (page_id, step_id, fingerprint) the element of the page that it is.

    least: likeness that the winner needs; margin: how far it must be ahead of the
    second, if there is one. A fingerprint without a winner gives no row.
    """
    of = extract.page()
    elements = extract.with_nodes(pages).select("page_id", F.inline(F.transform(F.filter("nodes", lambda n: n["node"] > 0), lambda n: F.struct(n["node"].alias("node"), _fingerprint(of, n).alias("now")))))
    known = fingerprints.select("page_id", "step_id", F.col("fingerprint").alias("known"))
    looked_up = known.select("page_id", "step_id", F.explode(_tokens(F.col("known"))).alias("token"))
    met = elements.select("page_id", "node", F.explode(_tokens(F.col("now"))).alias("token")).join(looked_up, ["page_id", "token"]).select("page_id", "step_id", "node").distinct()
    scored = met.join(elements, ["page_id", "node"]).join(known, ["page_id", "step_id"]).select("page_id", "step_id", "node", F.round(likeness(F.col("known"), F.col("now")), 6).alias("score"))
    order = Window.partitionBy("page_id", "step_id").orderBy(F.desc("score"), "node")
    ahead = F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))
    best = scored.withColumns({"n": F.row_number().over(order), "ahead": F.round(ahead, 6)}).where("n = 1")
    return best.where((F.col("score") >= least) & (F.col("ahead") >= margin)).select("page_id", "step_id", "node", "score", "ahead")


def element_locators(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (page_id, node, and what else there is) with locators: those that find the element and no other, most stable first.

    Test id, id, name and label, selectors by classes from short to long, the path. Values
    with quotes or brackets have no selector.
    """
    of = extract.page()
    kept = [c for c in wanted.columns if c != "page_id"]
    some = extract.with_nodes(pages).join(wanted, "page_id").withColumn("__n", F.try_element_at("nodes", F.col("node") + 1)).where("__n is not null and __n.node > 0")
    n, nodes = F.col("__n"), F.col("nodes")

    def alone(test) -> Column:
        return F.size(F.filter(nodes, test)) == 1

    def by(name: str, kind: str, value) -> Column:
        own = extract.attr_of(n, name)
        plain = own.rlike("^[A-Za-z_][A-Za-z0-9_-]*$") if name == "id" else (own != "") & ~own.rlike(r"[\"'\[\]>\s]")
        return F.when(F.coalesce(plain, F.lit(False)) & alone(lambda x: F.coalesce(extract.attr_of(x, name) == own, F.lit(False))), discover._locator(kind, value(own)))

    levels = [discover._level(n), *(F.when(~a["tag"].isin("html", "body"), discover._level(a)) for a in discover._above(of, n, MOST_LEVELS - 1))]
    chains = []
    for k in range(1, MOST_LEVELS + 1):
        chain = F.array(*levels[:k])
        there = levels[k - 1].isNotNull() if k > 1 else F.lit(True)
        chains.append(F.when(there, F.when(F.size(discover._chain_matches(of, nodes, chain, k)) == 1, discover._locator("css", discover._selector(chain)))))
    found = F.array(
        by("data-testid", "testId", lambda v: v), by("id", "css", lambda v: F.concat(F.lit("#"), v)), by("name", "css", lambda v: F.concat(F.lit("[name='"), v, F.lit("']"))), by("aria-label", "css", lambda v: F.concat(F.lit("[aria-label='"), v, F.lit("']"))),
        F.coalesce(*chains), discover._locator("xpath", let(n, lambda x: discover._path(of, x))),
    )
    return some.select("page_id", *kept, F.array_compact(found).alias("locators"))


def suggestions(pages: DataFrame, healed: DataFrame, failed: DataFrame) -> DataFrame:
    """page_id, step_id, locator, failed, source: what heal found as suggestions, with the locators (step_id, locators) that failed before."""
    named = element_locators(pages, healed.select("page_id", "step_id", "node"))
    return named.join(failed.select("step_id", F.col("locators").alias("failed")), "step_id").select("page_id", "step_id", F.element_at("locators", 1).alias("locator"), "failed", F.lit("fingerprint").alias("source"))
