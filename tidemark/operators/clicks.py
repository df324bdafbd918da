"""Clean-up of captured click-streams.

actions: session_id, idx, at (epoch ms), kind (step, field, or a marker of a
scope), step_type, url, value, key, mode, amount, element_key, has_target,
interactive, mutated, replaces_click, seq.
navigations: session_id, url, at, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered

SLACK_MS, WINDOW_MS, POPUP_MS = 5, 10_000, 5_000
#: A session is cut into spans of this length, each a task of its own.
SPAN_MS = 3_600_000


def attribute_navigations(actions: DataFrame, navigations: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """session_id, idx, url: the action that caused each navigation, as an as-of join.

    The cause is the latest action up to 5 ms behind the navigation and 10 s
    before. An address typed by hand or the edge of a scope in between means that
    no action caused it. One pass over actions and navigations in order, span by span.
    """
    acts = actions.select(
        "session_id", "idx", "at", "seq", F.lit(None).cast("string").alias("nav_url"), F.col("at").alias("sort_at"), F.lit(0).alias("order"),
        F.when(~F.col("kind").isin("step", "field"), "reset").when((F.col("kind") == "step") & (F.col("step_type") == "navigate"), "typed").when(F.col("kind") == "step", "act").otherwise("field").alias("what"),
    )
    navs = navigations.select("session_id", F.lit(None).cast("int").alias("idx"), "at", "seq", F.col("url").alias("nav_url"), (F.col("at") + SLACK_MS).alias("sort_at"), F.lit(1).alias("order"), F.lit("nav").alias("what"))
    # a typed address counts up to the navigation itself, by the shared sequence where both have one
    typed_at = F.when(F.col("what") == "typed", F.col("at") + SLACK_MS).otherwise(F.col("sort_at"))
    rows = acts.unionByName(navs).withColumns({"sort_at": typed_at, "order": F.when(F.col("what") == "typed", 0).otherwise(F.col("order")), "__seq": F.coalesce("seq", F.lit(0)), "__idx": F.coalesce("idx", F.lit(-1))})
    cause = F.when(F.col("what") == "act", F.struct("idx", "at")).when(F.col("what").isin("typed", "reset"), F.struct(F.lit(None).cast("int").alias("idx"), F.col("at").alias("at")))
    known = ordered.carried(rows, ["session_id"], ["sort_at", "order", "__seq", "__idx"], F.floor(F.col("sort_at") / span_ms), cause, "cause")
    found = known.where("what = 'nav' and cause.idx is not null").where(F.col("at") - F.col("cause.at") <= WINDOW_MS)
    # an action that caused several keeps the last
    last = Window.partitionBy("session_id", "cause.idx").orderBy(F.desc("at"), F.desc("__seq"))
    return found.withColumn("__n", F.row_number().over(last)).where("__n = 1").select("session_id", F.col("cause.idx").alias("idx"), F.col("nav_url").alias("url"))


def _is(row: Column, *kinds: str) -> Column:
    return F.coalesce((row["kind"] == "step") & row["step_type"].isin(*kinds), F.lit(False))


def coalesce_actions(actions: DataFrame, navigations: DataFrame | None = None, span_ms: int = SPAN_MS) -> DataFrame:
    """The actions worth replaying, with the value, amount and mode that they end with.

    Key presses that only move on to a targeted step, and clicks on nothing that did
    nothing, go first. What else goes or merges follows from the nearest rows that are
    left: a click or fill goes if the next row fills the same element, unless it
    navigated; a click goes if the next row is the address that it opened; an address
    goes if the row before (or before such a click) is the same address; scrolls of one
    element in a row are one scroll. So each row looks at two before and one behind it,
    and a session of any length is cut into spans of time (operators.ordered).
    """
    caused = attribute_navigations(actions, navigations, span_ms).select("session_id", "idx", F.lit(True).alias("navigated")) if navigations is not None else None
    rows = actions.join(caused, ["session_id", "idx"], "left") if caused is not None else actions.withColumn("navigated", F.lit(None).cast("boolean"))
    key, order, span = ["session_id"], ["at", "idx"], F.floor(F.col("at") / span_ms)
    own = F.struct("kind", "step_type", "element_key", "url", "at", "navigated", "replaces_click")
    true = lambda c: F.coalesce(c, F.lit(False))

    seen = ordered.neighbours(rows, key, order, span, ["kind", "has_target"], 0, 1)
    following = F.try_element_at("after", F.lit(1))
    moves_on = _is(own, "press") & true((F.col("key") == "Tab") & (following["kind"] == "step") & following["has_target"])
    idle = _is(own, "click") & true(~F.col("interactive") & ~F.col("mutated")) & ~true(F.col("navigated"))
    left = ordered.neighbours(seen.where(~moves_on & ~idle).drop("before", "after"), key, order, span, ["kind", "step_type", "element_key", "url", "at", "navigated", "replaces_click"], 2, 1)

    one, two, after = (F.try_element_at(F.col(c), F.lit(i)) for c, i in (("before", -1), ("before", -2), ("after", 1)))
    opened = lambda click, address: _is(click, "click") & _is(address, "navigate") & true(address["replaces_click"] & (address["at"] - click["at"] <= POPUP_MS))
    refilled = lambda a, b: _is(a, "click", "fill") & _is(b, "fill") & true((a["element_key"] != "") & (a["element_key"] == b["element_key"])) & ~true(a["navigated"])
    last = F.when(opened(one, own), two).otherwise(one)
    gone = opened(own, after) | refilled(own, after) | (_is(own, "navigate") & _is(last, "navigate") & last["url"].eqNullSafe(F.col("url")))
    scroll = _is(own, "scroll")
    told = left.withColumns({"__gone": gone, "__scroll": scroll, "__goes_on": scroll & _is(one, "scroll") & one["element_key"].eqNullSafe(F.col("element_key"))}).drop("before", "after")

    begins = F.when(F.col("__scroll") & ~F.col("__goes_on"), F.struct("at", "idx"))
    runs = ordered.carried(told, key, order, span, begins, "__run").where("__scroll").groupBy("session_id", F.col("__run.at").alias("__at"), F.col("__run.idx").alias("idx"))
    merged = runs.agg(F.count("*").alias("__n"), F.max(true(F.col("mode") == "toBottom")).alias("__bottom"), F.sum(F.coalesce("amount", F.lit(0.0))).alias("__sum"), F.max("at").alias("__end")).where("__n > 1")
    kept = told.where("not __gone and not __goes_on").withColumn("__at", F.col("at"))
    out = kept.join(merged.withColumnRenamed("idx", "__idx").withColumnsRenamed({"session_id": "__session", "__at": "__begin"}), [F.col("session_id").eqNullSafe(F.col("__session")), F.col("__at") == F.col("__begin"), F.col("idx") == F.col("__idx"), F.col("__scroll")], "left")
    several = F.col("__n").isNotNull()
    changed = {"mode": F.when(several & F.col("__bottom"), "toBottom").otherwise(F.col("mode")), "amount": F.when(several, F.when(~F.col("__bottom"), F.col("__sum"))).otherwise(F.col("amount")), "at": F.when(several, F.col("__end")).otherwise(F.col("at"))}
    return out.withColumns(changed).select(*actions.columns)


# What marks a field whose typed value must not be kept.
_SENSITIVE_AUTOCOMPLETE = r"(?i)(^|\s)(current-password|new-password|one-time-code|cc-[a-z-]+)($|\s)"
_SENSITIVE_NAME = r"(?i)passw|passcode|passphrase|secret|(^|[^a-z])(pin|otp|cvv|cvc|csc)([^a-z]|$)|card.?(number|no|num)|security.?code|one.?time"


def sensitive(input_type: Column, autocomplete: Column, name: Column, field_id: Column) -> Column:
    told = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    return told(input_type, "(?i)^password$") | told(autocomplete, _SENSITIVE_AUTOCOMPLETE) | told(name, _SENSITIVE_NAME) | told(field_id, _SENSITIVE_NAME)


def redact_sensitive(actions: DataFrame) -> DataFrame:
    """actions without values typed into password, card or one-time-code fields; once such a field, it stays one."""
    now = sensitive(F.col("input_type"), F.col("autocomplete"), F.col("field_name"), F.col("field_id"))
    before = Window.partitionBy("session_id", F.coalesce("element_key", F.concat(F.lit("#"), F.col("idx").cast("string")))).orderBy("at", "idx")
    ever = F.max(now).over(before.rowsBetween(Window.unboundedPreceding, 0))
    return actions.withColumn("redacted", ever & F.col("value").isNotNull()).withColumn("value", F.when(~F.col("redacted"), F.col("value")))
