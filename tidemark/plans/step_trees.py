"""Definitions from captured actions: a flat row of steps and markers becomes a tree of steps.

actions: session_id, at, idx, kind (step, field, listStart, detailStart, scopeEnd,
paginate), step_type, for_item (the step acts on an item of the list around it), name
(of a field), payload (a JSON object with what else the step, field or marker holds) and
wait_pattern (the address that a step leads to).

Markers are brackets: the running sum of what opens and closes, less its lowest value so
far, is the depth, and the last opening at a row's depth is the scope around it. So
scopes need no stack, whatever their depth. What follows from the scope:

- fields in a row are one extract step; a name that comes again replaces the first one;
- a step in a list that acts on no item is done once, before the list;
- a pager goes around the last list before it; a list's last pager counts;
- a detail page outside a list is no step; what is in it belongs to the scope around it;
- markers that close nothing, and pagers before any list, count for nothing.

The tree is put together level by level. A session becomes one definition, so windows
are by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import cut

#: Levels after which the plan of the bodies is cut.
CUT_LEVELS = 8


def _scopes(actions: DataFrame) -> DataFrame:
    """actions with pos, level (number of scopes around), scope (pos of the opening of the nearest), and for openings the level that they open."""
    in_order = Window.partitionBy("session_id").orderBy("at", "idx")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("kind").isin("listStart", "detailStart")
    rows = actions.withColumns({"pos": F.row_number().over(in_order), "__sum": F.sum(F.when(opens, 1).when(F.col("kind") == "scopeEnd", -1).otherwise(0)).over(so_far)})
    depth = F.col("__sum") - F.least(F.min("__sum").over(Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("__depth", depth.cast("int")).withColumns({"opened": F.when(opens, F.col("__depth")), "level": F.col("__depth") - opens.cast("int")})
    # an opening is looked for by what it opens, and looks for its own scope by its level
    seen = rows.select("session_id", "pos", F.explode(F.array(F.struct("level", F.lit(None).cast("int").alias("opening")), F.struct(F.col("opened").alias("level"), F.col("pos").alias("opening")))).alias("s")).where("s.level > 0")
    last = Window.partitionBy("session_id", "s.level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    scopes = seen.withColumn("scope", F.last("s.opening", ignorenulls=True).over(last)).where("s.opening is null").select("session_id", "pos", "scope")
    return rows.join(scopes, ["session_id", "pos"], "left").drop("__sum", "__depth")


def _text(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v"))), r'^\{"v":|\}$', "")


def _members(payload: Column) -> Column:
    """What is between a JSON object's braces, behind a comma; nothing if it is empty or no object."""
    inner = F.trim(F.regexp_extract(F.coalesce(payload, F.lit("")), r"(?s)^\s*\{(.*)\}\s*$", 1))
    return F.when(inner != "", F.concat(F.lit(","), inner)).otherwise("")


def step_nodes(actions: DataFrame) -> DataFrame:
    """session_id, node, parent, place (order among those of a parent), type, members (of its JSON), level, pager (its members, for a list with one)."""
    rows = _scopes(actions)
    openings = rows.where("opened is not null").select("session_id", F.col("pos").alias("scope"), F.col("kind").alias("scope_kind"), F.col("scope").alias("scope_scope"))
    # details outside lists are no scopes of their own; what is in them goes to the first scope around that is one
    lists = openings.where("scope_kind = 'listStart'").select("session_id", F.col("scope").alias("scope_scope"), F.lit(True).alias("__listed"))
    outside = openings.where("scope_kind = 'detailStart'").join(lists, ["session_id", "scope_scope"], "left").where("__listed is null")
    outside = cut(outside.select("session_id", "scope", F.col("scope_scope").alias("instead")), "outside")
    while not outside.join(outside.select("session_id", F.col("scope").alias("instead")), ["session_id", "instead"], "left_semi").isEmpty():
        further = outside.select("session_id", F.col("scope").alias("instead"), F.col("instead").alias("__further"), F.lit(True).alias("__on"))
        outside = cut(outside.join(further, ["session_id", "instead"], "left").select("session_id", "scope", F.when(F.col("__on"), F.col("__further")).otherwise(F.col("instead")).alias("instead")), "outside")
    rows = rows.join(outside.select("session_id", F.col("scope").alias("pos")), ["session_id", "pos"], "left_anti").join(outside.withColumn("__out", F.lit(True)), ["session_id", "scope"], "left")
    rows = rows.withColumn("scope", F.when(F.col("__out"), F.col("instead")).otherwise(F.col("scope"))).drop("instead", "__out")
    openings = rows.where("opened is not null").select("session_id", F.col("pos").alias("scope"), F.col("kind").alias("scope_kind"), F.col("scope").alias("scope_scope"))
    rows = rows.join(openings, ["session_id", "scope"], "left")
    in_list = F.coalesce(F.col("scope_kind") == "listStart", F.lit(False))

    last_list = F.last(F.when(F.col("kind") == "listStart", F.col("pos")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    pagers = rows.select("session_id", "pos", "kind", "payload", last_list.alias("node")).where("kind = 'paginate' and node is not null").groupBy("session_id", "node").agg(F.max_by(_members(F.col("payload")), "pos").alias("pager"))

    place = lambda major, minor, pos, last: F.struct(major.cast("int").alias("major"), F.lit(minor).alias("minor"), pos.cast("int").alias("pos"), F.lit(last).alias("last"))
    here, before = place(F.col("pos"), 1, F.col("pos"), 0), place(F.col("scope"), 0, F.col("pos"), 0)
    steps = rows.where("kind = 'step'").withColumn("__up", in_list & ~F.coalesce("for_item", F.lit(False)))
    steps = steps.select("session_id", F.col("pos").cast("double").alias("node"), F.when(F.col("__up"), F.col("scope_scope")).otherwise(F.col("scope")).alias("parent"), F.when(F.col("__up"), before).otherwise(here).alias("place"), F.col("step_type").alias("type"), _members(F.col("payload")).alias("members"), "for_item", "wait_pattern")
    waits = steps.where("wait_pattern is not null and not coalesce(for_item, false)").select("session_id", (F.col("node") + 0.5).alias("node"), "parent", F.col("place").withField("last", F.lit(1)).alias("place"), F.lit("waitFor").alias("type"), F.concat(F.lit(',"urlPattern":'), _text(F.col("wait_pattern"))).alias("members"))
    scopes = rows.where("opened is not null").select("session_id", F.col("pos").cast("double").alias("node"), F.col("scope").alias("parent"), here.alias("place"), F.when(F.col("kind") == "listStart", "forEach").otherwise("openDetail").alias("type"), _members(F.col("payload")).alias("members"))

    fields = rows.where("kind = 'field'").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("session_id").orderBy("pos")))
    named = fields.groupBy("session_id", "run", "scope", "scope_kind", "name").agg(F.min("pos").alias("first"), F.max_by(_members(F.col("payload")), "pos").alias("members"))
    field = F.concat(F.lit('{"name":'), _text(F.col("name")), "members", F.lit("}"))
    made = named.groupBy("session_id", "run", "scope", "scope_kind").agg(F.min("first").alias("pos"), F.sort_array(F.collect_list(F.struct("first", field.alias("json")))).alias("f"))
    told = F.concat(F.lit(',"scope":'), F.when(in_list, '"item"').otherwise('"page"'), F.lit(',"fields":['), F.array_join(F.transform("f", lambda x: x["json"]), ","), F.lit("]"))
    extracts = made.select("session_id", F.col("pos").cast("double").alias("node"), F.col("scope").alias("parent"), here.alias("place"), F.lit("extract").alias("type"), told.alias("members"))

    nodes = steps.drop("for_item", "wait_pattern").unionByName(waits).unionByName(scopes).unionByName(extracts)
    return nodes.join(pagers, ["session_id", "node"], "left").withColumn("parent", F.col("parent").cast("double"))


def step_trees(actions: DataFrame) -> DataFrame:
    """recording_id (the session), definition_json: steps with ids s1, s2, ... in reading order, their bodies inside."""
    nodes = cut(step_nodes(actions), "steps")
    # from the top: each node's places from the root on, which sort in reading order
    level = nodes.where("parent is null").withColumns({"level": F.lit(0), "path": F.array("place")})
    levels = []
    while not (level := cut(level, "level")).isEmpty():
        levels.append(level)
        above = level.select("session_id", F.col("node").alias("parent"), F.col("path").alias("__above"))
        level = nodes.join(above, ["session_id", "parent"]).withColumns({"level": F.lit(len(levels)), "path": F.concat("__above", F.array("place"))}).select(levels[0].columns)
    if not levels:
        return actions.sparkSession.createDataFrame([], f"recording_id {dict(actions.dtypes)['session_id']}, definition_json string")
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    weight = F.when(F.col("pager").isNotNull(), 2).otherwise(1)
    number = F.sum(weight).over(Window.partitionBy("session_id").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    numbered = cut(whole.withColumn("number", number), "numbered")
    # from the bottom: each level's steps become the bodies of the one above
    head = lambda number, kind, members: F.concat(F.lit('{"id":"s'), number.cast("string"), F.lit('","type":'), _text(kind), members)
    bodies = None
    for depth in reversed(range(len(levels))):
        rows = numbered.where(F.col("level") == depth)
        rows = rows.join(bodies, ["session_id", "node"], "left") if bodies is not None else rows.withColumn("body", F.lit(None).cast("string"))
        body = F.when(F.col("type").isin("forEach", "openDetail"), F.concat(F.lit(',"body":['), F.coalesce("body", F.lit("")), F.lit("]"))).otherwise("")
        own = F.concat(head(F.col("number"), F.col("type"), F.col("members")), body, F.lit("}"))
        paged = F.concat(head(F.col("number") - 1, F.lit("paginate"), F.col("pager")), F.lit(',"body":['), own, F.lit("]}"))
        json = F.when(F.col("pager").isNotNull(), paged).otherwise(own)
        told = rows.select("session_id", F.col("parent").alias("node"), F.struct("place", json.alias("json")).alias("s"))
        bodies = told.groupBy("session_id", "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["json"]), ",").alias("body"))
        bodies = cut(bodies, "bodies") if depth and depth % CUT_LEVELS == 0 else bodies
    return bodies.select(F.col("session_id").alias("recording_id"), F.concat(F.lit('{"steps":['), "body", F.lit("]}")).alias("definition_json"))
