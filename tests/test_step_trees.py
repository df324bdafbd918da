"""Trees of steps from captured actions, against building them with a stack."""

import json
import random

from pyspark.sql import functions as F

from tidemark.plans import definitions, step_trees

SCHEMA = "session_id string, at long, idx int, kind string, step_type string, for_item boolean, name string, payload string, wait_pattern string"


def plain(rows):
    """One session's steps, scope by scope; the shape only."""
    root = {"kind": "root", "body": [], "up": None}
    stack, last, previous = [root], None, None
    for r in rows:
        scope = stack[-1]
        real = scope
        while real["kind"] == "through":
            real = real["up"]
        kind = r["kind"]
        if kind == "field":
            if previous != "field":
                real["body"].append({"type": "extract", "scope": "item" if real["kind"] == "list" else "page", "fields": {}})
            real["body"][-1]["fields"][r["name"]] = json.loads(r["payload"] or "{}")
        elif kind == "listStart":
            node = {"type": "forEach", "body": []}
            real["body"].append(node)
            stack.append({"kind": "list", "body": node["body"], "up": real, "node": node})
            last = (node, real["body"])
        elif kind == "detailStart" and real["kind"] == "list":
            node = {"type": "openDetail", "body": []}
            real["body"].append(node)
            stack.append({"kind": "detail", "body": node["body"], "up": real})
        elif kind == "detailStart":
            stack.append({"kind": "through", "up": real})
        elif kind == "scopeEnd" and len(stack) > 1:
            stack.pop()
        elif kind == "paginate" and last:
            last[0]["pager"] = json.loads(r["payload"] or "{}")
        elif kind == "step":
            node = {"type": r["step_type"]}
            wait = [{"type": "waitFor", "urlPattern": r["wait_pattern"]}] if r["wait_pattern"] and not r["for_item"] else []
            if real["kind"] == "list" and not r["for_item"]:
                body = real["up"]["body"]
                at = next(i for i, x in enumerate(body) if x is real["node"])
                body[at:at] = [node, *wait]
            else:
                real["body"] += [node, *wait]
        previous = kind
    return wrapped(root["body"])


def wrapped(body):
    out = []
    for x in body:
        x = {**x, **({"body": wrapped(x["body"])} if "body" in x else {}), **({"fields": [{"name": k, **v} for k, v in x["fields"].items()]} if "fields" in x else {})}
        pager = x.pop("pager", None)
        out.append({"type": "paginate", **pager, "body": [x]} if pager is not None else x)
    return out


def without_ids(steps):
    return [{k: without_ids(v) if k == "body" else v for k, v in s.items() if k != "id"} for s in steps]


def sessions(deal):
    for s in range(40):
        rows = []
        for i in range(deal.randrange(1, 45)):
            kind = deal.choice(["step"] * 4 + ["field", "field", "listStart", "detailStart", "scopeEnd", "scopeEnd", "paginate"])
            rows.append({"session_id": f"s{s}", "at": i // 2, "idx": i, "kind": kind, "step_type": deal.choice(["click", "hover"]), "for_item": deal.choice([True, False, None]), "name": deal.choice("abc"), "payload": deal.choice([None, "{}"]) if kind != "field" else json.dumps({"n": i, "q": 'a"b}'}), "wait_pattern": deal.choice([None, None, 'x"/*'])})
        yield rows


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_trees_equal_a_stack(spark):
    found = list(sessions(random.Random(11)))
    df = frame(spark, [r for rows in found for r in rows])
    got = {r.recording_id: json.loads(r.definition_json)["steps"] for r in step_trees.step_trees(df).collect()}
    for rows in found:
        want = plain(rows)
        assert without_ids(got.get(rows[0]["session_id"], [])) == want, rows
    # ids are s1, s2, ... in reading order, and walking the definitions finds the same steps
    walked = definitions.walk_steps(step_trees.step_trees(df)).orderBy("recording_id", "path").collect()
    ids = {}
    for r in walked:
        ids.setdefault(r.recording_id, []).append(r.step_id)
    assert all(v == [f"s{i}" for i in range(1, len(v) + 1)] for v in ids.values()) and len(ids) > 30
    assert step_trees.step_trees(df.limit(0)).count() == 0


def test_deep_trees(spark):
    rows = [{"session_id": "d", "at": i, "idx": i, "kind": "listStart" if i % 2 == 0 else "detailStart", "step_type": None, "for_item": None, "name": None, "payload": None, "wait_pattern": None} for i in range(12)]
    rows.append({**rows[0], "at": 99, "idx": 99, "kind": "step", "step_type": "click"})
    (got,) = definitions.walk_steps(step_trees.step_trees(frame(spark, rows))).agg(F.max("depth")).first()
    assert got == 12
