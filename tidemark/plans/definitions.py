"""Definitions of recordings: versions, step trees, checks, templates.

recordings: recording_id, name, definition_json. versions: version_id,
version_seq, recording_id, definition_json, note, created_at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import regex_extract_first, trim
from tidemark.functions.urls import domain_of

#: Where a step may hold further steps.
BODIES = ["body", "steps", "detail"]


def save_definition(versions: DataFrame, definitions: DataFrame) -> DataFrame:
    """versions with a new one for each definition(recording_id, definition_json, note, created_at), and whether it is the board's first."""
    last = versions.groupBy("recording_id").agg(F.max("version_seq").alias("last"))
    new = definitions.join(last, "recording_id", "left").select(
        "recording_id", "definition_json", "note", "created_at",
        (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version_seq"),
        F.concat_ws("_", F.lit("ver"), "recording_id", (F.coalesce("last", F.lit(0)) + 1).cast("string")).alias("version_id"),
        F.col("last").isNull().alias("created"),
        definition_domain(F.col("definition_json")).alias("domain"),
    )
    return versions.unionByName(new, allowMissingColumns=True)


def definition_domain(definition: Column) -> Column:
    value = lambda p: F.get_json_object(definition, p)
    return domain_of(F.coalesce(value("$.startUrl"), value("$.feedUrl"), value("$.baseUrl")))


def latest_version(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy(F.desc("version_seq"))
    return versions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def version_history(versions: DataFrame, recording: str) -> DataFrame:
    return versions.where(F.col("recording_id") == recording).orderBy(F.desc("version_seq"))


def version_at(versions: DataFrame, recording: str, version: str) -> DataFrame:
    """One version to restore; none if it is another board's."""
    return versions.where((F.col("recording_id") == recording) & (F.col("version_id") == version))


def _steps_of(definition: str | None) -> list[tuple]:
    """parent id, depth, path, JSON of every step, each before the ones in its bodies; depth is that of the definition."""
    try:
        whole = json.loads(definition or "null")
    except (ValueError, RecursionError):
        return []
    top = whole.get("steps") if isinstance(whole, dict) else None
    out, ahead = [], [(None, [i], step) for i, step in enumerate(top if isinstance(top, list) else [])][::-1]
    while ahead:
        parent, path, step = ahead.pop()
        out.append((parent, len(path) - 1, path, step))
        if isinstance(step, dict):
            inner = [x for body in BODIES if isinstance(step.get(body), list) for x in step[body]]
            ahead += [(_plain(step.get("id")), [*path, i], x) for i, x in enumerate(inner)][::-1]
    return out


def _plain(value: object) -> str | None:
    """A JSON value as text, strings without quotes."""
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def walk_steps(definitions: DataFrame) -> DataFrame:
    """recording_id, step_id, parent_id, depth, path (place, for the order), type, step_json; steps before their bodies.

    Each definition is read once, whatever its depth. A definition that is no JSON
    object has no steps.
    """
    kind = dict(definitions.select("recording_id").dtypes)["recording_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, step) for i, text in enumerate(batch.column(1).to_pylist()) for step in _steps_of(text)]
            steps = [step for _, step in found]
            field = lambda name: pa.array([_plain(s[3].get(name)) if isinstance(s[3], dict) else None for s in steps], pa.string())
            columns = [
                batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), field("id"), pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.int32()),
                pa.array([s[2] for s in steps], pa.list_(pa.int32())), field("type"), pa.array([_plain(s[3]) for s in steps], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["recording_id", "step_id", "parent_id", "depth", "path", "type", "step_json"])

    return definitions.select("recording_id", "definition_json").mapInArrow(run, f"recording_id {kind}, step_id string, parent_id string, depth int, path array<int>, type string, step_json string")


def lint_definitions(definitions: DataFrame) -> DataFrame:
    """recording_id, step_id, problem: what makes a definition invalid."""
    value = lambda p: F.get_json_object("definition_json", p)
    low, high = value("$.settings.minDelayMs").try_cast("double"), value("$.settings.maxDelayMs").try_cast("double")
    delays = definitions.where(low > high).select("recording_id", F.lit(None).cast("string").alias("step_id"), F.lit("minDelayMs is above maxDelayMs").alias("problem"))
    token = value("$.boardToken")
    tokens = definitions.where((value("$.kind") == "api") & ~F.coalesce(token.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))).select("recording_id", F.lit(None).cast("string").alias("step_id"), F.lit("board token has odd characters").alias("problem"))
    steps = walk_steps(definitions)
    twice = steps.groupBy("recording_id", "step_id").count().where("count > 1").select("recording_id", "step_id", F.lit("step id is used twice").alias("problem"))
    of = lambda p: F.get_json_object("step_json", f"$.{p}")
    waits = sum((of(p).isNotNull().cast("int") for p in ("target", "urlPattern", "timeoutMs")), F.lit(0))
    paged = F.when(of("mode") == "nextButton", of("target").isNull()).when(of("mode") == "urlPattern", ~F.coalesce(of("urlPattern").contains("{{page}}"), F.lit(False))).otherwise(False)
    problem = F.when((F.col("type") == "scroll") & (of("mode") == "by") & of("amount").isNull(), "scroll by needs an amount").when((F.col("type") == "waitFor") & (waits != 1), "waitFor needs exactly one of target, urlPattern, timeoutMs").when((F.col("type") == "paginate") & paged, "paginate lacks what its mode needs")
    wrong = steps.withColumn("problem", problem).where("problem is not null").select("recording_id", "step_id", "problem")
    return reduce(DataFrame.unionByName, [delays, tokens, twice, wrong])


# --- templates and parameters

_KEY = r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"


def render_template(template: Column, values: Column) -> Column:
    """struct(text, error): {{key}} replaced by values[key]; an unknown key is an error and leaves no text."""
    keys = F.array_distinct(F.regexp_extract_all(template, F.lit(_KEY), F.lit(1)))
    missing = F.filter(keys, lambda k: ~F.map_contains_key(values, k))
    plain = F.regexp_replace(template, _KEY, "{{$1}}")
    text = F.aggregate(keys, plain, lambda acc, k: F.replace(acc, F.concat(F.lit("{{"), k, F.lit("}}")), F.coalesce(F.try_element_at(values, k), F.lit(""))))
    bad = F.size(missing) > 0
    return F.struct(F.when(~bad, text).alias("text"), F.when(bad, F.concat(F.lit("unknown parameter: "), F.array_join(missing, ", "))).alias("error"))


def resolve_params(declared: Column, overrides: Column) -> Column:
    """struct(params, error): declared defaults (null: needed) with overrides over them."""
    none = F.create_map().cast("map<string,string>")
    overrides = F.coalesce(overrides, none)
    odd = F.filter(F.map_keys(overrides), lambda k: ~F.map_contains_key(declared, k))
    params = F.map_zip_with(declared, F.map_filter(overrides, lambda k, _: F.map_contains_key(declared, k)), lambda _, d, o: F.coalesce(o, d))
    lacking = F.map_keys(F.map_filter(params, lambda _, v: v.isNull()))
    error = F.when(F.size(odd) > 0, F.concat(F.lit("undeclared: "), F.array_join(F.array_sort(odd), ", "))).when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(lacking), ", ")))
    return F.struct(F.when(error.isNull(), params).alias("params"), error.alias("error"))


# --- transforms of fields

REGEX = "regex:"


def transform_chain(value: Column, names: list[str], *, base: Column | None = None, now: Column | None = None) -> Column:
    """Named transforms in order, as one expression; null stays null, an unknown name is an error when the plan is made."""
    from tidemark.functions import money_dates, text, urls

    known = {
        "trim": trim,
        "collapseWhitespace": text.collapse_ws,
        "absoluteUrl": lambda v: urls.absolute_url(v, base),
        "parseDate": lambda v: F.date_format(money_dates.parse_date(v, now if now is not None else F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "parseSalary": lambda v: money_dates.format_salary(money_dates.parse_salary(v)),
    }
    for name in names:
        if name.startswith(REGEX):
            value = regex_extract_first(value, name[len(REGEX) :])
        elif name in known:
            value = known[name](value)
        else:
            raise ValueError(f'unknown transform "{name}"')
    return value


def apply_field_specs(records: DataFrame, specs: list[dict], *, base: str = "source_url", now: Column | None = None) -> DataFrame:
    """records(fields) with transformed fields; item_error names the required ones that are empty.

    specs: name, transforms, kind (url is made absolute), required.
    """
    made, lacking = [], []
    for s in specs:
        chain = [*s.get("transforms", []), *(["absoluteUrl"] if s.get("kind") == "url" else [])]
        v = transform_chain(F.try_element_at(F.col("fields"), F.lit(s["name"])), chain, base=F.col(base), now=now)
        made += [F.lit(s["name"]), v]
        if s.get("required"):
            lacking.append(F.when(v.isNull() | (trim(v) == ""), s["name"]))
    missing = F.array_compact(F.array(*lacking)) if lacking else F.array().cast("array<string>")
    return records.withColumns({"item_error": F.when(F.size(missing) > 0, F.concat(F.lit("empty: "), F.array_join(missing, ", "))), "fields": F.create_map(*made)})
