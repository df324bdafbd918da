"""Feeds of job boards as raw records.

payloads: one row for each fetched feed, with recording_id, run_id, run_seq,
source_url and body (the JSON as text). Entries are read as JSON text first, so
that one broken entry is set aside and the rest of its feed goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.normalize import compact_fields

GREENHOUSE = """id string, title string, absolute_url string, location struct<name: string>, content string, company_name string,
 first_published string, updated_at string, requisition_id string, departments array<struct<name: string>>, offices array<struct<name: string>>,
 pay_input_ranges array<struct<min_cents: double, max_cents: double, currency_type: string>>"""
LEVER = """id string, text string, hostedUrl string, createdAt bigint,
 categories struct<location: string, commitment: string, team: string, department: string, allLocations: array<string>>,
 workplaceType string, description string, descriptionPlain string, additional string, additionalPlain string,
 lists array<struct<text: string, content: string>>, salaryDescriptionPlain string,
 salaryRange struct<min: double, max: double, currency: string, `interval`: string>"""
ASHBY = """id string, title string, jobUrl string, location string, secondaryLocations array<struct<location: string>>, department string, team string,
 employmentType string, workplaceType string, isRemote boolean, isListed boolean, publishedAt string, descriptionHtml string, descriptionPlain string,
 compensation struct<scrapeableCompensationSalarySummary: string, compensationTierSummary: string>"""

#: provider -> entries' schema, path of the array in the payload, name of the title, path of the id.
_SHAPES = {"greenhouse": (GREENHOUSE, "$.jobs", "title"), "lever": (LEVER, "$", "text"), "ashby": (ASHBY, "$.jobs", "title")}
_KEYS = ["recording_id", "run_id", "run_seq", "source_url"]


def feed_shape_errors(payloads: DataFrame, provider: str) -> DataFrame:
    """Feeds whose root has another shape: their whole run fails."""
    entries = _entries(provider)
    return payloads.where(entries.isNull()).select("recording_id", "run_id", F.when(F.try_parse_json("body").isNull(), "not JSON").otherwise("unexpected shape").alias("reason"))


def _entries(provider: str) -> Column:
    path = _SHAPES[provider][1]
    root = F.trim(F.col("body")) if path == "$" else F.get_json_object("body", path)
    return F.when(root.startswith("["), F.from_json(root, "array<string>"))


def _read(payloads: DataFrame, provider: str) -> DataFrame:
    """One row for each entry: item_idx, entry (JSON text), error, e (the parsed entry)."""
    schema, _, title = _SHAPES[provider]
    rows = payloads.select(*_KEYS, F.posexplode(_entries(provider)).alias("item_idx", "entry"))
    value = lambda name: F.get_json_object("entry", f"$.{name}")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("entry"), f"$.{title}", "variant")) == "STRING"
    kind = F.schema_of_variant(F.coalesce(F.try_parse_json("entry"), F.parse_json(F.lit("null"))))
    no_title = ~F.coalesce(is_text, F.lit(False)) | (text.trim(F.coalesce(value(title), F.lit(""))) == "")
    error = F.when(~kind.startswith("OBJECT"), "not an object").when(no_title, f"{title}: missing or empty")
    if provider != "ashby":
        error = error.when(value("id").isNull(), "id: missing")
    return rows.withColumns({"error": error, "e": F.from_json("entry", schema)})


def quarantined_entries(payloads: DataFrame, provider: str) -> DataFrame:
    """Entries that are set aside, with place and reason."""
    return _read(payloads, provider).where("error is not null").select("recording_id", "run_id", "item_idx", F.col("error").alias("reason"))


def greenhouse_salary_text(ranges: Column) -> Column:
    first = F.try_element_at(F.filter(ranges, lambda r: r["min_cents"].isNotNull() | r["max_cents"].isNotNull()), F.lit(1))
    whole = lambda c: text.number_text(F.floor(c / 100 + 0.5))
    amounts = F.array_distinct(F.array_compact(F.array(whole(first["min_cents"]), whole(first["max_cents"]))))
    return F.when(first.isNotNull(), F.trim(F.concat_ws(" ", first["currency_type"], F.array_join(amounts, " - "))))


def lever_salary_text(pay: Column, plain: Column) -> Column:
    amounts = F.array_distinct(F.array_compact(F.array(text.number_text(pay["min"]), text.number_text(pay["max"]))))
    per = F.regexp_extract(pay["interval"], r"per-(hour|day|week|month|year)", 1)
    told = F.concat_ws(" ", text.null_if_empty(pay["currency"]), F.array_join(amounts, " - "))
    return F.when(F.size(F.coalesce(amounts, F.array().cast("array<string>"))) > 0, F.concat(told, F.when(per != "", F.concat(F.lit(" per "), per)).otherwise(""))).otherwise(plain)


def _names(structs: Column, name: str = "name") -> Column:
    return text.null_if_empty(F.array_join(F.filter(F.transform(structs, lambda s: s[name]), lambda n: n.isNotNull() & (n != "")), ", "))


def _records(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    made = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))))
    return rows.where("error is null").select(*_KEYS, "item_idx", compact_fields(made).alias("fields"))


def read_greenhouse(payloads: DataFrame) -> DataFrame:
    html = text.decode_entities(F.col("e.content"))
    return _records(
        _read(payloads, "greenhouse"),
        {
            "title": F.col("e.title"), "url": F.col("e.absolute_url"), "location": F.col("e.location.name"), "company": F.col("e.company_name"),
            "descriptionHtml": html, "description": text.html_to_text(html), "postedAt": F.coalesce("e.first_published", "e.updated_at"),
            "salaryText": greenhouse_salary_text(F.col("e.pay_input_ranges")), "department": _names(F.col("e.departments")), "office": _names(F.col("e.offices")),
            "requisitionId": F.col("e.requisition_id"), "sourceId": F.col("e.id"),
        },
    )


def read_lever(payloads: DataFrame) -> DataFrame:
    lists = F.coalesce(F.col("e.lists"), F.array().cast("array<struct<text:string,content:string>>"))
    join = lambda sep, *parts: text.null_if_empty(F.array_join(F.filter(F.concat(*parts), lambda p: p.isNotNull() & (p != "")), sep))
    one = lambda c: F.array(F.col(c))
    listed = F.transform(lists, lambda x: F.concat(F.lit("<h3>"), F.coalesce(x["text"], F.lit("")), F.lit("</h3><ul>"), F.coalesce(x["content"], F.lit("")), F.lit("</ul>")))
    # decoded as one text, for a helper can't be called inside transform
    bodies = F.array_join(F.transform(lists, lambda x: text.strip_tags(F.concat(F.lit("<ul>"), F.coalesce(x["content"], F.lit("")), F.lit("</ul>")))), "\u0001")
    bodies = F.transform(F.split(text.decode_entities(bodies), "\u0001"), text.clean_lines)
    plain = F.zip_with(lists, bodies, lambda x, body: F.when(x.isNotNull(), F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))))
    html = join("\n", one("e.description"), listed, one("e.additional"))
    places = F.col("e.categories.allLocations")
    return _records(
        _read(payloads, "lever"),
        {
            "title": F.col("e.text"), "url": F.col("e.hostedUrl"), "location": F.when(F.size(places) > 1, F.array_join(places, "; ")).otherwise(F.col("e.categories.location")),
            "remote": F.when(F.col("e.workplaceType") != "unspecified", F.col("e.workplaceType")), "employmentType": F.col("e.categories.commitment"),
            "descriptionHtml": html, "description": F.coalesce(join("\n\n", one("e.descriptionPlain"), plain, one("e.additionalPlain")), text.html_to_text(html)),
            "postedAt": F.date_format(F.timestamp_millis("e.createdAt"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "salaryText": lever_salary_text(F.col("e.salaryRange"), F.col("e.salaryDescriptionPlain")),
            "team": F.col("e.categories.team"), "department": F.col("e.categories.department"), "sourceId": F.col("e.id"),
        },
    )


def read_ashby(payloads: DataFrame) -> DataFrame:
    places = F.concat(F.array("e.location"), F.coalesce(F.transform("e.secondaryLocations", lambda s: s["location"]), F.array().cast("array<string>")))
    workplace = F.when(F.col("e.workplaceType") == "OnSite", "on-site").otherwise(F.coalesce(F.col("e.workplaceType"), F.when(F.col("e.isRemote"), "remote")))
    rows = _read(payloads, "ashby").where(F.col("error").isNotNull() | F.coalesce(F.col("e.isListed"), F.lit(True)))
    return _records(
        rows,
        {
            "title": F.col("e.title"), "url": F.col("e.jobUrl"), "location": text.null_if_empty(F.array_join(F.filter(places, lambda p: p.isNotNull() & (p != "")), "; ")),
            "remote": workplace, "employmentType": text.hyphen_case(F.col("e.employmentType")), "descriptionHtml": F.col("e.descriptionHtml"),
            "description": F.coalesce("e.descriptionPlain", text.html_to_text(F.col("e.descriptionHtml"))), "postedAt": F.col("e.publishedAt"),
            "salaryText": F.coalesce("e.compensation.scrapeableCompensationSalarySummary", "e.compensation.compensationTierSummary"),
            "department": F.col("e.department"), "team": F.col("e.team"), "sourceId": F.col("e.id"),
        },
    )


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": read_greenhouse, "lever": read_lever, "ashby": read_ashby}


def register_adapter(provider: str, read: Callable[[DataFrame], DataFrame]) -> None:
    """A reader for another provider's payloads."""
    ADAPTERS[provider] = read


def read_feeds(payloads: DataFrame, provider: str) -> DataFrame:
    if provider not in ADAPTERS:
        raise ValueError(f"no adapter for {provider}")
    return ADAPTERS[provider](payloads)


def feed_url(provider: Column, token: Column, base: Column | None = None) -> Column:
    """Address of a board's feed; null for an unknown provider."""
    # The providers' public addresses and paths.
    origin = F.when(provider == "greenhouse", "https://boards-api.greenhouse.io").when(provider == "lever", "https://api.lever.co").when(provider == "ashby", "https://api.ashbyhq.com")
    path = F.when(provider == "greenhouse", "/v1/boards/%s/jobs?content=true&pay_transparency=true").when(provider == "lever", "/v0/postings/%s?mode=json").when(provider == "ashby", "/posting-api/job-board/%s?includeCompensation=true")
    start = F.regexp_replace(F.coalesce(base, origin) if base is not None else origin, "/+$", "")
    return F.concat(start, F.replace(path, F.lit("%s"), F.replace(F.url_encode(token), F.lit("+"), F.lit("%20"))))


def union_sources(*parts: DataFrame) -> DataFrame:
    """Feed and page records as one table."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first
