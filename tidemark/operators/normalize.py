"""From raw records to postings: core fields, keys, hashes, in-run duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import money_dates, text, urls

# Names of fields that are columns of a posting; all others are custom.
CORE = "title company location remote salaryText url description descriptionHtml postedAt employmentType".split()

_HYBRID = rf"(?i){text.AT}hybrid{text.OFF}"
_REMOTE = rf"(?i){text.AT}(?:remote|work from home|wfh|distributed){text.OFF}|{text.AT}telecommut"
_ONSITE = rf"(?i){text.AT}(?:on[-{text.SPACE}]?site|in[-{text.SPACE}]office|in[-{text.SPACE}]person){text.OFF}"


def infer_remote(*texts: Column) -> Column:
    """hybrid, remote, onsite by the first text that says anything, else unknown."""
    said = (F.when(t.rlike(_HYBRID), "hybrid").when(t.rlike(_REMOTE), "remote").when(t.rlike(_ONSITE), "onsite") for t in texts)
    return F.coalesce(*said, F.lit("unknown"))


def compact_fields(fields: Column) -> Column:
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def split_custom(fields: Column) -> Column:
    """Fields that are no core field, trimmed; nulls stay."""
    return F.transform_values(F.map_filter(fields, lambda k, _: ~k.isin(CORE)), lambda _, v: text.trim(v))


def dedup_key(recording: Column, url: Column, title: Column, company: Column, location: Column) -> Column:
    """The canonical URL, else a hash of what identifies a posting."""
    identity = F.array(*(F.lower(F.coalesce(c, F.lit(""))) for c in (recording, title, company, location)))
    return F.coalesce(url, F.concat(F.lit("sha256:"), F.sha2(F.to_json(identity), 256)))


#: Columns that make a posting's content; the posting date isn't one, for relative dates move every day.
CONTENT = ["title", "company", "location", "remote", "salary_text", "salary_min", "salary_max", "salary_currency", "salary_period", "url", "description", "description_html", "employment_type"]


def content_hash(custom: Column, columns: list[str] = CONTENT) -> Column:
    entries = F.array_sort(F.map_entries(custom))
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns), entries.alias("custom")), {"ignoreNullFields": "false"}), 256)


def normalize_records(raw: DataFrame, now: Column, default_company: Column | None = None) -> DataFrame:
    """Postings of raw(recording_id, run_id, run_seq, item_idx, fields, source_url); records without a title are dropped.

    Projections only: no shuffle, one helper call for URLs that need resolving.
    """
    field = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    lined = raw.withColumns(
        {
            "title": text.clean_line(field("title")),
            "company": F.coalesce(text.clean_line(field("company")), text.clean_line(default_company) if default_company is not None else F.lit(None).cast("string")),
            "location": text.clean_line(field("location")),
            "salary_text": text.clean_line(field("salaryText")),
            "url": urls.canonicalize_url(text.null_if_empty(field("url")), F.col("source_url")),
            "description": text.clean_block(field("description")),
            "description_html": text.null_if_empty(text.trim(field("descriptionHtml"))),
            "employment_type": text.clean_line(field("employmentType")),
            "posted_at": money_dates.parse_date(field("postedAt"), now),
            "custom": split_custom(F.col("fields")),
        }
    ).where("title is not null")
    paid = lined.withColumns({"__pay": money_dates.parse_salary(F.col("salary_text")), "remote": infer_remote(field("remote"), F.col("location"), F.col("title"))})
    full = paid.withColumns({f"salary_{n}": F.col(f"__pay.{n}") for n in ("min", "max", "currency", "period")})
    keyed = full.withColumns({"dedup_key": dedup_key(*(F.col(c) for c in ("recording_id", "url", "title", "company", "location"))), "content_hash": content_hash(F.col("custom"))})
    return keyed.drop("__pay", "fields", "source_url")


def untitled(raw: DataFrame) -> DataFrame:
    """Records that give no posting for want of a title, with the names of the fields that they have."""
    title = text.clean_line(F.try_element_at(F.col("fields"), F.lit("title")))
    return raw.where(title.isNull()).select("recording_id", "run_id", "item_idx", F.array_sort(F.map_keys("fields")).alias("field_names"))


def dedupe_in_run(jobs: DataFrame, run: list[str] | None = None, key: str = "dedup_key", order: list[str] | None = None) -> DataFrame:
    """The first record of each key in a run."""
    w = Window.partitionBy(*(run or ["run_id"]), key).orderBy(*(order or ["item_idx"]))
    return jobs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dropped_in_run(jobs: DataFrame, run: list[str] | None = None, key: str = "dedup_key") -> DataFrame:
    """Per run how many records dedupe_in_run drops. Partial sums first: no run is one task's work."""
    run = run or ["run_id"]
    per_key = jobs.groupBy(*run, key).agg(F.count("*").alias("n"))
    return per_key.groupBy(*run).agg(F.sum(F.col("n") - 1).alias("dropped"))


def cap_items(records: DataFrame, most: int, run: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The first records of a run, and whether the run had more (limited).

    One more than that is kept of each run, by every task before the shuffle, and
    tells whether there were more: no task reads a whole run.
    """
    run, order = run or ["run_id"], order or ["item_idx"]
    w = Window.partitionBy(*run)
    some = records.withColumn("__n", F.row_number().over(w.orderBy(*order))).where(F.col("__n") <= most + 1)
    return some.withColumn("limited", F.max("__n").over(w) > most).where(F.col("__n") <= most).drop("__n")
