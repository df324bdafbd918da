"""Filters, search, paging and export of postings.

jobs: job_id, job_seq, recording_id, title, company, location, description,
remote, first_seen_at, last_seen_at, closed_at ...
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.shared import Versions

#: Columns that a search looks in.
SEARCHED = ["title", "company", "location", "description"]
_TOKEN = r"[\p{L}\p{N}]+"


def filter_jobs(jobs: DataFrame, *, recording: str | None = None, remote: str | None = None, since: datetime | None = None, until: datetime | None = None, include_closed: bool = False) -> DataFrame:
    """All conditions together; since <= first_seen_at < until; closed ones are hidden."""
    tests: list[Column] = [] if include_closed else [F.col("closed_at").isNull()]
    tests += [F.col(c) == v for c, v in (("recording_id", recording), ("remote", remote)) if v is not None]
    tests += [F.col("first_seen_at") >= F.lit(since)] if since is not None else []
    tests += [F.col("first_seen_at") < F.lit(until)] if until is not None else []
    for t in tests:
        jobs = jobs.where(t)
    return jobs


def end_of_day(day: Column) -> Column:
    """The bound that keeps all of a day."""
    return F.date_trunc("day", day) + F.expr("interval 1 day")


def posting_lists(jobs: DataFrame, columns: list[str] = SEARCHED, key: str = "job_id") -> DataFrame:
    """token, key, field, positions: where each folded word is, a row for each posting and column that has it."""

    def lists(field: int, column: str) -> Column:
        found = F.regexp_extract_all(text.fold_accents(F.coalesce(F.col(column), F.lit(""))), F.lit(_TOKEN), F.lit(0))
        return F.transform(found, lambda token, pos: F.struct(token.alias("token"), F.lit(field).alias("field"), pos.alias("pos")))

    words = F.flatten(F.array(*(lists(i, c) for i, c in enumerate(columns))))
    return jobs.select(key, F.explode(words).alias("w")).groupBy("w.token", key, "w.field").agg(F.sort_array(F.collect_list("w.pos")).alias("positions"))


class SearchIndex:
    """Posting lists in immutable segments, sorted by token, so that a search reads its own tokens' row groups only.

    A refresh writes a segment of its own rows and a list of the postings that it
    knows; what older segments say of those is void. Removed postings are a segment
    without lists. A merge writes all that holds as one segment. The segments that
    count are named by a version (shared.Versions).
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str] = SEARCHED, key: str = "job_id") -> None:
        self.spark, self.path, self.columns, self.key = spark, path, columns, key
        self._versions = Versions(spark, path)

    def segments(self) -> list[str]:
        """Oldest first."""
        return self._versions.newest({"segments": []})["segments"]

    def _write(self, lists: DataFrame | None, keys: DataFrame) -> str:
        name = uuid.uuid4().hex
        if lists is not None:
            lists.repartitionByRange("token").sortWithinPartitions("token", self.key).write.parquet(f"{self.path}/lists/{name}")
        keys.select(self.key).distinct().write.parquet(f"{self.path}/keys/{name}")
        return name

    def _publish(self, change) -> None:
        newest = self._versions.newest({"segments": []})
        self._versions.publish({"version": newest["version"] + 1, "segments": change(newest["segments"])})

    def refresh(self, jobs: DataFrame) -> None:
        """Take in postings whose text is new or changed; nothing else is read or written."""
        name = self._write(posting_lists(jobs, self.columns, self.key), jobs)
        self._publish(lambda known: [*known, name])

    def remove(self, keys: DataFrame) -> None:
        name = self._write(None, keys)
        self._publish(lambda known: [*known, name])

    def _tables(self, kind: str, segments: list[str]) -> DataFrame | None:
        there = set(self._versions.names(kind))
        some = [self.spark.read.parquet(f"{self.path}/{kind}/{s}").withColumn("segment", F.lit(i)) for i, s in enumerate(segments) if s in there]
        return reduce(DataFrame.unionByName, some) if some else None

    def _valid(self, found: DataFrame, segments: list[str]) -> DataFrame:
        """Rows (key, segment, ...) that no later segment makes void."""
        later = self._tables("keys", segments).select(self.key, F.col("segment").alias("__later"))
        return found.join(later, (found[self.key] == later[self.key]) & (F.col("__later") > F.col("segment")), "left_anti")

    def merge(self) -> None:
        """One segment of all that holds; the old ones stay until prune."""
        segments = self.segments()
        lists = self._tables("lists", segments)
        if lists is None:
            return
        kept = self._valid(lists, segments).drop("segment")
        name = self._write(kept, kept.select(self.key))
        self._publish(lambda known: [name, *known[len(segments) :]])

    def prune(self) -> None:
        used = {s for v in self._versions.keep_newest(1) for s in v["segments"]}
        for kind in ("lists", "keys"):
            for name in set(self._versions.names(kind)) - used:
                self._versions.remove(f"{kind}/{name}")

    def keys_with(self, query: str) -> DataFrame | None:
        """Keys of the postings that search_jobs finds; null for a query without any token or an empty index."""
        segments, terms = self.segments(), _terms(query)
        lists = self._tables("lists", segments)
        if not terms or lists is None:
            return None
        hits = None
        for term in terms:
            found = None
            for i, word in enumerate(term):
                token = F.col("token").startswith(word) if i == len(term) - 1 else F.col("token") == word
                # places of the term's first word, if this one is its i-th
                here = lists.where(token).select("segment", self.key, "field", F.transform("positions", lambda p: p - i).alias("at"))
                if found is None:
                    found = here
                else:
                    both = found.join(here.withColumnRenamed("at", "__at"), ["segment", self.key, "field"])
                    found = both.withColumn("at", F.array_intersect("at", "__at")).where(F.size("at") > 0).drop("__at")
            one = found.select("segment", self.key).distinct()
            hits = one if hits is None else hits.join(one, ["segment", self.key], "left_semi")
        return self._valid(hits, segments).select(self.key)


def _terms(query: str) -> list[list[str]]:
    """Words of a query as the tokens that must follow one another; words without any are left out."""
    return [t for t in (re.findall(r"[^\W_]+", w) for w in text.folded(query).split()) if t]


def search_jobs(jobs: DataFrame, query: str, *, index: SearchIndex | None = None, columns: list[str] = SEARCHED, key: str = "job_id") -> DataFrame:
    """Postings in which every word of the query begins a token of some searched column.

    A word with punctuation is a phrase: its tokens follow one another in one
    column, the last one being a beginning. A query without any token finds nothing.
    Without an index the postings are filtered as they are read; with one only the
    query's own tokens are.
    """
    terms = _terms(query)
    if not terms:
        return jobs.limit(0)
    if index is not None:
        hits = index.keys_with(query)
        return jobs.limit(0) if hits is None else jobs.join(hits, key, "left_semi")
    fold = [text.fold_accents(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    for term in terms:
        phrase = r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(term)
        jobs = jobs.where(reduce(lambda a, b: a | b, (c.rlike(phrase) for c in fold)))
    return jobs


def count_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"))


def list_jobs(jobs: DataFrame, *, page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of postings, newest first."""
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page from 1, page_size from 1 to 200")
    return jobs.orderBy(F.desc("first_seen_at"), F.desc("job_seq")).offset((page - 1) * page_size).limit(page_size)


def list_recordings(recordings: DataFrame) -> DataFrame:
    return recordings.orderBy("name", "recording_id")


def list_schedules(schedules: DataFrame, recording: str | None = None, enabled: bool | None = None) -> DataFrame:
    some = schedules if recording is None else schedules.where(F.col("recording_id") == recording)
    some = some if enabled is None else some.where(F.col("enabled") == enabled)
    return some.orderBy("schedule_seq")


def resolve_ref(table: DataFrame, ref: Column | str, *, key: str = "id", name: str | None = "name") -> DataFrame:
    """Rows that a reference names: its id, else its name in any case, else ids that begin with it (4 characters or more).

    status is found for one row and ambiguous for several; nothing is returned
    for a reference that names no row.
    """
    ref = F.lit(ref) if isinstance(ref, str) else ref
    by_name = F.when(F.lower(F.col(name)) == F.lower(ref), 2) if name else F.lit(None).cast("int")
    rank = F.coalesce(F.when(F.col(key) == ref, 1), by_name, F.when((F.length(ref) >= 4) & F.col(key).startswith(ref), 3))
    ranked = table.withColumn("__rank", rank).where("__rank is not null")
    best = ranked.groupBy("__rank").agg(F.count("*").alias("__n")).orderBy("__rank").limit(1)
    named = ranked.join(F.broadcast(best), "__rank")
    return named.withColumn("status", F.when(F.col("__n") == 1, "found").otherwise("ambiguous")).drop("__rank", "__n")


def job_cells(jobs: DataFrame, columns: list[str]) -> DataFrame:
    """line: a CSV line of every row, with cells that no spreadsheet runs as a formula."""
    cells = [text.csv_cell(text.number_text(F.col(c)) if t == "double" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if t == "timestamp" else F.col(c).cast("string")) for c, t in jobs.select(*columns).dtypes]
    return jobs.select(F.concat_ws(",", *cells).alias("line"))
