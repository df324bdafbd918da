"""Secrets in texts that change, by an incremental ledger of blobs.

Every version of every path is addressed by its content (SHA-256): a blob is scanned
once, however many paths and versions hold it. A ledger, append-only Parquet in a
shared folder, says which blob was scanned with which version of which rule and
what was found; a scan reads the texts of only those blobs that some rule's present
version has not seen, and findings are joined back to all versions by blob. A new
rule, or a new version of one, makes old blobs unseen for that rule alone.

A task passes on a blob's text once, whatever number of its rows hold it; up to
broadcast_blobs unseen blobs are sent to the tasks as their addresses, beyond that
texts are dealt by address. A scan's part of the ledger is one folder, which counts
once its writing is complete; scans at the same time may both add a pair, which is
read as one.

A span is the whole match in code points, its end exclusive. Matches of one rule
are the leftmost that don't overlap; one that is too short is passed over with
all that it covers. Defined cases: a null text is an empty one; rows that repeat are
answered each; an empty table gives an empty result; keys may be null.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import shared_dir, written


class Rule(NamedTuple):
    """Finds pattern where its group (0: all of it) has `least` characters or more."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which findings at one place are listed; the first three are the base kinds.
RULES = (
    Rule("assign", 1, r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("login", 1, r"\b[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~%+-]{1,64}:([^\s:@/\"'<>]+)@[A-Za-z0-9.-]+", 1, 6),
)

_SCANS = "blob binary, rule string, version int, spans array<struct<start: int, end: int>>"
_NAMES = ["blob", "rule", "version", "spans"]


def spans_of(rule: Rule, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def blob_of(text: Column) -> Column:
    """The address of a text's content."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """What was scanned with which rule's version, and found, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _parts(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return [p.toString() for p in found if fs.exists(done(p, "_SUCCESS"))]

    def scans(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, rule, version, spans of what is known by the rules' present versions; a pair may be there more than once."""
        parts = self._parts()
        known = self.spark.read.schema(_SCANS).parquet(*parts) if parts else self.spark.createDataFrame([], _SCANS)
        return known.where(F.struct("rule", "version").isin(*(F.struct(F.lit(r.name), F.lit(r.version)) for r in rules)))

    def append(self, scans: DataFrame) -> None:
        scans.select(_NAMES).write.parquet(f"{self.path}/scans-{uuid.uuid4().hex}")


def _first_texts(versions: DataFrame, text: str) -> DataFrame:
    """blob, text: each task's first row of each of its blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            yield batch.filter(pa.array([not (b in seen or seen.add(b)) for b in blobs], pa.bool_()))

    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return versions.select(blob_of(own).alias("blob"), own.alias("text")).mapInArrow(run, "blob binary, text string")


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of blobs with their texts and the places of the rules that haven't seen them (blob, text, unseen)."""
    kinds = [pa.binary(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for blob, text, unseen in zip(*batch.columns, strict=True):
                address, said = blob.as_py(), text.as_py()
                if address in done:
                    continue
                done.add(address)
                for i in unseen.as_py():
                    found = [{"start": a, "end": b} for a, b in spans_of(rules[i], said)]
                    for column, value in zip(out, (address, rules[i].name, rules[i].version, found), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=_NAMES)

    return texts.select("blob", "text", "unseen").mapInArrow(run, _SCANS)


def scan(versions: DataFrame, ledger: Ledger, *, text: str = "text", rules: tuple[Rule, ...] = RULES, broadcast_blobs: int = 10_000) -> int:
    """Bring the ledger up to date with all texts; gives the number of blobs that some rule had not seen."""
    place = {r.name: i for i, r in enumerate(rules)}
    addresses = versions.select(blob_of(F.col(text).cast("string")).alias("blob")).distinct()
    seen = ledger.scans(rules).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    missing = F.array_except(F.array(*(F.lit(r.name) for r in rules)), F.coalesce("seen", F.array().cast("array<string>")))
    numbers = F.transform(missing, lambda name: F.create_map(*(F.lit(x) for kv in place.items() for x in kv))[name])
    unseen = written(addresses.join(seen, "blob", "left").select("blob", numbers.alias("unseen")).where(F.size("unseen") > 0), "unseen")
    n = unseen.count()
    if n:
        texts = _first_texts(versions, text)
        # either way all texts of a blob come together, so that it is scanned once
        met = texts.join(F.broadcast(unseen), "blob").repartition("blob") if n <= broadcast_blobs else texts.join(unseen.hint("shuffle_hash"), "blob")
        ledger.append(_scanned(met, rules))
    return n


def findings(versions: DataFrame, ledger: Ledger, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions without their text, with blob and found: array of kind, start, end by start, then by the rules' order."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
    known = ledger.scans(rules).where(F.size("spans") > 0).dropDuplicates(["blob", "rule"])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("order"), s["end"].alias("end"), F.col("rule").alias("kind")))
    # written, so that the join's partitions are its own and Spark can split that of a blob with many rows
    of_blob = written(known.groupBy("blob").agg(F.flatten(F.collect_list(spans)).alias("__found")), "found")
    rest = [c for c in versions.columns if c.lower() not in (text.lower(), "found", "blob")]
    addressed = versions.select(*(F.col(f"`{c}`") for c in rest), blob_of(F.col(text).cast("string")).alias("blob"))
    kept = F.transform(F.array_sort(F.coalesce("__found", F.array().cast("array<struct<start: int, order: int, end: int, kind: string>>"))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return addressed.join(of_blob, "blob", "left").select(*(F.col(f"`{c}`") for c in rest), "blob", kept.alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
