"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard
transform, and hashed to the nearest signed axis (Andoni et al., 2015). A table's
bucket is the axes of one or more such turns: as many as keep buckets at a few
thousand vectors, so the number of buckets follows the number of vectors. A vector
is indexed once per table; a query probes the buckets whose axes are nearest to it
in every table. The candidates of a bucket are reranked by exact cosine, in blocks
of bounded size, so that a crowded bucket is many tasks.

How many buckets are probed is measured, not guessed: a bounded sample of queries
is compared with all vectors, and the probes are as many as find a share of
target_recall of their true neighbours. If that takes too many probes, buckets get
fewer turns; with one turn, probing all axes is a full comparison. A table of any
size is hashed.

Vectors of one direction are one class: only the k + 1 smallest ids of a class can
be among anyone's k nearest, so a class of any size costs as much as one vector,
with the same result. Cosines are compared rounded to 12 places, so that parallel
vectors are ties, as they are in exact numbers; scores are not rounded.

Queries with fewer than k candidates are compared with all vectors, in blocks; so is
everything if search is asked to (in_full), and vectors of 65,536 numbers or more.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite
number take no part, nor do rows with a null id. Rows that repeat an id are
candidates and queries each for themselves; only a query's own row is left out.
Only vectors of one length are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.storage import written

#: Rows of either side that are compared at once; rows of a bucket that are aimed at.
BLOCK = 2048
#: Queries by which the probes are measured; probes that are tried at most where a bucket is the axes of several turns.
MEASURED, MOST_PROBES = 256, 4096


def _turn(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation: three times random signs and the fast Hadamard transform."""
    size = x.shape[1]
    signs = np.random.default_rng([table, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        x = x * s
        half = 1
        while half < size:
            x = x.reshape(len(x), -1, 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
            half *= 2
        x = x.reshape(len(x), size) / np.sqrt(size)
    return x


def _sides(x: np.ndarray, turn: int) -> np.ndarray:
    """For each row the coordinate along each signed axis of a turn: 2 i for axis i, 2 i + 1 for its opposite."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    turned = _turn(padded, turn)
    return np.stack([turned, -turned], 2).reshape(len(x), 2 * size)


def probed(x: np.ndarray, table: int, turns: int, probes: int) -> np.ndarray:
    """For each row the buckets of a table that are nearest to it, nearest first, by the sum of the coordinates along their axes."""
    score, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for t in range(turns):
        sides = _sides(x, table * 8 + t)
        best = np.argsort(-sides, axis=1, kind="stable")[:, :probes]
        score = (score[:, :, None] + np.take_along_axis(sides, best, 1)[:, None]).reshape(len(x), -1)
        bucket = (bucket[:, :, None] * sides.shape[1] + best[:, None]).reshape(len(x), -1)
        first = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        score, bucket = np.take_along_axis(score, first, 1), np.take_along_axis(bucket, first, 1)
    return bucket


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, tables: int, plans: dict[int, tuple[int, int]], *, index: bool) -> DataFrame:
    """cls, id, vector, bucket: a row for each table and probed bucket (one, for the index). plans: length -> turns, probes."""
    kind = dict(classes.dtypes)["vector"]

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            for size in np.unique(sizes):
                turns, probes = plans[int(size)]
                some = batch.filter(pa.array(sizes == size))
                for i in range(0, len(some), 512):
                    part = some.slice(i, 512)
                    x = _unit(_matrix(part.column(2), len(part)))
                    found = np.concatenate([probed(x, t, turns, 1 if index else probes) + ((t * 65536 + int(size)) << 42) for t in range(tables)], 1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.tolist(), pa.list_(pa.int64()))], names=["cls", "id", "vector", "buckets"])

    return classes.select("cls", "id", "vector").mapInArrow(run, f"cls long, id long, vector {kind}, buckets array<long>").select("cls", "id", "vector", F.explode("buckets").alias("bucket"))


def _nearest_of_all(classes: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """(query's place, vector) of the k nearest classes of a bounded number of queries, by one scan; own: the queries' classes."""
    kind = dict(classes.dtypes)["vector"]

    def run(batches):
        places, nears, vectors = np.zeros(0, np.int64), np.zeros(0), []
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                near = queries @ _unit(_matrix(part.column(1), len(part))).T
                near[own[:, None] == part.column(0).to_numpy()[None]] = -2
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                rows = part.column(1).to_pylist()
                places, nears = np.append(places, np.repeat(np.arange(len(queries)), top.shape[1])), np.append(nears, np.take_along_axis(near, top, 1).ravel())
                vectors += [rows[j] for j in top.ravel()]
                order = np.lexsort((-nears, places))
                rank = np.arange(len(order)) - np.searchsorted(places[order], places[order])
                keep = order[rank < k]
                places, nears, vectors = places[keep], nears[keep], [vectors[j] for j in keep]
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(nears), pa.array(vectors, batch_kind)], names=["place", "near", "vector"])

    batch_kind = to_arrow_type(classes.schema["vector"].dataType)
    first = Window.partitionBy("place").orderBy(F.desc("near"))
    found = classes.select("cls", "vector").mapInArrow(run, f"place long, near double, vector {kind}").where("near >= -1.5")
    return [(r.place, np.array(r.vector, float)) for r in found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).collect()]


def _plan(classes: DataFrame, sought: DataFrame, size: int, rows: int, tables: int, k: int, target_recall: float) -> tuple[int, int]:
    """Turns and probes for the vectors of one length, measured on a bounded sample of the queries."""
    of_size = F.size("vector") == size
    sample = [(r.cls, r.vector) for r in sought.where(of_size).orderBy(F.xxhash64("cls", F.lit(5))).limit(MEASURED).collect()]
    if not sample:
        return 1, 1
    own, x = np.array([c for c, _ in sample]), _unit(np.array([v for _, v in sample], float))
    near = _nearest_of_all(classes.where(of_size), x, own, k)
    if not near:
        return 1, 1
    place, y = np.array([p for p, _ in near]), _unit(np.stack([v for _, v in near]))
    axes = 2 << max(0, size - 1).bit_length()
    turns = int(np.clip(np.ceil(np.log(max(1, rows / BLOCK)) / np.log(axes)), 1, 42 // int(np.log2(axes))))
    for turns in range(turns, 0, -1):
        probes = axes if turns == 1 else min(axes**turns, MOST_PROBES)
        first = np.full(len(place), probes)
        for t in range(tables):
            for i in range(0, len(place), 256):
                hit = probed(x[place[i : i + 256]], t, turns, probes) == probed(y[i : i + 256], t, turns, 1)
                first[i : i + 256] = np.minimum(first[i : i + 256], np.where(hit.any(1), hit.argmax(1), probes))
        needed = int(np.sort(first)[min(len(first) - 1, int(np.ceil(target_recall * len(first))) - 1)]) + 1
        # more probes than a tenth of many buckets cost more than fewer turns
        if turns == 1 or needed <= min(probes, axes**turns // 10):
            break
    return turns, min(needed, axes**turns)


def _best(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """query, cls: the k best classes of those that a query meets, ties to the smallest id; both sides hold cls, id, vector, bucket."""
    slices = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cut = slices(base, "base_cuts").join(slices(queries, "query_cuts"), "bucket")

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("cls"), F.col(own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        at = df.join(cut, "bucket").select("cls", "id", "vector", "bucket", mine.alias(own), theirs.alias(other))
        return at.select("cls", "id", "vector", "bucket", F.xxhash64("bucket", "base_cuts", "query_cuts").alias("place"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(left) and len(right):
            lb, rb = left.column("bucket").to_numpy(), right.column("bucket").to_numpy()
            for bucket in np.unique(lb):  # one, unless hashes collide
                a, b = left.filter(pa.array(lb == bucket)), right.filter(pa.array(rb == bucket))
                if not len(b):
                    continue
                x, y = (_unit(_matrix(t.column("vector").combine_chunks(), len(t))) for t in (a, b))
                cls, ids = b.column("cls").to_numpy(), b.column("id").to_numpy()
                for i in range(0, len(x), 256):
                    near = np.round(x[i : i + 256] @ y.T, 12)
                    top = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :k]
                    found = np.repeat(a.column("cls").to_numpy()[i : i + 256], top.shape[1]), cls[top].ravel(), ids[top].ravel(), np.take_along_axis(near, top, 1).ravel()
                    for part, values in zip(out, found, strict=True):
                        part.append(values)
        kinds = {"query": pa.int64(), "cls": pa.int64(), "id": pa.int64(), "near": pa.float64()}
        return pa.table({name: pa.array(np.concatenate(x) if x else [], kind) for x, (name, kind) in zip(out, kinds.items(), strict=True)})

    met = placed(queries, "query_cuts", "base_cuts").groupBy("place").cogroup(placed(base, "base_cuts", "query_cuts").groupBy("place")).applyInArrow(compare, "query long, cls long, id long, near double")
    first = Window.partitionBy("query").orderBy(F.desc("near"), "id")
    return met.groupBy("query", "cls", "id").agg(F.max("near").alias("near")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("query", "cls")


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, tables: int = 2, target_recall: float = 0.97, in_full: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition queries names its k nearest other rows.

    Nearest by cosine in double precision, ties to the smaller id. in_full: without
    hashing, exact and quadratic.
    """
    kind = dict(vectors.select(vector).dtypes)[vector]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    own = F.col(vector).cast(kind)
    as_double = own.cast("array<double>")
    norm = F.sqrt(F.aggregate(as_double, F.lit(0.0), lambda s, v: s + v * v))
    finite = F.forall(as_double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.where(F.col(key).isNotNull() & (F.size(F.coalesce(as_double, F.array().cast("array<double>"))) > 0)).where(finite).where((norm > 0) & (norm < float("inf")))
    direction = F.xxhash64(F.transform(as_double, lambda v: F.round(v / norm, 10) + 0.0))
    # written, so that the rows keep their ids
    rows = written(usable.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), own.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"), direction.alias("cls")), "vectors")
    smallest = Window.partitionBy("cls").orderBy("id", "row")
    members = written(rows.select("cls", "row", "id", "vector").withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1), "members")
    # ties go to the class with the smallest id
    classes = members.where("n = 1").select("cls", "id", "vector")
    sought = written(classes.join(rows.where("asks").select("cls").distinct(), "cls", "left_semi"), "sought")

    lengths = {r.length: r.n for r in classes.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).collect()}
    plans = {size: _plan(classes, sought, size, n, tables, k, target_recall) for size, n in lengths.items() if size < 65536 and not in_full}
    hashed = F.size("vector").isin(list(plans))
    all_of = lambda df: df.select("cls", "id", "vector", F.size("vector").cast("long").alias("bucket"))
    found = _best(_hashed(sought.where(hashed), tables, plans, index=False), _hashed(classes.where(hashed), tables, plans, index=True), k + 3)
    if len(plans) < len(lengths):
        found = found.unionByName(_best(all_of(sought.where(~hashed)), all_of(classes.where(~hashed)), k + 3))
    found = written(found, "candidates")

    # A class has k + 1 ids as soon as there are so many; queries that found too few are compared with everything of their length.
    counts = members.groupBy("cls").agg(F.count("*").alias("ids"))
    have = found.join(counts, "cls").groupBy("query").agg(F.sum("ids").alias("have"))
    want = F.coalesce(*(F.when(F.size("vector") == size, min(k + 1, n)) for size, n in lengths.items()), F.lit(0))
    short = sought.join(have, sought.cls == have.query, "left").where(hashed & (F.coalesce("have", F.lit(0)) < want)).select("cls", "id", "vector")
    short = written(short, "short")
    if plans and not short.isEmpty():
        found = found.unionByName(_best(all_of(short), all_of(classes.where(hashed)), k + 3)).distinct()

    tied = lambda score: F.round(score, 12)
    of_query = sought.select(F.col("cls").alias("query"), F.col("vector").alias("a"))
    exact = found.join(of_query, "query").join(members.select("cls", F.col("row").alias("vec_row"), F.col("id").alias("vec_id"), F.col("vector").alias("b")), "cls").withColumn("near", tied(_cosine(F.col("a"), F.col("b"))))
    best_ids = Window.partitionBy("query").orderBy(F.desc("near"), "vec_id", "vec_row")
    few = exact.withColumn("n", F.row_number().over(best_ids)).where(F.col("n") <= k + 1).select("query", "vec_row", "vec_id", "b")
    # a query's own row is left out last, so the queries of one class share all before
    asking = rows.where("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("vector").alias("q"), F.col("cls").alias("query"))
    near = Window.partitionBy("query_row").orderBy(F.desc(tied(F.col("score"))), "vec_id", "vec_row")
    scored = asking.join(few, "query").where(F.col("vec_row") != F.col("query_row")).withColumn("score", _cosine(F.col("q"), F.col("b")))
    return scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
