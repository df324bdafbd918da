"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled texts train linear classifiers in numpy.
The risk of Kiryo et al. (2017) is minimised: with the class prior p,

    p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)),

so that the toxic share among the unlabelled texts is not learned as clean, and
the second part cannot turn negative and overfit. The unlabelled part is a sum
over all texts: they are written once as sparse features, and every step of the
descent adds up their part of loss and gradient on the executors. Several
classifiers, each with another share of the unlabelled texts, are averaged.

Features are hashed words and hashed word beginnings, counted over all texts. Only
those that occur oftener in toxic than in all texts by a wide margin are kept, so
that a long clean text does not gather a score from chance.

Defined cases: null and empty texts get the score of a text without features;
null ids are scored like others; without any
confirmed toxic example every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes
from tidemark.llm.storage import Scratch
from tidemark.llm.sums import summed_rows

BITS = 20
#: Bytes of the word beginnings that are features besides the whole word.
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Settings:
    """max_toxic bounds the labelled rows that the classifiers are fitted on; the unlabelled ones are all used."""

    max_toxic: int = 3000
    max_features: int = 2048
    min_support: int = 4
    classifiers: int = 3
    steps: int = 40
    rate: float = 0.3
    decay: float = 1.5e-4
    threshold: float = 0.7
    rows_a_task: int = 200_000
    broadcast_rows: int = 200_000


@dataclass(frozen=True)
class Model:
    chosen: np.ndarray  # feature bucket of each column
    weights: np.ndarray  # classifier x (columns, bias)
    prior: float
    threshold: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if not len(self.weights):
            return out
        slots = _slots(self.chosen.tobytes())
        for first, data, at in textbytes.blocks(column):
            rows, cols, counts = _counts(data, at, slots)
            value = np.log1p(counts)
            for w in self.weights:
                logit = np.bincount(rows, w[cols] * value, minlength=len(at) - 1) + w[-1]
                out[first : first + len(at) - 1] += 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out / len(self.weights)


@lru_cache(maxsize=2)
def _slots(chosen: bytes) -> np.ndarray:
    """Feature bucket -> column, -1 for none; made in each worker, so that only the chosen buckets travel."""
    out = np.full(1 << BITS, -1, np.int16)
    buckets = np.frombuffer(chosen, np.int64)
    out[buckets] = np.arange(len(buckets))
    return out


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature."""
    begin, end, row = textbytes.word_spans(data, at)
    hasher = textbytes.SpanHasher(data)
    found, rows = [hasher(begin, end)], [row]
    for k in PREFIXES:
        long = end - begin >= k
        found.append(hasher(begin[long], begin[long] + k) ^ np.uint64(k << 56))
        rows.append(row[long])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def _counts(data: np.ndarray, at: np.ndarray, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count, each pair once."""
    bucket, row = _features(data, at)
    if slots is not None:
        bucket = slots[bucket]
        bucket, row = bucket[bucket >= 0].astype(np.int64), row[bucket >= 0]
    key, n = np.unique((row << BITS) | bucket, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def _supports(texts: DataFrame, text: str, wanted: np.ndarray | None = None) -> DataFrame:
    """bucket, n: how many texts have each feature (of those wanted). Texts are summed in each task first."""

    def run(batches):
        n = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, data, at in textbytes.blocks(batch.column(0)):
                n += np.bincount(_counts(data, at)[1], minlength=1 << BITS)
        if wanted is not None:
            n[np.unpackbits(wanted) == 0] = 0
        for i in range(0, 1 << BITS, 1 << 16):
            at = i + np.flatnonzero(n[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Rows:
    """Sparse rows: the features of all of them on end, and which classifier each row belongs to."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    part: np.ndarray

    def risk(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of each classifier: summed loss of calling them clean, its gradient, and how many they are."""
        k, width = w.shape
        own = self.part[self.row]
        logit = np.bincount(self.row, w[own, self.col] * self.value, minlength=len(self.part)) + w[self.part, -1]
        p = _sigmoid(logit)
        grad = np.bincount(own * width + self.col, p[self.row] * self.value, minlength=k * width).reshape(k, width)
        grad[:, -1] = np.bincount(self.part, p, minlength=k)
        loss = np.bincount(self.part, -np.log(np.maximum(1 - p, 1e-12)), minlength=k)
        return loss, grad, np.bincount(self.part, minlength=k).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sparse(texts: DataFrame, key: str, text: str, chosen: np.ndarray, classifiers: int) -> DataFrame:
    """row, col, value, part (binary): the chosen features of the texts, some hundred rows in each record."""
    sought = chosen.tobytes()

    def run(batches):
        slots = _slots(sought)
        for batch in batches:
            dealt, out = batch.column(1).to_numpy().view(np.uint64) % np.uint64(classifiers), []
            for first, data, at in textbytes.blocks(batch.column(0)):
                rows, cols, n = _counts(data, at, slots)
                part = dealt[first : first + len(at) - 1].astype(np.int8)
                out.append((rows.astype(np.int32).tobytes(), cols.astype(np.int16).tobytes(), np.log1p(n).astype(np.float32).tobytes(), part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in list(zip(*out, strict=True)) or [()] * 4], names=["row", "col", "value", "part"])

    return texts.select(F.col(text), F.xxhash64(F.col(key), F.col(text)).alias("h")).mapInArrow(run, "row binary, col binary, value binary, part binary")


def _rows(record) -> Rows:
    kinds = (np.int32, np.int16, np.float32, np.int8)
    row, col, value, part = (np.frombuffer(x, kind) for x, kind in zip(record, kinds, strict=True))
    return Rows(row, col.astype(np.int64), value, part.astype(np.int64))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from docs (all of them count as unlabelled) and the rows of labels with toxic = 1.

    The class prior is the toxic share of the labelled rows.
    """
    marks = labels.groupBy(F.col(key)).agg(F.max(toxic).alias("__toxic"))
    counts = marks.agg(F.count("__toxic"), F.sum("__toxic")).first()
    texts = docs.select(key, text).where(F.col(text).isNotNull())
    none = Model(np.zeros(0, np.int64), np.zeros((0, 1)), 0.0, settings.threshold)
    if not counts[1]:
        return none
    ids = marks.where("__toxic = 1").select(key)
    # few ids are broadcast, which spares the texts a shuffle; more are joined by key
    ids = F.broadcast(ids) if counts[1] <= settings.broadcast_rows else ids.hint("merge")
    with Scratch(docs.sparkSession) as scratch:
        flagged = scratch.written(texts.join(ids, key, "left_semi"), "toxic")
        n_toxic, n_all = flagged.count(), texts.count()
        if not n_toxic:
            return none
        prior = min(0.9, counts[1] / counts[0])
        often = np.zeros(1 << BITS, np.int64)
        for r in _supports(flagged, text).where(F.col("n") >= settings.min_support).toLocalIterator():
            often[r.bucket] = r.n
        # only features of toxic texts are counted in all texts: at most 2**BITS buckets, whatever the corpus
        counted = _supports(texts, text, np.packbits(often > 0))
        known = np.zeros(1 << BITS, np.int64)
        for r in counted.toLocalIterator():
            known[r.bucket] = r.n
        p, u = (often + 0.5) / (n_toxic + 1), (known + 0.5) / (n_all + 1)
        worth = np.where((often > 0) & (p > 1.5 * u), np.log(p / u) * np.sqrt(often), 0)
        chosen = np.argsort(-worth, kind="stable")[: settings.max_features]
        chosen = chosen[worth[chosen] > 0].astype(np.int64)

        share = min(1.0, settings.max_toxic / n_toxic)
        # rows that repeat an id and its text are dealt alike, so they count once there
        dealt = flagged.where(F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * share)).dropDuplicates([key, text])
        positive = [_rows(r) for r in _sparse(dealt, key, text, chosen, 1).collect()]
        if not positive:
            return none
        # a few tasks for each step of the descent, more for more texts
        tasks = max(4, n_all // settings.rows_a_task)
        sparse = scratch.written(_sparse(texts, key, text, chosen, settings.classifiers).repartition(tasks), "sparse")
        shape = (settings.classifiers, len(chosen) + 3)

        def unlabelled(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            def run(batches):
                total = np.zeros(shape)
                for batch in batches:
                    for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        loss, grad, n = _rows(record).risk(w)
                        total += np.column_stack([grad, loss, n])
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

            got = summed_rows(sparse.mapInArrow(run, "data binary"), shape, sums=max(1, round(tasks**0.5) // 2))
            return got[:, -2], got[:, :-2], got[:, -1]

        return Model(chosen, nnpu(positive, unlabelled, prior, len(chosen) + 1, settings), prior, settings.threshold)


def nnpu_gradient(of_toxic: tuple[np.ndarray, np.ndarray, np.ndarray], of_unlabelled: tuple[np.ndarray, np.ndarray, np.ndarray], on_toxic: tuple[np.ndarray, np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Risk and descent direction of each classifier.

    of_toxic and of_unlabelled: loss, gradient and number of the rows, as clean ones;
    on_toxic: loss and gradient of the toxic rows as toxic ones. Where the corrected
    risk of the clean class is negative, the direction goes up in it instead, which
    is the rule of the non-negative estimator.
    """
    loss_t, grad_t, n_t = of_toxic
    loss_u, grad_u, n_u = of_unlabelled
    n_u = np.maximum(n_u, 1)
    excess = loss_u / n_u - prior * loss_t / n_t
    negative = grad_u / n_u[:, None] - prior * grad_t / n_t[:, None]
    toxic = prior * on_toxic[1] / n_t[:, None]
    return prior * on_toxic[0] / n_t + np.maximum(0, excess), np.where(excess[:, None] >= 0, toxic + negative, -negative)


def nnpu(positive: list[Rows], unlabelled, prior: float, width: int, s: Settings) -> np.ndarray:
    """Minimise the non-negative risk with logistic loss by Adam on all rows; one row of weights for each classifier."""
    w = np.zeros((s.classifiers, width))
    w[:, -1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def over_toxic(w: np.ndarray):
        as_clean, as_toxic = [np.zeros(len(w)), np.zeros(w.shape), np.zeros(len(w))], [np.zeros(len(w)), np.zeros(w.shape)]
        for rows in positive:
            for k in range(len(w)):  # the toxic rows are all of every classifier
                for sign, total in ((1, as_clean), (-1, as_toxic)):
                    loss, grad, n = rows.risk(sign * w[k : k + 1])
                    total[0][k] += loss[0]
                    total[1][k] += sign * grad[0]
                    if sign > 0:
                        total[2][k] += n[0]
        return tuple(as_clean), tuple(as_toxic)

    for step in range(1, s.steps + 1):
        as_clean, as_toxic = over_toxic(w)
        _, grad = nnpu_gradient(as_clean, unlabelled(w), as_toxic, prior)
        grad[:, :-1] += s.decay * w[:, :-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1)))
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def score(docs: DataFrame, model: Model, *, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with score double and predicted int, their names behind prefix; columns of those names are replaced."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        got = model.score(batch.column(batch.schema.get_field_index(text)))
        return {f"{prefix}score": pa.array(got), f"{prefix}predicted": pa.array((got >= model.threshold).astype(np.int32))}

    return textbytes.append_columns(docs, make, T.StructType([T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())]))
