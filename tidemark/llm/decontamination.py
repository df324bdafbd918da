"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping windows of words) of documents and benchmark items are
TF-IDF vectors of hashed words; document frequencies count all documents. A
distributed randomised SVD (Halko, Martinsson and Tropp, 2011) gives the latent
space: executors sum A'(A random) and then the small Gram matrix of its range over
a bounded sample of the documents' passages and all of the items'. Every passage
of every document is projected; where its cosine with an item passage, as the
latent space reconstructs that one, is above a threshold, it is a candidate. A
candidate is a leak if the longest common subsequence of item and surrounding
words covers most of the item, or less of it together with the item's answer (its
last words).

Items are handled in blocks of bounded size, each with its own latent space fitted
on the same written sample; several blocks share one scan of the documents, and
only a block's matrices travel to the executors.

Defined cases: null and empty texts, and items without words, leak nothing. Items
shorter than min_words leak only where all of their words stand in one run. With
rows that repeat an id each row is judged by its own text. Item ids may be of any
type, null included. If documents and items name their keys alike, the item's
column of the result is called item_<name>.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import textbytes
from tidemark.llm.storage import Scratch
from tidemark.llm.sums import SCHEMA, chunks, summed

BITS = 14
SIZE = 1 << BITS
#: Tasks that sum over the sample.
SAMPLE_TASKS = 4
#: Half passages that are projected at once.
HALVES = 2048


@dataclass(frozen=True)
class Settings:
    """half: words of half a passage. sample_passages bounds what the latent space is fitted on.

    item_share: weight of the items' passages in the fit, of all of them together
    as against all sampled ones of documents. blocks_at_once: blocks of items that
    one scan of the documents searches.
    """

    half: int = 16
    min_rank: int = 64
    max_rank: int = 256
    item_share: float = 6.0
    sample_passages: int = 20_000
    cosine: float = 0.25
    subsequence: float = 0.8
    with_answer: float = 0.6
    answer_words: int = 5
    min_words: int = 8
    items_at_once: int = 400
    blocks_at_once: int = 8
    seed: int = 11


@dataclass(frozen=True)
class Index:
    """A block of items: its latent space and what the final checks need."""

    ids: list[object]
    words: list[list[int]]
    masks: list[dict[int, int]]
    space: np.ndarray  # buckets x rank, with the weights of terms in it, and a row of zeros
    windows: np.ndarray  # item passages x rank, over the square of their length
    squares: np.ndarray  # squared weight of each term, and a zero
    item_of: np.ndarray
    settings: Settings


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every word."""
    begin, end, row = textbytes.word_spans(data, at)
    first = np.searchsorted(row, np.arange(len(at) - 1))
    return textbytes.SpanHasher(data)(begin, end), row, np.arange(len(row)) - first[row] if len(row) else row


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _passages(row: np.ndarray, place: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each half passage begins among the words, and which of them begin a passage of two halves (or of all there is)."""
    starts = np.flatnonzero(place % half == 0)
    if not len(starts):
        return starts, np.zeros(0, bool)
    goes_on = np.append(row[starts[1:]] == row[starts[:-1]], False)
    return starts, goes_on | (place[starts] == 0)


def document_frequencies(docs: DataFrame, *, text: str = "text", half: int = 16) -> tuple[np.ndarray, int, int]:
    """Documents that each term bucket is in, of all documents; their number; the number of passages."""

    def count(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        hashes, row, place = _words(data, at)
        out = np.zeros(SIZE + 2)
        for i in range(0, len(at) - 1, 512):
            some = slice(*np.searchsorted(row, [i, i + 512]))
            seen = np.zeros((min(512, len(at) - 1 - i), SIZE), np.uint8)
            seen[row[some] - i, _bucket(hashes[some])] = 1
            out[:SIZE] += seen.sum(0, dtype=np.int64)
        out[SIZE:] = len(at) - 1, _passages(row, place, half)[1].sum()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 2)
        for batch in batches:
            for _, data, at in textbytes.blocks(batch.column(0)):
                total += count(data, at)
        yield chunks(total, 64)

    got = summed(docs.select(text).mapInArrow(run, SCHEMA), (SIZE + 2,))
    return got[:SIZE], int(got[SIZE]), int(got[SIZE + 1])


def sampled_passages(docs: DataFrame, n_passages: int, row_hash: Column, *, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """terms (array<int>, term buckets): about settings.sample_passages of all passages at most, in a few partitions.

    First documents are dealt by row_hash, then their passages; copies of a text
    are dealt apart as far as row_hash tells them apart.
    """
    rate, half = min(1.0, settings.sample_passages / max(1, n_passages)), settings.half
    of_docs = min(1.0, 50 * rate)
    dealt = docs.select(F.col(text).alias("text"), row_hash.alias("h")).where(F.col("text").isNotNull()).where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * of_docs))
    limit = np.uint64(min((1 << 64) - 1, int(2.0**64 * (rate / of_docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, terms = batch.column(1).to_numpy().view(np.uint64), []
            for first, data, at in textbytes.blocks(batch.column(0)):
                hashes, row, place = _words(data, at)
                starts, begins = _passages(row, place, half)
                at_word = starts[begins]
                draw = ((own[first + row[at_word]] ^ hashes[at_word]) + place[at_word].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                bounds = np.searchsorted(row, np.arange(len(at)))
                for i in at_word[draw ^ (draw >> np.uint64(29)) <= limit]:
                    terms.append(_bucket(hashes[i : min(i + 2 * half, bounds[row[i] + 1])]))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32()))], names=["terms"])

    return dealt.mapInArrow(run, "terms array<int>").repartition(SAMPLE_TASKS)


def _tfidf(hashes: np.ndarray, row: np.ndarray, place: np.ndarray, idf: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of length 1, one for each passage: passage, bucket, value (sorted by passage); and each passage's row."""
    starts, begins = _passages(row, place, half)
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row))))
    bucket = _bucket(hashes)
    number = np.cumsum(begins) - 1  # of the passage that a half begins
    second = np.append(False, begins[:-1] & (row[starts[1:]] == row[starts[:-1]])) if len(starts) else begins
    before = np.append(-1, number[:-1]) if len(starts) else number
    parts = [(number[own][begins[own]], bucket[begins[own]]), (before[own][second[own]], bucket[second[own]])]
    passage, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    return *_weighted(passage, bucket, int(begins.sum()), idf), row[starts[begins]]


def _dense(passage: np.ndarray, value: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of value * rows by passage."""
    out = np.zeros((n, rows.shape[1]))
    if len(passage):
        at = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        out[passage[at]] = np.add.reduceat(rows * value[:, None], at, axis=0)
    return out


def _transposed_product(passage, bucket, value, y: np.ndarray) -> np.ndarray:
    order = np.argsort(bucket, kind="stable")
    return _dense(bucket[order], value[order], y[passage[order]], SIZE)


def _weighted(passage: np.ndarray, bucket: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of length 1 from the terms of n passages."""
    key, count = np.unique((passage << BITS) | bucket, return_counts=True)
    passage, bucket = key >> BITS, key & (SIZE - 1)
    value = count * idf[bucket]
    norm = np.sqrt(np.bincount(passage, value**2, minlength=n))
    return passage, bucket, value / np.maximum(norm, 1e-12)[passage]


def _over_sample(sample: DataFrame, idf: np.ndarray, of_rows, factor, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices that of_rows(passage, bucket, value, n, factor()) gives for parts of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, by = np.zeros(shape), factor()
        for batch in batches:
            for i in range(0, len(batch), 512):
                terms = batch.column(0).slice(i, 512)
                own = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                total += of_rows(*_weighted(own, terms.flatten().to_numpy().astype(np.int64), len(terms), idf), len(terms), by)
        yield chunks(total, 1)

    return summed(sample.mapInArrow(run, SCHEMA), shape)


def fit(sample: DataFrame, items: list[tuple[object, str]], frequencies: tuple[np.ndarray, int, int], *, settings: Settings = Settings()) -> Index | None:
    """Latent space of a block of items; None if they have no words. sample: see sampled_passages."""
    s = settings
    df, n_docs, n_passages = frequencies
    idf = np.log((1 + n_docs) / (1 + df)) + 1e-6
    data, at = textbytes.text_bytes(pa.array([t or "" for _, t in items], pa.string()))
    hashes, row, place = _words(data, at)
    if not len(hashes):
        return None
    passage, bucket, value, item_of = _tfidf(hashes, row, place, idf, s.half)
    rank = int(np.clip(len(item_of), s.min_rank, s.max_rank))
    wide, seed = rank + 8, s.seed
    weight = s.item_share * max(1, min(n_passages, s.sample_passages)) / len(item_of)
    random = lambda: np.random.default_rng(seed).standard_normal((SIZE, wide))

    def ahead(p, b, v, n: int, by: np.ndarray) -> np.ndarray:
        return _transposed_product(p, b, v, _dense(p, v, by[b], n))

    # the sum is SIZE x wide whatever the number of documents
    image = _over_sample(sample, idf, ahead, random, (SIZE, wide))
    image += weight * ahead(passage, bucket, value, len(item_of), random())
    basis, _ = np.linalg.qr(image)
    basis = basis.astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(basis)

    def gram(p, b, v, n: int, by: np.ndarray) -> np.ndarray:
        y = _dense(p, v, by[b], n)
        return y.T @ y

    small = _over_sample(sample, idf, gram, lambda: shared.value, (wide, wide))
    small += weight * gram(passage, bucket, value, len(item_of), basis)
    squares, turn = np.linalg.eigh(small)
    keep = [i for i in np.argsort(-squares)[:rank] if squares[i] > 1e-9 * squares.max()]
    space = basis @ turn[:, keep]
    windows = _dense(passage, value, space[bucket], len(item_of))
    # over their squared length: what a passage that holds the item's words would have without the loss of the projection
    windows /= np.maximum(np.square(windows).sum(1, keepdims=True), 0.05)
    cut = np.searchsorted(row, np.arange(1, len(items)))
    words = [w.tolist() for w in np.split(hashes, cut)]
    masks = []
    for w in words:
        masks.append({})
        for i, x in enumerate(w):
            masks[-1][x] = masks[-1].get(x, 0) | 1 << i
    weighted = np.vstack([space * idf[:, None], np.zeros((1, len(keep)))])
    return Index([i for i, _ in items], words, masks, weighted.astype(np.float32), windows.astype(np.float32), np.append(idf**2, 0).astype(np.float32), item_of, s)


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item of n words, given by the places of each of its words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _verdict(index: Index, item: int, words: list[int]) -> tuple[float, bool] | None:
    """Share of the item that is a subsequence of the words, and whether its answer is; None if that's no leak."""
    own, s = index.words[item], index.settings
    n = len(own)
    if n < s.min_words:
        run = any(words[i : i + n] == own for i in range(len(words) - n + 1))
        return (1.0, True) if run else None
    # no subsequence holds more of the item than the places of the words that both have
    masks = index.masks[item]
    if sum(masks[w].bit_count() for w in masks.keys() & set(words)) < s.with_answer * n:
        return None
    share = common_subsequence(masks, n, words) / n
    if share < s.with_answer:
        return None
    answer = {}
    for i, w in enumerate(own[-s.answer_words :]):
        answer[w] = answer.get(w, 0) | 1 << i
    answered = common_subsequence(answer, s.answer_words, words) == s.answer_words
    return (share, answered) if share >= s.subsequence or answered else None


def _search(index: Index, hashes: np.ndarray, row: np.ndarray, place: np.ndarray, texts: int) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """(row, place of the item) -> cosine, share of the item, answer found; of the leaks in a block of texts, given by their words."""
    s = index.settings
    starts, begins = _passages(row, place, s.half)
    if not len(starts):
        return {}
    # one row of terms for each half passage; what is lacking in a short one points to the row of zeros
    terms = np.full((len(starts) + 1, s.half), SIZE)
    terms[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row)))), place % s.half] = _bucket(hashes)
    same = np.append(row[starts[1:]] == row[starts[:-1]], False)
    bounds = np.searchsorted(row, np.arange(texts + 1))
    found: dict[tuple[int, int], tuple[float, float, bool]] = {}
    for i in range(0, len(starts), HALVES):
        some = terms[i : i + HALVES + 1]  # and the second half of the last passage
        halves, one = index.space[some[:, 0]], np.empty((len(some), index.space.shape[1]), np.float32)
        for k in range(1, s.half):
            np.take(index.space, some[:, k], axis=0, out=one, mode="clip")
            halves += one
        squares = index.squares[some].sum(1)
        goes_on, of = same[i : i + HALVES, None], begins[i : i + HALVES]
        both = (halves[:-1] + np.where(goes_on, halves[1:], 0))[of]
        # as if all words were different: at most the true length, so no candidate is lost before repeats are counted
        length = np.sqrt(squares[:-1] + np.where(goes_on[:, 0], squares[1:], 0))[of]
        near, first = both @ index.windows.T, starts[i : i + HALVES][of]
        hits = np.flatnonzero((near >= s.cosine * length[:, None]).ravel())
        passage = np.unique(hits // near.shape[1])
        own = np.concatenate([some[:-1], np.where(goes_on, some[1:], SIZE)], 1)[of][passage]
        length[passage] = np.sqrt((index.squares[own] * (own[:, :, None] == own[:, None, :]).sum(2)).sum(1))
        hits = hits[near.ravel()[hits] >= s.cosine * length[hits // near.shape[1]]]
        for hit in hits.tolist():
            p, w = divmod(hit, near.shape[1])
            begin, item = int(first[p]), int(index.item_of[w])
            r, n = int(row[begin]), len(index.words[item])
            if found.get((r, item), (0, 0))[1] >= 1:
                continue
            around = hashes[max(bounds[r], begin - n) : min(bounds[r + 1], begin + 2 * s.half + n)].tolist()
            if (got := _verdict(index, item, around)) and got[0] > found.get((r, item), (0, 0))[1]:
                found[r, item] = (min(1.0, float(near[p, w] / length[p])), *got)
    return found


def _scans(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, settings: Settings) -> Iterator[list[Broadcast[Index]]]:
    """The indexes that one scan of docs searches, for each scan."""
    rows = benchmark.select(F.col(item), F.col(item_text)).where(F.col(item_text).isNotNull()).toLocalIterator()
    frequencies = sample = None
    with Scratch(docs.sparkSession) as scratch:
        for some in batched(batched(rows, settings.items_at_once), settings.blocks_at_once):
            if not frequencies:
                frequencies = document_frequencies(docs, text=text, half=settings.half)
                dealt = F.xxhash64(F.col(key), F.col(text), F.lit(settings.seed))
                sample = scratch.written(sampled_passages(docs, frequencies[2], dealt, text=text, settings=settings), "passages")
            fitted = (fit(sample, sorted(((r[0], r[1]) for r in block), key=lambda r: (str(r[0]), r[1])), frequencies, settings=settings) for block in some)
            shared = [docs.sparkSession.sparkContext.broadcast(index) for index in fitted if index]
            if shared:
                yield shared


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """key, item, cosine, subsequence and answer of every pair of a document and an item that leaks into it."""
    item_name = f"item_{item}" if item == key else item
    told = (T.StructField("cosine", T.DoubleType()), T.StructField("subsequence", T.DoubleType()), T.StructField("answer", T.BooleanType()))
    of_doc, of_item = docs.select(key).schema[0].dataType, benchmark.select(item).schema[0].dataType
    kinds = T.StructType([T.StructField(key, of_doc), T.StructField(item_name, of_item), *told])
    item_kind, parts = to_arrow_type(of_item), []
    for indexes in _scans(docs, benchmark, key, text, item, item_text, settings):

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for first, data, at in textbytes.blocks(batch.column(1)):
                    words = _words(data, at)
                    for index in indexes:
                        out += [(first + r, index.value.ids[i], *found) for (r, i), found in _search(index.value, *words, len(at) - 1).items()]
                columns = list(zip(*out, strict=True)) or [()] * 5
                arrays = [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], item_kind), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

        parts.append(docs.select(key, text).mapInArrow(run, kinds))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], kinds)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that no item leaks into."""
    out, column = docs, docs.columns.index(text)
    for indexes in _scans(docs, benchmark, key, text, item, item_text, settings):

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for first, data, at in textbytes.blocks(batch.column(column)):
                    words = _words(data, at)
                    for index in indexes:
                        for r, _ in _search(index.value, *words, len(at) - 1):
                            clean[first + r] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
