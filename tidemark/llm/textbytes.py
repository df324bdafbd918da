"""Vectorised views of a text column: UTF-8 bytes, words and n-grams as 64-bit hashes.

All functions work on the Arrow buffer of a batch, without a Python object for
each word. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that are hashed at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits and all of multi-byte characters.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Lower-cased letters; everything else in ASCII is a space.
_LETTERS = np.where((np.arange(256) >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)), _LOWER, 32).astype(np.uint8)


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: T.StructType) -> DataFrame:
    """df with further columns that make computes from each Arrow batch; columns of those names are replaced."""
    kept = df.drop(*schema.names)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = make(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *new.values()], names=[*names, *new])

    # `make` may read a column that it replaces, so it sees all of df
    return df.mapInArrow(run, T.StructType([*kept.schema.fields, *schema.fields]))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each begins (one more offset than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most limit bytes of text (or one row): first row, bytes, offsets."""
    data, at = text_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the row that it is in. No word reaches over two rows."""
    mask = is_word[data]
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    edges = at[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    begin, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return begin, end, np.searchsorted(at, begin, side="right") - 1


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse. What is kept follows the size of a block, not the longest text."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    size = max(n, BLOCK_BYTES + 1)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    tables = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, inverse)]
    if size == BLOCK_BYTES + 1:
        _powers[:] = tables
    return tables[0], tables[1]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the accented capitals of Latin-1 in lower case."""
    low = _LOWER[data]
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    low[capital] += 0x20
    return low


class SpanHasher:
    """Hashes of spans of a block's bytes, in order of their begin and whatever their case, in a few array operations."""

    def __init__(self, data: np.ndarray) -> None:
        self._data, self._sums = data, None

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self._data) <= BLOCK_BYTES:
            if self._sums is None:
                self._sums = _prefix_sums(self._data)
            return self._hashed(self._sums, begin, end)
        # a long text a stretch at a time
        out = np.empty(len(begin), np.uint64)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + BLOCK_BYTES // 2)))
            low, high = int(begin[i]), int(end[i:j].max())
            out[i:j] = self._hashed(_prefix_sums(self._data[low:high]), begin[i:j] - low, end[i:j] - low)
            i = j
        return out

    @staticmethod
    def _hashed(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power_tables(len(sums))[1]
        h = (sums[end] - sums[begin]) * down[begin]
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    up = _power_tables(len(data) + 1)[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lowered(data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def letter_grams(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each run of three bytes of letters and single spaces, and the row it is in."""
    plain = _LETTERS[lowered(data)]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # runs of non-letters count as one space
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32) | (row[1:] != row[:-1])
    plain, row = plain[keep].astype(np.uint32), row[keep]
    if len(plain) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (plain[:-2] << np.uint32(16)) | (plain[1:-1] << np.uint32(8)) | plain[2:]
    inside = row[:-2] == row[2:]
    bucket = (gram[inside] * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return bucket.astype(np.int64), row[:-2][inside]
