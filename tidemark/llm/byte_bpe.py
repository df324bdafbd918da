"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until the pieces are short; each piece is encoded by itself, and
neighbours are joined by encoding a window around their boundary anew. The window
grows until both of its edges are stable cuts: a space between two characters
that are no white space begins a new match of the pattern whatever surrounds it,
so the tokens outside cannot change. The join is associative, and a piece's
encoding is all that a join needs. Decoding joins the bytes up the same tree.

Defined cases: null and empty texts have no tokens. A text with no stable cut at
all ends in a window over all of it, which is its plain encoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import textbytes
from tidemark.llm.token_counts import _BLANK

#: Characters of a text, or ids, that make a leaf.
LEAF = 1 << 14
#: Characters on each side of a boundary that are encoded anew at first.
WINDOW = 32

_CUT = re.compile(rf"(?<=[^{_BLANK}]) (?=[^{_BLANK}])")


class TreeCodec:
    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, begin: int, end: int) -> list[int]:
        if end - begin <= LEAF:
            return self._leaf(text[begin:end])
        middle = (begin + end) // 2
        return self.join(text, begin, middle, end, self._encode(text, begin, middle), self._encode(text, middle, end))

    def join(self, text: str, begin: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Encoding of text[begin:end] from the encodings of its two parts."""
        wide = WINDOW
        while True:
            low, high = max(begin, middle - wide), min(end, middle + wide)
            # a cut needs the character behind it in the same part
            cuts = [m.start() for m in _CUT.finditer(text, low, middle)]
            first = cuts[-1] if cuts else begin if low == begin else None
            found = _CUT.search(text, middle, high)
            last = found.start() if found else end if high == end else None
            if first is not None and last is not None:
                kept_left = self._without(left, len(text[first:middle].encode("utf-8", "replace")), from_end=True)
                kept_right = self._without(right, len(text[middle:last].encode("utf-8", "replace")), from_end=False)
                if kept_left is not None and kept_right is not None:
                    return kept_left + self._leaf(text[first:last]) + kept_right
            wide *= 2

    def _without(self, ids: list[int], n: int, *, from_end: bool) -> list[int] | None:
        """ids without those of the last or first n bytes; None if no token begins there."""
        k = 0
        while n > 0 and k < len(ids):
            k += 1
            n -= len(self._bytes[ids[-k] if from_end else ids[k - 1]])
        if n:
            return None
        return ids[: len(ids) - k] if from_end else ids[k:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self._bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> TreeCodec:
    return TreeCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids (array<int>) of each text; path: of a file of ranks, the same on every executor."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(batch.schema.get_field_index(text))
        return {out: pa.array([_codec(path, pattern).encode(x.as_py() or "") for x in column], pa.list_(pa.int32()))}

    return textbytes.append_columns(docs, make, T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes (binary) of each array of ids."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(batch.schema.get_field_index(ids))
        return {out: pa.array([_codec(path, pattern).decode(x.as_py() or []) for x in column], pa.binary())}

    return textbytes.append_columns(docs, make, T.StructType([T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encoded, and decoded again from the ids, in one pass."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column, codec = batch.column(batch.schema.get_field_index(text)), _codec(path, pattern)
        sizes, of_ids, of_bytes = [], [], []
        for x in column:
            ids = codec.encode(x.as_py() or "")
            sizes.append(len(ids))
            of_ids.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_bytes)}

    return textbytes.append_columns(docs, make, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
