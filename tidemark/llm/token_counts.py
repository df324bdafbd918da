"""Exact token counts of whole texts with a public subword tokenizer.

Overlap resynchronisation: a long text is encoded in overlapping chunks with the
offsets of their parts. Neighbours are spliced at a boundary that both chunks
have and that is proven stable: a space between two characters that are no white
space always begins a new match of the tokenizer's pattern, whatever stands
before or behind. If an overlap holds no common boundary it is widened until
there is one or the text ends. So memory follows the chunk, not the text.

The parts between stable boundaries (mostly words) are counted by the tokenizer
itself, once in each Python worker as long as they are remembered.

Defined cases: null and empty texts have 0 tokens.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 1 << 16, 256
#: Parts that a worker remembers at most (then it forgets all of them), and characters of one that is remembered.
REMEMBERED, LONGEST = 300_000, 64

_BLANK = r"\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff\ufff0-\uffff"
#: A space beside something that is, or might be, white space.
_UNSTABLE = re.compile(rf" [{_BLANK}]|[{_BLANK}] ")


def stable_parts(text: str) -> list[str]:
    """The text cut before each stable space; the parts but the first begin with one (which is left out here)."""
    pieces = text.split(" ")
    if not _UNSTABLE.search(text):
        return pieces
    out = [pieces[0]]
    blank = re.compile(rf"[{_BLANK}]")
    for x in pieces[1:]:
        before = out[-1][-1:]
        if before and x and not blank.match(before) and not blank.match(x[0]):
            out.append(x)
        else:
            out[-1] += " " + x
    return out


class TokenCounter:
    """Counts with the tokenizer of a file; remembers the counts of parts."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            raise ValueError("a sentencepiece model has other stable boundaries; give a tokenizers .json")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._inner: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        encode = getattr(self._tokenizer, "encode_batch_fast", self._tokenizer.encode_batch)
        return [len(e.ids) for e in encode(texts, add_special_tokens=False)]

    def _learn(self, parts: Iterable[str]) -> Callable[[str], int]:
        """Counts of these parts; long ones are not remembered, so that memory is bounded in bytes."""
        if len(self._inner) > REMEMBERED:
            self._inner.clear()
        new, long = [p for p in set(parts) if p not in self._inner], {}
        for i in range(0, len(new), 4096):
            for part, n in zip(new[i : i + 4096], self._library([" " + p for p in new[i : i + 4096]]), strict=True):
                (self._inner if len(part) <= LONGEST else long)[part] = n
        return (lambda p: long[p] if p in long else self._inner[p]) if long else self._inner.__getitem__

    def count_all(self, texts: list[str]) -> list[int]:
        short = {i: stable_parts(t) for i, t in enumerate(texts) if t and len(t) <= CHUNK}
        get = self._learn(p for parts in short.values() for p in parts[1:])
        firsts = dict(zip(short, self._library([p[0] for p in short.values()]), strict=True)) if short else {}
        counts = [firsts[i] + sum(map(get, short[i][1:])) if i in short else 0 for i in range(len(texts))]
        # afterwards, for a long text may make the worker forget the parts of the short ones
        return [self.count_long(t) if t and i not in short else n for i, (t, n) in enumerate(zip(texts, counts, strict=True))]

    def _encoded(self, text: str, at: int) -> tuple[list[int], list[int]]:
        """Offsets in the whole text where the parts of a chunk begin, and the tokens before each of them."""
        parts = stable_parts(text)
        counts = [self._library(parts[:1])[0] if parts[0] else 0, *map(self._learn(parts[1:]), parts[1:])]
        starts = [at, *(at + n + i for i, n in enumerate(accumulate(len(p) for p in parts[:-1])))]
        return starts, [0, *accumulate(counts)]

    def count_long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        n, begin, total = len(text), 0, 0
        splice = 0  # all before it is counted; a part begins there
        while True:
            wide = overlap
            while True:
                end = min(n, begin + chunk + wide)
                starts, tokens = self._encoded(text[begin:end], begin)
                if end == n:
                    return total + tokens[-1] - tokens[bisect.bisect_left(starts, splice)]
                right = begin + chunk
                ahead, _ = self._encoded(text[right:end], right)
                # the first part of the right chunk and the last of the left one are cut off
                common = sorted(set(starts[1:]) & set(ahead[1:]))
                if common:
                    break
                wide *= 2
            total += tokens[bisect.bisect_left(starts, common[0])] - tokens[bisect.bisect_left(starts, splice)]
            begin = splice = common[0]


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; columns of those names are replaced.

    path: of a byte-level BPE tokenizer's .json file, the same on every executor.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(batch.schema.get_field_index(text))
        counts: list[int] = []
        for i in range(0, len(column), 256):
            counts += _counter(path).count_all([t or "" for t in column.slice(i, 256).to_pylist()])
        return {"n_tokens": pa.array(counts, pa.int64())}

    counted = textbytes.append_columns(docs, make, T.StructType([T.StructField("n_tokens", T.LongType())]))
    return counted.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})
