"""Phrases that stand together, from the weighted de Bruijn graph of a corpus.

Texts are cut into pieces and these into words; counts are per language. Only the
longest grams (three words) are counted over the corpus, beside the last words of
the pieces. A three-word gram is an edge of the graph, from the node of its first
two words to the node of its last two. All shorter counts are derived: a two-word
phrase occurs as often as its node's edges go out plus as often as pieces end with
it, a word as often as the nodes that begin with it plus the pieces that end with it.

Tasks count grams in blocks of bounded size and send them packed: the grams of one
block that fall into one bucket of nodes are one row, sorted, so that the shuffle is
a small part of the text. A bucket has all edges of its nodes, so their flows need no
second shuffle, and a frequent gram arrives once for each block. Buckets leave only
the edges and nodes that occur often enough, and their words' counts.

The graph of those edges is compacted: runs of nodes with
one way in and one way out become paths, by pointer doubling, each path one row with
its edges' counts and its nodes' flows. One node in CUT by hash counts as a branch,
which bounds the length of a path's row and the number of rounds; a ring without any
branch stays edge by edge. Three-word phrases are scored from their path's row.

Defined cases: a null text is an empty one, a null language is `und`; empty pieces
count for nothing; repeated rows count each time; equal scores go by count, then by
the phrase's bytes. A gram's words hold no space, tab or line end, so a gram is its
words with single spaces between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import Scratch, written

#: Bytes of text that a task gathers before it counts; grams that are counted at once.
BLOCK_BYTES, BLOCK_GRAMS = 1 << 22, 1 << 18
#: One node in so many ends a path.
CUT = 16
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD, _SPACE, _END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _END
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, 1024, np.int64).astype(np.uint64) | np.uint64(1)


class _Words:
    """The words of some texts on end, with one space behind each."""

    def __init__(self, text: bytes) -> None:
        data = _LOWER[np.frombuffer(text, np.uint8)]
        kind = _KIND[data]
        word = kind == _WORD
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        begin, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        self.piece = np.searchsorted(np.flatnonzero(kind == _END), begin)
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size
        self.data = np.full(int(self.end[-1]) + 1 if len(size) else 0, 32, np.uint8)
        letters = np.ones(len(self.data), bool)
        letters[self.end] = False
        self.data[letters] = data[word]

    def grams(self, n: int, *, last: bool = False) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Blocks of the different grams of n words inside pieces (only those that end a piece, if last) and how often each occurs."""
        first = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.zeros(0, np.int64)
        if last:
            after = first + n
            first = first[(after == len(self.piece)) | (self.piece[np.minimum(after, len(self.piece) - 1)] != self.piece[first])]
        for i in range(0, len(first), BLOCK_GRAMS):
            at = first[i : i + BLOCK_GRAMS]
            begin, size = self.begin[at], self.end[at + n - 1] - self.begin[at]
            offsets = np.concatenate([[0], np.cumsum(size)])
            place = np.repeat((begin - offsets[:-1]).astype(np.int64), size) + np.arange(offsets[-1])
            got = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[place])]).value_counts()
            yield got.field("values"), got.field("counts").to_numpy(zero_copy_only=False)


def _packed(grams: pa.Array, counts: np.ndarray, n: int, buckets: int) -> tuple[list[int], pa.Array, pa.Array]:
    """Buckets (by the first two words), the grams of each as one text of sorted lines, and their counts."""
    offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1].astype(np.int64)
    data = np.frombuffer(grams.buffers()[2], np.uint8)[: offsets[-1]]
    node_end = np.flatnonzero(data == 32).reshape(len(grams), 2)[:, 1] if n == 3 else offsets[1:]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    mixed = np.append((data.astype(np.uint64) + np.uint64(1)) * _PLACES[place & 1023], np.uint64(0))
    bounds = np.stack([offsets[:-1], node_end], 1).ravel()
    h = np.add.reduceat(mixed, bounds)[::2]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    # sorted by their first bytes, which is enough to make them small
    head = data[np.minimum(offsets[:-1, None] + np.arange(8), len(data) - 1)].copy().view(">u8").ravel()
    order = np.lexsort((head, bucket))
    ordered = bucket[order]
    cuts = np.flatnonzero(np.diff(ordered, prepend=-1, append=buckets))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
    lines = pc.binary_join(lists(grams.take(pa.array(order)).cast(pa.string())), "\n")
    return ordered[cuts[:-1]].tolist(), lines, lists(pa.array(counts[order], pa.int64()))


_CELLS = "bucket int, parts array<struct<lang: string, words: int, grams: string, counts: array<long>>>"
_PART = pa.struct([("lang", pa.string()), ("words", pa.int32()), ("grams", pa.string()), ("counts", pa.list_(pa.int64()))])


def _by_bucket(cells: list[int], parts: list[pa.StructArray]) -> pa.RecordBatch:
    """One row for each bucket, with its parts."""
    bucket = np.array(cells, np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.concat_arrays(parts).take(pa.array(order)))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts[:-1]]), lists], names=["bucket", "parts"])


def _cells(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed counts of each task's blocks: grams of three words, and the two words and the word that end a piece. docs: lang, text."""

    def counted(texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        cells, parts, held = [], [], 0
        for lang, some in texts.items():
            words = _Words(b"\n".join(some))
            for n, last in ((3, False), (2, True), (1, True)):
                for grams, counts in words.grams(n, last=last):
                    cell, lines, numbers = _packed(grams, counts, n, buckets)
                    cells += cell
                    same = lambda v, kind: pa.array([v] * len(cell), kind)
                    parts.append(pa.StructArray.from_arrays([same(lang, pa.string()), same(n, pa.int32()), lines, numbers], fields=list(_PART)))
                    held += len(grams)
                    if held >= 2 * BLOCK_GRAMS:
                        yield _by_bucket(cells, parts)
                        cells, parts, held = [], [], 0
        if cells:
            yield _by_bucket(cells, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                texts.setdefault(lang.as_py(), []).append(raw)
                held += len(raw)
                if held >= BLOCK_BYTES:
                    yield from counted(texts)
                    texts, held = {}, 0
        yield from counted(texts)

    return docs.mapInArrow(run, _CELLS)


def _lines(blobs: pa.Array) -> pa.Array:
    """The lines of all texts, one on the other."""
    data = np.frombuffer("\n".join(blobs.to_pylist()).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    size = np.diff(ends, prepend=-1) - 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


def _totals(grams: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different grams and the sum of each one's counts (doubles hold them exactly)."""
    told = grams.dictionary_encode()
    return told.dictionary, np.bincount(told.indices.to_numpy(), counts, len(told.dictionary)).astype(np.int64)


def _heads(grams: pa.Array, words: int) -> pa.Array:
    """The first words of each gram of one word more."""
    if not len(grams):
        return grams
    offsets = np.frombuffer(grams.buffers()[1], np.int32)[: len(grams) + 1].astype(np.int64)
    data = np.frombuffer(grams.buffers()[2], np.uint8)[: offsets[-1]]
    begin, end = offsets[:-1], np.flatnonzero(data == 32).reshape(len(grams), words)[:, -1]
    marks = np.zeros(len(data) + 1, np.int8)
    marks[begin] += 1
    marks[end] -= 1
    kept = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    size = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(size), pa.py_buffer(data[kept])])


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.concat_arrays([x for x in (a, b) if len(x)] or [a])


def graph(docs: DataFrame, *, text: str = "text", group: str = "lang", least: int = 1, buckets: int | None = None) -> DataFrame:
    """lang, words, gram, n: edges (words 3) and nodes with their flows (2) that occur `least` times or more, and parts of the words' counts (1).

    buckets: four for each shuffle partition, if not given.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text).alias("text"))

    def added(cells: pa.Table) -> pa.Table:
        out = []
        parts = cells.column("parts").combine_chunks().flatten()
        where: dict[tuple[str, int], list[int]] = {}
        for i, key in enumerate(zip(parts.field("lang").to_pylist(), parts.field("words").to_pylist(), strict=True)):
            where.setdefault(key, []).append(i)
        for lang in dict.fromkeys(lang for lang, _ in where):

            def told(n: int) -> tuple[pa.Array, np.ndarray]:
                if (lang, n) not in where:
                    return pa.array([], pa.binary()), np.zeros(0, np.int64)
                some = parts.take(pa.array(where[lang, n]))
                return _totals(_lines(some.field("grams")), some.field("counts").flatten().to_numpy())

            edges, n = told(3)
            pairs, pair_ends = told(2)
            single, single_ends = told(1)
            nodes, flow = _totals(_joined(_heads(edges, 2), pairs), np.concatenate([n, pair_ends]))
            words, f = _totals(_joined(_heads(nodes, 1), single), np.concatenate([flow, single_ends]))
            for size, grams, count, most in ((3, edges, n, least), (2, nodes, flow, least), (1, words, f, 1)):
                enough = count >= most
                out.append(pa.table({"lang": pa.array([lang] * int(enough.sum()), pa.string()), "words": pa.array(np.full(enough.sum(), size, np.int32)), "gram": grams.filter(pa.array(enough)).cast(pa.string()), "n": pa.array(count[enough])}))
        return pa.concat_tables(out)

    return _cells(given, buckets).groupBy("bucket").applyInArrow(added, "lang string, words int, gram string, n long")


def word_counts(found: DataFrame) -> DataFrame:
    """lang, word, f: from the nodes that begin with a word and the pieces that end with it. found: see graph."""
    return found.where("words = 1").groupBy("lang", F.col("gram").alias("word")).agg(F.sum("n").alias("f"))


def _nodes(found: DataFrame, heavy: DataFrame) -> DataFrame:
    """lang, node, flow, into (an edge to it), best (its heaviest edge), joins (whether a path goes on through it)."""
    none = lambda kind: F.lit(None).cast(kind)
    sides = [
        heavy.select("lang", F.col("src").alias("node"), F.lit(1).alias("outs"), F.lit(0).alias("ins"), none("string").alias("into"), F.col("n").alias("best"), none("long").alias("flow")),
        heavy.select("lang", F.col("dst").alias("node"), F.lit(0).alias("outs"), F.lit(1).alias("ins"), F.col("edge").alias("into"), F.col("n").alias("best"), none("long").alias("flow")),
        found.where("words = 2").select("lang", F.col("gram").alias("node"), F.lit(0).alias("outs"), F.lit(0).alias("ins"), none("string").alias("into"), none("long").alias("best"), F.col("n").alias("flow")),
    ]
    of_node = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("lang", "node")
    joined = of_node.agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"), F.max("into").alias("into"), F.max("best").alias("best"), F.max("flow").alias("flow"))
    joins = (F.col("outs") == 1) & (F.col("ins") == 1) & (F.pmod(F.xxhash64("lang", "node"), F.lit(CUT)) != 0)
    return joined.select("lang", "node", "flow", "into", "best", joins.alias("joins"))


def _ranked(heavy: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Each heavy edge with `at`, the first edge of its path, and `place` on it. Rounds: the logarithm of the longest path."""
    src = nodes.select("lang", F.col("node").alias("src"), F.col("flow").alias("src_flow"), F.when(F.col("joins"), F.col("into")).alias("before"))
    dst = nodes.select("lang", F.col("node").alias("dst"), F.col("flow").alias("dst_flow"))
    linked = heavy.join(src, ["lang", "src"]).join(dst, ["lang", "dst"])
    first = F.col("before").isNull() | (F.col("before") == F.col("edge"))
    ranked = linked.select("lang", "edge", "n", "src_flow", "dst_flow", F.when(first, F.col("edge")).otherwise(F.col("before")).alias("at"), F.when(first, 0).otherwise(1).alias("place"), first.alias("done"))
    ranked = scratch.written(ranked, "ranked")
    left, before = ranked.where("not done").count(), None
    while left and left != before:
        ahead = ranked.select("lang", F.col("edge").alias("at"), F.col("at").alias("further"), F.col("place").alias("more"), F.col("done").alias("reached"))
        moved = ranked.where("not done").join(ahead, ["lang", "at"]).withColumns({"at": F.col("further"), "place": F.col("place") + F.col("more"), "done": F.col("reached")})
        ranked = scratch.written(ranked.where("done").unionByName(moved.select(ranked.columns)), "ranked")
        before, left = left, ranked.where("not done").count()
    # what is left goes round in a ring
    return ranked.withColumns({"at": F.when(F.col("done"), F.col("at")).otherwise(F.col("edge")), "place": F.when(F.col("done"), F.col("place")).otherwise(0)})


def _paths(ranked: DataFrame) -> DataFrame:
    """lang, words, counts (of the edges), flows (of the nodes, one more): a row for each path."""
    steps = F.sort_array(F.collect_list(F.struct("place", "edge", "n", "src_flow", "dst_flow")))
    path = ranked.groupBy("lang", "at").agg(steps.alias("s"))
    words = F.concat(F.split("at", " "), F.transform(F.slice("s", 2, F.size("s")), lambda e: F.substring_index(e["edge"], " ", -1)))
    flows = F.concat(F.array(F.col("s")[0]["src_flow"]), F.transform("s", lambda e: e["dst_flow"]))
    return path.select("lang", words.alias("words"), F.transform("s", lambda e: e["n"]).alias("counts"), flows.alias("flows"))


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def heavy_edges(found: DataFrame) -> DataFrame:
    """lang, edge, n, src, dst of what graph gave as edges."""
    tail = F.expr("substring(gram, instr(gram, ' ') + 1)")
    return found.where("words = 3").select("lang", F.col("gram").alias("edge"), "n", F.substring_index("gram", " ", 2).alias("src"), tail.alias("dst"))


def scored(found: DataFrame, words: DataFrame, *, least: int, share: int, scratch: Scratch) -> DataFrame:
    """lang, phrase, a, l, r, score of all phrases of two or three words that occur often enough and aren't dropped. found, words: written tables."""
    heavy = scratch.written(heavy_edges(found), "heavy")
    nodes = scratch.written(_nodes(found, heavy), "nodes")
    paths = _paths(_ranked(heavy, nodes, scratch))
    on_path = F.transform(
        "counts",
        lambda n, i: F.struct(F.array_join(F.slice("words", i + 1, 3), " ").alias("phrase"), n.alias("a"), F.element_at("words", i + 1).alias("first"), F.element_at("words", i + 3).alias("last"), F.element_at("flows", i + 1).alias("l2"), F.element_at("flows", i + 2).alias("r2")),
    )
    threes = paths.select("lang", F.explode(on_path).alias("c")).select("lang", "c.*")
    none = F.lit(None).cast("long")
    # a phrase of two words goes if one of three, which is an edge of its node, has its share
    kept = nodes.where(F.coalesce(F.col("best") * 100 < F.col("flow") * share, F.lit(True)))
    twos = kept.select("lang", F.col("node").alias("phrase"), F.col("flow").alias("a"), F.substring_index("node", " ", 1).alias("first"), F.substring_index("node", " ", -1).alias("last"), none.alias("l2"), none.alias("r2"))
    often = words.where(F.col("f") >= least)
    of = lambda name: often.select("lang", F.col("word").alias(name), F.col("f").alias(f"f_{name}"))
    both = threes.unionByName(twos).join(of("first"), ["lang", "first"]).join(of("last"), ["lang", "last"])
    one = F.struct(_score(F.col("a"), F.col("f_first"), F.coalesce("r2", "f_last")).alias("score"), F.lit(1).alias("k"), F.col("f_first").alias("l"), F.coalesce("r2", "f_last").alias("r"))
    two = F.struct(_score(F.col("a"), F.col("l2"), F.col("f_last")).alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("f_last").alias("r"))
    lowest = F.when(F.col("l2").isNull(), one).otherwise(F.least(one, two))
    return both.withColumn("cut", lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, *, text: str = "text", group: str = "lang", least: int = 10, share: int = 50, top: int = 2000, salt: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two or three words.

    least: occurrences that a phrase needs; share: percentage of a phrase's
    occurrences that must lie in one longer phrase for it to be dropped.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.written(graph(docs, text=text, group=group, least=least), "grams")
        words = scratch.written(word_counts(found), "words")
        ranked = scored(found, words, least=least, share=share, scratch=scratch)
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # a language may have most phrases, so each of its parts gives its own first ones first
        parts = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(salt)))
        some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        return written(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
