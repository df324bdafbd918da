"""Language identification in two steps.

A linear one-against-the-rest support vector machine predicts the language
family; within the family, one-versus-one linear support vector machines
separate the closely related languages, and the language that wins most of its
duels (then by margin, then by name) is the prediction. All are trained in numpy
on hashed letter trigrams of a bounded sample of rows.

A text's score for a hyperplane is the mean of the weights at its trigrams, so
whole texts of any length take one pass over their bytes.

Defined cases: `und` with score 0 for null texts and texts without a letter; when
nothing could be learned every prediction is `und`. A language without a family
in FAMILIES is a family of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes

BITS = 13
UNDETERMINED = "und"

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "bn", "mr", "ne", "pa", "gu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


@dataclass(frozen=True)
class Model:
    """Hyperplanes are columns of weights (buckets x planes) with a bias each."""

    families: list[str]
    languages: dict[str, list[str]]
    duels: dict[str, list[tuple[int, int, int]]]  # family -> (plane, one language's place, the other's)
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(column))
        for first, data, at in textbytes.blocks(column):
            n = len(at) - 1
            bucket, row = textbytes.letter_grams(data, at, BITS)
            length = np.maximum(np.bincount(row, minlength=n), 1)
            planes = np.stack([np.bincount(row, w[bucket], minlength=n) / length for w in self.weights.T], 1) + self.bias if self.weights.size else np.zeros((n, 0))
            lettered = _lettered(data, at)
            for i in range(n):
                name, scores[first + i] = self._one(planes[i]) if lettered[i] and self.families else (UNDETERMINED, 0.0)
                names.append(name)
        return names, scores

    def _one(self, plane: np.ndarray) -> tuple[str, float]:
        by_family = plane[: len(self.families)]
        best = int(np.argmax(by_family))
        family = self.families[best]
        rivals = np.exp(np.clip(by_family - by_family.max(), -30, 0))
        sure = float(rivals[best] / rivals.sum())
        own = self.languages[family]
        wins, margins = np.zeros(len(own)), np.zeros(len(own))
        for k, a, b in self.duels[family]:
            wins[a if plane[k] >= 0 else b] += 1
            margins[a] += plane[k]
            margins[b] -= plane[k]
        won = max(range(len(own)), key=lambda i: (wins[i], margins[i], own[i]))
        against = [plane[k] if a == won else -plane[k] for k, a, b in self.duels[family] if won in (a, b)]
        return own[won], sure * (1 / (1 + float(np.exp(-np.clip(min(against), -30, 30)))) if against else 1.0)


def _lettered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: by its ASCII bytes, else by its characters."""
    low = data | 32
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    found = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~found & (wide[at[1:]] > wide[at[:-1]])):
        found[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 800, max_rows: int = 4000, epochs: int = 30, reg: float = 1e-4) -> Model:
    """Train on about rows_per_language texts of each language (fewer if that were over max_rows of all), dealt by the hash of key and text.

    Rows that repeat a key and its text count once among those dealt.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text), F.lit(7)).alias("h"), F.xxhash64(text).alias("t"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    part, most = F.lit(False), min(rows_per_language, max_rows // max(1, len(counts)))
    for name, n in counts.items():
        part = part | ((F.col("lang") == name) & (F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1, most / n))))

    def grams(batches):
        for batch in batches:
            out = []
            for _, data, at in textbytes.blocks(batch.column(0)):
                bucket, row = textbytes.letter_grams(data, at, BITS)
                for i in range(len(at) - 1):
                    n = np.bincount(bucket[row == i], minlength=1 << BITS)
                    # the buckets that occur, then their counts
                    out.append(np.concatenate([b := np.flatnonzero(n), n[b]]).astype(np.uint32).tobytes() if n.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(out, pa.binary())], names=["lang", "h", "t", "f"])

    rows = known.where(part).dropDuplicates(["lang", "h", "t"]).mapInArrow(grams, "lang string, h long, t long, f binary").where("f is not null").collect() if counts else []
    rows.sort(key=lambda r: (r.h, r.t, r.lang))
    langs = sorted({r.lang for r in rows})
    if not rows:
        return Model([], {}, {}, np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    x, y = np.zeros((len(rows), 1 << BITS), np.float32), np.array([r.lang for r in rows])
    for i, r in enumerate(rows):
        bucket, n = np.frombuffer(r.f, np.uint32).reshape(2, -1)
        x[i, bucket] = n
    del rows
    x /= x.sum(1, keepdims=True)
    family_of = {name: _FAMILY.get(name, name) for name in langs}
    families = sorted(set(family_of.values()))
    languages = {f: [name for name in langs if family_of[name] == f] for f in families}
    fam = np.array([family_of[name] for name in y])
    planes = [_svm(x, np.arange(len(y)), np.where(fam == f, 1, -1), epochs, reg) if len(families) > 1 else (np.zeros(1 << BITS, np.float32), 0.0) for f in families]
    duels: dict[str, list[tuple[int, int, int]]] = {}
    for f in families:
        duels[f] = []
        for a, b in combinations(range(len(languages[f])), 2):
            one, two = y == languages[f][a], y == languages[f][b]
            duels[f].append((len(planes), a, b))
            planes.append(_svm(x, np.flatnonzero(one | two), np.where(one, 1, -1)[one | two], epochs, reg))
    return Model(families, languages, duels, np.stack([w for w, _ in planes], 1).astype(np.float32), np.array([b for _, b in planes]))


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int, reg: float) -> tuple[np.ndarray, float]:
    """Averaged stochastic subgradient descent (Pegasos) on the hinge loss, in small batches of these rows of x.

    Rows are scaled so that a typical one has length 1; the weights returned are
    for the rows as given.
    """
    scale = 1 / float(np.sqrt(np.einsum("ij,ij->i", x, x)[rows]).mean())
    share = {k: len(y) / (2 * (y == k).sum()) for k in (1, -1)}
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    total, bias, n = np.zeros_like(w), 0.0, 0
    order = np.random.default_rng(1)
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
            step += 1
            rate = 1 / (reg * (step + 1 / reg / 5))
            own = x[rows[part]]
            margin = y[part] * (own @ w * scale + b)
            cost = np.where(margin < 1, y[part] * np.where(y[part] > 0, share[1], share[-1]), 0).astype(np.float32)
            w = w * (1 - rate * reg) + (rate * scale / len(part)) * (cost @ own)
            b += rate * 0.1 * float(cost.mean())
            if epoch >= epochs // 2:
                total, bias, n = total + w, bias + b, n + 1
    return total / n * scale, bias / n


def identify(docs: DataFrame, model: Model, *, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred string and score double, their names behind prefix; columns of those names are replaced."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names, scores = model.predict(batch.column(batch.schema.get_field_index(text)))
        return {f"{prefix}lang_pred": pa.array(names, pa.string()), f"{prefix}score": pa.array(scores)}

    return textbytes.append_columns(docs, make, T.StructType([T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]))
