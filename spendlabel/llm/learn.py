"""Bounded training samples, hashed word features and sparse gradient descent in numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, ship

#: Hashed feature space of words and their beginnings and ends.
BITS = 20
#: Thai, Lao, Burmese, Khmer, kana and Han letters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def bounded_sample(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, other columns of ids) of at most ``rows`` of ``ids``, the first in the
    order of a hash of the id, one row each: where an id has several texts, the least. Only ids
    are sorted; the chosen ones (``rows`` at most, which bounds the broadcast and the result)
    then pick their texts in one scan, reduced in the tasks."""
    chosen = ids.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = (docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
             .groupBy("doc_id").agg(F.min("text").alias("text")))
    return texts.join(F.broadcast(chosen), "doc_id")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word, its 3-6 letter beginnings and 3-4 letter
    ends; in scripts written without spaces, where a word may be a sentence, every letter and
    every two letters in a row."""
    parts = [f"={word}"]
    parts += [f"^{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n]
    parts += [f"{word[-n:]}$" for n in (3, 4) if len(word) > n]
    for run in () if word.isascii() else _UNSPACED.findall(word):
        parts += [*run, *map("".join, zip(run, run[1:]))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in parts]


class Sparse:
    """Rows of (feature, value) pairs with the two products a linear model needs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c, _ in rows])
        self.col = np.concatenate([np.zeros(0, np.int32), *(c for c, _ in rows)])
        self.val = np.concatenate([np.zeros(0, np.float32), *(v for _, v in rows)])

    def keep(self, features: np.ndarray) -> Sparse:
        """The same rows over the given features, renumbered by place."""
        at = np.full(max(1 << BITS, 1), -1, np.int32)
        at[features] = np.arange(len(features))
        held = at[self.col] >= 0
        out = Sparse([])
        out.n, out.row, out.col, out.val = self.n, self.row[held], at[self.col[held]], self.val[held]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def dot_t(self, coef: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.col, self.val * coef[self.row], d)

    def presence(self, rows: np.ndarray) -> np.ndarray:
        """In how many of the marked rows each feature occurs."""
        return np.bincount(self.col[rows[self.row]], minlength=1 << BITS)


def word_weights(text: str | None) -> dict[str, float]:
    """Each distinct lower-case word with 1 + log(its count): a word repeated hundreds of
    times says little more than a word said a few times."""
    return {w: 1.0 if n == 1 else 1.0 + log(n) for w, n in Counter((text or "").lower().split()).items()}


def sampled_features(sample: DataFrame, label: str) -> tuple[list, Sparse]:
    """Labels and feature rows of a bounded sample (``label``, text). The tasks turn texts
    into weighted hashed features; the driver gets these rows, in an order that does not
    depend on the partitioning."""
    ship(sample.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for b in batches:
            cols, vals = [], []
            for text in column(b, "text").to_pylist():
                feats, weights = [], []
                for word, n in word_weights(text).items():
                    f = table.get(word)
                    if f is None:
                        if len(table) >= 200_000:
                            table.clear()
                        f = table[word] = word_features(word)
                    feats += f
                    weights += [n] * len(f)
                c, at = np.unique(np.array(feats, np.int32), return_inverse=True)
                cols.append(c.astype("<i4").tobytes())
                vals.append(np.bincount(at, weights, len(c)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(b, label), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], [label, "cols", "vals"])

    kind = dict(sample.dtypes)[label]
    rows = [(r[0], bytes(r.cols), bytes(r.vals)) for r in sample.select(label, "text").mapInArrow(
        featurise, f"{label} {kind}, cols binary, vals binary").toLocalIterator()]
    rows.sort()
    return [r[0] for r in rows], Sparse([(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")) for _, c, v in rows])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    def __init__(self, d: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(d), np.zeros(d), 0, rate

    def step(self, w: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class WordScores(dict):
    """Word -> sum of its features' weights (a float, or a row for several outputs).
    Bounded: when full it starts anew, which costs time only."""

    ROWS, LONG = 400_000, 64

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        super().__init__()
        self.at = {int(f): i for i, f in enumerate(features)}
        self.weights = weights
        self.zero = weights[:0].sum(0)

    def __missing__(self, word: str):
        rows = [self.at[f] for f in word_features(word) if f in self.at]
        s = self.weights[rows].sum(0) if rows else self.zero
        s = float(s) if self.weights.ndim == 1 else s
        if len(word) <= self.LONG:
            if len(self) >= self.ROWS:
                self.clear()
            self[word] = s
        return s
