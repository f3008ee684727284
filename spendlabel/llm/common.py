"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_path
from ..session import ship_package as ship

#: The characters that separate words and are stripped from line ends: [\x20\x09-\x0D].
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CHARS = SPACE_BYTES.decode()

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd base of the polynomial word hash modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the cluster's shared checkpoint folder and read it back: the
    lineage ends there, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (wrapping uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), wrapping; grown on demand and kept per worker."""
    global _POWERS
    while len(_POWERS) < n:
        step = _POWERS[-1:] * _BASE
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS[:n]


class Words:
    """The words of a column of texts as flat arrays.

    ``start``/``end`` are byte places in ``data``; ``doc`` is the row of each word;
    ``first[r] : first[r+1]`` are the words of row ``r``; null texts have none.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data = _LOWER[data] if lower else data
        self.off = off
        word = ~_IS_SPACE[self.data]
        begins, ends = word.copy(), np.zeros(len(word) + 1, bool)
        begins[1:] &= ~word[:-1]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(word))]
        begins[inner] = word[inner]  # a row's first byte starts a word of its own
        ends[1:-1] = word[:-1] & ~word[1:]
        ends[inner] |= word[inner - 1]
        if len(word):
            ends[-1] = word[-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):  # blocks of bytes keep the temporaries small
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + block, "right")))
            a, b = int(self.start[i]), int(self.end[j - 1])
            code = _BYTE_CODE[self.data[a:b]]
            s, e = self.start[i:j] - a, self.end[i:j] - a
            within = np.arange(b - a) - np.repeat(s, np.diff(np.append(s, b - a)))
            code *= _powers(int((e - s).max()) + 1)[np.minimum(within, int((e - s).max()))]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code, dtype=np.uint64)])
            out[i:j] = sums[e] - sums[s]
            i = j
        return mix64(out ^ ((self.end - self.start).astype(np.uint64) << np.uint64(48)))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (in any case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` without the columns that have one of ``names`` (in any case)."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             schema: T.StructType) -> DataFrame:
    """``mapInArrow`` over columns of any name: dots and quotes in names, which a plain
    call would resolve as paths, reach ``work`` and the result as they are."""
    held, made = df.columns, [f"c{i}" for i in range(len(schema))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(b.rename_columns(held) for b in batches):
            yield out.rename_columns(made)

    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(made, schema)])
    return df.toDF(*[f"c{i}" for i in range(len(held))]).mapInArrow(named, plain).toDF(*schema.names)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
