"""One-vs-rest logistic classifier over hashed n-grams.

Tables
  weights  W(bucket, block, w[], g2[])   observed buckets with AdaGrad accumulators, the classes
                                         in blocks of ``CLASS_BLOCK`` (the last one ends in zeros)
  rows     R(row_id, text, category, weight)   one row per distinct training row id
  cells    R without text, with b[], x[]       its sparse feature row (``sparse_rows``)

A row's features are the L2-normalised counts of its hashed unigrams and bigrams (O36-O38). A
text is tokenised once per fit; every step reads the stored sparse rows.

One step: margins and residuals per row, gradient sums per bucket (added up in the tasks first),
which meet the weights by ranges of buckets, so that AdaGrad on the mean logistic loss +
alpha * L2 updates every bucket seen so far, also those that this step does not touch. Weights are read and written as tables; the driver holds class names and
intercepts.

Rows meet the weights in one of two ways with the same result. Weights of at most
``BROADCAST_BYTES`` (observed buckets x classes, counted) are broadcast, and a step or a scoring
is one map over the rows. Larger ones go by shuffle. In a step a task has a tile: a run of
blocks of classes, whose weights it holds, and the rows, which stream past; so the gradient of
a run is added up in one place, and where the tile sees every row its weights are updated there.
Scoring deals the rows over tasks that hold all weights. Weights too large for that are joined: rows are
dealt into chunks of bounded size, each chunk's distinct buckets are joined with the weights, and every
(chunk, run of blocks of classes) is worked on by itself. Rows are multiplied some at a time, as
a dense matrix over their distinct buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import joined_tokens
from ..session import scratch_path, ship_package
from .features import DEFAULT_BITS, buckets, cells_of, text_slices

# The classifier's settings.
ALPHA = 1e-5
ETA = 0.5
EPS = 1e-8
TOP_K = 3
STEPS_UPDATE = 1
STEPS_REFIT = 5
#: Classes of one weight row.
CLASS_BLOCK = 32
#: Weights above this size are joined by shuffle (``Model.broadcast_bytes``).
BROADCAST_BYTES = 64 << 20
#: Bounds of one chunk of rows: cells, distinct buckets and rows; a longer row is a chunk of its own.
CHUNK_CELLS, CHUNK_BUCKETS, CHUNK_ROWS = 1 << 20, 1 << 15, 1 << 16
#: Blocks of classes that a chunk meets at a time.
BLOCKS_AT_A_TIME = 4
#: A step over more classes goes by tiles: a task cannot add up so wide sums of many buckets.
MAP_CLASSES = 256
#: Doubles of the weights that a tile of a step holds (one block of classes at least), and a task that scores.
TILE_DOUBLES, SCORE_DOUBLES = 1 << 22, 1 << 25
#: Cells that a step may move for the sake of more runs of classes than the tiles' size asks for.
CELLS_MOVED = 1 << 29
#: Rows and cells that are multiplied as one dense matrix, or one row; up to so many classes are gone through one by one.
PIECE_ROWS, PIECE_CELLS, FLAT_CLASSES = 64, 1 << 13, 8
#: Doubles that a task multiplies at a time.
_AT_A_TIME = 1 << 22

WEIGHTS_SCHEMA = T.StructType([
    T.StructField("bucket", T.IntegerType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("w", T.ArrayType(T.DoubleType())),
    T.StructField("g2", T.ArrayType(T.DoubleType())),
])
_BIAS = -1  # the bucket of the intercepts while a step runs
#: Weights as a step by tiles stores them: some buckets of a block in a row, as bytes, since a row costs
#: far more on its way to a task than its bytes do. Intercepts are rows by themselves.
PACKED_SCHEMA = T.StructType([T.StructField("bias", T.BooleanType()), T.StructField("block", T.IntegerType()),
                              *(T.StructField(c, T.BinaryType()) for c in ("at", "w", "g2"))])
#: Buckets of a pack of weights, cells of a pack of rows (or one row), and how packs are written: a reader
#: holds a row group.
PACK_BUCKETS, PACK_CELLS = 256, 1 << 13
_PACKS = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false"}


@dataclass
class Model:
    classes: list[str]
    weights: DataFrame
    intercept: list[float]
    intercept_g2: list[float]
    bits: int = DEFAULT_BITS
    n_observed: int = 0  # observed buckets
    rows_trained: int = 0
    version: int | None = None
    broadcast_bytes: int = BROADCAST_BYTES
    packed: DataFrame | None = None  # the weights as of ``PACKED_SCHEMA``, where a step left them so

    @property
    def k(self) -> int:
        return len(self.classes)

    @property
    def width(self) -> int:
        """Classes of a weight row."""
        return max(1, min(self.k, CLASS_BLOCK))

    @property
    def blocks(self) -> int:
        return -(-self.k // self.width)

    def class_name(self, idx: Column) -> Column:
        arr = F.array(*[F.lit(c) for c in self.classes])
        return F.element_at(arr, idx + 1)

    def fits_broadcast(self) -> bool:
        return self.n_observed * self.k * 8 <= self.broadcast_bytes

    def long_weights(self) -> DataFrame:
        """(bucket, class_id, w): a row for each observed bucket and class."""
        return (self.weights.select("bucket", "block", F.posexplode("w").alias("i", "w"))
                .select("bucket", (F.col("block") * self.width + F.col("i")).alias("class_id"), "w")
                .where(F.col("class_id") < self.k))


# -- sparse rows -------------------------------------------------------------------------

Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # buckets, values, first cell of each row


def _count_cells(tokens: pa.Array, bits: int) -> Cells:
    """Cells of rows of joined tokens: n-gram counts over the row's Euclidean norm."""
    n = len(tokens)
    row, bucket, tf = cells_of(*buckets(tokens, bits))
    norm = np.sqrt(np.bincount(row, tf * tf, n))
    return bucket.astype(np.int32), tf / norm[row], np.append(0, np.cumsum(np.bincount(row, minlength=n)))


def _held_cells(b: pa.Array, x: pa.Array) -> Cells:
    return b.flatten().to_numpy(), x.flatten().to_numpy(), np.append(0, np.cumsum(b.value_lengths().to_numpy()))


def _slices(batches: Iterator[pa.RecordBatch], lists: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``limit`` entries of column ``lists`` at most, or one row."""
    for b in batches:
        end = np.cumsum(b.column(b.schema.names.index(lists)).value_lengths().to_numpy())
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.ascontiguousarray(flat).ravel()))


def _with_tokens(df: DataFrame, text: str, drop: bool) -> DataFrame:
    return df.select(*[c for c in df.columns if not (drop and c == text)], joined_tokens(text).alias("__t"))


def sparse_rows(df: DataFrame, text: str = "text", bits: int = DEFAULT_BITS) -> DataFrame:
    """``df`` without ``text``, with b (buckets) and x (values): the text's sparse feature row.
    Tokens are column expressions; the task hashes each distinct n-gram once and counts."""
    ship_package(df.sparkSession)
    tokens = _with_tokens(df, text, drop=True)
    schema = T.StructType([*tokens.schema.fields[:-1], T.StructField("b", T.ArrayType(T.IntegerType())),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__t"):
            b, x, first = _count_cells(batch.column(batch.num_columns - 1), bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(b, first), _lists(x, first)], schema.names)

    return tokens.mapInArrow(count, schema)


def _is_sparse(df: DataFrame) -> bool:
    return {"b", "x"} <= set(df.columns)


def _stored(df: DataFrame, name: str) -> DataFrame:
    return stored_with(df, name)[0]


def stored_with(df: DataFrame, name: str, write: dict | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` as a scratch table, and ``metrics`` (aggregates by name) over its rows from the pass
    that writes it. A write's tasks count once each, however often a lost executor makes one
    run, so the figures are exact."""
    path, seen = scratch_path(df.sparkSession, name), Observation()
    out = df.observe(seen, *[m.alias(k) for k, m in metrics.items()]) if metrics else df
    out.write.options(**(write or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get if metrics else {})


def register_classes(df: DataFrame, col: str = "category") -> list[str]:
    """Sorted distinct categories: the class list, fixed before the first step.
    Only K names reach the driver."""
    return [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct()
            .orderBy(col).collect()]


def class_table(df: DataFrame, col: str = "category") -> DataFrame:
    """(class_id, category) computed in Spark: K rows, numbered in name order."""
    cats = df.select(F.col(col).alias("category")).filter(F.col("category").isNotNull()).distinct()
    return cats.select((F.row_number().over(Window.orderBy("category")) - 1).cast("int")
                       .alias("class_id"), "category")


def empty_model(spark: SparkSession, classes: list[str], bits: int = DEFAULT_BITS,
                broadcast_bytes: int = BROADCAST_BYTES) -> Model:
    k = len(classes)
    return Model(classes=list(classes), weights=spark.createDataFrame([], WEIGHTS_SCHEMA),
                 intercept=[0.0] * k, intercept_g2=[0.0] * k, bits=bits, broadcast_bytes=broadcast_bytes)


def group_copies(df: DataFrame, text: str = "text", category: str = "category",
                 id_col: str = "row_id") -> DataFrame:
    """One row per distinct row id with its multiplicity as ``weight`` (an input
    that is already grouped passes through). Text and category are functions of the
    row id, so any copy carries them. Copies are merged map-side (partial
    aggregate) before the one shuffle of text, and the result comes out
    hash-partitioned by row id."""
    if "weight" in df.columns:
        return df.select(id_col, text, category, "weight")
    return df.groupBy(id_col).agg(F.first(text).alias(text), F.first(category).alias(category),
                                  F.count(F.lit(1)).alias("weight"))


def _segment_sums(values: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, sum of its rows) of rows that are sorted by segment."""
    first = np.flatnonzero(np.diff(segment, prepend=-1 << 40))
    return segment[first], np.add.reduceat(values, first, axis=0)


def _places(at: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of each bucket among the sorted ones ``at``, -1 where it is not there."""
    if not len(at):
        return np.full(len(b), -1)
    place = np.minimum(np.searchsorted(at, b), len(at) - 1)
    return np.where(at[place] == b, place, -1)


def _lookup(at: np.ndarray, bits: int) -> np.ndarray:
    """Place of every bucket among the sorted ones ``at``, -1 where it is not there."""
    out = np.full(1 << bits, -1, np.int32)
    out[at] = np.arange(len(at))
    return out


def _margins(cells: Cells, place: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Margins (rows x classes); ``place`` is the row of ``w`` of each cell's bucket, or -1."""
    _, x, first = cells
    out = np.tile(bias, (len(first) - 1, 1))
    known = place >= 0
    row, place, x = np.repeat(np.arange(len(first) - 1), np.diff(first))[known], place[known], x[known]
    step = max(1, _AT_A_TIME // max(len(x), 1))
    for k in range(0, len(bias), step) if len(x) else ():
        rows, sums = _segment_sums(x[:, None] * w[place, k:k + step], row)
        out[rows, k:k + step] += sums
    return out


def _residuals(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted residuals; ``y`` is the column of each row's class, or outside of it."""
    r = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
    own = np.flatnonzero((y >= 0) & (y < r.shape[1]))
    r[own, y[own]] -= 1.0
    return r * weight[:, None]


def _broadcast_weights(model: Model):
    """The observed buckets, sorted, and their weights (buckets x classes), sent to the tasks."""
    packs = []
    for batch in _packed(model).select("block", "at", F.col("w").alias("v")).toArrow().to_batches():
        packs += _weights_of(batch)
    held = _Held(packs, 0, model.blocks, model.width, model.bits)
    at, w = held.bucket, np.ascontiguousarray(held.w[:-1, :model.k])
    return model.weights.sparkSession.sparkContext.broadcast((at, w, np.array(model.intercept)))


def _classed(cells: DataFrame, model: Model) -> DataFrame:
    """(y, weight, b, x): the class number of each row, -1 for other categories. Joined as a
    table of the model's classes, which the driver holds."""
    spark = cells.sparkSession
    names = spark.createDataFrame(pa.table({"category": pa.array(model.classes, pa.string()), "y": pa.array(range(model.k), pa.int32())}))
    return (cells.join(F.broadcast(names), "category", "left")
            .select(F.coalesce("y", F.lit(-1)).alias("y"), F.col("weight").cast("double"), "b", "x"))


def _gradient_map(rows: DataFrame, model: Model, step: tuple) -> DataFrame:
    """The weights after one step, in packs: a map over the rows (as of :func:`_classed` or :func:`_row_packs`) with
    broadcast weights. A task ends with sums of most buckets, however few rows it has, so tasks are few."""
    sent, width, bits = _broadcast_weights(model), model.width, model.bits
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    ranges, packed = _ranges(model, model.n_observed or 1 << bits, tasks), "first" in rows.columns

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        made = None
        for cells, y, weight in _of_packs(batches) if packed else _of_rows(batches):
            made = made or _Tile(at, _lookup(at, bits), w, 0, width, len(bias), bias)
            made.add(cells, y, weight)
            if (made.n - made.known) * len(bias) > _AT_A_TIME:
                yield from made.sums(ranges)
                made = None
        if made is not None:
            yield from made.sums(ranges)

    return _merged(model, rows.coalesce(4 * tasks).mapInArrow(add_up, _CUT_SCHEMA), ranges, step)


def _chunked(rows: DataFrame) -> DataFrame:
    """``rows`` (b, ...) with ``chunk``: runs of rows within the bounds of a chunk, or one row. What
    a chunk moves is its distinct buckets x classes, so the bound is theirs and not the cells'."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, cells, held = TaskContext.get().partitionId() << 40, np.zeros(0, np.int32), 0, 0
        for batch in _slices(batches, "b", CHUNK_BUCKETS // 4):
            b = batch.column(batch.schema.names.index("b")).flatten().to_numpy()
            both = np.union1d(seen, b)
            if held and (len(both) > CHUNK_BUCKETS or cells + len(b) > CHUNK_CELLS or held + batch.num_rows > CHUNK_ROWS):
                chunk, both, cells, held = chunk + 1, np.unique(b), 0, 0
            seen, cells, held = both, cells + len(b), held + batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, chunk))], [*batch.schema.names, "chunk"])

    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.LongType())])
    return _stored(rows.mapInArrow(deal, schema), "chunks")


def _with_weights(chunks: DataFrame, model: Model, work, schema: T.StructType) -> DataFrame:
    """``work(rows, at, w, bias, block)`` for every chunk and run of ``BLOCKS_AT_A_TIME`` blocks of
    classes, ``block`` being the first, with the weights of the chunk's buckets. A chunk's distinct
    buckets are joined with the weights."""
    width, k = model.width, model.k
    bias = model.weights.sparkSession.sparkContext.broadcast(np.array(model.intercept))
    need = chunks.select(F.col("chunk").alias("c"), F.explode("b").alias("bucket")).distinct()
    run = F.floor(F.col("block") / BLOCKS_AT_A_TIME).cast("int")
    pulled = need.join(model.weights.select("bucket", run.alias("k"), "block", "w"), "bucket").select("c", "k", "bucket", "block", "w")
    runs = -(-model.blocks // BLOCKS_AT_A_TIME)
    spread = chunks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def both(key: tuple, rows: pa.Table, weights: pa.Table) -> pa.Table:
        block = key[1].as_py() * BLOCKS_AT_A_TIME
        size = min(width * BLOCKS_AT_A_TIME, k - block * width)
        at, place = np.unique(weights["bucket"].to_numpy(), return_inverse=True)
        w = np.zeros((len(at), BLOCKS_AT_A_TIME, width))
        if len(at):
            w[place, weights["block"].to_numpy() - block] = weights["w"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        w = w.reshape(len(at), BLOCKS_AT_A_TIME * width)[:, :size]
        rows = rows.combine_chunks().to_batches()
        out = list(work(rows[0], at, w, bias.value[block * width:block * width + size], block)) if rows else []
        return pa.Table.from_batches(out, schema=arrow)

    arrow = to_arrow_schema(schema)
    return spread.groupBy("chunk", "run").cogroup(pulled.groupBy("c", "k")).applyInArrow(both, schema)


def _pieces(cells: Cells, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to) as a dense matrix over the distinct places of their cells."""
    _, x, first = cells
    row, i = np.repeat(np.arange(len(first) - 1), np.diff(first)), 0
    while i < len(first) - 1:
        j = min(i + PIECE_ROWS, max(i + 1, int(np.searchsorted(first, first[i] + PIECE_CELLS, "right")) - 1))
        s = slice(first[i], first[j])
        at, column = np.unique(place[s], return_inverse=True)
        yield i, j, at, np.bincount((row[s] - i) * len(at) + column, x[s], (j - i) * len(at)).reshape(j - i, len(at))
        i = j


def _dense_margins(cells: Cells, place: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """:func:`_margins` over many classes; the last row of ``w`` is zero, for places of -1."""
    out = np.empty((len(cells[2]) - 1, len(bias)))
    for i, j, at, x in _pieces(cells, place):
        np.matmul(x, w[at], out=out[i:j])
    out += bias
    return out


def _with_zero(w: np.ndarray) -> np.ndarray:
    return np.concatenate([w, np.zeros((1, w.shape[1]))])


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())


def _pack(bias: bool, block: int, at: np.ndarray, w: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([block], pa.int32()), _bytes(at.astype(np.int32)),
                                       _bytes(w), _bytes(q)], PACKED_SCHEMA.names)


def _packed(model: Model) -> DataFrame:
    """The weights in packs."""
    width = model.width

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            w, q = (_doubles(batch.column(i)).reshape(-1, width) for i in (2, 3))
            for k in np.unique(block).tolist():
                at = np.flatnonzero(block == k)
                for i in range(0, len(at), PACK_BUCKETS):
                    rows = at[i:i + PACK_BUCKETS]
                    yield _pack(False, k, bucket[rows], w[rows], q[rows])

    if model.packed is not None:
        return model.packed
    return model.weights.select(*WEIGHTS_SCHEMA.names).mapInArrow(pack, PACKED_SCHEMA)


def _unpacked(packs: DataFrame, width: int) -> DataFrame:
    """Weights (bucket, block, w, g2) of packs."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block, at, w, q in zip(*(c.to_pylist() for c in batch.columns)):
                bucket = np.frombuffer(at, np.int32)
                first = np.arange(len(bucket) + 1) * width
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), block, np.int32)),
                                                  *(_lists(np.frombuffer(v), first) for v in (w, q))], WEIGHTS_SCHEMA.names)

    return packs.mapInArrow(rows, WEIGHTS_SCHEMA)


#: Packs of weights (kind 0, their squares 2) or of gradient sums (1) of one range of buckets.
_CUT_SCHEMA = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("tile", "kind", "block")),
                            *(T.StructField(c, T.BinaryType()) for c in ("at", "v"))])


def _ranges(model: Model, buckets: int, parts: int) -> int:
    """Into how many ranges buckets fall where the sums of ``parts`` tasks are merged."""
    return max(parts, -(-buckets * model.k * parts // (1 << 24)))


def _cut(kind: int, block: int, at: np.ndarray, v: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Values of some buckets (the intercepts' is of range 0), a pack for each range."""
    tile = np.maximum(at, 0) % ranges
    order = np.argsort(tile, kind="stable")
    edge = np.searchsorted(tile[order], np.arange(ranges + 1))
    for r in range(ranges):
        for i in range(edge[r], edge[r + 1], 16 * PACK_BUCKETS):
            rows = order[i:min(i + 16 * PACK_BUCKETS, edge[r + 1])]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (r, kind, block)),
                                              _bytes(at[rows].astype(np.int32)), _bytes(v[rows])], _CUT_SCHEMA.names)


def _merged(model: Model, sums: DataFrame, ranges: int, step: tuple) -> DataFrame:
    """The weights after one step, in packs. Weights and gradient sums (as of ``_CUT_SCHEMA``) meet by ranges of
    buckets, so every bucket seen so far is there, whether this step touches it or not."""
    width, blocks, k, (n, eta, alpha, eps) = model.width, model.blocks, model.k, step
    ends = [np.append(v, np.zeros(blocks * width - k)) for v in (model.intercept, model.intercept_g2)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, at, *values in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(at, np.int32)
                for kind, v in zip((0, 2), values):
                    yield from _cut(kind, block, at, np.frombuffer(v).reshape(-1, width), ranges)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bias = ([], [], []), None
        for batch in batches:
            for kind, *pack in zip(batch.column(1).to_pylist(), *zip(*_weights_of(batch))):
                at = pack[1]
                if at[0] == _BIAS:  # sorted first, among the buckets of range 0
                    bias = np.zeros(blocks * width) if bias is None else bias
                    bias[pack[0] * width:(pack[0] + 1) * width] += pack[2][:width]
                    pack[1:] = at[1:], pack[2][width:]
                held[kind].append(pack)
        if bias is not None:  # intercepts do not decay
            g = (bias / n).reshape(-1, width)
            b, q = (v.reshape(-1, width) for v in ends)
            q = q + g * g
            b = b - eta * g / np.sqrt(q + eps)
            for block in range(blocks):
                yield _pack(True, block, np.array([_BIAS]), b[block:block + 1], q[block:block + 1])
        bucket = np.unique(np.concatenate([np.zeros(0, np.int32), *(at for packs in held for _, at, _ in packs)]))
        w, g, q = (np.zeros((blocks, len(bucket), width)) for _ in range(3))
        for packs, total in zip(held, (w, g, q)):
            while packs:
                block, at, v = packs.pop()
                total[block, np.searchsorted(bucket, at)] += v.reshape(-1, width)
        for block in range(blocks):
            for i in range(0, len(bucket), PACK_BUCKETS):
                s = slice(i, i + PACK_BUCKETS)
                grad = g[block, s] / n + alpha * w[block, s]
                grown = q[block, s] + grad * grad
                yield _pack(False, block, bucket[s], w[block, s] - eta * grad / np.sqrt(grown + eps), grown)

    weights = _packed(model).select("block", "at", "w", "g2").mapInArrow(cut, _CUT_SCHEMA)
    return weights.unionByName(sums).repartitionById(ranges, F.col("tile")).mapInArrow(add_up, PACKED_SCHEMA)


_ROW_PACK = {"y": np.int32, "weight": np.float64, "b": np.int32, "x": np.float64, "first": np.int32}


def _row_packs(rows: DataFrame) -> DataFrame:
    """Rows (as of :func:`_classed`) in stored packs, those of a class together where they can be: they have many
    buckets in common."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "b", PACK_CELLS):
            b, x, first = _held_cells(batch.column(2), batch.column(3))
            values = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), b, x, first)
            yield pa.RecordBatch.from_arrays([_bytes(v.astype(t)) for v, t in zip(values, _ROW_PACK.values())], list(_ROW_PACK))

    schema = T.StructType([T.StructField(c, T.BinaryType()) for c in _ROW_PACK])
    return stored_with(rows.sortWithinPartitions("y").mapInArrow(pack, schema), "packs", _PACKS)[0]


Classed = tuple[Cells, np.ndarray, np.ndarray]  # with the class number and weight of each row


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Classed]:
    for batch in _slices(batches, "b", _AT_A_TIME):
        yield _held_cells(batch.column(2), batch.column(3)), batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _of_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[Classed]:
    """Rows of packs, about ``_AT_A_TIME`` cells at a time."""
    held, size = [], 0

    def joined() -> Classed:
        y, weight, b, x, first = zip(*held)
        sizes = np.concatenate([np.diff(f) for f in first])
        return (np.concatenate(b), np.concatenate(x), np.append(0, np.cumsum(sizes))), np.concatenate(y), np.concatenate(weight)

    for batch in batches:
        for i in range(batch.num_rows):
            pack = [np.frombuffer(batch.column(batch.schema.names.index(c))[i].as_buffer(), t) for c, t in _ROW_PACK.items()]
            held.append(pack)
            size += len(pack[2])
            if size >= _AT_A_TIME:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


class _Held:
    """Weights of a run of blocks from ``first`` on, put together from packs; the last row is zero."""

    def __init__(self, packs: list[tuple[int, np.ndarray, np.ndarray]], first: int, blocks: int, width: int, bits: int, room: int = 0):
        self.bucket = np.unique(np.concatenate([np.zeros(0, np.int32), *(at for _, at, _ in packs)]))
        self.place = _lookup(self.bucket, bits)
        self.w = np.zeros((max(room, len(self.bucket)) + 1, blocks * width))
        for block, at, w in packs:
            j = (block - first) * width
            self.w[self.place[at], j:j + width] = w.reshape(-1, width)


class _Tile:
    """A run of classes, from block ``first`` on, with the weights of its buckets and their gradient sums. A
    bucket that rows bring has a place from then on, and weights of zero."""

    def __init__(self, bucket: np.ndarray, place: np.ndarray, w: np.ndarray, first: int, width: int, k: int, bias: np.ndarray):
        self.width, self.first, self.classes = width, first, min(w.shape[1], k - first * width)
        self.bias, self.bias_sum = bias[:self.classes], np.zeros(self.classes)
        self.known = self.n = len(bucket)
        self.place, self.w, self.g = place, w, np.zeros_like(w)
        self.bucket = np.append(bucket, np.zeros(len(w) - self.n, np.int32))

    def _places(self, b: np.ndarray) -> np.ndarray:
        place = self.place[b]
        if (place < 0).any():
            new = np.unique(b[place < 0])
            need = self.n + len(new) - len(self.bucket)
            if need > 0:
                more = max(need, len(self.bucket) // 2)
                self.bucket = np.append(self.bucket, np.zeros(more, np.int32))
                self.w, self.g = (np.concatenate([a, np.zeros((more, a.shape[1]))]) for a in (self.w, self.g))
            self.bucket[self.n:self.n + len(new)] = new
            self.place[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            place = self.place[b]
        return place

    def add(self, cells: Cells, y: np.ndarray, weight: np.ndarray) -> None:
        k, y, place = self.classes, y - self.first * self.width, self._places(cells[0])
        if k <= FLAT_CLASSES and self.n <= 4 * len(place):
            return self._add_flat(cells, place, y, weight)
        for i, j, at, x in _pieces(cells, place):
            m = x @ self.w[at, :k] + self.bias if self.known else np.tile(self.bias, (j - i, 1))
            r = _residuals(m, y[i:j], weight[i:j])
            self.g[at, :k] += x.T @ r
            self.bias_sum += r.sum(0)

    def _add_flat(self, cells: Cells, place: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Few classes and many cells: class by class over all cells."""
        _, x, first = cells
        row, m = np.repeat(np.arange(len(y)), np.diff(first)), np.tile(self.bias, (len(y), 1))
        for j in range(self.classes if self.known else 0):
            m[:, j] += np.bincount(row, x * np.ascontiguousarray(self.w[:self.n, j])[place], len(y))
        r = _residuals(m, y, weight)
        for j in range(self.classes):
            self.g[:self.n, j] += np.bincount(place, x * np.ascontiguousarray(r[:, j])[row], self.n)
        self.bias_sum += r.sum(0)

    def sums(self, ranges: int) -> Iterator[pa.RecordBatch]:
        """The gradient sums, cut by range of buckets; the intercepts' come first in range 0."""
        at = np.append(_BIAS, self.bucket[:self.n]).astype(np.int32)
        for j in range(0, self.classes, self.width):
            part = np.zeros((len(at), self.width))
            size = min(self.width, self.classes - j)
            part[0, :size], part[1:, :size] = self.bias_sum[j:j + size], self.g[:self.n, j:j + size]
            yield from _cut(1, self.first + j // self.width, at, part, ranges)

    def updated(self, block: int, at: np.ndarray, q: np.ndarray, step: tuple) -> pa.RecordBatch:
        """Weights after the step; ``q`` is their squares so far."""
        n, eta, alpha, eps = step
        j, place = (block - self.first) * self.width, self.place[at]
        w = self.w[place, j:j + self.width]
        g = self.g[place, j:j + self.width] / n + alpha * w
        q = q + g * g
        return _pack(False, block, at, w - eta * g / np.sqrt(q + eps), q)

    def rest(self, squares: np.ndarray, step: tuple) -> Iterator[pa.RecordBatch]:
        """Intercepts, whose squares so far are ``squares``, and weights of the buckets that the rows brought."""
        n, eta, _, eps = step
        g = self.bias_sum / n
        q = squares[:self.classes] + g * g
        b = self.bias - eta * g / np.sqrt(q + eps)
        pad = np.zeros(-self.classes % self.width)
        for block, ends in enumerate(zip(*(np.append(v, pad).reshape(-1, self.width) for v in (b, q))), self.first):
            yield _pack(True, block, np.array([_BIAS]), *ends)
            for i in range(self.known, self.n, PACK_BUCKETS):
                at = self.bucket[i:min(i + PACK_BUCKETS, self.n)]
                yield self.updated(block, at, np.zeros((len(at), self.width)), step)


def _doubles(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy()


def _tiling(model: Model, buckets: int, cells: int, tasks: int) -> tuple[int, int, int]:
    """(blocks of a run, runs, parts of the rows). A run's weights are of bounded size; there are as many
    runs as tasks where that does not move too many cells, and parts where runs are too few."""
    runs = -(-model.blocks // max(1, TILE_DOUBLES // (max(1, buckets) * model.width)))
    if runs > tasks or cells * tasks <= CELLS_MOVED:
        runs = -(-max(runs, 1) // tasks) * tasks
    size = -(-model.blocks // min(runs, model.blocks))
    runs = -(-model.blocks // size)
    return size, runs, max(1, tasks // runs)


def _dealt(weights: list[DataFrame], rows: DataFrame, tiles: int) -> DataFrame:
    """Packs of weights and rows, both with ``tile`` and ``kind`` (0 is weights, 1 rows), each tile a
    partition, ordered by kind."""
    every = rows
    for part in weights:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.repartitionById(tiles, F.col("tile")).sortWithinPartitions("kind")


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(kind, a batch of that kind)."""
    for batch in batches:
        kind = batch.column(batch.schema.names.index("kind")).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
        for i, j in zip(edge, edge[1:]):
            if i < j:
                yield int(kind[i]), batch.slice(i, j - i)


def _weights_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, buckets, values) of packs (block, at, v)."""
    for block, at, v in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("block", "at", "v"))):
        yield block, np.frombuffer(at, np.int32), np.frombuffer(v)


def _gradient_join(rows: DataFrame, model: Model, tiling: tuple, step: tuple) -> DataFrame:
    """The weights after one step, in packs, by tiles of classes and rows. A tile that sees every row updates its weights,
    the sums of others are merged. ``rows`` are as of :func:`_row_packs`, ``step`` is (n, eta, alpha, eps)."""
    size, runs, parts, buckets = tiling
    whole, width, k, bits = parts == 1, model.width, model.k, model.bits
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = _packed(model).withColumn("__part", F.lit(0) if whole else every_part)
    tile = (F.col("__part") * runs + F.floor(F.col("block") / size)).cast("int").alias("tile")
    kinds = [held.select(tile, F.lit(kind).alias("kind"), "block", "at", F.col(v).alias("v"))
             for kind, v in [(0, "w"), (2, "g2")][:1 + whole]]
    mine = F.lit(0) if whole else F.pmod(F.monotonically_increasing_id(), F.lit(parts))  # of a stored table: the same at each reading
    spread = (rows.withColumn("__part", mine).withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
              .select((F.col("__part") * runs + F.col("__run")).cast("int").alias("tile"), F.lit(1).alias("kind"), *_ROW_PACK))
    sent = rows.sparkSession.sparkContext.broadcast((np.array(model.intercept), np.array(model.intercept_g2)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, made = [], None
        for kind, batch in _kinds(batches):
            if kind == 0:
                packs += _weights_of(batch)
                continue
            if made is None:
                first = batch.column(0)[0].as_py() % runs * size
                held = _Held(packs, first, min(size, -(-k // width) - first), width, bits, buckets if whole else 0)
                made, packs = _Tile(held.bucket, held.place, held.w, first, width, k, sent.value[0][first * width:]), None
            if kind == 1:
                for rows in _of_packs([batch]):
                    made.add(*rows)
            else:
                for block, at, q in _weights_of(batch):
                    yield made.updated(block, at, q.reshape(-1, width), step)
        if made is not None:
            yield from made.rest(sent.value[1][made.first * width:], step) if whole else made.sums(ranges)

    ranges = _ranges(model, buckets, parts)
    made = _dealt(kinds, spread, runs * parts).mapInArrow(work, PACKED_SCHEMA if whole else _CUT_SCHEMA)
    return made if whole else _merged(model, made, ranges, step)


def fit(rows: DataFrame, model: Model, steps: int, eta: float = ETA, alpha: float = ALPHA,
        eps: float = EPS, n: int | None = None) -> Model:
    """``steps`` AdaGrad steps over ``rows`` (as of :func:`group_copies`, or sparse already) from
    ``model``. Texts are tokenised once, into stored sparse rows. ``rows_trained`` counts the
    rows of this fit once; ``n`` is their number (sum of weights) where the caller has it."""
    spark = rows.sparkSession
    ship_package(spark)
    cells = rows
    if not _is_sparse(rows):
        made = sparse_rows(rows.select("category", "weight", "text"), "text", model.bits)
        cells, seen = stored_with(made, "cells", n=F.sum("weight"))
        n = seen.get("n")
    elif n is None:
        n = cells.agg(F.sum("weight")).first()[0]
    classed = _classed(cells, model)
    if not n or not model.k:
        return model
    step, packs, held = (float(n), eta, alpha, eps), None, None
    for _ in range(steps):
        if model.fits_broadcast() and model.k <= MAP_CLASSES:
            packs = _row_packs(classed) if packs is None and steps > 1 else packs
            new = _gradient_map(classed if packs is None else packs, model, step)
        else:
            packs = _row_packs(classed) if packs is None else packs
            if held is None:
                held = (cells.select(F.explode("b").alias("b")).groupBy("b").count()
                        .agg(F.count("b"), F.coalesce(F.sum("count"), F.lit(0))).first())
            buckets = max(held[0], model.n_observed)
            tiling = _tiling(model, buckets, held[1], spark.sparkContext.defaultParallelism)
            new = _gradient_join(packs, model, (*tiling, buckets), step)
        observed = F.sum(F.when((F.col("block") == 0) & ~F.col("bias"), F.length("at") / 4))
        new, seen = stored_with(new, "weights", _PACKS, observed=F.coalesce(observed, F.lit(0)))
        packed = new.where(~F.col("bias"))
        ends, weights = _unpacked(new.where("bias"), model.width), _unpacked(packed, model.width)
        ends = sorted(ends.collect(), key=lambda r: r["block"])
        model = replace(model, weights=weights, packed=packed, intercept=[v for r in ends for v in r["w"]][:model.k],
                        intercept_g2=[v for r in ends for v in r["g2"]][:model.k], version=None,
                        n_observed=int(seen["observed"]))
    return replace(model, rows_trained=model.rows_trained + int(n))


def ovr_step(rows: DataFrame, model: Model, **kw) -> Model:
    """One AdaGrad step over all rows; returns the updated model."""
    return fit(rows, model, 1, **kw)


def full_refit(df: DataFrame, steps: int = STEPS_REFIT, bits: int = DEFAULT_BITS, **kw) -> Model:
    """Train from zero on all rows; the classes are those of this input."""
    rows = group_copies(df)
    model = empty_model(df.sparkSession, register_classes(df), bits)
    return fit(rows, model, steps, **kw)


# -- scoring -----------------------------------------------------------------------

def score_margins(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` (all columns) with m: raw margins of every class. With broadcast weights it is one
    map, no exchange; a text without tokens scores by the intercepts alone. Rows that are
    sparse already (b, x) are not tokenised again. ``keep_text=False`` leaves the text out of the
    result, so that a task gets a row's tokens only, and gives no text back."""
    ship_package(df.sparkSession)
    if not model.fits_broadcast():
        return _margins_joined(df, model, text, keep_text)
    sparse, bits = _is_sparse(df), model.bits
    kept = df if keep_text else df.drop(text)
    src = kept if sparse else _with_tokens(df, text, drop=not keep_text)
    schema = T.StructType([*kept.schema.fields, T.StructField("m", T.ArrayType(T.DoubleType()))])
    sent = _broadcast_weights(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = sent.value
        lookup, limit = _lookup(at, bits), max(1, _AT_A_TIME // max(len(bias), 1))
        for batch in _slices(batches, "b", limit) if sparse else text_slices(batches, "__t", limit):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cells = _held_cells(col["b"], col["x"]) if sparse else _count_cells(col["__t"], bits)
            m = _margins(cells, lookup[cells[0]], w, bias)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(schema) - 1], _lists(m, np.arange(len(m) + 1) * len(bias))], schema.names)

    return src.mapInArrow(add, schema)


def _margins_joined(df: DataFrame, model: Model, text: str, keep_text: bool, shares: bool = False) -> DataFrame:
    """Margins with weights that are too large to broadcast: by shuffle. ``shares``: also prob, and
    ``__i``, the place of the most probable class."""
    kept = (df if keep_text else df.drop(text)).drop(*["prob"] * shares)
    spark, k, bits, sparse = df.sparkSession, model.k, model.bits, _is_sparse(df)
    own = [F.col(f"`{c}`") for c in kept.columns]
    cells = df.select(F.struct(*own, F.lit(0).alias("__0")).alias("__kept"), *(["b", "x"] if sparse else [text]))
    held = _stored(cells if sparse else sparse_rows(cells, text, bits), "scored")
    extra = [T.StructField("m", T.ArrayType(T.DoubleType()))]
    extra += [T.StructField("prob", T.ArrayType(T.DoubleType())), T.StructField("__i", T.IntegerType())] * shares
    schema = T.StructType([held.schema["__kept"], *extra])

    def scored(m: np.ndarray) -> list[pa.Array]:
        first = np.arange(len(m) + 1) * k
        if not shares:
            return [_lists(m, first)]
        p = _probabilities(m)
        return [_lists(m, first), _lists(p, first), pa.array(p.argmax(1).astype(np.int32))]

    limit = max(1, _AT_A_TIME // max(k, 1))
    if model.n_observed * k > SCORE_DOUBLES:
        out = _margins_by_chunks(held, model)
        if shares:
            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(0, batch.num_rows, limit):
                        piece = batch.slice(i, limit)
                        yield pa.RecordBatch.from_arrays([piece.column(0), *scored(_doubles(piece.column(1)).reshape(-1, k))], schema.names)

            out = out.mapInArrow(add, schema)
    else:
        tiles = spark.sparkContext.defaultParallelism
        bias = spark.sparkContext.broadcast(np.array(model.intercept))
        mine = F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int")  # of a stored table: the same at each reading
        rows = held.select(mine.alias("tile"), F.lit(1).alias("kind"), "__kept", "b", "x")
        weights = _packed(model).select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(0).alias("kind"),
                                        "block", "at", F.col("w").alias("v"))
        width, blocks = model.width, model.blocks

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packs, made = [], None
            for kind, batch in _kinds(batches):
                if kind == 0:
                    packs += _weights_of(batch)
                    continue
                if made is None:
                    made, packs = _Held(packs, 0, blocks, width, bits), None
                    w = made.w[:, :k]
                for i in range(0, batch.num_rows, limit):
                    col = {n: c for n, c in zip(batch.schema.names, batch.slice(i, limit).columns)}
                    cells = _held_cells(col["b"], col["x"])
                    m = _dense_margins(cells, made.place[cells[0]], w, bias.value)
                    yield pa.RecordBatch.from_arrays([col["__kept"], *scored(m)], schema.names)

        out = _dealt([weights], rows, tiles).mapInArrow(add, schema)
    return out.select(*[F.col("__kept")[c].alias(c) for c in kept.columns], *[f.name for f in extra])


def _margins_by_chunks(held: DataFrame, model: Model) -> DataFrame:
    """(__kept, m) of stored rows (__kept, b, x): blocks of classes of each chunk, put together by row."""
    held = held.withColumn("__row", F.monotonically_increasing_id())

    def work(rows: pa.RecordBatch, at, w, bias, block: int) -> Iterator[pa.RecordBatch]:
        col = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
        cells = _held_cells(col["b"], col["x"])
        m = _dense_margins(cells, _places(at, cells[0]), _with_zero(w), bias)
        yield pa.RecordBatch.from_arrays([col["__row"], pa.array(np.full(len(m), block, np.int32)),
                                          _lists(m, np.arange(len(m) + 1) * m.shape[1])], ["__row", "block", "m"])

    parts = _with_weights(_chunked(held.select("__row", "b", "x")), model, work, T.StructType([
        T.StructField("__row", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("m", T.ArrayType(T.DoubleType()))]))
    whole = parts.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("s"))
    return held.join(whole.select("__row", F.flatten("s.m").alias("m")), "__row").select("__kept", "m")


def _probabilities(m: np.ndarray) -> np.ndarray:
    """:func:`ovr_probabilities` of rows of margins."""
    with np.errstate(over="ignore"):
        p = np.exp(-m)
    p += 1.0
    np.reciprocal(p, out=p)
    total = p.sum(1)
    p[total == 0] = 1.0 / max(m.shape[1], 1)
    p /= np.where(total > 0, total, 1.0)[:, None]
    return p


def _sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def _let(value: Column, body) -> Column:
    """``body(value)``, ``value`` computed once a row: inside a lambda over an array it would be
    computed again for every entry, which makes the work the square of the classes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def ovr_probabilities(m: Column, k: int) -> Column:
    """Sigmoid per class divided by the row sum (uniform when the sum is 0)."""
    def shares(s: Column) -> Column:
        return _let(_sum(s), lambda tot: F.when(tot > 0, F.transform(s, lambda v: v / tot))
                    .otherwise(F.array_repeat(F.lit(1.0 / k), k)))

    return _let(F.transform(m, lambda v: _sigmoid(v)), shares)


def softmax(m: Column) -> Column:
    def shares(e: Column) -> Column:
        return _let(_sum(e), lambda tot: F.transform(e, lambda v: v / tot))

    return _let(F.array_max(m), lambda mx: _let(F.transform(m, lambda v: F.exp(v - mx)), shares))


def softmax_scores(df: DataFrame, col: str = "m", out: str = "prob") -> DataFrame:
    return df.withColumn(out, softmax(F.col(col)))


def score_ovr(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with m, prob, predicted: predicted is the most probable class, ties to the
    lower class id. Labels and keys stay on their rows, so nothing is joined back."""
    if not model.fits_broadcast():
        ship_package(df.sparkSession)
        sc = _margins_joined(df, model, text, keep_text, shares=True)
        return sc.withColumn("predicted", model.class_name(F.col("__i"))).drop("__i")
    sc = score_margins(df, model, text, keep_text)
    sc = sc.withColumn("prob", ovr_probabilities(F.col("m"), model.k))
    idx = (F.array_position(F.col("prob"), F.array_max("prob")) - 1).cast("int")
    return sc.withColumn("predicted", model.class_name(idx))


def top_k_categories(df: DataFrame, model: Model, k: int = TOP_K, prob: str = "prob",
                     out: str = "top") -> DataFrame:
    """``top``: the k most probable (category, prob), ties in class order."""
    names = F.array(*[F.lit(c) for c in model.classes])
    zipped = F.transform(F.col(prob), lambda p, i: F.struct((-p).alias("np"), i.alias("i")))
    best = F.slice(F.array_sort(zipped), 1, k)
    return df.withColumn(out, F.transform(best, lambda s: F.struct(
        F.element_at(names, s["i"] + 1).alias("category"), (-s["np"]).alias("prob"))))


def score_batch(df: DataFrame, model: Model, key: str, k: int = TOP_K,
                vendor: str = "vendor", description: str = "description") -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): text is built as for training; rows with empty text are
    routed to ``rejected``; every other row gets exactly one scored row with
    ``category`` (predicted) and ``top``."""
    from .clean import build_text

    t = build_text(df.select(key, vendor, description), vendor, description, category=None)
    held = (F.length(vendor) > 0) | (F.length(description) > 0)  # a text is empty when both are; it is not built to ask
    ok = t.filter(held)
    rejected = t.filter(~held).withColumn("reason", F.lit("empty_text"))
    sc = score_ovr(ok.select(key, "text"), model, keep_text=False)
    sc = top_k_categories(sc, model, k)
    return sc.select(key, F.col("predicted").alias("category"), "top", "prob"), rejected


# -- evaluation --------------------------------------------------------------------

def evaluate(scored: DataFrame, label: str = "category", pred: str = "predicted",
             guard: DataFrame | None = None, min_rows: int = 10, min_classes: int = 2,
             guard_counts: tuple[int, int] | None = None, weight: str | None = None) -> DataFrame:
    """One row: accuracy, n, classes. Accuracy is 0.0 when the guard frame (the
    whole labelled input, default ``scored``) has < 2 classes or < 10 rows.
    ``guard_counts`` (rows, classes) skips recounting when the caller knows them;
    otherwise both come from one scalar subquery (one pass over the guard). ``weight``:
    how many rows a scored row stands for."""
    if guard_counts is not None:
        n_all, classes = F.lit(int(guard_counts[0])), F.lit(int(guard_counts[1]))
    else:
        g = guard if guard is not None else scored
        stats = g.agg(F.struct(F.count(F.lit(1)).alias("n_all"),
                               F.countDistinct(label).alias("classes"))).scalar()
        n_all, classes = stats["n_all"], stats["classes"]
    w = F.col(weight) if weight else F.lit(1).cast("long")
    right = F.when(F.col(label) == F.col(pred), w).otherwise(F.lit(0))
    acc = scored.agg((F.sum(right) / F.sum(w)).alias("acc"), F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n"))
    ok = (n_all >= min_rows) & (classes >= min_classes)
    return acc.select(F.when(ok, F.coalesce(F.col("acc"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("accuracy"),
                      "n", classes.alias("classes"))


def class_metrics(scored: DataFrame, label: str = "category", pred: str = "predicted") -> DataFrame:
    """Per class: support, tp, fp, fn, precision, recall, f1 from the confusion
    counts (one aggregate of at most K^2 cells)."""
    conf = scored.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).count()
    tp = conf.filter(F.col("l") == F.col("p")).select(F.col("l").alias("category"),
                                                       F.col("count").alias("tp"))
    sup = conf.groupBy(F.col("l").alias("category")).agg(F.sum("count").alias("support"))
    pc = conf.groupBy(F.col("p").alias("category")).agg(F.sum("count").alias("predicted_n"))
    out = (sup.join(pc, "category", "full_outer").join(tp, "category", "left")
           .fillna(0, ["support", "predicted_n", "tp"]))
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return (out.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))
            .select("category", "support", "tp", (F.col("predicted_n") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"), "precision", "recall", "f1"))
