"""Embedding whitening by spectrum slicing.

Every entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. The
covariance V of all x-vectors (divisor n) is gathered by the tasks: a first pass gives n and
the exact sums S, a second one centres every vector on round(S / n) and multiplies; products
of these small whole numbers are summed without rounding up to 2**53, and the remaining
shift (less than a half) is taken off exactly on the one matrix that is left.

The leading eigenvalues of V (dims x dims, whatever the number of rows) are found by spectrum
slicing: an LDL^T factorisation of V - s*I (symmetric pivoting, 1x1 and 2x2 blocks) has as
many positive pivots as V has eigenvalues above s, so bisection on such counts isolates the
k-th eigenvalue in an interval of its own. Rayleigh quotient iteration converges cubically
inside it; two more counts, just above and just below the value found, certify that it is the
k-th. Eigenvalues too close to be told apart in double precision share an interval; their
vectors are then any orthonormal basis of the common space.

A third pass measures the covariance of the whitened rows themselves (``identity_error``).

Edge cases. A null vector, or one with a null or non-finite entry: dropped, as is a vector of
another length than the most frequent one (of equally frequent lengths the greatest), and an
empty vector. Null ids, repeated ids and repeated rows stay, each row for itself. Fewer
dimensions than components, or directions without variance (eigenvalue not above 1e-12 of the
trace): only the components there are; all vectors equal: no row. Entries beyond 2**40 / 1024
are held there. ``deviation`` is null where its exact value does not fit a long. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, ship

COMPONENTS = 8
# The whole numbers that stand for the entries.
SCALE, SHIFT = 1024, 100_000
_TOP = float(1 << 40)
_ALPHA = (1 + 17**0.5) / 8  # bounds the growth of the pivots
_EPS = np.finfo(float).eps


# -- eigenpairs of one symmetric matrix ----------------------------------------------

def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``: positive pivots of LDL^T of v - shift * I."""
    a = v - shift * np.eye(len(v))
    tiny = _EPS * max(np.abs(v).max(initial=0.0), abs(shift), np.finfo(float).tiny)
    above = 0
    while len(a):
        n = len(a)
        diag = np.abs(np.diag(a))
        p = int(diag.argmax())
        off = np.abs(a)
        off[np.arange(n), np.arange(n)] = 0
        r, c = divmod(int(off.argmax()), n)
        if max(diag[p], off[r, c]) <= tiny:
            break  # what is left is zero: not above
        one = diag[p] >= _ALPHA * off[r, c]
        first = [p] if one else [r, c]
        rest = np.setdiff1d(np.arange(n), first)
        block, side = a[np.ix_(first, first)], a[np.ix_(rest, first)]
        # a 2x2 pivot has one eigenvalue on either side of zero, as its off-diagonal dominates
        above += int(block[0, 0] > 0) if one else 1
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return above


def _solve(v: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    try:
        x = np.linalg.solve(v - shift * np.eye(len(v)), b)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        step = 4 * _EPS * (abs(shift) + np.abs(v).max())
        x = np.linalg.solve(v - (shift + step) * np.eye(len(v)), b)
    return x / np.linalg.norm(x)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of the symmetric ``v``, falling, and unit eigenvectors
    (rows)."""
    n = len(v)
    k = min(k, n)
    radius = np.abs(v).sum(1) - np.abs(np.diag(v))
    bottom, top = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())
    size = max(abs(bottom), abs(top), np.finfo(float).tiny)
    bottom, top = bottom - 4 * _EPS * size, top + 4 * _EPS * size
    counts = {bottom: n, top: 0}  # shift -> eigenvalues above it

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(v, s)
        return counts[s]

    start = np.random.default_rng(11).standard_normal((k, n))
    values, vectors = np.zeros(k), np.zeros((0, n))
    for j in range(k):
        hi = min(s for s, c in counts.items() if c <= j)
        lo = max(s for s, c in counts.items() if c > j and s < hi)
        found = False
        while not found:
            alone = above(lo) == j + 1 and above(hi) == j
            if alone or hi - lo <= 8 * _EPS * size:
                value, x = (lo + hi) / 2, start[j]
                for step in range(40):
                    x = x - vectors.T @ (vectors @ x)
                    x = _solve(v, value, x)
                    x = x - vectors.T @ (vectors @ x)
                    x /= np.linalg.norm(x)
                    if step < 1:
                        continue  # one step of inverse iteration inside the interval
                    value = float(x @ v @ x)
                    rest = float(np.linalg.norm(v @ x - value * x))
                    if not lo <= value <= hi or rest <= 16 * _EPS * size * n**0.5:
                        break
                near = max(rest, 16 * _EPS * size)
                found = hi - lo <= 8 * _EPS * size or (
                    lo - near <= value <= hi + near and rest <= 1e-9 * size
                    and above(value + near) <= j < above(value - near))
            if not found:
                middle = (lo + hi) / 2
                lo, hi = (middle, hi) if above(middle) > j else (lo, middle)
        values[j], vectors = value, np.vstack([vectors, x])
    return values, vectors


# -- the table -------------------------------------------------------------------------

def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, e): rows whose vector is whole and finite, as doubles."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    return v.where("e is not null and size(e) > 0 and forall(e, x -> x is not null and abs(x) < double('infinity'))")


def _whole(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    e = column(batch, "e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(SCALE * np.clip(e, -_TOP, _TOP)), -_TOP, _TOP).astype(np.int64) + SHIFT


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of two million entries at most, or one vector."""
    step = max(1, 2_000_000 // dims)
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _sum_matrices(rows: DataFrame, per_batch, dims: int, width: int) -> np.ndarray:
    """Sum of the (m, width) matrices that ``per_batch`` makes, m rows: each task adds up its
    own, one row of the matrix a key; the keys are then added up apart from each other."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in _slices(batches, dims):
            m = per_batch(b)
            total = m if total is None else total + m
        if total is not None:
            yield _rows_of(dict(enumerate(total)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(column(b, "i").to_pylist(), column(b, "r").to_pylist()):
                r = np.frombuffer(r, "<f8")
                total[i] = total[i] + r if i in total else r
        if total:
            yield _rows_of(total)

    kind = "i int, r binary"
    parts = rows.mapInArrow(add_up, kind).repartition("i").mapInArrow(again, kind).toArrow()
    out = np.zeros((max(parts["i"].to_pylist(), default=-1) + 1, width))
    for i, r in zip(parts["i"].to_pylist(), parts["r"].to_pylist()):
        out[i] += np.frombuffer(r, "<f8")
    return out


def _rows_of(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()),
                                       pa.array([r.astype("<f8").tobytes() for r in rows.values()], pa.binary())], ["i", "r"])


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each
    usable vector and component."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _usable(vectors, vec_id, embedding)
    lengths = rows.groupBy(F.size("e").alias("dims")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims, n = int(common["dims"]), int(common["n"])
    rows = rows.where(F.size("e") == dims)

    def sums(b: pa.RecordBatch) -> np.ndarray:  # in two halves, each exact as a double
        s = _whole(b, dims).sum(0)
        return np.stack([s >> 20, s & 0xFFFFF]).astype(float)

    high, low = _sum_matrices(rows, sums, dims, dims)
    total = [(int(h) << 20) + int(x) for h, x in zip(high, low)]  # S, exact
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)

    def scatter(b: pa.RecordBatch) -> np.ndarray:
        y = (_whole(b, dims) - centre).astype(float)
        return y.T @ y

    left = np.array([(s - n * int(c)) / n for s, c in zip(total, centre)])  # S / n - centre, under a half
    v = _sum_matrices(rows, scatter, dims, dims) / n - np.outer(left, left)
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    value, vector = leading(v, components) if trace > 0 else (np.zeros(0), np.zeros((0, dims)))
    value = value[value > 1e-12 * trace]
    if not len(value):
        return spark.createDataFrame([], schema)
    k = len(value)
    project = vector[:k].T / np.sqrt(value)

    def white(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _whole(b, dims)
        return x, ((x - centre) - left) @ project

    def moments(b: pa.RecordBatch) -> np.ndarray:
        z = white(b)[1]
        return np.vstack([z.T @ z, z.sum(0)])

    m = _sum_matrices(rows, moments, dims, k)
    mean = m[k] / n
    error = float(np.abs(m[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    share = value / trace

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, dims):
            x, z = white(b)
            size = b.num_rows
            dev = _wide(x, n, total) if _needs_wide(x, n, total) else _narrow(x, n, total)
            each = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [column(b, "vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * k, n)), pa.array(dev, pa.int64()).take(each), pa.array(z.ravel()),
                 pa.array(np.tile(share, size)), pa.array(np.full(size * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema)


def _needs_wide(x: np.ndarray, n: int, total: list[int]) -> bool:
    """Whether n * x - S, squared and summed, may pass 2**62."""
    most = max(abs(n * int(c) - s) for c, s in [*zip(x.max(0), total), *zip(x.min(0), total)])
    return n * int(np.abs(x).max()) >= 1 << 62 or max(map(abs, total)) >= 1 << 62 or x.shape[1] * most * most >= 1 << 62


def _narrow(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    far = n * x - np.array(total, np.int64)
    return (far * far).sum(1)


def _wide(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    far = n * x.astype(object) - np.array(total, object)
    return [d if d < 1 << 63 else None for d in (far * far).sum(1)]
