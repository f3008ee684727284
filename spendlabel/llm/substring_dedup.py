"""Repeated passages by prefix-partitioned suffix trees.

A word goes when some window of ``window`` consecutive words that covers it also starts
anywhere else, in the same document or another; windows are judged on the input.

The suffixes of all texts are indexed sparsely: of the ``k``-word prefixes of the suffixes
inside a window the one with the least hash is the window's anchor, so equal windows have
their anchor at the same place. A suffix that starts at an anchor stands for the run of
windows that share it. The work is split by variable-length prefixes:

1. ``k``-word prefixes. One aggregate over all anchors counts each prefix and tells
   whether all its occurrences have the same surroundings (the words its windows span).
   A prefix found once has a one-leaf subtree, no internal node, and is done. Where all
   surroundings are equal, every window of the run is a repeat, and is done too.
2. The other prefixes' occurrences are partitioned by prefix, with their words. A group
   is a subtree that fits into memory: its suffixes are sorted, neighbours' common prefix
   lengths give the internal nodes at each depth, and the same for the reversed words to
   the left. Two windows ``o`` words before their anchors are equal when they share the
   internal node at depth ``window - o`` to the right and at depth ``o`` to the left.
   Maximal repeats are the union of such windows.
3. Prefixes found more than ``group`` times would not fit. They are split by the longest
   prefix that matters, all ``window`` words (a 128-bit hash): each such group is one
   internal node, and counting needs no words, only a pre-aggregated sum. Equal
   surroundings are merged before that.

Texts are read three times; they are shuffled once, for the last step. Fixed-size
bitmaps (``BITMAP`` bits at most) tell the second reading which prefixes matter and which
are frequent; a bit set by chance costs a row, never a result.

Edge cases. Null or empty text, or fewer words than ``window``: nothing removed. Null id:
handled like any row. Repeated rows: each is a repeat of the other, both lose the words.
Empty table: empty result. Extra columns pass through, whatever their names. Surroundings of one prefix, and
windows of very frequent prefixes, are compared by hashes of 128 bits in all; everything
else word by word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, column, cut, free_names, map_rows, mix64, ship, without

WINDOW, GROUP = 35, 1_000
#: The columns ``remove_repeats`` adds; a document's own of these names give way.
RESULT = ("n_words", "n_removed", "kept_text", "kept_sha256")
BITMAP = 1 << 28
#: Bytes of text hashed at a time in a task, occurrences whose trees are built at a time.
RUN_BYTES, TREE_ROWS = 2_000_000, 30_000
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Ranges:
    """Hashes of word ranges by prefix sums of word hashes."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_P, len(h))[:len(h)], dtype=np.uint64)])
        self.back = _powers(_P_INVERSE, len(h) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.back[a])


class _Anchors:
    """Anchors of a run of texts: places (in words of the run) and their runs of windows."""

    def __init__(self, texts: pa.Array, window: int):
        self.k = max(1, window // 3)
        wide = window - self.k + 1  # prefixes inside a window
        self.words = w = Words(texts)
        self.ranges = _Ranges(h := w.hashes())
        n = len(h) - window + 1
        if n <= 0:
            self.at = self.lo = self.hi = np.zeros(0, np.int64)
            self.key = self.around = np.zeros(0, np.uint64)
            return
        i = np.arange(len(h) - self.k + 1)
        grams = self.ranges.of(i, i + self.k)
        starts = np.flatnonzero(w.doc[:n] == w.doc[window - 1:])
        at = starts + np.lib.stride_tricks.sliding_window_view(grams, wide)[starts].argmin(1)
        # windows of one document that share their anchor follow each other
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (w.doc[starts[1:]] != w.doc[starts[:-1]])]))[:len(starts)]
        self.at, self.lo = at[new], starts[new]
        self.hi = starts[np.append(new[1:], len(starts)) - 1] if len(starts) else starts
        self.key = grams[self.at]
        self.around = mix64(self.ranges.of(self.lo, self.hi + window) + (self.at - self.lo).astype(np.uint64) * np.uint64(1_000_003)
                            + (self.hi - self.lo).astype(np.uint64))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(np.array([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in column(batch, "text").cast(pa.binary())]))
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(size, size[a] + RUN_BYTES, "right")) - 1)
        yield batch.slice(a, z - a)
        a = z


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def prefix_counts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, n, same): prefixes at anchors found twice or more; ``same`` when all of them
    have the same surroundings."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in _runs(b):
                a = _Anchors(column(run, "text"), window)
                order = np.lexsort((a.around, a.key))  # pre-aggregated in the task
                key, around = a.key[order], a.around[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[:len(key)]
                n = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays([_signed(x) for x in (
                    key[first], n.astype(np.int64), around[first], around[first + n - 1])], ["key", "n", "least", "most"])

    parts = docs.where("text is not null").select("text").mapInArrow(count, "key long, n long, least long, most long")
    # unsigned order in the task and signed order here both only ask whether all are equal
    return (parts.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.least("least", "most")).alias("a"),
                                     F.max(F.greatest("least", "most")).alias("b"))
            .where("n > 1").select("key", "n", (F.col("a") == F.col("b")).alias("same")))


def _bitmap(keys: DataFrame, count: int) -> tuple[int, list]:
    """(bits, bytes): a bitmap of the keys, put together from segments of fixed size."""
    bits = min(BITMAP, 1 << max(16, math.ceil(math.log2(16 * max(1, count)))))
    segments = max(1, bits >> 20)
    width = bits // segments

    def mark(t: pa.Table) -> pa.Table:
        at = (t["key"].to_numpy().view(np.uint64) % np.uint64(bits)).astype(np.int64)
        seg = int(at[0]) // width
        held = np.zeros(width, bool)
        held[at - seg * width] = True
        return pa.table({"seg": [seg], "blob": pa.array([np.packbits(held).tobytes()], pa.binary())})

    low = F.expr(f"pmod(key, {bits}L)")  # bits is a power of two: the same for signed and unsigned
    rows = keys.select("key", F.floor(low / width).alias("s")).groupBy("s").applyInArrow(mark, "seg long, blob binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.seg * width // 8:(r.seg + 1) * width // 8] = np.frombuffer(r.blob, np.uint8)
    return bits, out


def _in_bitmap(key: np.ndarray, bits: int, held: np.ndarray) -> np.ndarray:
    at = key & np.uint64(bits - 1)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def occurrences(docs: DataFrame, equal: tuple, mixed: tuple, large: tuple, window: int = WINDOW) -> DataFrame:
    """(doc_id, fp, key, around, lo, hi, at, equal, path, words): anchors whose prefix is in a
    bitmap. Window starts lo..hi and anchor ``at`` are word places in the document; ``words``
    are the surroundings and ``around`` is their hash. ``path`` 1 goes to the trees, 2 to the
    longest prefixes, 0 (no words) to neither; it depends on the prefix alone."""
    sent = docs.sparkSession.sparkContext.broadcast((equal, mixed, large))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equal, mixed, large = sent.value
        for b in batches:
            for run in _runs(b):
                a = _Anchors(column(run, "text"), window)
                many, same = _in_bitmap(a.key, *mixed), _in_bitmap(a.key, *equal)
                path = np.where(many, 1 + _in_bitmap(a.key, *large), 0).astype(np.int8)
                take = np.flatnonzero(many | same)
                w, doc = a.words, a.words.doc[a.at[take]] if len(take) else np.zeros(0, np.int64)
                base = w.first[doc]
                raw = w.data.tobytes() if many.any() else b""
                words = [raw[x:y] if m else None for x, y, m in zip(
                    w.start[a.lo[take]].tolist(), w.end[a.hi[take] + window - 1].tolist(), many[take].tolist())]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [column(run, "doc_id").take(rows), column(run, "fp").take(rows), _signed(a.key[take]), _signed(a.around[take]),
                     *(pa.array((x[take] - base).astype(np.int32)) for x in (a.lo, a.hi, a.at)),
                     pa.array(same[take]), pa.array(path[take]), pa.array(words, pa.binary())],
                    ["doc_id", "fp", "key", "around", "lo", "hi", "at", "equal", "path", "words"])

    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(
        find, "doc_id long, fp long, key long, around long, lo int, hi int, at int, equal boolean, path byte, words binary")


def _nodes(rows: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Node of each row at each depth 0..width in the trees of the groups: rows are equal in
    their first d words (and have that many) exactly when they share column d."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(np.concatenate([group[:, None], rows], 1).astype(">i4")).view(f"V{4 * (width + 1)}").ravel(),
                       kind="stable")
    r, s, g = rows[order], size[order], group[order]
    common = np.minimum.accumulate(r[1:] == r[:-1], axis=1).sum(1)
    common = np.minimum(common, np.minimum(s[1:], s[:-1]))
    common[g[1:] != g[:-1]] = -1
    out = np.zeros((n, width + 1), np.int32)
    for d in range(width + 1):
        out[order[1:], d] = np.cumsum(common < d)
    return out


def repeated_windows(group: np.ndarray, words: list[bytes], lo: np.ndarray, hi: np.ndarray, at: np.ndarray,
                     window: int) -> list[tuple[int, int]]:
    """(row, window start) of the windows of the rows that another row of its group has."""
    table: dict[bytes, int] = {}
    n, k = len(words), max(1, window // 3)
    left_width = window - k
    right, left = np.zeros((n, window), np.int32), np.zeros((n, left_width), np.int32)
    right_size, left_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, raw in enumerate(words):
        c = [table.setdefault(x, len(table) + 1) for x in raw.split()]
        o = int(at[i] - lo[i])
        r, q = c[o:o + window], c[:o][::-1]
        right[i, :len(r)], left[i, :len(q)] = r, q
        right_size[i], left_size[i] = len(r), len(q)
    r_node, l_node = _nodes(right, right_size, group), _nodes(left, left_size, group)
    found = []
    for o in range(left_width + 1):  # windows that start o words before the anchor
        rows = np.flatnonzero((at - o >= lo) & (at - o <= hi))
        if len(rows) < 2:
            continue
        key = r_node[rows, window - o].astype(np.int64) << 32 | l_node[rows, o]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = rows[count[inverse] > 1]
        found.append(np.stack([hit, at[hit] - o], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _trees(occ: DataFrame, window: int) -> DataFrame:
    """(doc_id, fp, lo, hi): runs of repeated windows, from occurrences of memory-sized groups."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            key = t["key"].to_numpy()
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int32)
            hits = repeated_windows(group, t["words"].to_pylist(), *(t[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "at")), window)
            row, start = hits[:, 0], hits[:, 1]
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))[:len(row)]
            last = np.append(new[1:], len(row)) - 1 if len(row) else new
            rows = pa.array(row[new])
            return pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks().take(rows), t["fp"].combine_chunks().take(rows),
                 pa.array(start[new].astype(np.int32)), pa.array(start[last].astype(np.int32))], ["doc_id", "fp", "lo", "hi"])

        for b in batches:  # sorted by key: whole groups leave as soon as enough rows are there
            held.append(b)
            if sum(x.num_rows for x in held) >= TREE_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t["key"].to_numpy()
                tail = int(np.searchsorted(key, key[-1]))
                if tail:
                    yield flush(t.slice(0, tail))
                held = t.slice(tail).to_batches()
        if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield flush(t)

    return (occ.repartition("key").sortWithinPartitions("key")
            .mapInArrow(build, "doc_id long, fp long, lo int, hi int"))


def _long_prefixes(occ: DataFrame, window: int) -> DataFrame:
    """(doc_id, fp, lo, hi) of repeated windows of very frequent prefixes, by whole windows.

    Occurrences with the same surroundings are merged first: their windows repeat each
    other. One of each kind is spelled out in windows, which tells what the others share."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(column(b, "words"))
            r = _Ranges(h := w.hashes())
            r2 = _Ranges(mix64(h ^ np.uint64(0x5851F42D4C957F2D)))
            lo, hi = column(b, "lo").to_numpy(), column(b, "hi").to_numpy()
            n = (hi - lo + 1).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = w.first[row] + step
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(column(b, c).take(rows) for c in ("doc_id", "fp", "n")), pa.array((lo[row] + step).astype(np.int32)),
                 _signed(r.of(a, a + window)), _signed(r2.of(a, a + window))], ["doc_id", "fp", "n", "lo", "h1", "h2"])

    kinds = cut(occ.groupBy("key", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "fp", "lo", "hi", "words")).alias("one")), "surroundings")
    whole = occ.join(kinds.where("n > 1").select("key", "around"), ["key", "around"], "left_semi").select("doc_id", "fp", "lo", "hi")
    each = cut(kinds.select("n", "one.*").mapInArrow(spell, "doc_id long, fp long, n long, lo int, h1 long, h2 long"), "windows")
    often = each.groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1").select("h1", "h2")
    lone = each.where("n = 1").join(often, ["h1", "h2"], "left_semi").select("doc_id", "fp", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(lone)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, lo, hi): runs of repeated windows, by the places of their first words."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counts = cut(prefix_counts(docs, window), "prefixes")
    parts = {"equal": "same", "mixed": "not same", "large": f"n > {group}"}
    sizes = counts.agg(*[F.count(F.when(F.expr(c), 1)).alias(k) for k, c in parts.items()]).first()
    maps = [_bitmap(counts.where(c), sizes[k]) for k, c in parts.items()]
    occ = cut(occurrences(docs, *maps, window), "occurrences")
    # a bit set by chance must not remove a word: here the prefix itself is compared
    whole = (occ.where("equal").select("key", "doc_id", "fp", "lo", "hi")
             .join(counts.where("same").select("key"), "key", "left_semi").drop("key"))
    return whole.unionByName(_trees(occ.where("path = 1"), window)).unionByName(_long_prefixes(occ.where("path = 2"), window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``docs`` (all columns) with n_words, n_removed, kept_text (kept words joined by one
    space) and kept_sha256."""
    ranges = cut(repeated_ranges(docs, window, group), "repeats")
    given = without(docs, RESULT)
    doc, own, mark, held = free_names(given, "run_doc", "own_print", "run_print", "runs")
    per_doc = ranges.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("lo", "hi"))).toDF(doc, mark, held)
    joined = given.withColumn(own, F.xxhash64("text")).join(
        per_doc.hint("shuffle_hash"), given["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(mark)),
        "left").drop(doc, mark, own)
    names = given.columns
    schema = T.StructType([*given.schema.fields, *(T.StructField(n, t) for n, t in zip(
        RESULT, (T.LongType(), T.LongType(), T.StringType(), T.StringType())))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, digest = [], [], [], []
            for text, runs in zip(column(b, "text").to_pylist(), column(b, held).to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [r["lo"] for r in runs], 1)
                    np.add.at(gone, [r["hi"] + window for r in runs], -1)
                    words = [x for x, g in zip(words, np.cumsum(gone).tolist()) if not g]
                n_removed.append(n_words[-1] - len(words))
                raw = b" ".join(words)
                kept.append(raw.decode())
                digest.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(b, c) for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                                 pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                [*names, *RESULT])

    return map_rows(joined, apply, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+34], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
-- the last repeated window that starts at or before a word covers it if any does
cov AS (SELECT p.doc_id, p.p, p.word,
               coalesce(max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.p ROWS UNBOUNDED PRECEDING), -100) >= p.p - 34 AS gone
        FROM pos p LEFT JOIN rep r ON r.doc_id = p.doc_id AND r.i = p.p),
agg AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
        FROM cov GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""
