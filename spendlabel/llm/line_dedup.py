"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without outer [\\x20\\x09-\\x0D], A-Z lower-cased, hashed to 128
bits. The state has three tables:

* ``refs``    (k1, k2, doc_id): one row per document that holds a key, the exact truth. It lies
  as a log: each change adds a folder of its documents' references and one of the ids that
  it replaces or deletes, and writes no other reference again; a log of more than ``LOG``
  changes is written anew as one;
* ``counts``  (shard, k1, k2, n_docs, keeper): the frequent keys, derived from ``refs``;
* ``filters`` (shard, blob): per shard a cuckoo filter of the frequent keys.

``insert_documents`` and ``delete_documents`` change ``refs`` and recount the touched keys
only; keys that become frequent enter their shard's filter, keys that no longer are leave
it, so a deletion undoes an insertion exactly. When the frequent keys outgrow their shards,
there are more shards from then on. ``dropped_lines`` sends each reference to
its shard, where the filter discards the keys that are surely not frequent before the
exact count decides. A shard that holds a large share of all references (one very common
line) is read by several tasks, each with the shard's filter and counts.

Edge cases. Null or empty text: one empty line, nothing dropped. Null id: such rows keep
all lines and count for no key. Repeated rows with one id are one document and get the
same verdict each. Ties cannot occur: the keeper is the largest id. Empty table: empty
result. Extra columns pass through untouched whatever their names and types; those named like
a result column (``RESULT``) give way to it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, column, cut, free_names, map_rows, mix64, scratch_path, ship, without

MIN_CHARS, MIN_DOCS = 40, 5
#: The columns ``dedup_lines`` adds.
RESULT = ("n_lines", "n_dropped", "kept_text", "kept_sha256")
#: Frequent keys a shard holds on average, and references a task reads of one shard.
SHARD_KEYS, TASK_REFS = 50_000, 200_000
#: Changes a state holds before its references are written as one folder.
LOG = 16
_SLOTS, _KICKS = 4, 500


class CuckooFilter:
    """Approximate set with deletion: 16-bit marks in buckets of four, two places a key."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(2, math.ceil(math.log2(max(1, capacity) / (_SLOTS * 0.85))))
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(16, len(keys))
        while not (made := cls(capacity)).insert(keys):
            capacity *= 2
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, _SLOTS).copy())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, mask = mix64(keys.astype(np.uint64)), np.uint64(len(self.table) - 1)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = h & mask
        return mark, one.astype(np.int64), ((one ^ mix64(mark.astype(np.uint64))) & mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds the keys; False when a key found no place (build a larger filter then)."""
        rng = np.random.default_rng(len(keys))
        mask = len(self.table) - 1
        for m, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
            else:
                at = a
                for _ in range(_KICKS):
                    slot = int(rng.integers(_SLOTS))
                    m, self.table[at, slot] = int(self.table[at, slot]), m
                    at = (at ^ int(mix64(np.array([m], np.uint64))[0])) & mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = m
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted before."""
        for m, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == m)
                if len(held):
                    self.table[at, held[0]] = 0
                    break


def _key(line: str, min_chars: int) -> tuple[int, int] | None:
    line = line.strip(SPACE_CHARS)
    if len(line) < min_chars:
        return None
    d = xxhash.xxh3_128_digest(line.encode().lower())  # bytes.lower() touches A-Z only
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id): each long key of each document once."""
    ship(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, k1, k2 = [], [], []
            for doc, text in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
                found = {_key(x, min_chars) for x in text.split("\n")} - {None}
                ids += [doc] * len(found)
                k1 += [x for x, _ in found]
                k2 += [x for _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k1, k2, ids)], ["k1", "k2", "doc_id"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(keys, "k1 long, k2 long, doc_id long")


@dataclass
class State:
    log: tuple[Change, ...]
    refs: DataFrame  # the log's living references
    counts: DataFrame
    filters: DataFrame
    shards: int


@dataclass(frozen=True)
class Change:
    """Folders of one change: references it adds (k1, k2, doc_id, seq) and ids whose earlier
    references it ends (doc_id, seq)."""
    added: str | None
    ended: str | None


REFS, ENDED = "k1 long, k2 long, doc_id long, seq int", "doc_id long, seq int"


def _record(log: tuple[Change, ...], added: DataFrame | None, ended: DataFrame | None) -> tuple[Change, ...]:
    """``log`` with one more change; only its own rows are written."""
    def put(df: DataFrame | None, name: str) -> str | None:
        if df is None:
            return None
        path = scratch_path(df.sparkSession, name)
        df.withColumn("seq", F.lit(len(log))).write.parquet(path)
        return path

    return (*log, Change(put(added, "line-refs"), put(ended, "line-ended")))


def _living(spark: SparkSession, log: tuple[Change, ...]) -> DataFrame:
    """(k1, k2, doc_id): references that no later change ended."""
    refs = spark.read.schema(REFS).parquet(*[c.added for c in log if c.added])
    ended = [c.ended for c in log if c.ended]
    if ended:
        last = (spark.read.schema(ENDED).parquet(*ended)
                .groupBy("doc_id").agg(F.max("seq").alias("ended")))
        refs = refs.join(last, "doc_id", "left").where("ended is null or seq >= ended")
    return refs.select("k1", "k2", "doc_id")


def _count(refs: DataFrame, shards: int, min_docs: int) -> DataFrame:
    return (refs.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs)
            .select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", "k2", "n_docs", "keeper"))


def _filters(counts: DataFrame) -> DataFrame:
    def build(t: pa.Table) -> pa.Table:
        f = CuckooFilter.of(t["k2"].to_numpy())
        return pa.table({"shard": t["shard"][:1], "blob": pa.array([f.to_bytes()], pa.binary())})

    return counts.groupBy("shard").applyInArrow(build, "shard int, blob binary")


def build_state(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> State:
    """State of a first batch. The number of shards follows the number of frequent keys."""
    log = _record((), line_refs(docs, min_chars), None)
    refs = _living(docs.sparkSession, log)
    counts = cut(_count(refs, 1, min_docs), "line-counts")
    shards = max(1, math.ceil(counts.count() / SHARD_KEYS))
    counts = counts.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    return State(log, refs, counts, cut(_filters(counts), "line-filters"), shards)


def _change(state: State, log: tuple[Change, ...], touched: DataFrame, min_docs: int) -> State:
    """State over ``log``, recounting the ``touched`` keys only."""
    refs = _living(touched.sparkSession, log)
    if len(log) > LOG:
        log = _record((), refs, None)
        refs = _living(touched.sparkSession, log)
    touched = touched.select("k1", "k2").distinct()
    new = cut(_count(refs.join(touched, ["k1", "k2"], "left_semi"), state.shards, min_docs), "line-recount")
    old = state.counts.join(touched, ["k1", "k2"], "left_semi")
    counts = cut(state.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(new), "line-counts")
    shards = max(1, math.ceil(counts.count() / SHARD_KEYS))
    if shards > state.shards:  # outgrown: more shards, and their filters from the exact counts
        counts = counts.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
        return State(log, refs, counts, cut(_filters(counts), "line-filters"), shards)
    entered = new.join(old, ["k1", "k2"], "left_anti").select("shard", "k2", F.lit(True).alias("enter"))
    left = old.join(new, ["k1", "k2"], "left_anti").select("shard", "k2", F.lit(False).alias("enter"))

    def patch(filters: pa.Table, moves: pa.Table) -> pa.Table:
        shard = (filters if filters.num_rows else moves)["shard"][:1]
        enter = moves["enter"].to_numpy(zero_copy_only=False).astype(bool)
        keys = moves["k2"].to_numpy()
        f = CuckooFilter.from_bytes(filters["blob"][0].as_py()) if filters.num_rows else CuckooFilter(1024)
        f.delete(keys[~enter])
        full = not f.insert(keys[enter])
        return pa.table({"shard": shard, "blob": pa.array([None if full else f.to_bytes()], pa.binary())})

    moved = cut(state.filters.groupBy("shard").cogroup(entered.unionByName(left).groupBy("shard"))
                .applyInArrow(patch, "shard int, blob binary"), "line-moves")
    # a filter that ran full is built anew from its shard's exact counts
    full = moved.where("blob is null").select("shard")
    filters = moved.where("blob is not null").unionByName(_filters(counts.join(full, "shard", "left_semi")))
    return State(log, refs, counts, cut(filters, "line-filters"), state.shards)


def insert_documents(state: State, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> State:
    """State with more documents. One that is there already is replaced: keys its new text
    no longer has are released (the same text again changes nothing)."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    log = _record(state.log, line_refs(docs, min_chars).distinct(), ids)
    read = docs.sparkSession.read
    new = read.schema(REFS).parquet(log[-1].added).drop("seq")
    ids = read.schema(ENDED).parquet(log[-1].ended).drop("seq")
    old = cut(state.refs.join(ids, "doc_id", "left_semi"), "line-old")
    on = ["k1", "k2", "doc_id"]
    touched = new.join(old, on, "left_anti").unionByName(old.join(new, on, "left_anti"))
    return _change(state, log, cut(touched, "line-touched"), min_docs)


def delete_documents(state: State, ids: DataFrame, min_docs: int = MIN_DOCS) -> State:
    """State without the documents of ``ids`` (doc_id)."""
    ids = ids.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    log = _record(state.log, None, ids)
    ids = ids.sparkSession.read.schema(ENDED).parquet(log[-1].ended).drop("seq")
    return _change(state, log, cut(state.refs.join(ids, "doc_id", "left_semi"), "line-gone"), min_docs)


def dropped_lines(state: State) -> DataFrame:
    """(doc_id, keys): the keys whose lines a document loses, as k1 values with k2."""
    refs = state.refs.withColumn("shard", F.pmod("k1", F.lit(state.shards)).cast("int"))
    # one row per shard: how many tasks share its references
    # (as many rows as shards, one for SHARD_KEYS frequent keys: small enough to broadcast,
    # and references must not be exchanged on the shard alone)
    load = F.broadcast(refs.groupBy("shard").agg(F.ceil(F.count("*") / TASK_REFS).cast("int").alias("parts")))
    held = (state.counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("k1", "k2", "keeper"))).alias("exact"))
            .join(state.filters, "shard").join(load, "shard")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    refs = (refs.join(load, "shard")
            .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts"))

    def decide(r: pa.Table, h: pa.Table) -> pa.Table:
        names, empty = ["doc_id", "k1", "k2"], pa.table([pa.array([], pa.int64())] * 3, ["doc_id", "k1", "k2"])
        if not h.num_rows or not r.num_rows:
            return empty
        maybe = CuckooFilter.from_bytes(h["blob"][0].as_py()).contains(r["k2"].to_numpy())
        r = r.filter(pa.array(maybe)).select(names)
        exact = h["exact"].combine_chunks().flatten()
        k1, k2 = exact.field("k1").to_numpy(), exact.field("k2").to_numpy()
        at = np.searchsorted(k1, r["k1"].to_numpy())
        at_end = np.searchsorted(k1, r["k1"].to_numpy(), "right")
        keeper, hit = exact.field("keeper").to_numpy(), np.zeros(r.num_rows, bool)
        for step in range(int((at_end - at).max(initial=0))):  # rows that share k1: one, as good as always
            i = np.minimum(at + step, len(k1) - 1)
            hit |= (at + step < at_end) & (k2[i] == r["k2"].to_numpy()) & (keeper[i] != r["doc_id"].to_numpy())
        return r.filter(pa.array(hit))

    lost = (refs.groupBy("shard", "part").cogroup(held.groupBy("shard", "part"))
            .applyInArrow(decide, "doc_id long, k1 long, k2 long"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("lost_keys"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                state: State | None = None) -> DataFrame:
    """``docs`` (all columns) with n_lines, n_dropped, kept_text, kept_sha256."""
    state = state or build_state(docs, min_chars, min_docs)
    lost = cut(dropped_lines(state), "line-lost")
    # one exchange of the texts by id at every size; the list of lost keys is the hashed side
    given = without(docs, RESULT)
    lost_id, held = free_names(given, "lost_id", "lost_keys")
    joined = given.join(lost.toDF(lost_id, held).hint("shuffle_hash"),
                        given["doc_id"] == F.col(lost_id), "left").drop(lost_id)
    names = given.columns
    schema = T.StructType([*given.schema.fields, *(T.StructField(n, t) for n, t in zip(
        RESULT, (T.LongType(), T.LongType(), T.StringType(), T.StringType())))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, kept, digest = [], [], [], []
            for text, lost_keys in zip(column(b, "text").to_pylist(), column(b, held).to_pylist()):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if lost_keys:
                    gone = {(x["k1"], x["k2"]) for x in lost_keys}
                    lines = [x for x in lines if _key(x, min_chars) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                text = "\n".join(lines)
                kept.append(text)
                digest.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(b, c) for c in names] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                                 pa.array(kept, pa.string()), pa.array(digest, pa.string())],
                [*names, *RESULT])

    return map_rows(joined, apply, schema)


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM raw),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
v AS (SELECT doc_id, pos, line, (keeper IS NOT NULL AND keeper <> doc_id) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
