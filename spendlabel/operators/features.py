"""Text features as dataflow (O36-O38) and the stratified holdout.

Layout: n-grams, their counts and the L2 norm belong to a key, so a key that occurs once is
counted in the task that reads its text, in slices of bounded size; neither texts nor n-grams
are exchanged. Only keys that occur again are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BIGRAM_JOIN, bucket_of, joined_tokens, ngram_array
from ..session import ship_package
from .clean import bounded_broadcast

DEFAULT_BITS = 20
#: Characters of texts that a task turns into n-grams at a time.
TEXT_AT_A_TIME = 500_000


def ngrams(joined: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, place of its term, the distinct terms) of every unigram and adjacent bigram, repeats
    included, of texts given as joined tokens."""
    tokens = pc.split_pattern(joined, BIGRAM_JOIN)
    size = tokens.value_lengths().to_numpy()
    row, flat = np.repeat(np.arange(len(size)), size), tokens.flatten()
    held = pc.not_equal(flat, "")  # a text without tokens splits into one empty one
    row, coded = row[held.to_numpy(zero_copy_only=False)], flat.filter(held).dictionary_encode()
    word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    same = row[1:] == row[:-1]
    pairs = pa.array((word[:-1] << 32 | word[1:])[same]).dictionary_encode()
    first, second = (pa.array(x) for x in np.divmod(pairs.dictionary.to_numpy(), 1 << 32))
    terms = pc.binary_join_element_wise(words.take(first), words.take(second), BIGRAM_JOIN)
    return (np.concatenate([row, row[1:][same]]), np.concatenate([word, pairs.indices.to_numpy() + len(words)]),
            pa.concat_arrays([words, terms]))


_MD5_ADD = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_MD5_SHIFT = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_MD5_WORD = [(1, 0), (5, 1), (3, 5), (7, 0)]


def _md5_heads(block: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of padded messages of one block each (16 words x messages)."""
    a, b, c, d = (np.full(block.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(61):  # the last three steps do not touch this word
        turn, (times, plus) = i // 16, _MD5_WORD[i // 16]
        f = (d ^ (b & (c ^ d)) if turn == 0 else c ^ (d & (b ^ c)) if turn == 1
             else b ^ c ^ d if turn == 2 else c ^ (b | ~d))
        f += a
        f += block[(times * i + plus) % 16]
        f += _MD5_ADD[i]
        s = _MD5_SHIFT[turn][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(s) | f >> np.uint32(32 - s))
    return (b + np.uint32(0x67452301)).byteswap()


#: What a word of 8 bytes keeps of a message that has 0 to 8 bytes left, and the bit that ends it there.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_END = np.array([0x80 << 8 * n for n in range(8)] + [0], np.uint64)


def _blocks(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Padded MD5 messages (16 words x messages) of the bytes that begin at ``start``, 55 at most;
    ``data`` has 8 bytes more than they need. Bytes are taken 8 at a time."""
    wide, eights = np.zeros((8, len(size)), np.uint64), np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    for j in range(int(size.max()) // 8 + 1):
        at = np.flatnonzero(size >= 8 * j)
        left = np.minimum(size[at] - 8 * j, 8)
        wide[j, at] = eights[start[at] + 8 * j] & _KEEP[left] | _END[left]
    wide[7] = size * 8
    words = np.empty((16, len(size)), np.uint32)
    words[::2], words[1::2] = wide & np.uint64(0xFFFFFFFF), wide >> np.uint64(32)
    return words


def hashed(terms: pa.Array, bits: int = DEFAULT_BITS) -> np.ndarray:
    """``bucket_of`` of each term: short ones together, longer than one block of MD5 by themselves."""
    out = np.empty(len(terms), np.int64)
    if not len(terms):
        return out
    terms = terms.cast(pa.large_binary())
    edge = np.frombuffer(terms.buffers()[1], np.int64, len(terms) + 1, terms.offset * 8)
    start, size = edge[:-1] - edge[0], np.diff(edge)
    held = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[edge[0]:edge[-1]]
    data = np.concatenate([held, np.zeros(8, np.uint8)])
    long = size > 55
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(md5(held[start[i]:start[i] + size[i]], usedforsecurity=False).digest()[:4], "big")
    short = np.flatnonzero(~long)
    for i in range(0, len(short), 16384):
        at = short[i:i + 16384]
        out[at] = _md5_heads(_blocks(data, start[at], size[at]))
    return out & ((1 << bits) - 1)


def buckets(joined: pa.Array, bits: int = DEFAULT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of joined tokens, repeats included; each distinct n-gram is
    hashed once."""
    row, place, terms = ngrams(joined)
    return row, hashed(terms, bits)[place]


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = TEXT_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``limit`` bytes of column ``text`` at most (a byte more per row), or one row."""
    for b in batches:
        end = np.cumsum(pc.binary_length(b.column(b.schema.names.index(text))).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j


def cells_of(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, how often) of the distinct pairs, in order."""
    cell, n = np.unique(row << 32 | value, return_counts=True)
    return cell >> 32, cell & 0xFFFFFFFF, n


def _by_key(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) of the keys that occur once, and of those that occur again (None if there are
    none). Only keys are counted and moved; few that occur again are broadcast."""
    rows = df.select(key, text)
    again = df.groupBy(F.col(key).alias("__k")).count().where(F.col("count") > 1).select("__k")
    again = bounded_broadcast(again)
    if again.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("__k"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def _per_row(rows: DataFrame, key: str, text: str, schema: T.StructType, work) -> DataFrame:
    """``work(keys, joined tokens)`` over the rows of each task: columns of ``schema``."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "__t"):
            yield pa.RecordBatch.from_arrays(work(b.column(0), b.column(1)), schema.names)

    return rows.select(key, joined_tokens(text).alias("__t")).mapInArrow(run, schema)


def tokenize_ngrams(df: DataFrame, key: str, text: str = "text", counted: bool = False) -> DataFrame:
    """(key, token): unigrams and adjacent bigrams of the whole text. ``counted``: (key, token, n),
    how often each key has it. A key that occurs once is counted in its task, so that neither
    texts nor n-grams move; the n-grams of others are grouped."""
    if not counted:
        return (df.select(key, F.explode_outer(ngram_array(text)).alias("token"))
                .filter(F.col("token").isNotNull()))
    once, again = _by_key(df, key, text)
    schema = T.StructType([df.schema[key], T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])

    def work(keys: pa.Array, tokens: pa.Array) -> list[pa.Array]:
        row, place, terms = ngrams(tokens)
        row, place, n = cells_of(row, place)
        return [keys.take(pa.array(row)), terms.take(pa.array(place)), pa.array(n)]

    out = _per_row(once, key, text, schema, work)
    if again is not None:
        out = out.unionByName(tokenize_ngrams(again, key, text).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")))
    return out


def hashed_tf(df: DataFrame, key: str, text: str = "text", bits: int = DEFAULT_BITS, rows: bool = False) -> DataFrame:
    """(key, bucket, tf): term counts per key and bucket, no sign, no vocabulary. ``rows``: one
    row per key, with bucket and tf as lists.

    A key that occurs once is counted in its task, slice by slice, and nothing moves; the
    counts of other keys are grouped."""
    once, again = _by_key(df, key, text)
    kinds = [T.ArrayType(t) if rows else t for t in (T.IntegerType(), T.LongType())]
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in zip(("bucket", "tf"), kinds))])

    def work(keys: pa.Array, tokens: pa.Array) -> list[pa.Array]:
        row, bucket, tf = cells_of(*buckets(tokens, bits))
        bucket, tf = pa.array(bucket.astype(np.int32)), pa.array(tf)
        if not rows:
            return [keys.take(pa.array(row)), bucket, tf]
        first = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(keys)))), pa.int32())
        return [keys, *(pa.ListArray.from_arrays(first, x) for x in (bucket, tf))]

    out = _per_row(once, key, text, schema, work)
    if again is not None:
        cells = (tokenize_ngrams(again, key, text).select(key, bucket_of("token", bits).alias("bucket"))
                 .groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("tf")))
        if rows:
            cells = (cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", "tf"))).alias("s"))
                     .select(key, F.col("s.bucket").alias("bucket"), F.col("s.tf").alias("tf")))
        out = out.unionByName(cells)
    return out


def l2_normalize(tf: DataFrame, key: str, value: str = "tf") -> DataFrame:
    """(key, bucket, x) of a (key, bucket, value) table: value / Euclidean norm of its key's.
    With lists (``hashed_tf(rows=True)``) a key is one row and nothing moves; otherwise the
    norm is a sum over the key's window, so the table is computed once. Null keys have no norm."""
    tf = tf.filter(F.col(key).isNotNull())
    if isinstance(tf.schema[value].dataType, T.ArrayType):
        squares = F.aggregate(value, F.lit(0.0), lambda a, v: a + v * v)
        named = tf.select(key, "bucket", value, F.sqrt(squares).alias("__n"))
        return named.select(key, F.inline(F.arrays_zip(
            F.col("bucket").alias("bucket"), F.transform(value, lambda v: v / F.col("__n")).alias("x"))))
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key)))
    return tf.select(key, "bucket", (F.col(value) / norm).alias("x"))


def stratified_holdout(df: DataFrame, label: str = "category", id_col: str = "row_id",
                       test_size: float = 0.2, seed: int = 42, distinct_ids: bool = False) -> DataFrame:
    """Add ``split`` ('train' / 'test'): per label, the first round(n * test_size)
    distinct ids in md5(seed:id) order are held out. Exact counts (unlike sampleBy);
    equal rows share an id and land on one side. Ranking uses hash-prefix buckets
    with offsets, so a huge label is ranked by many tasks, not one. Only (label, id) pairs
    are ranked and moved; the last id held out of each label decides the side of every row
    where it is read. ``distinct_ids`` says that every id occurs once in ``df``."""
    from .maintain import assign_positions

    pairs = df.select(label, id_col).filter(F.col(label).isNotNull())
    pairs = pairs if distinct_ids else pairs.distinct()
    h = _order(id_col, seed)
    ranked = assign_positions(pairs, h, [id_col], partition_cols=[label], with_total=True)
    cut = F.round(F.col("__total").cast("double") * F.lit(float(test_size)))
    last = (ranked.filter(F.col("pos") <= cut).groupBy(F.col(label).alias("__l"))
            .agg(F.max(F.struct(h.alias("h"), F.col(id_col).alias("id"))).alias("__last")))
    test = F.struct(h.alias("h"), F.col(id_col).alias("id")) <= F.col("__last")
    joined = df.join(bounded_broadcast(last), F.col(label) == F.col("__l"), "left")
    return joined.withColumn("split", F.when(F.col(id_col).isNotNull() & F.col("__last").isNotNull() & test, "test")
                             .otherwise("train")).drop("__l", "__last")


def _order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col)))


def holdout_thresholds(df: DataFrame, known: DataFrame | None = None, label: str = "category", id_col: str = "row_id",
                       test_size: float = 0.2, seed: int = 42, distinct_ids: bool = False) -> DataFrame:
    """(label, threshold) of the labels of ``df`` that ``known`` lacks: ids whose
    md5(seed:id) lies below the threshold are held out. It is the least hash on the train
    side of :func:`stratified_holdout`, so the first split has its exact counts; a label too
    small to hold anything out takes ``test_size`` of the hash range where that moves no id."""
    fresh = df.filter(F.col(label).isNotNull())
    fresh = fresh if known is None else fresh.join(known.select(label), label, "left_anti")
    split = stratified_holdout(fresh.select(label, id_col), label, id_col, test_size, seed, distinct_ids)
    h, share = _order(id_col, seed), F.lit(f"{min(int(test_size * 16**8), 16**8 - 1):08x}")
    least = split.groupBy(label).agg(F.min(F.when(F.col("split") == "train", h)).alias("least"),
                                     F.count_if(F.col("split") == "test").alias("held"))
    threshold = F.coalesce(F.when(F.col("held") == 0, F.least("least", share)).otherwise(F.col("least")), F.lit("g"))
    return least.select(label, threshold.alias("threshold"))


def stable_holdout(df: DataFrame, thresholds: DataFrame, label: str = "category", id_col: str = "row_id",
                   seed: int = 42) -> DataFrame:
    """Add ``split`` by stored thresholds: an id's side depends on its label and itself only,
    so no learned id is ever held out however its label grows."""
    test = F.col("threshold").isNotNull() & (_order(id_col, seed) < F.col("threshold"))
    return (df.join(bounded_broadcast(thresholds.select(label, "threshold")), label, "left")
            .withColumn("split", F.when(test, "test").otherwise("train")).drop("threshold"))
