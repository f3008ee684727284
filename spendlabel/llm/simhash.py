"""SimHash near-duplicates by a binary-trie self-join.

Each whole text gets a 64-bit fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+,
``shingle`` words joined by one space (repeats included), XXH64 with seed 42 of each; a
bit is 1 where over half of the hashes have it. Equal fingerprints form one class first.
The classes are then joined with themselves at up to ``max_bits`` differing bits:

* the 64 bits are cut into ``max_bits + 2`` blocks; a pair within the budget agrees on at
  least two of them, so for each pair of blocks the classes are grouped by those bits.
  In the trie whose first levels are these bits a group is one subtree, reached without
  a differing bit; only its node paired with itself can hold new links;
* a group of more than ``GROUP`` classes is split by its next trie levels: the other bits are
  cut into ``max_bits + 1`` blocks, of which a pair agrees on at least one, and the group
  falls into the subtrees of each;
* inside a group the trie over the remaining bits (sorted array, a node is a range) is
  traversed in node pairs, adding a differing bit whenever the children differ, and
  dropping the pair once the sum exceeds the budget;
* a link counts in the first pair of blocks it agrees on (in a split group: and in the
  first further block), so it is found once.

Links between classes become components by large-star and small-star rounds, each
written to the shared checkpoint folder.

Edge cases. Fewer words than ``shingle``: the whole word sequence is the one shingle.
No word, empty or null text: fingerprint zero, linked like any other. Null id: the row
keeps its fingerprint and joins its class; a component of null ids only has a null id.
Repeated rows: one row each (``keep_one`` keeps one). Empty table: empty result. Extra columns are ignored by
``components``; ``keep_one`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, free_names, ship

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Classes of one group that one task joins; a larger group is split. Rows a task joins at a time.
GROUP, AT_A_TIME = 100_000, 200_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() cuts at [\x20\x09-\x0D]
    if not words:
        return 0
    line, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    begin = np.cumsum([0] + [len(w) + 1 for w in words])
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begin[:n].tolist(), (begin[shingle:] - 1).tolist())),
                    np.uint64, n)
    ones = [np.bincount(col, minlength=256) @ _BYTE_BITS for col in h.view(np.uint8).reshape(n, 8).T]
    return sum(1 << i for i, c in enumerate(np.concatenate(ones).tolist()) if 2 * c > n)


_LOWER = bytes(range(256)).lower()  # touches A-Z only


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print, fp): a hash of the text, and the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in column(b, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "print"), pa.array(fps.view(np.int64))],
                                             ["doc_id", "print", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("print"), "text").mapInArrow(
        prints, "doc_id long, print long, fp long")


def trie_pairs(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of places with equal ``group`` whose ``fp`` differ in 1..max_bits bits.

    The input is sorted by (group, fp) and distinct. One trie per group; all tries are
    walked level by level, a node being the range [lo, hi) of its leaves.
    """
    n = len(fp)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    big = hi - lo > 1
    alo, ahi = lo[big], hi[big]
    blo, bhi, cost = alo.copy(), ahi.copy(), np.zeros(len(alo), np.int64)
    for bit in range(63, -1, -1):
        if not len(alo):
            break
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same = alo == blo  # a node with itself gives its two children and their one pair
        parts = [(alo, amid, blo, bmid, cost, slice(None)), (amid, ahi, bmid, bhi, cost, slice(None)),
                 (alo, amid, bmid, bhi, cost + 1, slice(None)), (amid, ahi, blo, bmid, cost + 1, ~same)]
        rows = [np.stack([p[0], p[1], p[2], p[3], p[4]])[:, p[5]] for p in parts]
        alo, ahi, blo, bhi, cost = np.concatenate(rows, axis=1)
        live = (cost <= max_bits) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, cost = alo[live], ahi[live], blo[live], bhi[live], cost[live]
    return alo, blo


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): fingerprints of distinct ``classes`` (fp) at 1..max_bits differing bits, each pair once."""
    blocks = max_bits + 2
    ship(classes.sparkSession)
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    block = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    masks = [block[x] | block[y] for x, y in combinations(range(blocks), 2)]
    further = [[sum(1 << int(x) for x in part) for part in np.array_split([x for x in range(64) if not m >> x & 1], max_bits + 1)]
               for m in masks]  # of each pair of blocks

    def under(mask: int):
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))

    keys = F.array(*[F.struct(F.lit(i).alias("pair"), under(m).alias("bits")) for i, m in enumerate(masks)])
    spread = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.pair", "k.bits")
    large = cut(spread.groupBy("pair", "bits").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
                .select("pair", "bits"), "large-groups")
    whole = [F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subbits")]
    if large.isEmpty():
        groups = spread.select("*", *whole)
    else:
        parts = F.element_at(F.array(*[F.array(*[F.struct(F.lit(j).alias("sub"), under(m).alias("subbits"))
                                                 for j, m in enumerate(ms)]) for ms in further]), F.col("pair") + 1)
        split = spread.join(large, ["pair", "bits"], "left_semi").withColumn("s", F.explode(parts))
        groups = (spread.join(large, ["pair", "bits"], "left_anti").select("fp", "pair", "bits", *whole)
                  .union(split.select("fp", "pair", "bits", "s.sub", "s.subbits")))
    by = ["pair", "bits", "sub", "subbits"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table) -> pa.RecordBatch:
            fp, pair, sub = t["fp"].to_numpy().view(np.uint64), t["pair"].to_numpy(), t["sub"].to_numpy()
            group = np.cumsum(_begins(t, by))
            order = np.lexsort((fp, group))
            fp, pair, sub = fp[order], pair[order], sub[order]
            i, j = trie_pairs(group[order], fp, max_bits)
            diff, first = fp[i] ^ fp[j], np.ones(len(i), bool)
            for p, m in enumerate(masks):  # found again in a later pair of blocks, or further block: not here
                first &= ~((p < pair[i]) & ((diff & np.uint64(m)) == 0))
                for k, f in enumerate(further[p]):
                    first &= ~((p == pair[i]) & (k < sub[i]) & ((diff & np.uint64(f)) == 0))
            return pa.RecordBatch.from_arrays([pa.array(fp[x][first].view(np.int64)) for x in (i, j)], ["a", "b"])

        held, rows, enough = [], 0, AT_A_TIME
        for b in batches:  # sorted by group: whole groups are joined as soon as enough rows are there
            held.append(b)
            rows += b.num_rows
            if rows >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                tail = int(np.flatnonzero(_begins(t, by))[-1])
                if tail:
                    yield flush(t.slice(0, tail))
                held, rows = t.slice(tail).to_batches(), t.num_rows - tail
                enough = max(AT_A_TIME, 2 * rows)  # one group in progress is put together ever more rarely
        if rows:
            yield flush(pa.Table.from_batches(held))

    return (groups.repartition(*by).sortWithinPartitions(*by)
            .mapInArrow(join, "a long, b long"))


def _begins(t: pa.Table, by: list[str]) -> np.ndarray:
    """Whether a row of the sorted table is the first of its group."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in by:
        v = t[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the least node reachable.

    Alternates large stars (a node's larger neighbours go to its least one) and small
    stars (its smaller neighbours do) until nothing changes; the number of rounds grows
    with the logarithm of a component's width. Least neighbours come from map-side
    aggregates, so a node with very many neighbours is no group in one task.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v") if large else (
            e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        if large:
            moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.select("u", "m"))
        return moved.where("a <> b").distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.where("a <> b").select("a", "b").distinct(), "links")
    before, now = None, sign(edges)
    while now != before:
        edges = cut(star(star(edges, True), False), "star")
        before, now = now, sign(edges)
    return edges.toDF("node", "root").union(edges.select("b", "b").distinct())


def _placed(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, print, fp) and classes (fp, first, n_links), ``first`` being the first
    row of the class's component: (no_id, doc_id, print), rows without id last."""
    fps = cut(fingerprints(docs, shingle), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    classes = cut(fps.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    pairs = cut(links(classes, max_bits), "pairs")
    degree = (pairs.select(F.col("a").alias("fp")).union(pairs.select("b"))
              .groupBy("fp").agg(F.count("*").alias("n_links")))
    root = connected(pairs).toDF("fp", "root")
    placed = (classes.join(root, "fp", "left").join(degree, "fp", "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    return fps, cut(placed.drop("first").join(firsts, "root").select("fp", "first", "n_links"), "labels")


def components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): one row per document. ``n_links``
    counts the other fingerprints linked to the document's own."""
    fps, label = _placed(docs, shingle, max_bits)
    return (fps.join(label, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("first.doc_id").alias("component_id"), "n_links"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (all columns) with one document of each component: the least id (where
    none has an id, the least hash of the text). Of rows that repeat it one stays."""
    fps, label = _placed(docs, shingle, max_bits)
    rows = fps.join(label, "fp")
    key, mark, own, n = free_names(docs, "kept_id", "kept_print", "own_print", "n_rows")
    chosen = cut(rows.where((F.col("print") == F.col("first.print")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
                 .groupBy(F.col("doc_id").alias(key), F.col("print").alias(mark)).agg(F.count("*").alias(n)), "chosen")
    kept = docs.withColumn(own, F.xxhash64("text")).join(
        chosen.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark)))
    helpers = [key, mark, own, n]
    if chosen.where(F.col(n) > 1).isEmpty():
        return kept.drop(*helpers)
    # only rows that are there more than once meet their copies
    many = kept.where(F.col(n) > 1).dropDuplicates([key, mark])
    return kept.where(F.col(n) == 1).drop(*helpers).unionByName(many.drop(*helpers))
