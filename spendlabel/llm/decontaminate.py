"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Documents are searched for passages within ``edits(n)`` word edits of a benchmark item of
``n`` words (words are \\w+, lower-cased; each letter is a word in scripts that
put no spaces between words; an edit replaces, inserts or removes a word).

1. Windows. Items fall into size classes; a window of the class's size is looked at where
   it holds enough of the benchmark's q-grams. The needed number is the q-gram lemma's
   lower bound for a passage within the edit budget, so this loses nothing.
2. Embedding. From each such window start a CGK random walk reads the words: at step j it
   emits the word it stands on and moves on by one random bit of (j, word). Near word
   sequences fall back into step after an edit, so edit distance becomes Hamming distance
   of the emitted rows.
3. Bit sampling. Each of ``TABLES`` tables per walk, for ``WALKS`` walks, compares a few
   sampled places of the rows; equal samples make a (window, item) candidate. Walks drift
   apart on long texts, so an item over ``PIECE`` words is embedded in pieces.
4. The rest, exactly. Hash tables may miss, the q-gram lemma does not: wherever a window
   holds as many q-grams of one item as a passage within its budget must keep (or within the
   distance the tables already found), the item is a candidate too. So no leak is lost,
   whatever its length and kind of edits.
5. Verification. Candidates of one item that overlap are verified together by exact
   semi-global edit distance over words (numpy); only those within the budget count.

The benchmark is the stated query set: it meets all rows in blocks of about ``BLOCK_ITEMS``
items and ``BLOCK_CHARS`` characters, each block's index (bounded) being sent to the tasks
once. Texts are never shuffled.

Edge cases. Null or empty text: no match. Null item, or one without a word: not searched.
Short items are searched like all others (under 5 words the budget is 0: verbatim copies),
so an item of one common word marks every text with it; ``min_words`` leaves out items of
fewer words, if a caller wants that. Null ids
are reported as null. Repeated rows, repeated items and ties: each (doc_id, item_id) once,
with its best passage (the first of equals). Empty tables: empty result. Extra columns
are ignored (``matches``) or passed through (``decontaminate``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_rows, mix64, ship

EDIT_SHARE, MIN_WORDS = 0.2, 1
WALKS, TABLES, SAMPLED = 6, 8, 3
#: Share of the leaks at the full edit budget that walks and tables are to find by themselves,
#: for items of any length and edits of any kind; their numbers are set for it.
TARGET_RECALL = 0.9
#: Size classes grow by this factor, up and down from this size.
CLASS_STEP, CLASS_FROM = 1.25, 8
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Longer items are embedded in pieces of at most so many words.
PIECE = 40
#: Cells of walks, and words of a text, looked at in one go.
WALK_CELLS, LOOK_WORDS = 1 << 21, 4096
_WORD = re.compile(r"\w+")
#: Thai, Lao, Burmese, Khmer, kana and Han: no spaces between words.
_DENSE = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
          "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_HAS_DENSE = re.compile(f"[{_DENSE}]").search
_DENSE_WORD = re.compile(rf"(?=\w)[{_DENSE}]|[^\W{_DENSE}]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class WordCodes(dict):
    """Word -> 64-bit hash; bounded, starts anew when full."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = h
        return h


def codes(text: str | None, table: WordCodes) -> np.ndarray:
    text = (text or "").lower()
    words = (_WORD if text.isascii() or not _HAS_DENSE(text) else _DENSE_WORD).findall(text)
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def edits(n: int, share: float = EDIT_SHARE) -> int:
    return int(share * n)


def qgrams(h: np.ndarray, q: int) -> np.ndarray:
    if len(h) < q:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - q + 1]
    for k in range(1, q):
        out = mix64(out * _GOLD + h[k: len(h) - q + 1 + k])
    return out


def cgk(h: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """Words emitted by each walk from each start, (steps, WALKS, starts); zero beyond the end."""
    padded = np.append(h, np.uint64(0))
    at, out = np.tile(starts.astype(np.int64), (WALKS, 1)), np.empty((steps, WALKS, len(starts)), np.uint64)
    walk = np.arange(WALKS, dtype=np.uint64)[:, None] * np.uint64(100_003)
    for j in range(steps):
        out[j] = sym = padded[np.minimum(at, len(h))]
        coin = mix64(sym ^ ((walk + np.uint64(j + 1)) * _GOLD)) >> np.uint64(63)
        at += coin.astype(np.int64)
    return out


@dataclass
class SizeClass:
    size: int  # least words of its items
    most: int
    q: int
    need: int  # q-grams of the benchmark a window must hold
    grams: np.ndarray  # sorted hashes
    post: np.ndarray  # gram k is in the items holders[post[k]:post[k + 1]]
    holders: np.ndarray
    steps: int
    places: np.ndarray  # walk x table x sampled
    tables: list  # walk x table: (sorted keys, piece)
    pieces: np.ndarray  # (item index, first word) of each embedded piece
    lengths: np.ndarray  # words of each item of the block
    gate: np.ndarray | None = None  # by low hash bits, of all classes with this q: a cheap first look


def _keys(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    key = np.zeros(rows.shape[1], np.uint64)
    for p in places:
        key = mix64(key * _GOLD + rows[p])
    return key


def build_index(items: list[tuple[int, str]], share: float = EDIT_SHARE, min_words: int = MIN_WORDS):
    """Item hashes and size classes of a block of items."""
    table = WordCodes()
    held = [(i, h) for i, t in items if len(h := codes(t, table)) >= max(1, min_words)]
    classes: list[SizeClass] = []
    lengths = np.array([len(h) for _, h in held], np.int64)
    by: dict[int, list[int]] = {}
    for k, (_, h) in enumerate(held):
        by.setdefault(math.floor(math.log(len(h) / CLASS_FROM) / math.log(CLASS_STEP) + 1e-9), []).append(k)
    for members in by.values():
        sizes = [len(held[k][1]) for k in members]
        lo, hi = min(sizes), max(sizes)
        bound = {q: min(n + 1 - q * (edits(n, share) + 1) for n in sizes) for q in (3, 2, 1)}
        q = next((q for q in (3, 2) if bound[q] >= 2), 1)
        own = [np.unique(qgrams(held[k][1], q)) for k in members]
        every, holders = np.concatenate(own), np.repeat(np.array(members, np.int32), [len(g) for g in own])
        order = np.argsort(every, kind="stable")
        grams, post = np.unique(every[order], return_index=True)
        post, holders = np.append(post, len(every)).astype(np.int32), holders[order]
        cuts = [(k, np.linspace(0, n, -(-n // PIECE) + 1).astype(np.int64)) for k, n in zip(members, sizes)]
        pieces = np.array([(k, a) for k, c in cuts for a in c[:-1]], np.int64)
        steps = max(SAMPLED, int(1.6 * min(int(np.diff(c).min()) for _, c in cuts)))
        rng = np.random.default_rng(lo)
        places = np.sort(np.stack([rng.choice(steps, SAMPLED, replace=False) for _ in range(WALKS * TABLES)]), 1)
        places = places.reshape(WALKS, TABLES, SAMPLED)
        tables = []
        rows = np.concatenate([cgk(held[k][1][a:b], np.zeros(1, np.int64), steps)
                               for k, c in cuts for a, b in zip(c[:-1], c[1:])], 2)
        for w in range(WALKS):
            for t in range(TABLES):
                key = _keys(rows[:, w], places[w, t])
                order = np.argsort(key, kind="stable")
                tables.append((key[order], order))
        classes.append(SizeClass(lo, hi, q, max(1, bound[q]), grams, post, holders, steps, places, tables, pieces,
                                 lengths))
    for q in {c.q for c in classes}:
        gate = np.zeros(1 << 21, bool)
        for c in classes:
            if c.q == q:
                gate[(c.grams & np.uint64(len(gate) - 1)).astype(np.int64)] = True
                c.gate = gate
    return held, classes


def windows(h: np.ndarray, classes: list[SizeClass], share: float = EDIT_SHARE) -> list[tuple]:
    """(class, places of its q-grams in such windows, their gram numbers, marked words) of each
    class that has windows with enough of its q-grams."""
    out = []
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in classes:
        if len(h) < c.size - edits(c.size, share):
            continue
        if c.q not in hits:  # places of any class's q-grams, by one look at a shared bit table
            g = qgrams(h, c.q)
            at = np.flatnonzero(c.gate[(g & np.uint64(len(c.gate) - 1)).astype(np.int64)])
            hits[c.q] = at, g[at]
        at, g = hits[c.q]
        if len(at) < c.need:
            continue
        gram = np.minimum(np.searchsorted(c.grams, g), len(c.grams) - 1)
        held = c.grams[gram] == g
        at, gram = at[held], gram[held]
        if len(at) < c.need:
            continue
        # starts whose window of most + edits words holds enough of the q-grams
        span = c.most + edits(c.most, share)
        first, last = at[: len(at) - c.need + 1], at[c.need - 1:]
        near = last - first < span
        if not near.any():
            continue
        mark = np.zeros(len(h) + 2, np.int32)
        np.add.at(mark, np.maximum(0, last[near] - span + 1), 1)
        # a piece starts anywhere in its window
        np.add.at(mark, np.minimum(first[near] + (span if c.most > PIECE else 1), len(h) + 1), -1)
        used = np.zeros(len(at) + 1, np.int32)
        np.add.at(used, np.flatnonzero(near), 1)
        np.add.at(used, np.flatnonzero(near) + c.need, -1)
        used = np.cumsum(used)[:-1] > 0
        out.append((c, at[used], gram[used], np.flatnonzero(np.cumsum(mark)[: len(h)] > 0)))
    return out


def candidates(h: np.ndarray, found: list[tuple]) -> list[tuple[int, int, int]]:
    """(item index, place in the text, place in the item) that agree in at least one table."""
    out: set[tuple[int, int, int]] = set()
    for c, _, _, every in found:
        step = max(1, WALK_CELLS // (c.steps * WALKS))
        for k in range(0, len(every), step):
            starts = every[k:k + step]
            rows = cgk(h, starts, c.steps)
            for w in range(WALKS):
                for t in range(TABLES):
                    keys, piece = c.tables[w * TABLES + t]
                    key = _keys(rows[:, w], c.places[w, t])
                    a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    for s in np.flatnonzero(b > a):
                        out.update((int(i), int(starts[s]), int(o)) for i, o in c.pieces[piece[a[s]:b[s]]])
    return sorted(out)


def lemma_spans(found: list[tuple], sizes: np.ndarray, budget: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item index, start, end) that hold every passage within ``budget`` edits of an item of
    ``sizes`` words: the item's q-grams in it are as many as so many edits must leave."""
    for c, at, gram, _ in found:
        reach = c.most + int(budget[c.holders].max())
        look = max(LOOK_WORDS, 4 * reach)
        for p in range(int(at[0]), int(at[-1]) + 1, look - reach):
            a, b = np.searchsorted(at, (p, p + look))
            if b - a < c.need:
                continue
            n = c.post[gram[a:b] + 1] - c.post[gram[a:b]]
            word = np.repeat(at[a:b], n)
            item = c.holders[np.arange(len(word)) + np.repeat(c.post[gram[a:b]] - (np.cumsum(n) - n), n)]
            order = np.argsort(item, kind="stable")
            item, word = item[order], word[order]
            need = np.maximum(1, sizes[item] + 1 - c.q * (budget[item] + 1))
            to = np.arange(len(item)) + need - 1
            inside = to < len(item)
            head, to = np.flatnonzero(inside), to[inside]
            wide = sizes[item[head]] + budget[item[head]]
            near = (item[to] == item[head]) & (word[to] + c.q - word[head] <= wide)
            for i, x, y, w in zip(item[head[near]], word[head[near]], word[to[near]] + c.q, wide[near]):
                yield int(i), max(0, int(y - w)), int(x + w)


def best_passage(h: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the passage of ``h`` nearest to ``item`` in word edits."""
    n = len(item)
    order = np.arange(n + 1)
    dist, begin = order.copy(), np.zeros(n + 1, np.int64)
    best = (n, 0, 0)
    for j, sym in enumerate(h):
        diag, up = dist[:-1] + (item != sym), dist[1:] + 1
        d = np.empty(n + 1, np.int64)
        b = np.empty(n + 1, np.int64)
        d[0], b[0] = 0, j + 1
        take = diag <= up
        d[1:], b[1:] = np.where(take, diag, up), np.where(take, begin[:-1], begin[1:])
        low = np.minimum.accumulate(d - order)  # words of the item left out
        src = np.maximum.accumulate(np.where(d - order == low, order, 0))
        d, b = low + order, b[src]
        dist, begin = d, b
        if d[n] < best[0]:
            best = (int(d[n]), int(b[n]), j + 1)
            if not best[0]:
                break
    return best


def search(h: np.ndarray, held: list, classes: list[SizeClass], share: float = EDIT_SHARE, any_one: bool = False):
    """(item index, distance, start, end): verified passages, the best of each item;
    ``any_one``: as soon as there is one."""
    out: dict[int, tuple[int, int, int]] = {}
    seen: dict[int, list[tuple[int, int]]] = {}

    def verify(spans) -> None:
        group: list[tuple[int, int, int]] = []
        for i, a, b in sorted(spans):
            b = min(b, len(h))
            if group and group[-1][0] == i and a <= group[-1][2]:
                group[-1] = (i, group[-1][1], max(b, group[-1][2]))
            else:
                group.append((i, a, b))
        for i, a, b in group:
            item = held[i][1]
            if any(x <= a and b <= y for x, y in seen.get(i, ())) or (i in out and not out[i][0] and out[i][1] <= a):
                continue
            seen.setdefault(i, []).append((a, b))
            d, x, y = best_passage(h[a:b], item)
            if d <= edits(len(item), share):
                out[i] = min(out.get(i, (d, a + x, a + y)), (d, a + x, a + y))

    found = windows(h, classes, share)
    if not found:
        return []
    sizes = classes[0].lengths
    budget = (share * sizes).astype(np.int64)
    # words before a piece may be left out or put in
    verify((i, max(0, s - o - int(budget[i])), s - o + int(sizes[i] + budget[i] * (1 + (o > 0))))
           for i, s, o in candidates(h, found))
    if not (any_one and out):
        for i, m in out.items():
            budget[i] = m[0]
        verify(lemma_spans(found, sizes, budget))
    return [(i, *m) for i, m in out.items()]


def blocks_of(items: DataFrame, block_items: int) -> int:
    n, chars = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    return max(1, math.ceil(n / block_items), math.ceil((chars or 0) / BLOCK_CHARS))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, min_words: int = MIN_WORDS,
            block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, first_word, last_word, n_item_words): leaked passages."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    blocks = blocks_of(items, block_items)
    schema = "doc_id long, item_id long, distance int, first_word int, last_word int, n_item_words int"
    out = None
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        held, classes = build_index(sorted(((r.item_id, r.text) for r in mine.collect()),
                                           key=lambda r: (r[0] is None, r)), share, min_words)
        sent = spark.sparkContext.broadcast((held, classes))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (held, classes), table = sent.value, WordCodes()
            for b in batches:
                rows = []
                for doc, text in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
                    for i, d, x, y in search(codes(text, table), held, classes, share):
                        rows.append((doc, held[i][0], d, x, y - 1, len(held[i][1])))
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 ["doc_id", "item_id", "distance", "first_word", "last_word", "n_item_words"])

        part = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct("distance", "first_word", "last_word", "n_item_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark. One map over
    the rows per block of items; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    blocks = blocks_of(items, BLOCK_ITEMS)
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(build_index(
            sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda r: (r[0] is None, r)), share, min_words))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (held, classes), table = sent.value, WordCodes()
            for b in batches:
                yield b.filter(pa.array([not search(codes(t, table), held, classes, share, any_one=True)
                                         for t in column(b, "text").to_pylist()], pa.bool_()))

        docs = map_rows(docs, clean, docs.schema)
    return docs
