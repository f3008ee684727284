"""Alignment of two tokenizers over the same bytes.

Every text is encoded by A (byte-level BPE, the text after one space) and by B (SentencePiece,
which puts that space itself); both token rows then cover the same bytes. The libraries' spans
are coarse cuts (A's character offsets; the begins of B's pieces from its proto output, which
has taken the place of the immutable proto in the installed library): a token whose span is as
long as its decoded bytes lies there; tokens that share a multibyte character, and B's byte
pieces, are placed by their decoded bytes within it.

Byte places where tokens of A and B both end cut the rows into groups; tokens whose ranges
overlap are links. A pair (A id, B id) counts once for each document that holds it linked.

Layout. One map encodes the documents and writes, per document, its sizes, the digest of its
groups, and its distinct linked pairs with how often. The pairs are counted in an aggregate
that combines in the tasks first. Pairs are very uneven: those above a count that at most
``FREQUENT`` pairs reach (found from a histogram of counts) are broadcast, which bounds the
broadcast whatever the data, and added up where the documents are; the others are joined by
shuffle. No pair is left out.

A text falls into chunks at every single space between two other characters: no token of either
tokenizer reaches over it, both start one there, and so it is a cut of the groups too (checked
for the files when they are loaded; tokenizers that do not allow it get whole texts). Each
distinct chunk is encoded and aligned once per task (bounded table); a document adds up its
chunks. Long texts are taken in parts of about ``PART`` characters, so what a task holds is
bounded by its table and by the longest stretch without such a space.

Edge cases. Null or empty texts, and texts whose joined token bytes differ from space + text
(U+2581 in it, for instance): zeros and an empty ``groups_sha256``. Null ids, repeated ids and
repeated rows: one row each, each counted as a document. Special strings in a text are plain
text. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, ship

PART = 100_000
#: Characters of short texts that a task takes at a time.
BATCH = 400_000
#: Chunks whose tokens and links a task holds, and links in all (8 bytes each); when either is
#: full the table starts anew (costs time only).
CHUNKS, LINKS = 500_000, 9_600_000
#: Pairs that are broadcast at most (17 bytes each).
FREQUENT = 400_000
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_EDGE = re.compile(r"\A[\s▁]|[\s▁]\Z")
_ID, _BEGIN = attrgetter("id"), attrgetter("begin")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    for itself, the others in order from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """Decoded bytes of each id, and the id's decimal text before ``,``, ``|`` and ``;``."""

    def __init__(self, pieces: list[bytes], end: str):
        self.pieces, self.size = pieces, np.array([len(p) for p in pieces], np.int64)
        self.n = len(pieces)
        self.text = [f"{i}," for i in range(self.n)] + [f"{i}{end}" for i in range(self.n)]

    def places(self, ids: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of each token in bytes. ``coarse``: (begin, end) of the library's span.
        A span as long as the decoded bytes is the place; tokens in between share a character,
        and follow each other by their decoded bytes."""
        size = self.size[ids]
        start, whole = coarse[0].copy(), coarse[1] - coarse[0] == size
        if not whole.all():
            run = np.cumsum(size) - size
            known = np.maximum.accumulate(np.where(whole, np.arange(len(ids)), -1))
            base = np.where(known >= 0, start[known] - run[known], 0)
            start = np.where(whole, start, base + run)
        return start, start + size


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None, "post_processor": None}))
        self.a.encode_special_tokens = True
        at, vocab = byte_level_alphabet(), self.a.get_vocab()
        names = [""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            names[i] = name
        self.side_a = Side([bytes(at[c] for c in n) if all(c in at for c in n) else b"" for n in names], "|")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_b = Side([bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else
                            b"" if self.b.is_control(i) else p.replace("▁", " ").encode()
                            for i, p in enumerate(pieces)], ";")
        self.text = self.side_a.text + self.side_b.text
        # a single space between words starts a token of both, whatever stands around it
        self.independent = (spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
                      and spec["normalizer"] is None and not any("▁" in p.lstrip("▁") for p in pieces))
        self.clear()

    def chunks(self, text: str) -> list[str]:
        return _CUT.split(text) if self.independent else [text]

    def parts(self, text: str) -> Iterator[str]:
        """The text in slices of about ``PART`` characters, cut where chunks are."""
        at = 0
        while self.independent and len(text) - at > PART and (m := _CUT.search(text, at + PART)):
            yield text[at:m.start()]
            at = m.end()
        yield text[at:]

    def tokens(self, chunks: list[str]) -> tuple | None:
        """Ids, starts, ends and tokens of each chunk, for A and for B, of the chunks joined by
        spaces; and where the chunks end. None where the bytes differ."""
        text = " ".join(chunks)
        data = (" " + text).encode()
        enc, proto = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text, return_type="proto").pieces
        head = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
        byte = np.append(np.flatnonzero(head), len(data))  # characters -> bytes
        edge = byte[np.cumsum([len(c) + 1 for c in chunks])]
        begin = np.fromiter(map(_BEGIN, proto), np.int64, len(proto)) + 1  # behind the space that B put there
        begin[:1] = 0
        ids_a = enc.ids
        spans = np.fromiter(chain.from_iterable(enc.offsets), np.int64, 2 * len(ids_a))
        out = []
        for side, ids, coarse in ((self.side_a, ids_a, byte[spans.reshape(-1, 2)].T),
                                  (self.side_b, list(map(_ID, proto)), np.stack([begin, np.append(begin[1:], len(data))]))):
            if b"".join(map(side.pieces.__getitem__, ids)) != data:
                return None
            flat = np.array(ids, np.int64)
            start, end = side.places(flat, coarse)
            n = np.searchsorted(end, edge, "right")
            if (end[n - 1] != edge).any():
                return None
            out.append((flat, start, end, np.diff(n, prepend=0)))
        return *out, edge

    def hold(self, chunks: set[str]) -> None:
        """Have all of ``chunks`` in the table, which starts anew when full."""
        new = chunks.difference(self.place)
        if new and (len(self.place) + len(new) > CHUNKS or self.first[-1] > LINKS):
            self.clear()
            new = chunks
        self.learn(sorted(new))

    def learn(self, chunks: list[str]) -> None:
        """Add chunks to the table: together, but for those that begin or end in white space."""
        odd = [c for c in chunks if not c or _EDGE.search(c)]
        self.learn_run(sorted(set(chunks).difference(odd)))
        for c in odd:
            self.learn_run([c])

    def learn_run(self, chunks: list[str]) -> None:
        if not chunks:
            return
        t = self.tokens(chunks)
        if t is None and len(chunks) > 1:  # one of them differs: found by halves
            self.learn_run(chunks[:len(chunks) // 2])
            self.learn_run(chunks[len(chunks) // 2:])
            return
        self.place.update(zip(chunks, range(len(self.groups_of), len(self.groups_of) + len(chunks))))
        if t is None:
            self.groups_of.append("")
            self.add(np.array([[-1, 0, 0, 0]]), np.zeros(0, np.int64))
            return
        (a, start_a, end_a, n_a), (b, start_b, end_b, n_b), edge = t
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)  # the group of each token
        order = np.argsort(np.concatenate([2 * at_a, 2 * at_b + 1]), kind="stable")
        place = np.concatenate([a + (both[at_a] == end_a) * self.side_a.n,
                                b + (both[at_b] == end_b) * self.side_b.n + 2 * self.side_a.n])[order]
        line = list(map(self.text.__getitem__, place.tolist()))
        stop = np.cumsum(n_a + n_b)
        self.groups_of += ["".join(line[i:j]) for i, j in zip((stop - n_a - n_b).tolist(), stop.tolist())]
        lo, hi = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        n = hi - lo
        to = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        links = np.add.reduceat(n, np.cumsum(n_a) - n_a)
        self.add(np.stack([n_a, n_b, np.diff(np.searchsorted(both, edge, "right"), prepend=0), links], 1),
                 np.repeat(a, n) * self.side_b.n + b[to])

    def add(self, sizes: np.ndarray, code: np.ndarray) -> None:
        """Sizes and pair codes of the next chunks; the arrays grow by doubling."""
        n, m = len(self.groups_of), int(self.first[-1])
        while len(self.sizes) < n:
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while len(self.code) < m + len(code):
            self.code = np.concatenate([self.code, np.zeros_like(self.code)])
        self.sizes[n - len(sizes):n], self.code[m:m + len(code)] = sizes, code
        self.first = np.concatenate([self.first, m + np.cumsum(sizes[:, 3])])

    def clear(self) -> None:
        self.place, self.groups_of = {}, []
        self.sizes, self.code, self.first = np.zeros((1024, 4), np.int64), np.zeros(8192, np.int64), np.zeros(1, np.int64)

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, sha, pair codes, times) of each text."""
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))
        parts = [self.parts(t) if t else () for t in texts]
        if sum(len(t or "") for t in texts) <= BATCH:  # short texts meet the table together
            parts = [[self.chunks(p) for p in text] for text in parts]
            self.hold({c for text in parts for p in text for c in p})
        else:
            parts = [map(self.chunks, text) for text in parts]
        for text in parts:
            sizes, sha, codes, times, last = np.zeros(4, np.int64), hashlib.sha256(), [], [], ""
            for chunks in text:
                try:
                    at = list(map(self.place.__getitem__, chunks))
                except KeyError:
                    self.hold(set(chunks))
                    at = list(map(self.place.__getitem__, chunks))
                found, n = np.unique(np.array(at), return_counts=True)
                if (self.sizes[found, 0] < 0).any():
                    sizes[:] = 0
                    break
                sizes += n @ self.sizes[found]
                each = self.sizes[found, 3]
                begin = np.cumsum(each) - each
                codes.append(self.code[np.arange(each.sum()) - np.repeat(begin - self.first[found], each)])
                times.append(np.repeat(n, each))
                line = last + "".join(map(self.groups_of.__getitem__, at))
                sha.update(line[:-1].encode())
                last = line[-1:]
            if not sizes[0]:
                yield none
                continue
            code, where = np.unique(np.concatenate(codes), return_inverse=True)
            yield (*sizes.tolist(), sha.hexdigest(), code, np.bincount(where, np.concatenate(times)).astype(np.int32))


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate([np.zeros(0), *rows]) if not rows else np.concatenate(rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()),
                                    pa.array(flat, kind))


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, code, times), written once."""
    ship(docs.sparkSession)
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "code", "times"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for whole in batches:
            size = np.cumsum([len(t) if t else 0 for t in column(whole, "text").to_pylist()])
            at = 0
            while at < whole.num_rows:  # a few texts at a time: encodings are large objects
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, "right")))
                b = whole.slice(at, end - at)
                out = list(zip(*aligner.documents(column(b, "text").to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b.num_rows)), column(b, "doc_id"), *(pa.array(x, pa.int64()) for x in out[:4]),
                     pa.array(out[4], pa.string()), _lists(out[5], pa.int64()), _lists(out[6], pa.int32())], names)
                row, at = row + b.num_rows, end

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                "code array<long>, times array<int>"), "aligned")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(code, count, best): documents that hold each pair, and whether no pair of its A id has
    more. The greatest count per A id has a row for each id of the vocabulary at most."""
    counts = cut(rows.select(F.explode("code").alias("code")).groupBy("code").agg(F.count("*").alias("count")), "pairs")
    a = F.expr(f"code div {width}")
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return (counts.withColumn("a", a).join(F.broadcast(most), "a")
            .select("code", "count", (F.col("count") == F.col("most")).alias("best")))


def _least_frequent(pairs: DataFrame, limit: int) -> int:
    """A count that at most ``limit`` pairs reach: bins of an eighth of a doubling."""
    bins = (pairs.groupBy(F.floor(F.log2("count") * 8).alias("bin"))
            .agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("bin")).collect())
    held, least = 0, 1 << 62
    for b in bins:  # some hundred rows: counts fit 64 bits
        held += b["n"]
        if held > limit:
            break
        least = b["least"]
    return least


def align(docs: DataFrame, path_a: str, path_b: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per
    document."""
    spark = docs.sparkSession
    rows = encoded(docs, path_a, path_b)
    width = _aligner(path_a, path_b).side_b.n
    pairs = pair_counts(rows, width)
    least = _least_frequent(pairs, frequent)
    held = pairs.where(F.col("count") >= least).toArrow().sort_by("code")
    sent = spark.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("code", "count", "best")))
    names = ["row", "n_best", "count_sum", "code", "times"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = sent.value
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                lists = column(b, "code")
                pair, times = lists.flatten().to_numpy(), column(b, "times").flatten().to_numpy()
                doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(code, pair), max(len(code) - 1, 0))
                known = code[at] == pair if len(code) else np.zeros(len(pair), bool)
                n_best, sums = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                np.add.at(sums, doc[known], times[known] * count[at[known]])
                np.add.at(n_best, doc[known], times[known] * best[at[known]])
                rest = np.append(0, np.cumsum(np.bincount(doc[~known], minlength=b.num_rows)))
                off = pa.array(rest, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [column(b, "row"), pa.array(n_best), pa.array(sums), pa.ListArray.from_arrays(off, pa.array(pair[~known])),
                     pa.ListArray.from_arrays(off, pa.array(times[~known]))], names)

    some = cut(rows.select("row", "code", "times").mapInArrow(
        add_up, "row long, n_best long, count_sum long, code array<long>, times array<int>"), "frequent")
    rare = (some.select("row", F.explode(F.arrays_zip("code", "times")).alias("p"))
            .select("row", "p.code", F.col("p.times").cast("long").alias("times"))
            .join(pairs.where(F.col("count") < least), "code")
            .select("row", (F.col("times") * F.col("best").cast("long")).alias("n_best"),
                    (F.col("times") * F.col("count")).alias("count_sum")))
    sums = (some.select("row", "n_best", "count_sum").unionByName(rare)
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return (rows.drop("code", "times").join(sums, "row")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
