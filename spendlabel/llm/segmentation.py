"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

Encoding gives the library's own ids; decoding joins the pieces' bytes again. Besides,
each row gets ``k`` distinct segmentations of its whole text, drawn without replacement by
the Gumbel top-k trick:

* Arcs of the lattice are the vocabulary's pieces that match at a place, weighted
  ``-alpha * log(rank + 1)``; characters without a piece use their byte pieces. No piece
  reaches over the border of a chunk (a run of word marks with what follows it, or one
  line feed; checked when the file is loaded), so the lattice of a text is a chain of chunk
  lattices, and a chunk's lattice is built once per task. Backward sums turn weights into
  the probability of each arc at its node.
* A* search over perturbed log-probabilities: an open region of the space of
  segmentations is "these pieces so far, then any piece but those already taken"; its
  priority is the largest perturbed value in it, a Gumbel at the region's log-mass cut off
  at its parent's, which is exact, so regions leave the queue in the order of the samples.
  The region on top is opened by drawing its next piece, and the way on to the end of the
  text is the way of that maximum; every node passed leaves a new region behind.
* The inclusion score of a sample is log(1 - exp(-exp(log_prob - t))), t being the
  perturbed value of the best region left in the queue (0 when none is left).

Draws are hashes of (row key, sample, chunk, step): a row gets the same segmentations
whatever batch, task or machine it is on.

Edge cases. Null or empty text: no ids and one sample, the empty one, with probability 1.
Texts with fewer than ``k`` segmentations: all of them. Null key: like key 0. Repeated
rows: equal results. ``round_trip`` says whether the row's ids and those of each of its
samples, decoded in the task, return the text; it is false
only where the text holds the word mark U+2581 itself, which the library reads as a space.
Very long texts are handled chunk by chunk; a text is one row of a task. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, mix64, ship

SAMPLES, ALPHA, SEED = 2, 1.0, 0
#: Chunk lattices are kept up to this many arcs; texts are handled in runs, and new chunks in
#: slices, of these many characters.
ARCS, RUN_CHARS, SLICE_CHARS = 8_000_000, 500_000, 100_000
#: The trie of the pieces has a table of the next states by so many kinds of characters.
KINDS = 64
MARK = "▁"
#: Latin letters. Where no piece of a model joins one to another character (but for marks
#: before it), texts are cut there too, which makes far fewer different chunks.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Kinds of bytes: letters, others, spaces and line feeds. All bytes of a character are of one kind.
_A_LETTER, _OTHER, _SPACE, _FEED = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[32], _KIND[10] = _A_LETTER, _SPACE, _FEED


def chunks_of(texts: list[str], fine: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(place of its chunk, the distinct chunks, chunks of each text) of every chunk of ``texts`` in
    order. A chunk is one line feed, or spaces and what follows them: up to the next space or line
    feed, and where ``fine`` is set also to the border between letters and others."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    kind = _KIND[data]
    if fine:  # Latin letters beyond ASCII have two bytes each
        two = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
        code = (data[two].astype(np.int32) & 0x1F) << 6 | data[two + 1] & 0x3F
        two = two[(code <= 0x24F) & (code != 0xD7) & (code != 0xF7)]
        kind[two] = kind[two + 1] = _A_LETTER
    else:
        kind[kind == _A_LETTER] = _OTHER
    begins = np.ones(len(data), bool)
    now, last = kind[1:], kind[:-1]
    begins[1:] = (now != last) & ((last != _SPACE) | (now == _FEED)) | (now == _FEED)
    ends = np.cumsum(size)
    begins[(ends - size)[size > 0]] = True
    start = np.flatnonzero(begins)
    edge = pa.array(np.append(start, len(data)), pa.int64())
    coded = pa.LargeStringArray.from_buffers(len(start), edge.buffers()[1], pa.py_buffer(data)).dictionary_encode()
    at = np.searchsorted(start, np.append(0, ends))
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.diff(at)


#: No Gumbel drawn here is further above its place: uniforms have 53 bits.
_HIGHEST = 37.5
#: Regions are first looked for among so many places.
NEAR = 256
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F))


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        n = self.n = self.sp.vocab_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)
                                             or self.sp.is_unused(i))]
        if any(MARK in names[i].lstrip(MARK) or "\n" in names[i] for i in plain):
            raise ValueError("pieces of this model reach over words or lines")
        whole = re.compile(f"{MARK}*([{_LETTER}]*|[^{_LETTER}]*)")
        self.fine = all(whole.fullmatch(names[i]) for i in plain)
        probe = " a  b\n c"
        if self.sp.decode(self.sp.encode(probe)) != probe:
            raise ValueError("this model normalises its input")
        self.ids = {names[i]: i for i in plain}
        prefixes = {"": 0} | {x: i + 1 for i, x in enumerate(sorted(
            {p[:j] for p in self.ids for j in range(1, len(p) + 1)}))}
        edges = sorted((prefixes[x[:-1]] << 21 | ord(x[-1]), i) for x, i in prefixes.items() if x)
        self.edge, self.to = (np.array(x, np.int64) for x in zip(*edges))
        # next states by the characters that most edges have; other characters are searched for
        char, many = np.unique(self.edge & 0x1FFFFF, return_counts=True)
        often = char[np.argsort(-many, kind="stable")]
        often = often[often < 0x2FFF][:KINDS - 1]
        self.kinds = np.zeros(0x3000, np.uint8)
        self.kinds[often] = np.arange(1, len(often) + 1)
        self.next = np.full(len(prefixes) * KINDS, -1, np.int32)
        kind = self.kind(self.edge & 0x1FFFFF)
        self.next[((self.edge >> 21) * KINDS + kind)[kind > 0]] = self.to[kind > 0]
        self.ends = np.full(len(prefixes), -1)  # piece that ends at each state of the trie
        for p, i in self.ids.items():
            self.ends[prefixes[p]] = i
        rank = np.clip([-self.sp.get_score(i) for i in range(n)], 0, n)
        self.weight = -alpha * np.log(rank + 2)
        self.missing = -alpha * math.log(n + 2)  # of each byte of a character without a piece
        self.bytes = [names[i].replace(MARK, " ").encode() for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if self.sp.is_byte(i):
                self.byte_id[int(names[i][1:-1], 16)] = i
                self.bytes[i] = bytes([int(names[i][1:-1], 16)])
        self.joined = pa.array(self.bytes, pa.large_binary())

    def kind(self, char: np.ndarray) -> np.ndarray:
        """Column of ``next`` of each character, 0 for those that have none."""
        return self.kinds[np.minimum(char, len(self.kinds) - 1)]

    def step(self, state: np.ndarray, char: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Next state of the trie, -1 where no piece goes on."""
        to = self.next[state * KINDS + kind]
        rare = np.flatnonzero(kind == 0)
        if len(rare):
            key = state[rare].astype(np.int64) << 21 | char[rare]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            to[rare] = np.where(self.edge[at] == key, self.to[at], -1)
        return to

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of a text's ids (the leading mark is the one encoding put there)."""
        if not len(ids):
            return b""
        taken = self.joined.take(pa.array(ids))
        _, edge, data = taken.buffers()
        edge = np.frombuffer(edge, np.int64, len(taken) + 1, taken.offset * 8)
        return data[int(edge[0]) + 1:int(edge[-1])].to_pybytes()


ARC = np.dtype([("p", "f8"), ("end", "i4"), ("piece", "i4")])


class _Grown:
    """An array that grows at its end; untouched room costs no memory."""

    def __init__(self, dtype, room: int):
        self.held, self.n = np.zeros(room, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.zeros(self.n + 2 * len(more), self.held.dtype)])
        self.held[self.n:self.n + len(more)] = more
        self.n += len(more)

    def view(self) -> np.ndarray:
        return self.held[:self.n]


class Lattices:
    """Chunk lattices of a task as flat arrays. Chunks are kept with spaces for word marks.

    ``first`` is a chunk's first node; the arcs of node x are ``arc[ptr[x]:ptr[x + 1]]``,
    the likeliest first, each with its probability at the node, the node it leads to and
    its piece (from the size of the vocabulary on: a character that only has several bytes).
    ``best[first_best[c]:first_best[c + 1]]`` are the library's ids of chunk c.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.ptr, self.arc = _Grown(np.int32, ARCS // 8), _Grown(np.int32, ARCS // 2), _Grown(ARC, ARCS + ARCS // 4)
        self.first_best, self.best = _Grown(np.int64, ARCS // 8), _Grown(np.int32, ARCS // 4)
        self.ptr.extend(np.zeros(1, np.int32))
        self.first_best.extend(np.zeros(1, np.int64))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each of ``chunks``, which all differ; new ones get their lattices and best ids."""
        out = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(out < 0)
        out[new] = at = np.arange(len(self.at), len(self.at) + len(new))
        found = [chunks[i] for i in new.tolist()]
        self.at.update(zip(found, at.tolist()))
        self._add(found)
        return out

    def _add(self, chunks: list[str]) -> None:
        if not chunks:
            return
        vocab = self.vocab
        marked = [c[0] == " " for c in chunks]
        found = vocab.sp.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked)])
        best = [(ids or [vocab.ids[MARK]]) if m else ids[2:] for ids, m in zip(found, marked)]  # [2:]: mark, line feed
        ends, flat = np.cumsum([len(x) for x in best]), np.fromiter(chain.from_iterable(best), np.int32)
        self.first_best.extend(self.best.n + ends)
        self.best.extend(flat)
        size = np.array([len(c) for c in chunks])
        a, run = 0, np.cumsum(size)
        while a < len(chunks):  # slices whose tables stay small
            z = max(a + 1, int(np.searchsorted(run, (run[a - 1] if a else 0) + SLICE_CHARS, "right")))
            self._lattices("".join(chunks[a:z]), size[a:z])
            a = z

    def _lattices(self, text: str, size: np.ndarray) -> None:
        """Lattices of the chunks that ``text`` consists of."""
        vocab = self.vocab
        char = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        char[char == 32] = ord(MARK)
        n, owner, stop = len(char), np.repeat(np.arange(len(size)), size), np.cumsum(size)
        node = np.arange(n) + owner  # one node per character and one at the end of each chunk
        left = stop[owner] - np.arange(n)  # characters from here to the chunk's end
        # (place, piece) of every piece of 1, 2, ... characters: all places walk the trie together
        kind = vocab.kind(char)
        live, state, steps, bare = np.arange(n), vocab.step(np.zeros(n, np.int32), char, kind), [], np.ones(n, bool)
        while len(live):
            live, state = live[state >= 0], state[state >= 0]
            piece = vocab.ends[state]
            found = piece >= 0
            steps.append((live[found], piece[found]))
            go = left[live] > len(steps)
            live, state = live[go], state[go]
            state = vocab.step(state, char[live + len(steps)], kind[live + len(steps)])
        bare[steps[0][0]] = False
        bare = np.flatnonzero(bare)  # characters without a piece: their bytes
        steps.insert(0, (bare, np.where(char[bare] < 0x80, vocab.byte_id[char[bare] & 0x7F], vocab.n + char[bare])))
        count = np.zeros(n, np.int64)
        for i, _ in steps:
            count[i] += 1
        # arcs lie by their distance from the chunk's end, then by place, then by length
        order = np.argsort(left if size.max() > 0xFFFF else left.astype(np.uint16), kind="stable")
        begin = np.empty(n, np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        total = int(count.sum())
        owns, piece, length, weight = (np.empty(total, t) for t in (np.int64, np.int64, np.int64, float))
        free = begin.copy()
        for l, (i, x) in enumerate(steps):
            slot = free[i]
            free[i] += 1
            owns[slot], piece[slot], length[slot] = i, x, max(1, l)
            if l:
                weight[slot] = vocab.weight[x]
            else:
                c = char[i]
                weight[slot] = vocab.missing * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
        # backward sums, from the chunks' ends on; places equally far from an end go together
        back, p, leads = np.zeros(n + len(size)), np.empty(total), node[owns] + length
        bounds = np.searchsorted(left[order], np.arange(1, int(size.max()) + 2))
        edge = np.append(begin[order], total)
        for a, b in zip(bounds, bounds[1:]):
            if a == b:
                continue
            i, first, per = order[a:b], edge[a:b] - edge[a], np.diff(edge[a:b + 1])
            s = slice(edge[a], edge[b])
            w = weight[s] + back[leads[s]]
            top = np.maximum.reduceat(w, first)
            mass = np.exp(w - np.repeat(top, per))
            both = np.add.reduceat(mass, first)
            back[node[i]] = top + np.log(both)
            p[s] = mass / np.repeat(both, per)
        base = self.ptr.n - 1
        first = np.cumsum(count) - count
        to = first[owns] + np.arange(total) - begin[owns]
        arcs = np.empty(total, ARC)
        arcs["p"][to], arcs["piece"][to], arcs["end"][to] = p, piece, base + leads
        best = np.flatnonzero(p == np.repeat(np.maximum.reduceat(p, edge[:-1]), count[order]))
        best = best[np.append(True, owns[best[1:]] != owns[best[:-1]])]  # the shortest of equals
        here, likely = first[owns[best]], to[best]
        arcs[here], arcs[likely] = arcs[likely], arcs[here]
        per_node = np.zeros(len(back), np.int64)
        per_node[node] = count
        self.first.extend((base + stop - size + np.arange(len(size))).astype(np.int32))
        self.ptr.extend((self.arc.n + np.cumsum(per_node)).astype(np.int32))
        self.arc.extend(arcs)

    def view(self) -> dict[str, np.ndarray]:
        return {k: x.view() for k, x in vars(self).items() if isinstance(x, _Grown)}


def _seeded(seed: np.ndarray, sample: int, chunk: np.ndarray) -> np.ndarray:
    return seed + chunk.astype(np.uint64) * _A + np.atleast_1d(np.uint64(sample + 1)) * _C


def _uniform(seeded: np.ndarray, step) -> np.ndarray:
    u = (mix64(seeded + np.atleast_1d(step).astype(np.uint64) * _B) >> np.uint64(11)).astype(float)
    u += 0.5
    u *= 2.0**-53
    return u


def _below(loc, bound, u):
    """Gumbel at ``loc`` given that it is below ``bound``."""
    return loc - np.log(np.exp(np.minimum(loc - bound, 700)) - np.log(u))


def _walk(v: dict, node: np.ndarray, seeded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws a way from each node to the end of its chunk: arcs per chunk; node and arc record of each, by place."""
    ptr, arc = v["ptr"], v["arc"]
    live, steps, count = np.arange(len(node)), [], np.zeros(len(node), np.int64)
    while len(live):
        at, end = ptr[node], ptr[node + 1]
        go = at < end
        count[live[~go]] = len(steps)
        live, node, seeded, at, last = live[go], node[go], seeded[go], at[go].astype(np.int64), end[go] - 1
        u = _uniform(seeded, np.uint64(len(steps)))
        rec = arc[at]
        rest = np.flatnonzero((u >= rec["p"]) & (at < last))  # not the likeliest arc: try the next ones
        u_rest, at, last = u[rest] - rec["p"][rest], at[rest], last[rest]
        while len(rest):
            at += 1
            rec[rest] = more = arc[at]
            on = (u_rest >= more["p"]) & (at < last)
            rest, u_rest, at, last = rest[on], (u_rest - more["p"])[on], at[on], last[on]
        steps.append((live, node, rec))
        node = rec["end"]
    first = np.cumsum(count) - count
    nodes, arcs = np.empty(int(count.sum()), np.int32), np.empty(int(count.sum()), ARC)
    for i, (live, node, rec) in enumerate(steps):
        to = first[live] + i
        nodes[to], arcs[to] = node, rec
    return count, nodes, arcs


class _Way:
    """One sample of one text: its pieces, their log-probabilities, the nodes they leave and the chunks these are in."""

    def __init__(self, pieces, logp, nodes, chunks, value):
        self.pieces, self.logp, self.nodes, self.chunks, self.value = pieces, logp, nodes, chunks, value
        self.log_prob = float(logp.sum())


def _regions(v: dict, ways: list[_Way], probs: list[np.ndarray], new_from: list[int], before: list[float],
             seeds: np.ndarray, sample: int, k: int):
    """Of each way the ``k`` best regions its nodes leave behind, from place ``new_from`` on (``probs``:
    its probabilities from there on): lists of (value, place, log-mass of the node)."""
    out: list[list] = [[] for _ in ways]

    def mass(i: int, places: int | None) -> np.ndarray:
        # way by way, so that a row's sums do not depend on its batch
        x = ways[i].logp[new_from[i]:][:places]
        return np.cumsum(x) - x + before[i]

    def draw(which: list[int], masses: list[np.ndarray], places: list[np.ndarray]):
        """(way, place, log-mass, value) of the regions at ``places``, by way."""
        owner = np.repeat(np.array(which, np.int64), [len(x) for x in places])
        place, node_mass = np.concatenate(places), np.concatenate([m[x] for m, x in zip(masses, places)])
        nodes = np.concatenate([ways[i].nodes[new_from[i]:][x] for i, x in zip(which, places)])
        chunks = np.concatenate([ways[i].chunks[new_from[i]:][x] for i, x in zip(which, places)])
        p = np.concatenate([probs[i][x] for i, x in zip(which, places)])
        several = np.flatnonzero(v["ptr"][nodes + 1] - v["ptr"][nodes] > 1)
        owner, place, node_mass, chunks = owner[several], place[several], node_mass[several], chunks[several]
        loc = node_mass + np.log(np.maximum(1 - p[several], 1e-300))
        seeded = _seeded(seeds[owner] ^ _C, sample, chunks)
        return owner, place, node_mass, _below(loc, np.array([w.value for w in ways])[owner], _uniform(seeded, place))

    def keep(owner: np.ndarray, place: np.ndarray, node_mass: np.ndarray, value: np.ndarray) -> None:
        for _ in range(k):
            if not len(owner):
                return
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            top = np.repeat(np.maximum.reduceat(value, start), np.diff(start, append=len(owner)))
            at = np.flatnonzero(value == top)
            at = at[np.diff(owner[at], prepend=-1) > 0]
            for o, g, x, m in zip(owner[at].tolist(), value[at].tolist(), place[at].tolist(), node_mass[at].tolist()):
                out[o].append((g, x + new_from[o], m))
            owner, place, node_mass, value = (np.delete(x, at) for x in (owner, place, node_mass, value))

    held = [i for i, w in enumerate(ways) if len(w.logp) > new_from[i]]
    if not held:
        return out
    # regions far down a long text cannot win: they are drawn only where the better ones are poor
    masses = [mass(i, NEAR) for i in held]
    masses = [mass(i, None) if len(m) == NEAR and m[-1] >= -46 else m for i, m in zip(held, masses)]
    places = [np.flatnonzero(m >= -45) for m in masses]
    found = draw(held, masses, places)
    good = np.bincount(found[0][found[3] >= _HIGHEST - 45], minlength=len(ways)) >= k
    poor = [i for i, x in zip(held, places) if not good[i] and len(x) < len(ways[i].logp) - new_from[i]]
    if poor:
        rest = np.flatnonzero(~np.isin(found[0], poor))
        found = tuple(x[rest] for x in found)
        masses = [mass(i, None) for i in poor]
        keep(*draw(poor, masses, [np.arange(len(m)) for m in masses]))
    keep(*found)
    return out


def sample_ways(v: dict, first: list[np.ndarray], seeds: np.ndarray, k: int) -> tuple[list[list[_Way]], list[float]]:
    """``k`` distinct ways of each text (``first``: the first node of each of its chunks) in
    falling order of perturbed value, and the best value left in each queue."""
    n, ptr, ends, probs, pieces = len(first), v["ptr"], v["arc"]["end"], v["arc"]["p"], v["arc"]["piece"]
    done: list[list[_Way]] = [[] for _ in range(n)]
    queue: list[list[tuple]] = [[] for _ in range(n)]  # (value, way, place, node mass, pieces taken)

    def log(p: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(p, 1e-300))

    def finish(texts: list[int], heads: list[tuple | None], values: list[float], sample: int) -> None:
        """Walks each text from its head (way, place, arc; None: its beginning) to the end."""
        begin = np.array([0 if h is None else h[0].chunks[h[1]] for h in heads], np.int64)
        nodes = [first[t][c:] for t, c in zip(texts, begin.tolist())]
        sizes = np.array([len(x) for x in nodes])
        start, nodes = np.cumsum(sizes) - sizes, np.concatenate(nodes)
        chunk = np.arange(len(nodes)) - np.repeat(start - begin, sizes)
        headed = [x for x, h in enumerate(heads) if h is not None]
        taken = np.array([heads[x][2] for x in headed], np.int64)
        nodes[start[headed]] = ends[taken]
        count, nodes, arcs = _walk(v, nodes, _seeded(np.repeat(seeds[texts], sizes), sample, chunk))
        cut = np.append(0, np.cumsum(count))[np.append(start, len(count))].tolist()
        chunk, logp, piece = np.repeat(chunk, count), log(arcs["p"]), arcs["piece"].copy()
        ways, new_from, before = [], [0] * len(texts), [0.0] * len(texts)
        parts = [[x[a:z] for x in (piece, logp, nodes, chunk)] for a, z in zip(cut, cut[1:])]
        p_new = [arcs["p"][a:z] for a, z in zip(cut, cut[1:])]
        for x, arc, p in zip(headed, taken, log(probs[taken])):
            way, place, _, mass = heads[x]
            new_from[x], before[x] = place + 1, mass + math.log(max(1e-300, probs[arc]))
            held = (way.pieces[:place], pieces[arc:arc + 1]), (way.logp[:place], [p]), (way.nodes[:place + 1],), (way.chunks[:place + 1],)
            parts[x] = [np.concatenate([*h, y]) for h, y in zip(held, parts[x])]
        ways = [_Way(*x, g) for x, g in zip(parts, values)]
        for t, way, found in zip(texts, ways, _regions(v, ways, p_new, new_from, before, seeds[texts], sample, k - sample)):
            done[t].append(way)
            queue[t] += [(g, way, place, mass, (int(way.pieces[place]),)) for g, place, mass in found]

    zero = np.zeros(n, np.int64)
    root = -np.log(-np.log(_uniform(_seeded(seeds ^ _B, 0, zero), zero)))
    if n:
        finish(list(range(n)), [None] * n, root.tolist(), 0)
    for sample in range(1, k):  # no more than k - sample regions of a way can be asked for from here on
        texts = [t for t in range(n) if queue[t]]
        if not texts:
            break
        tops = [queue[t].pop(max(range(len(queue[t])), key=lambda q: queue[t][q][0])) for t in texts]
        place = np.array([top[2] for top in tops])
        u1, u2 = (_uniform(_seeded(seeds[texts] ^ x, sample, place), 0) for x in (_A, _C))
        heads, over = [], []
        for x, (t, (g, way, place, mass, taken)) in enumerate(zip(texts, tops)):
            node = way.nodes[place]
            a = int(ptr[node])
            names = pieces[a:ptr[node + 1]].tolist()
            arcs = [a + i for i, y in enumerate(names) if y not in taken]
            p = probs[arcs]
            pick = arcs[min(len(arcs) - 1, int(np.searchsorted(np.cumsum(p), u1[x] * p.sum(), "right")))]
            heads.append((way, place, pick, mass))
            left = [y for y in arcs if y != pick]
            if left:  # what remains of the region, below the value that just left it
                over.append((x, mass + math.log(max(1e-300, float(probs[left].sum()))), (*taken, names[pick - a])))
        at = [x for x, _, _ in over]
        values = np.array([top[0] for top in tops])
        for (x, _, taken), g in zip(over, _below(np.array([loc for _, loc, _ in over]), values[at], u2[at]).tolist()):
            queue[texts[x]].append((g, *tops[x][1:4], taken))
        finish(texts, heads, values.tolist(), sample)
    return done, [max((q[0] for q in queue[t]), default=-math.inf) for t in range(n)]


def log_inclusion(log_prob: float, threshold: float) -> float:
    if threshold == -math.inf:
        return 0.0
    x = log_prob - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700))))


@lru_cache(maxsize=1)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


def _run(lat: Lattices, texts: list[str], keys: list[int], k: int, emit: bool) -> list[dict]:
    """Results of a run of texts."""
    if not texts:
        return []
    if lat.arc.n > ARCS:
        lat.clear()
    # the leading space is the mark that encoding puts there
    place, chunks, size = chunks_of([" " + t.replace(MARK, " ") if t else "" for t in texts], lat.vocab.fine)
    codes, cut = lat.numbers(chunks)[place], np.cumsum(size)[:-1]
    v = lat.view()
    seeds = np.array([xxhash.xxh64_intdigest(str(x).encode(), SEED) for x in keys], np.uint64)
    ways, left = sample_ways(v, np.split(v["first"][codes], cut), seeds, k)
    vocab, out = lat.vocab, []

    def ids_of(way: _Way) -> np.ndarray:
        ids = way.pieces
        if len(ids) and ids.max() >= vocab.n:  # characters that only have several bytes
            ids = np.array([y for x in ids.tolist() for y in (
                (x,) if x < vocab.n else (vocab.byte_id[b] for b in chr(x - vocab.n).encode("utf-8", "replace")))])
        return ids.astype(np.int32, copy=False)

    def told(ids: np.ndarray) -> dict:
        return {"n_ids": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<i4", copy=False)).hexdigest()} | (
            {"ids": ids} if emit else {})

    a = v["first_best"][codes]
    n = v["first_best"][codes + 1] - a
    end = np.append(0, np.cumsum(n))
    found = np.split(v["best"][np.repeat(a - end[:-1], n) + np.arange(end[-1])], end[cut])
    drawn = [[ids_of(w) for w in ws] for ws in ways]
    for text, ids, ws, ds, rest in zip(texts, found, ways, drawn, left):
        raw, decoded = text.encode("utf-8", "replace"), [vocab.decode(x) for x in (ids, *ds)]
        row = told(ids) | {"round_trip": all(x == raw for x in decoded), "decoded_sha256": hashlib.sha256(decoded[0]).hexdigest()}
        row["samples"] = [told(x) | {"log_prob": w.log_prob, "perturbed": w.value,
                                                  "log_inclusion": log_inclusion(w.log_prob, rest)} for w, x in zip(ws, ds)]
        out.append(row)
    return out


def _offsets(lists: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())


def _columns(rows: list[dict], kinds: list[tuple[str, pa.DataType]]) -> list[pa.Array]:
    """The columns of ``rows``; id lists are joined as arrays, not id by id."""
    out = []
    for name, kind in kinds:
        held = [r[name] for r in rows]
        out.append(pa.ListArray.from_arrays(_offsets(held), pa.array(np.concatenate([np.zeros(0, np.int32), *held])))
                   if pa.types.is_list(kind) else pa.array(held, kind))
    return out


def segment(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, ids: bool = True,
            key: str = "doc_id") -> DataFrame:
    """(doc_id, n_ids, ids_sha256, [ids,] round_trip, decoded_sha256, samples): the library's encoding of
    each whole text, whether it and the samples decode to the text, the digest of what it decodes to, and ``k`` sampled
    segmentations, each with its size, digest of the ids (as little-endian 32-bit integers), log-probability,
    perturbed value and log inclusion score. ``ids=False`` leaves the id lists out."""
    ship(docs.sparkSession)
    base = [("n_ids", pa.int32()), ("ids_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * ids
    sample = pa.struct([*base, ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])
    base = [*base, ("round_trip", pa.bool_()), ("decoded_sha256", pa.string())]
    kinds = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
    ddl = [(n, kinds.get(t, "array<int>")) for n, t in base]
    nested = ", ".join(f"{f.name}: {kinds.get(f.type, 'array<int>')}" for f in sample)
    schema = f"{key} long, " + ", ".join(f"{n} {t}" for n, t in ddl) + f", samples array<struct<{nested}>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what an earlier stage left in this worker
        lat = Lattices(vocabulary(path, alpha))  # gone with the task: an idle worker holds none
        for b in batches:
            texts = [t or "" for t in column(b, "text").to_pylist()]
            keys = [x or 0 for x in column(b, key).to_pylist()]
            a = 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and (z == a or size + len(texts[z]) <= RUN_CHARS):
                    size += len(texts[z])
                    z += 1
                rows = _run(lat, texts[a:z], keys[a:z], k, ids)
                cols = [column(b, key).slice(a, z - a)]
                cols += _columns(rows, base)
                drawn = [r["samples"] for r in rows]
                drawn_cols = _columns([x for s in drawn for x in s], [(f.name, f.type) for f in sample])
                cols.append(pa.ListArray.from_arrays(_offsets(drawn), pa.StructArray.from_arrays(drawn_cols, fields=list(sample))))
                yield pa.RecordBatch.from_arrays(cols, [key, *(n for n, _ in base), "samples"])
                a = z

    return docs.select(F.col(key).cast("long"), "text").mapInArrow(encode, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of each id list (null for null)."""
    ship(rows.sparkSession)
    plain = rows.drop("decoded")
    schema = T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            held = column(b, ids)
            first = held.offsets.to_numpy()
            flat, there = held.values.to_numpy(zero_copy_only=False), held.is_valid().to_pylist()
            texts = [vocab.decode(flat[i:j]).decode("utf-8", "replace") if x else None for x, i, j in zip(there, first, first[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return plain.mapInArrow(join, schema)
