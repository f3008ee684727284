"""Token counts, SentencePiece encoding, decoding and sampling."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from spendlabel.llm import queries, segmentation, token_counts
from spendlabel.llm.queries import QUERIES
from tests.oracle_harness import duck_connect

from .helpers import SMALL, edge_rows, rows_of, table, tokenizer, with_clashes

ODD = ["a", "B", "'s", "'T", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "é", "́", "9", "<|endoftext|>", "<|startoftext|>",
       "<s>", "!", "|", "İ", "ﬁ", "‍", "😀", "한", "Σ", "\x00", "²", "½", "the", "ing"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 16))) for _ in range(n)]


def test_counts_same_as_the_library(spark):
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = edge_rows() + [(100 + i, t, "en", "s") for i, t in enumerate(odd_texts(500, 3))]
    want = sorted(((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for i, t, *_ in rows), key=repr)
    df = token_counts.token_counts(with_clashes(table(spark, rows)), tokenizer("word_bpe_49k.json"))
    assert rows_of(df, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    docs = duck_connect(SMALL).sql("select doc_id, text from documents").fetchall()
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, SMALL).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in docs}
    assert token_counts.token_counts(table(spark, []), tokenizer("word_bpe_49k.json")).count() == 0


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_ROWS", 3)
    t = token_counts.PieceTable(tokenizer("word_bpe_49k.json"))
    assert [t[w] for w in "a bb ccc dddd eeeee a bb".split()] == [t[w] for w in "a bb ccc dddd eeeee a bb".split()]
    assert len(t) <= 3


PIECES = tokenizer("piece_bpe_32k.model")


def test_encoding_and_round_trip(spark):
    rows = edge_rows() + [(100 + i, t, "en", "s") for i, t in enumerate(odd_texts(400, 5))]
    docs = with_clashes(table(spark, rows)).drop("ids", "samples", "key")
    out = segmentation.segment(docs, PIECES, k=3)
    sp = segmentation.vocabulary(PIECES).sp
    got = out.collect()
    want = sorted(((i, sp.encode(t or "")) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want
    by_id = {i: t or "" for i, t, *_ in rows if i is not None}
    for r in got:
        assert r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) >= 1
        assert all(a.perturbed >= b.perturbed for a, b in zip(r.samples, r.samples[1:]))
        if r.doc_id is not None:
            assert all(sp.decode(s.ids) == by_id[r.doc_id] for s in r.samples)
    back = segmentation.decode(out.select("doc_id", "ids"), PIECES)
    assert rows_of(back, "doc_id", "decoded") == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert segmentation.segment(table(spark, []), PIECES).count() == 0


def all_segmentations(text):
    vocab = segmentation.vocabulary(PIECES)
    text, out = "▁" + text.replace(" ", "▁"), {}

    def go(i, ids, w):
        if i == len(text):
            out[ids] = math.exp(w)
        for j in range(i + 1, len(text) + 1):
            if (p := vocab.ids.get(text[i:j])) is not None:
                go(j, (*ids, p), w + float(vocab.weight[p]))
    go(0, (), 0.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_samples_follow_the_lattice_without_replacement():
    exact, n = all_segmentations("then it"), 8000
    lat = segmentation.Lattices(segmentation.vocabulary(PIECES))
    runs = segmentation._run(lat, ["then it"] * n, list(range(n)), 2, True)
    first = Counter(tuple(r["samples"][0]["ids"].tolist()) for r in runs)
    either = Counter(tuple(s["ids"].tolist()) for r in runs for s in r["samples"])
    weighted = Counter()
    for r in runs:
        for s in r["samples"]:
            ids = tuple(s["ids"].tolist())
            assert abs(math.exp(s["log_prob"]) - exact[ids]) < 1e-12
            weighted[ids] += math.exp(s["log_prob"] - s["log_inclusion"]) / n
    for ids, p in exact.items():
        tol = 4 * math.sqrt(p * (1 - p) / n) + 2e-3
        included = p + sum(q * p / (1 - q) for k, q in exact.items() if k != ids)
        assert abs(first[ids] / n - p) < tol
        assert abs(either[ids] / n - included) < 4 * math.sqrt(included * (1 - included) / n) + 2e-3
        assert abs(weighted[ids] - p) < 4 * tol  # the inclusion scores weigh the samples back


def test_round_trip_decodes_the_ids_and_every_sample(monkeypatch):
    vocab = segmentation.Vocabulary(PIECES, segmentation.ALPHA)
    texts = ["then it was said", "", "two  spaces\nand 東京 \u0000", "a word \u2581 mark"]
    run = lambda: [r["round_trip"] for r in segmentation._run(
        segmentation.Lattices(vocab), texts, [1, 2, 3, 4], 2, False)]
    assert run() == [True, True, True, False]
    right, asked = vocab.decode, []

    def wrong_for(n):
        def decode(ids):
            asked.append(len(ids))
            return right(ids) + b"?" * (len(asked) == n)
        return decode

    for n in (1, 2, 3):  # the ids, the first and the second sample of the first text
        asked.clear()
        monkeypatch.setattr(vocab, "decode", wrong_for(n))
        assert run() == [False, True, True, False]


def test_few_segmentations_are_all_returned():
    lat = segmentation.Lattices(segmentation.vocabulary(PIECES))
    exact = all_segmentations("is")
    row = segmentation._run(lat, ["is"], [1], 50, True)[0]
    assert {tuple(s["ids"].tolist()) for s in row["samples"]} == set(exact)
    assert all(s["log_inclusion"] == 0 for s in row["samples"])
    empty = segmentation._run(lat, [""], [1], 3, True)[0]
    assert empty["n_ids"] == 0 and len(empty["samples"]) == 1 and empty["samples"][0]["log_prob"] == 0


def test_a_row_gets_the_same_samples_in_any_batch(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cols = ("doc_id", "ids_sha256", "samples")
    one = segmentation.segment(docs.repartition(7), PIECES, ids=False)
    two = segmentation.segment(docs.coalesce(1), PIECES, ids=False)
    assert rows_of(one, *cols) == rows_of(two, *cols)


def test_the_query_returns_ids_and_decodes_them(spark, tmp_path):
    texts = [*odd_texts(60, 9), "", None, "two\n lines  ", "one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sp = segmentation.vocabulary(PIECES).sp
    got = {r.doc_id: r for r in queries.op6_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i].ids) == sp.encode(t or "") and got[i].n_ids == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert all(sp.decode(s.ids) == (t or "") for s in got[i].samples)


def test_decoding_slices_and_nulls(spark):
    sp = segmentation.vocabulary(PIECES).sp
    rows = [(0, None), (1, sp.encode("a b")), (2, []), (3, None), (4, sp.encode("then it é"))]
    df = spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1)
    back = {r.k: r.decoded for r in segmentation.decode(df, PIECES).where("k > 0").collect()}
    assert back == {1: "a b", 2: "", 3: None, 4: "then it é"}


def test_chunks_of_a_run_are_those_of_each_text():
    letter = "A-Za-zÀ-ÖØ-öø-ɏ"
    cuts = {True: f" +(?:[{letter}]+|[^ \n{letter}]+)?|[{letter}]+|[^ \n{letter}]+|\n", False: " +[^ \n]*|[^ \n]+|\n"}
    texts = ["", " a  b\n c", "é×÷ɏɐz", " ab12, c\n \n", "", "日本 語x😀 y", "\n", "  ", "aÀb\tÖ×ö", "x"]
    for fine, cut in cuts.items():
        want = [re.findall(cut, t) for t in texts]
        place, chunks, size = segmentation.chunks_of(texts, fine)
        assert size.tolist() == [len(x) for x in want] and len(set(chunks)) == len(chunks)
        assert [chunks[i] for i in place] == [c for x in want for c in x]
    assert [len(x) for x in segmentation.chunks_of([], True)] == [0, 0, 0]


def test_draws_of_a_run_are_made_together(monkeypatch):
    vocab, right, calls = segmentation.vocabulary(PIECES), segmentation._uniform, []
    monkeypatch.setattr(segmentation, "_uniform", lambda *a: calls.append(1) or right(*a))

    def calls_for(n):
        calls.clear()
        segmentation._run(segmentation.Lattices(vocab), ["then it was said"] * n, list(range(n)), 3, False)
        return len(calls)

    assert calls_for(400) <= calls_for(40) + 20  # not some for every text


def test_regions_do_not_depend_on_how_far_they_are_looked_for(monkeypatch):
    texts = [*odd_texts(60, 21), "then it was said, and is of the " * 40, "is", ""]

    def run():
        rows = segmentation._run(segmentation.Lattices(segmentation.vocabulary(PIECES)), texts, list(range(len(texts))), 4, True)
        return [[(x["ids"].tolist(), x["log_prob"], x["perturbed"], x["log_inclusion"]) for x in r["samples"]] for r in rows]

    want = run()
    for near, poor in ((1, -math.inf), (7, -math.inf), (10**6, -math.inf), (7, math.inf)):  # inf: every region is drawn
        monkeypatch.setattr(segmentation, "NEAR", near)
        if poor > 0:
            monkeypatch.setattr(segmentation, "_HIGHEST", poor)
        assert run() == want


def test_the_trie_knows_common_and_rare_characters():
    vocab = segmentation.vocabulary(PIECES)
    char = vocab.edge & 0x1FFFFF
    kind = vocab.kind(char)
    assert (kind == 0).any() and (kind > 0).any()
    assert (vocab.step(vocab.edge >> 21, char, kind) == vocab.to).all()
    none = np.array([ord("e"), 0x1F600, 0x10FFFF, 0x2FFF])
    leaf = np.full(4, int(np.setdiff1d(np.arange(len(vocab.ends)), vocab.edge >> 21)[0]))
    assert (vocab.step(leaf, none, vocab.kind(none)) == -1).all()


def test_chunks_get_the_same_numbers_again():
    lat = segmentation.Lattices(segmentation.vocabulary(PIECES))
    assert lat.numbers([" a", "b", "\n"]).tolist() == [0, 1, 2]
    size = lat.arc.n
    assert lat.numbers(["b", " a"]).tolist() == [1, 0] and lat.arc.n == size
    assert lat.numbers(["c", "b", " d"]).tolist() == [3, 1, 4] and len(lat.first.view()) == 5
    assert lat.numbers([]).tolist() == []
