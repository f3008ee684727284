"""Cross-tokenizer alignment against a plain whole-text version."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from spendlabel.llm import alignment
from spendlabel.llm.queries import QUERIES

from .helpers import SMALL, edge_rows, prose, rows_of, table, tokenizer, with_clashes

COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def paths():
    return tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def brute(texts, paths):
    """Token by token, byte by byte, from the libraries' whole-text ids."""
    a_lib, b_lib = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a_lib.encode_special_tokens = True
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    rows, docs_of = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in b_lib.encode(text or ""):
            p = b_lib.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("\u2581", " ").encode()))
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            rows.append(None)
            continue

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out
        a, b = spans(a), spans(b)
        links, j = Counter(), 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links[i, b[k][0]] += 1
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, i, j = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while i < len(a) and a[i][2] <= end:
                ga.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= end:
                gb.append(str(b[j][0]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        rows.append((len(a), len(b), len(ends), links, ";".join(groups)))
        docs_of.update(links.keys())
    best = defaultdict(int)
    for (i, _), n in docs_of.items():
        best[i] = max(best[i], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = r[3]
        out.append((*r[:3], links.total(), sum(n for p, n in links.items() if docs_of[p] == best[p[0]]),
                    sum(n * docs_of[p] for p, n in links.items()), hashlib.sha256(r[4].encode()).hexdigest()))
    return out


ODD = ["h\u00e9llo  \u65e5\u672c \u2603\U0001034dx\n a", "a\u2581b", "   ", " x", "x ", "two  spaces  ", "<|endoftext|> <s></s><0x41> </s>",
       "\u00e9" * 30, "\u0000a", "a\r\n\tb", "don't we'll I'm", "e\u0301 \u00a0x\u3000y", "\ufb01 \u2126 \uff21", "\U0001f468\u200d\U0001f469 ok", "a \u2581 b"]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 50, 0])
def test_alignment_equals_brute_force(spark, paths, frequent):
    """Odd texts, edge rows, clashing columns; pairs broadcast, in part, or all joined."""
    rows = [*edge_rows(), *((100 + i, t, "en", "s") for i, t in enumerate(ODD)), *((200 + i, prose(i, 80), "en", "s") for i in range(12))]
    want = [(i, *x) for (i, *_), x in zip(rows, brute([t for _, t, *_ in rows], paths))]
    got = alignment.align(with_clashes(table(spark, rows)), *paths, frequent=frequent)
    assert rows_of(got, *COLS) == sorted(want, key=repr)


def test_small_tables_and_parts(spark, paths, monkeypatch):
    """Long texts in parts, and a table of chunks that starts anew, change nothing."""
    text = " ".join([prose(3, 4_000), "\u00fcber  \u65e5\u672c\n", prose(4, 2_000)])
    want = list(alignment.Aligner(*paths).documents([text]))[0]
    monkeypatch.setattr(alignment, "PART", 1_000)
    monkeypatch.setattr(alignment, "BATCH", 10)
    monkeypatch.setattr(alignment, "CHUNKS", 50)
    got = list(alignment.Aligner(*paths).documents([text]))[0]
    assert got[:5] == want[:5] and (got[5] == want[5]).all() and (got[6] == want[6]).all()
    assert alignment.align(table(spark, [(1, "x", "en", "s")]).limit(0), *paths).collect() == []


def test_query_equals_brute_force(spark, paths):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = QUERIES["op12_tokenizer_alignment"](spark, SMALL)
    want = [(d.doc_id, *x) for d, x in zip(docs, brute([d.text for d in docs], paths))]
    assert rows_of(got, *COLS) == sorted(want, key=repr)
