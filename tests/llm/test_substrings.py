"""Substring dedup, SimHash near-dedup, benchmark decontamination."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from spendlabel.llm import decontaminate, simhash, substring_dedup
from spendlabel.llm.queries import QUERIES
from tests.oracle_harness import duck_connect

from .helpers import SMALL, WORD, edge_rows, prose, rows_of, sha, table, with_clashes
from .test_rules_lines import same_as_oracle


def brute_repeats(rows, window):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(rows, words):
        gone = {p + j for p in range(len(w) - window + 1) if seen[tuple(w[p:p + window])] > 1 for j in range(window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out, key=repr)


REPEATS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def passage_rows(window, seed):
    r = random.Random(seed)
    shared = [prose(seed + k, r.randint(window - 1, 3 * window)) for k in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += [prose(seed * 1000 + i * 10, r.randint(0, 30)), r.choice(shared)]
        words = " ".join(parts).split()
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words).replace(" ", r.choice([" ", "\n", "  ", "\t"])), "en", "s"))
    loop = " ".join(["a b c"] * 40)  # repeats inside one document
    return rows + [(90, loop, "en", "s"), (91, "x y " + loop + " z", "en", "s")]


@pytest.mark.parametrize("window, group", [(5, 5000), (9, 3), (35, 5000), (35, 2), (1, 5000), (2, 4)])
def test_repeats_same_as_brute_force(spark, window, group):
    rows = passage_rows(window, window + group) + edge_rows()
    df = substring_dedup.remove_repeats(with_clashes(table(spark, rows)), window, group)
    assert rows_of(df, *REPEATS) == brute_repeats(rows, window)


def test_repeats_in_small_runs(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "TREE_ROWS", 20)
    rows = passage_rows(8, 77)
    assert rows_of(substring_dedup.remove_repeats(table(spark, rows), 8), *REPEATS) == brute_repeats(rows, 8)


def test_repeats_same_as_sql(spark):
    same_as_oracle(spark, duck_connect(SMALL), "op3_substring_dedup", substring_dedup.ORACLE)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def brute_print(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (a ^ b).bit_count() <= bits and find(a) != find(b):
                root[find(a)] = find(b)
    return {f: find(f) for f in keys}


def test_components_same_as_brute_force(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in duck_connect(SMALL).sql("select doc_id, text, lang, source from documents").fetchall()]
    rows += [(10_000 + (r[0] or 0), *r[1:]) for r in edge_rows() if r[0] != 9] + [(None, "left alone here", "en", "s")]
    prints = [brute_print(t) for _, t, *_ in rows]
    group = brute_components(prints)
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    want = sorted(((i, format(p, "016x"), least.get(group[p])) for (i, *_), p in zip(rows, prints)), key=repr)
    got = simhash.components(with_clashes(table(spark, rows)))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == want
    kept = [r.doc_id for r in simhash.keep_one(table(spark, rows)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(least.values())
    assert kept.count(None) == 1  # only the lone row without id
    assert simhash.components(table(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_trie_join_finds_every_pair_once(spark, bits):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    fps = sorted({b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, bits + 1))}) for b in base for _ in range(12)})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= bits}
    i, j = simhash.trie_pairs(np.zeros(len(fps)), np.array(fps, np.uint64), bits)
    found = [tuple(sorted((fps[x], fps[y]))) for x, y in zip(i, j)]
    assert len(found) == len(want) and set(found) == want
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    linked = [tuple(sorted((p.a % 2**64, p.b % 2**64))) for p in simhash.links(df, bits).collect()]
    assert len(linked) == len(want) and set(linked) == want


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_large_groups_are_split_without_losing_a_link(spark, monkeypatch, bits):
    """Fingerprints that share their first 44 bits are one group for several pairs of blocks."""
    monkeypatch.setattr(simhash, "GROUP", 20)
    monkeypatch.setattr(simhash, "AT_A_TIME", 30)
    r = random.Random(bits)
    fps = sorted({(7 << 60) | r.getrandbits(9) for _ in range(220)} | {r.getrandbits(64) for _ in range(50)})
    fps = sorted({*fps, *(f ^ (1 << r.randrange(64)) for f in fps[::5])})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= bits}
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    linked = [tuple(sorted((p.a % 2**64, p.b % 2**64))) for p in simhash.links(df, bits).collect()]
    assert len(linked) == len(want) > 200 and set(linked) == want


def test_long_chains_become_one_component(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001)] + [(5000, 5000 + i) for i in range(1, 200)]
    root = {r.node: r.root for r in simhash.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {root[i] for i in range(301)} == {0} and root[1001] == 1000 and {root[5000 + i] for i in range(200)} == {5000}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], min(prev + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        at, kind = r.randrange(len(words)), r.random()
        if kind < 0.34:
            words[at] = "swapped"
        elif kind < 0.67:
            words.insert(at, "added")
        else:
            del words[at]
    return words


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(5)
    items = [(k, prose(2000 + k, r.randint(12, 60))) for k in range(60)]
    rows, want = edge_rows(), set()
    for k, text in items:
        words = text.split()
        for share in (0, 0.05, 0.1, 0.15, 0.2):
            i = 1000 + len(rows)
            leak = edited(words, int(share * len(words)), r)
            cut = re.split(" ", prose(i, 150))
            p = r.randrange(150)
            rows.append((i, " ".join(cut[:p] + leak + cut[p:]).title().replace(" ", r.choice([" ", "\n", ", "])), "en", "s"))
            want.add((i, k))
    clean = [(9000 + i, prose(7000 + i, 200), "en", "s") for i in range(40)]
    bench = spark.createDataFrame([*items, (60, None), (None, prose(2000, 30)), (61, ""), (62, "too short")], "item_id long, text string")
    docs = with_clashes(table(spark, rows + clean))
    found = {(m.doc_id, m.item_id): m for m in decontaminate.matches(docs, bench, block_items=25).collect()}
    hits = {k for k in found if k[1] is not None}
    assert len(want & hits) >= 0.98 * len(want) and not {i for i, _ in hits} & {c[0] for c in clean}
    text = {i: re.findall(r"\w+", t.lower()) for i, t, *_ in rows if t}
    for (i, k), m in found.items():  # every reported distance is exact
        if k is not None and i is not None:
            item = re.findall(r"\w+", dict(items)[k])
            assert m.distance == edit_distance(text[i][m.first_word:m.last_word + 1], item) <= int(0.2 * len(item))
    left = {x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()}
    assert {c[0] for c in clean} <= left and not left & {i for i, _ in hits}


def changed(words, n, kind, r):
    """``words`` after exactly ``n`` edits of one kind, at distance ``n``."""
    words, at = list(words), sorted(r.sample(range(len(words)), n), reverse=True)
    for j, p in enumerate(at):
        if kind == "swap":
            words[p] = f"new{j}"
        elif kind == "add":
            words.insert(p, f"new{j}")
        else:
            del words[p]
    return words


@pytest.mark.parametrize("n_words", [59, 100, 250, 1000])
def test_leaks_at_the_full_budget_are_found_at_any_length(spark, n_words):
    r = random.Random(n_words)
    items = [(k, prose(3000 + n_words + k, n_words)) for k in range(4 if n_words == 1000 else 8)]
    rows = []
    for k, text in items:
        for kind in ("swap", "add", "drop"):
            for _ in range(1 if n_words == 1000 else 3):
                i = 100 * len(rows) + k
                around = prose(50_000 + i, 300).split()
                leak = changed(text.split(), int(0.2 * n_words), kind, r)
                rows.append((i, " ".join(around[:100] + leak + around[100:]), "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows).repartition(8)
    got = {(m.doc_id, m.item_id): m.distance for m in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(i, i % 100) for i, *_ in rows}  # each leak, and nothing else
    assert all(d <= int(0.2 * n_words) for d in got.values())
    assert decontaminate.decontaminate(docs, bench).count() == 0


def test_candidates_lose_no_passage_within_the_budget():
    r = random.Random(11)
    items = [(k, prose(600 + k, n)) for k, n in enumerate([8, 9, 10, 14, 15, 25, 40, 41, 60, 90])]
    held, classes = decontaminate.build_index(items)
    table = decontaminate.WordCodes()
    for _ in range(25):
        words = prose(r.randrange(10**6), 30).split()
        for k in r.sample(range(len(items)), 3):
            words += edited(items[k][1].split(), r.randint(0, int(0.25 * len(items[k][1].split()))), r) + ["between"]
        h = decontaminate.codes(" ".join(words), table)
        want = {}
        for i, (_, item) in enumerate(held):
            d, a, b = decontaminate.best_passage(h, item)
            if d <= decontaminate.edits(len(item)):
                want[i] = d
        assert {i: d for i, d, _, _ in decontaminate.search(h, held, classes)} == want
        assert bool(decontaminate.search(h, held, classes, any_one=True)) == bool(want)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(n, " ".join(f"k{n}x{j}" for j in range(n))) for n in range(1, 8)]
    han, thai = "机器学习需要大量高质量的数据", "การเรียนรู้ของเครื่องต้องใช้ข้อมูล"
    around = prose(78, 60)
    rows = [(n, f"{around} {t} {around}", "en", "s") for n, t in items]
    rows += [(100 + n, f"{around} {t.replace('x1', 'other')} {around}", "en", "s") for n, t in items[1:]]
    rows += [(20, f"他们说，{han}和时间。", "zh", "s"), (21, f"ว่า{thai}มาก", "th", "s"), (30, "数，据", "zh", "s"),
             (31, "没有数", "zh", "s"), (40, around, "en", "s")]
    # one edit is within the budget from 5 words on
    want = {(n, n): 0 for n in range(1, 8)} | {(100 + n, n): 1 for n in (5, 6, 7)}
    want |= {(20, 20): 0, (21, 21): 0, (20, 22): 0, (30, 22): 0}
    bench = spark.createDataFrame([*items, (20, han), (21, thai), (22, "数据"), (23, "...")], "item_id long, text string")
    docs = table(spark, rows)
    assert {(m.doc_id, m.item_id): m.distance for m in decontaminate.matches(docs, bench).collect()} == want
    left = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {102, 103, 104, 31, 40}


def test_distance_is_the_least_over_all_passages():
    r = random.Random(9)
    for _ in range(60):
        h = np.array([r.randrange(4) for _ in range(r.randint(1, 14))], np.uint64)
        item = np.array([r.randrange(4) for _ in range(r.randint(1, 7))], np.uint64)
        d, a, b = decontaminate.best_passage(h, item)
        least = min(edit_distance(h[x:y], item) for x in range(len(h) + 1) for y in range(x, len(h) + 1))
        assert d == least == edit_distance(h[a:b], item)


def test_leaks_in_the_tables_and_empty_tables(spark):
    got = {(m.doc_id, m.item_id) for m in QUERIES["op4_benchmark_decontamination"](spark, SMALL).collect()}
    duck = duck_connect(SMALL)
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    docs, items = (duck.sql(f"select * from {t}").fetchall() for t in ("documents", "benchmark"))
    exact = {(d[0], i[0]) for d in docs for i in items if norm(i[1]) in norm(d[1])}
    assert exact <= got
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(table(spark, edge_rows()), bench).count() == 0
    assert decontaminate.decontaminate(table(spark, edge_rows()), bench).count() == len(edge_rows())
    assert decontaminate.matches(table(spark, []), spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["swap", "insert", "delete"])
@pytest.mark.parametrize("n", [12, 30, 60, 120, 250])
def test_tables_alone_reach_their_target(n, kind):
    """Recall of walks and tables without the exact rest, each leak at the full budget."""
    r = random.Random(n * 31 + len(kind))
    vocab = ["w%d" % i for i in range(3_000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i in range(60)]
    held, classes = decontaminate.build_index(items)
    found = 0
    for k, (_, text) in enumerate(items):
        words = text.split()
        places = r.sample(range(n), decontaminate.edits(n, decontaminate.EDIT_SHARE))
        out = []
        for i, w in enumerate(words):
            hit = i in places
            out += [w] if not hit else [r.choice(vocab)] if kind == "swap" else [r.choice(vocab), w] if kind == "insert" else []
        passage = [r.choice(vocab) for _ in range(40)] + out + [r.choice(vocab) for _ in range(40)]
        h = decontaminate.codes(" ".join(passage), decontaminate.WordCodes())
        found += k in {i for i, *_ in decontaminate.candidates(h, decontaminate.windows(h, classes))}
    assert found >= decontaminate.TARGET_RECALL * len(items), found / len(items)
