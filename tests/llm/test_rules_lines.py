"""Quality rules and line dedup."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from spendlabel.llm import line_dedup, quality_rules
from spendlabel.llm.queries import QUERIES
from tests.oracle_harness import duck_connect

from .helpers import SMALL, WORD, edge_rows, prose, rows_of, sha, table, with_clashes

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def same_as_oracle(spark, duck, name, sql):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    want = sorted((tuple(r) for r in duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall()), key=repr)
    assert rows_of(df, *cols) == want


@pytest.mark.parametrize("name, sql", [("op1_quality_rules", quality_rules.ORACLE), ("op2_line_dedup", line_dedup.ORACLE)])
def test_same_as_sql(spark, name, sql):
    same_as_oracle(spark, duck_connect(SMALL), name, sql)


def base_of(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (doc_id, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_base_figures_on_edge_rows(spark):
    rows = edge_rows() + [(20, "a b c a b c " * 30, "en", "s"), (21, "a a a a", "en", "s"), (22, "#*$%&|<> x#", "en", "s")]
    got = rows_of(quality_rules.quality_rules(with_clashes(table(spark, rows))), *BASE)
    assert got == sorted((base_of(i, t) for i, t, *_ in rows), key=repr)


def test_frequent_lines_deplete(spark):
    line = prose(3, 40)
    shared = [(i, f"{line}\n{prose(100 + i, 25)}", "en", "hot") for i in range(30)]  # 40 of 65 words go
    clean = [(100 + i, prose(500 + i, 80) + "\n" + prose(900 + i, 20), "en", "cold") for i in range(30)]
    mirror = [(200 + i, prose(7, 90), "en", "hot") for i in range(40)]  # exact copies are one document
    few = [(300 + i, f"{line.upper()}\n{prose(300 + i, 25)}", "en", "cold") for i in range(5)]  # under the limit there
    out = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, shared + clean + mirror + few)).collect()}
    assert {i for i, r in out.items() if not r.kept} == set(range(30))
    assert all(out[i].n_removed_words == 40 and out[i].n_removed_lines == 1 for i in range(30))
    assert all(out[i].n_removed_words == 0 for i in out if i >= 100)


def test_rules_on_an_empty_table(spark):
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(x):
        x = x.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    held = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def line_rows():
    common = [prose(50 + k, 9) for k in range(6)]
    rows = edge_rows()
    for i in range(40):
        lines = [prose(1000 + i, 12), *(c for k, c in enumerate(common) if i % (k + 1) == 0), common[0].upper() + " \t", "", "Ä" * 39]
        rows.append((100 + i, "\n".join(lines), "en", "s"))
    return rows


COLS = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_lines_on_edge_rows(spark):
    rows = line_rows()
    df = line_dedup.dedup_lines(with_clashes(table(spark, rows)))
    assert rows_of(df, *COLS) == brute_lines(rows)
    assert df.where("host = 'own host' and lost_id = 'own lost_id' and `dotted.name` = 'own dotted.name'"
                    " and nested.`a b.c` = 1").count() == len(rows)  # other columns pass through
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_a_shard_is_shared_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TASK_REFS", 10)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    rows = line_rows()
    assert rows_of(line_dedup.dedup_lines(table(spark, rows)), *COLS) == brute_lines(rows)


def test_state_is_reversible(spark):
    rows = line_rows()
    one, two = [r for r in rows if (r[0] or 0) % 3], [r for r in rows if not (r[0] or 0) % 3]
    first = line_dedup.build_state(table(spark, one))
    both = line_dedup.insert_documents(first, table(spark, two))
    docs = table(spark, rows)
    assert rows_of(line_dedup.dedup_lines(docs, state=both), *COLS) == brute_lines(rows)
    again = line_dedup.insert_documents(both, table(spark, two))  # a second time changes nothing
    back = line_dedup.delete_documents(again, table(spark, two).where("doc_id is not null"))
    key = ("k1", "k2", "n_docs", "keeper")
    assert rows_of(back.counts, *key) == rows_of(first.counts, *key)
    assert rows_of(back.refs, "k1", "k2", "doc_id") == rows_of(first.refs, "k1", "k2", "doc_id")
    assert rows_of(line_dedup.dedup_lines(table(spark, one), state=back), *COLS) == brute_lines(one)
    held = {r.shard: line_dedup.CuckooFilter.from_bytes(r.blob) for r in back.filters.collect()}
    for r in back.counts.collect():
        assert held[r.shard].contains(np.array([r.k2]))[0]


def test_a_changed_document_replaces_its_keys(spark):
    rows = line_rows()
    docs = table(spark, rows)
    state = line_dedup.build_state(docs)
    new = [(i, "\n".join([prose(7000 + i, 12), prose(51, 9)]), "en", "s") for i, *_ in rows[-30:]]
    now = [r for r in rows if r[0] not in {x[0] for x in new}] + new
    state = line_dedup.insert_documents(state, table(spark, new))
    fresh = line_dedup.build_state(table(spark, now))
    assert rows_of(state.refs, "k1", "k2", "doc_id") == rows_of(fresh.refs, "k1", "k2", "doc_id")
    assert rows_of(state.counts, "k1", "k2", "n_docs", "keeper") == rows_of(fresh.counts, "k1", "k2", "n_docs", "keeper")
    assert rows_of(line_dedup.dedup_lines(table(spark, now), state=state), *COLS) == brute_lines(now)
    held = {r.shard: line_dedup.CuckooFilter.from_bytes(r.blob) for r in state.filters.collect()}
    assert all(held[r.shard].contains(np.array([r.k2]))[0] for r in state.counts.collect())


def test_a_change_writes_its_own_references_only(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LOG", 3)
    rows = line_rows()
    states = [line_dedup.build_state(table(spark, rows[:-4]))]
    for r in rows[-4:]:
        states.append(line_dedup.insert_documents(states[-1], table(spark, [r])))
    assert [len(s.log) for s in states] == [1, 2, 3, 1, 2]  # beyond three changes: one folder
    assert states[2].log[:2] == states[1].log and states[1].log[:1] == states[0].log
    assert {r.doc_id for r in spark.read.parquet(states[1].log[1].added).collect()} == {rows[-4][0]}
    fresh = line_dedup.build_state(table(spark, rows))
    assert rows_of(states[-1].refs, "k1", "k2", "doc_id") == rows_of(fresh.refs, "k1", "k2", "doc_id")
    first = line_dedup.build_state(table(spark, rows[:-4]))  # an older state still says what it said
    assert rows_of(states[0].refs, "k1", "k2", "doc_id") == rows_of(first.refs, "k1", "k2", "doc_id")
    gone = line_dedup.delete_documents(states[0], table(spark, rows).where("doc_id is not null"))
    assert gone.refs.count() == gone.counts.count() == 0


def test_a_state_begun_small_gets_more_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows = line_rows()
    state = line_dedup.build_state(table(spark, []))
    assert state.shards == 1
    both = line_dedup.insert_documents(state, table(spark, rows))
    whole = line_dedup.build_state(table(spark, rows))
    assert both.shards == whole.shards > 1
    key = ("shard", "k1", "k2", "n_docs", "keeper")
    assert rows_of(both.counts, *key) == rows_of(whole.counts, *key)
    assert rows_of(line_dedup.dedup_lines(table(spark, rows), state=both), *COLS) == brute_lines(rows)
    gone = line_dedup.delete_documents(both, table(spark, rows[::2]).where("doc_id is not null"))
    held = {r.shard: line_dedup.CuckooFilter.from_bytes(r.blob) for r in gone.filters.collect()}
    assert all(held[r.shard].contains(np.array([r.k2]))[0] for r in gone.counts.collect())


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 3000)
    f = line_dedup.CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(keys + 1).mean() < 0.01
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01
    small = line_dedup.CuckooFilter(8)
    assert not small.insert(keys[:200])
