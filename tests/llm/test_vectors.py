"""Embedding whitening and near-dedup against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlabel.llm import embedding_dedup, whitening
from spendlabel.llm.queries import QUERIES

from .helpers import CHECK

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


def clashing(df):
    names = ["node", "v", "q", "m", "first", "centre", "angle", "component", "n", "e", "kept", "component_id", "n_links", "recall", "whitened"]
    return df.withColumns({c: F.lit(f"own {c}") for c in names})


def odd_rows(r, d):
    """Nulls, zeros, non-finite entries, another length, repeated ids and rows."""
    base = r.standard_normal((60, d)).tolist()
    return [(i, v) for i, v in enumerate(base)] + [
        (100, None), (101, [NAN] + [1.0] * (d - 1)), (102, [INF] * d), (103, [None] + [1.0] * (d - 1)), (104, []), (105, [0.0] * d),
        (None, base[0]), (3, base[3]), (3, base[3]), (106, base[5][:-1]), (None, None)]


# -- whitening -----------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_spectrum_slicing_finds_the_leading_pairs(n):
    r = np.random.default_rng(n)
    a = r.standard_normal((3 * n, n))
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    ties = np.repeat([3.0, 1.0], [min(2, n), n - min(2, n)])
    for v in (a.T @ a, np.eye(n) + 1e-7 * (a.T @ a), (q * ties) @ q.T, np.diag(np.arange(n) - n / 2.0), np.ones((n, n))):
        v = (v + v.T) / 2
        value, vector = whitening.leading(v, 8)
        want = np.linalg.eigvalsh(v)[::-1][:8]
        assert np.abs(value - want).max() <= 1e-12 * max(1, np.abs(want).max())
        assert np.abs(v @ vector.T - vector.T * value).max() <= 1e-10 * max(1, np.abs(v).max())
        assert np.abs(vector @ vector.T - np.eye(len(value))).max() <= 1e-12
        for s in (*want, *(want + 0.1)):
            assert whitening.count_above(v, float(s) + 1e-6) == (np.linalg.eigvalsh(v) > s + 1e-6).sum()


def plain(x):
    n, total = len(x), x.sum(0)
    c = x - total / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    return value[::-1], vector[:, ::-1], c, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x]


def compare(got, ids, x, k=8):
    value, vector, c, deviation = plain(x)
    assert len(got) == len(x) * min(k, x.shape[1]) and {r.n for r in got} == {len(x)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    for j in range(min(k, x.shape[1])):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened, r.explained) for r in got if r.component == j + 1)
        z = c @ vector[:, j] / np.sqrt(value[j])
        for sign in (1, -1):
            want = sorted((i is None, i or 0, d, sign * w) for i, d, w in zip(ids, deviation, z))
            if max(abs(a[3] - b[3]) for a, b in zip(mine, want)) < 1e-8:
                break
        else:
            raise AssertionError(f"component {j + 1}")
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert all(abs(m[4] - value[j] / value.sum()) <= 1e-10 for m in mine)


def test_whitening_of_the_table(spark):
    e = spark.read.parquet(f"{CHECK}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in e], float)).astype(int) + 100_000
    compare(QUERIES["op11_embedding_whitening"](spark, CHECK).collect(), [r.vec_id for r in e], x)


def test_whitening_edge_rows(spark):
    rows = odd_rows(np.random.default_rng(3), 12)
    kept = [(i, v) for i, v in rows if v and len(v) == 12 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(float)).astype(int) + 100_000
    compare(whitening.whiten(clashing(vectors(spark, rows))).collect(), [i for i, _ in kept], x)


def test_whitening_of_few_dimensions_equal_rows_and_nothing(spark):
    small = vectors(spark, [(i, [float(i), float(i * i % 7), 1.0]) for i in range(30)])
    got = whitening.whiten(small).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9  # the third has no variance
    same = vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert whitening.whiten(same).count() == whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).columns[:2] == ["vec_id", "component"]


def test_deviations_beyond_a_long_are_null(spark):
    far = vectors(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 0.5])])
    got = {r.vec_id: r.deviation for r in whitening.whiten(far).collect()}
    x = np.clip(np.floor(1024 * np.array([[1e9, 0], [-1e9, 1], [0, .5]], np.float32).astype(float)), -2**40, 2**40).astype(int) + 100_000
    want = {i + 1: d if d < 1 << 63 else None for i, d in enumerate(plain(x)[3])}
    assert got == want and None in want.values()


# -- near-dedup ----------------------------------------------------------------------------

def brute(rows, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    d = max((len(v) for (_, v), o in zip(rows, ok) if o), default=1)
    u = np.array([np.pad(np.array(v, np.float32).astype(float), (0, d - len(v))) if o else np.zeros(d) for (_, v), o in zip(rows, ok)])
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], int(link[j].sum()), least, rows[j][0] == least)
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_near_dedup_edge_rows_and_ties(spark):
    r = np.random.default_rng(9)
    rows = odd_rows(r, 16)
    for i in range(30):  # chains and loose pairs around the threshold
        v = r.standard_normal(16)
        for k in range(4):
            rows.append((1_000 + 10 * i + k, (v + r.standard_normal(16) * (0.1 + 0.08 * k)).tolist()))
    rows += [(5_000, [2.0 * c for c in rows[0][1]]), (5_001, [-c for c in rows[0][1]])]
    assert found(embedding_dedup.near_duplicates(clashing(vectors(spark, rows)))) == brute(rows)


def test_near_dedup_of_large_groups(spark, monkeypatch):
    """A third of the rows around one vector, tight; others wide, so that balls meet in part."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    r = np.random.default_rng(4)
    rows, at = [], 0
    for size, spread in ((250, 0.03), (120, 0.09), (120, 0.14)):
        v = r.standard_normal(24)
        v /= np.linalg.norm(v)
        for _ in range(size):
            rows.append((at, (v + r.standard_normal(24) * spread).tolist()))
            at += 1
    rows += [(at + i, v) for i, v in enumerate(r.standard_normal((260, 24)).tolist())]
    got, want = found(embedding_dedup.near_duplicates(vectors(spark, rows))), brute(rows)
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want) > 0
    assert [g[2:] for g in got] == [w[2:] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))


def test_near_dedup_of_nothing(spark):
    empty = vectors(spark, [(1, [1.0, 0.0])]).limit(0)
    assert embedding_dedup.near_duplicates(empty).collect() == []
    lone = found(embedding_dedup.near_duplicates(vectors(spark, [(4, [0.0, 0.0]), (5, None)])))
    assert lone == [(4, 0, 4, True), (5, 0, 5, True)]
    assert found(embedding_dedup.near_duplicates(vectors(spark, [(4, [1.0, 0.0])]))) == [(4, 0, 4, True)]


def test_near_dedup_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{CHECK}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_near_dedup"](spark, CHECK)
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"] and found(got) == brute(rows)
