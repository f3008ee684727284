"""Work of steps and scores over many classes."""

import numpy as np
from pyspark.sql import functions as F

from spendlabel.operators import model as MD


def test_row_sums_are_computed_once_a_row(spark):
    rows = np.random.default_rng(1).normal(0, 3, (20, 300))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, m array<double>")
    out = df.select("i", MD.ovr_probabilities(F.col("m"), 300).alias("p"), MD.softmax(F.col("m")).alias("s"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 and plan.count("array_max(") == 1
    got = out.orderBy("i").collect()
    s, e = 1 / (1 + np.exp(-rows)), np.exp(rows - rows.max(1, keepdims=True))
    assert np.allclose([r["p"] for r in got], s / s.sum(1, keepdims=True), rtol=1e-12)
    assert np.allclose([r["s"] for r in got], e / e.sum(1, keepdims=True), rtol=1e-12)


def test_chunks_are_bounded_by_their_distinct_buckets(spark):
    same = [(list(range(100)), [1.0] * 100)] * 1000  # 100,000 cells, 100 buckets
    df = spark.createDataFrame(same, "b array<int>, x array<double>").coalesce(1)
    assert MD._chunked(df).select("chunk").distinct().count() == 1
    other = [(list(range(i * 4000, i * 4000 + 4000)), [1.0] * 4000) for i in range(20)]
    df = spark.createDataFrame(other, "b array<int>, x array<double>").coalesce(1)
    n = MD._chunked(df).groupBy("chunk").agg(F.countDistinct(F.element_at("b", 1)).alias("n")).collect()
    assert len(n) > 1 and sum(r["n"] for r in n) == 20 and max(r["n"] for r in n) * 4000 <= MD.CHUNK_BUCKETS


def test_a_step_over_many_classes_is_the_same_by_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(f"r{i}", f"word{i % 7} {'big ' * (i % 3)}x{i}", f"c{i % 150:03d}", 1 + i % 2) for i in range(400)],
                                 "row_id string, text string, category string, weight long")
    classes = MD.register_classes(docs)

    taken, gradient = [], MD._gradient_join
    monkeypatch.setattr(MD, "_gradient_join", lambda *a: taken.append(1) or gradient(*a))

    def weights(limit):
        monkeypatch.setattr(MD, "MAP_CLASSES", limit)
        return MD.fit(docs, MD.empty_model(spark, classes, 10), 2)

    a, b = weights(256), weights(0)
    assert len(taken) == 2
    assert np.allclose(a.intercept, b.intercept, atol=1e-9)
    both = a.long_weights().alias("a").join(b.long_weights().alias("b"), ["bucket", "class_id"], "full_outer")
    worst = both.agg(F.max(F.abs(F.col("a.w") - F.col("b.w"))).alias("d"), F.count_if(F.col("a.w").isNull() | F.col("b.w").isNull()).alias("n")).first()
    assert worst["n"] == 0 and worst["d"] < 1e-9


def _rows(spark, n=200, classes=70, skip=0):
    """Rows of many classes; one has no tokens, one more cells than a piece of rows."""
    rows = [(f"r{i}", f"word{i % 7} {'big ' * (i % 3)}x{i} w{i * 31 % 50}", f"c{i % classes:03d}", 1 + i % 2) for i in range(skip, n + skip)]
    rows += [(f"none{skip}", "", "c001", 1), (f"long{skip}", " ".join(f"long{i}" for i in range(300)), "c002", 2)]
    return spark.createDataFrame(rows, "row_id string, text string, category string, weight long")


def _same(a, b):
    assert a.n_observed == b.n_observed and np.allclose(a.intercept, b.intercept, atol=1e-12) and np.allclose(a.intercept_g2, b.intercept_g2, atol=1e-12)
    x, y = ({(r[0], r[1]): np.array([r[2], r[3]]) for r in m.weights.select("bucket", "block", "w", "g2").collect()} for m in (a, b))
    assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], rtol=1e-9, atol=1e-11) for k in x)


def test_tiles_give_the_weights_of_the_broadcast_step(spark, monkeypatch):
    """a task adds up its classes over all rows and updates them there, so no gradient moves; rows in parts
    and pieces of one row, too. The second fit brings buckets that the first has not seen, and leaves some out."""
    monkeypatch.setattr(MD, "CLASS_BLOCK", 8)
    monkeypatch.setattr(MD, "PACK_CELLS", 100)
    monkeypatch.setattr(MD, "PACK_BUCKETS", 7)
    first, more = _rows(spark), _rows(spark, 40, skip=500)
    classes = MD.register_classes(first)
    monkeypatch.setattr(MD, "MAP_CLASSES", 256)
    want = MD.fit(more, MD.fit(first, MD.empty_model(spark, classes, 10), 2), 1)
    monkeypatch.setattr(MD, "MAP_CLASSES", 0)
    for parts, cells in ((0, 100), (3, 4)):
        monkeypatch.setattr(MD, "PIECE_CELLS", cells)
        monkeypatch.setattr(MD, "_tiling", lambda *a, n=parts: (5, 2, n) if n else (2, 5, 1))
        got = MD.fit(more, MD.fit(first, MD.empty_model(spark, classes, 10), 2), 1)
        assert got.packed is not None
        _same(want, got)


def test_a_tile_is_bounded_and_every_task_has_one():
    m = MD.Model(classes=[str(i) for i in range(6000)], weights=None, intercept=[], intercept_g2=[])
    for buckets in (0, 100, 10_000, 1 << 20):
        size, runs, parts = MD._tiling(m, buckets, 10**6, 8)
        assert size * runs >= m.blocks > size * (runs - 1) and runs * parts >= 8
        assert size == 1 or size * 32 * buckets <= MD.TILE_DOUBLES
    assert MD._tiling(m, 10, 10**9, 8)[1:] == (1, 8)  # many cells: parts of the rows, not more runs


def test_scores_of_many_classes_do_not_move(spark, monkeypatch):
    """a row's margins and probabilities are computed in one task; by chunks of rows and classes where the weights
    are too many for a task. Columns stay as they are, null cells too."""
    rows = _rows(spark)
    m = MD.fit(rows, MD.empty_model(spark, MD.register_classes(rows), 10), 2)
    df = rows.selectExpr("row_id AS a", "text", "IF(category = 'c003', NULL, category) AS b")
    want = {r[0]: r for r in MD.score_ovr(df, m).collect()}
    joined = MD.replace(m, broadcast_bytes=0)
    for limit in (MD.SCORE_DOUBLES, 0):
        monkeypatch.setattr(MD, "SCORE_DOUBLES", limit)
        for keep in (True, False):
            out = MD.score_ovr(df, joined, keep_text=keep)
            assert out.columns == ["a", *["text"] * keep, "b", "m", "prob", "predicted"]
            if limit:
                plan = out._jdf.queryExecution().optimizedPlan().toString()
                assert "Join" not in plan and "collect_list" not in plan
            got = out.collect()
            assert len(got) == len(want) == 202
            for r in got:
                w = want[r["a"]]
                assert r["b"] == w["b"] and r["predicted"] == w["predicted"] and (not keep or r["text"] == w["text"])
                assert np.allclose(r["m"], w["m"], atol=1e-9) and np.allclose(r["prob"], w["prob"], atol=1e-9)


def test_steps_over_few_classes_merge_sums_by_ranges_of_buckets(spark, monkeypatch):
    """a step over many rows has few tasks, whose sums meet the weights as packs; class by class, in dense
    pieces, in packs of rows and not, with little room for new buckets: the same weights as plain sums."""
    rows = _rows(spark, classes=5).repartition(60)
    classes = MD.register_classes(rows)
    cells = [r.asDict() for r in MD.sparse_rows(rows, "text", 9).collect()]
    x, y, weight = np.zeros((len(cells), 512)), np.zeros((len(cells), 5)), np.array([r["weight"] for r in cells], float)
    for i, r in enumerate(cells):
        x[i, r["b"]], y[i, classes.index(r["category"])] = r["x"], 1
    w, q, b, p = np.zeros((512, 5)), np.zeros((512, 5)), np.zeros(5), np.zeros(5)
    for _ in range(3):
        res = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight[:, None]
        g, gb = x.T @ res / weight.sum() + MD.ALPHA * w, res.sum(0) / weight.sum()
        q, p = q + g * g, p + gb * gb
        w, b = w - MD.ETA * g / np.sqrt(q + MD.EPS), b - MD.ETA * gb / np.sqrt(p + MD.EPS)
    seen = np.flatnonzero(x.any(0))
    for flat, steps, room in ((8, (3,), 1 << 22), (0, (1, 2), 100)):
        monkeypatch.setattr(MD, "FLAT_CLASSES", flat)
        monkeypatch.setattr(MD, "_AT_A_TIME", room)
        m = MD.empty_model(spark, classes, 9)
        for n in steps:
            m = MD.fit(rows, m, n)
        got = {r["bucket"]: r["w"] for r in m.weights.collect()}
        assert m.packed is not None and m.n_observed == len(got) and set(got) == set(seen.tolist())
        assert np.allclose([got[k] for k in seen.tolist()], w[seen], atol=1e-9) and np.allclose(m.intercept, b, atol=1e-9)
