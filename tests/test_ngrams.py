"""N-grams counted in the tasks, keys that occur again, checks and micro-batches read once."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendlabel.functions.text import bucket_of, ngram_array, trim_ws
from spendlabel.operators import clean as C
from spendlabel.operators import features as FE
from spendlabel.operators import model as MD
from spendlabel.operators import validate as V
from spendlabel.plans import training

TEXTS = [(1, "aa bb aa bb cc"), (2, "été ÉTÉ x y_1 " + "z" * 70), (3, ""), (4, None), (5, "a b c"), (6, "dd " * 300),
         (7, "aa bb"), (7, "bb aa bb"), (7, None), (None, "aa"), (None, "aa zz")]


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, text string").repartition(3)


@pytest.mark.parametrize("bits", [8, 20, 32])
def test_hashed_equals_md5_at_every_length(bits):
    terms = ["", "a b", "é" * 27, "é" * 28, *("x" * n for n in range(50, 140)), *(f"w{i} v{i % 7}" for i in range(9000))]
    want = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) & ((1 << bits) - 1) for t in terms]
    assert FE.hashed(pa.array(terms), bits).tolist() == want


def test_counts_equal_exploded_ngrams(docs):
    long = docs.select("id", F.explode(ngram_array("text")).alias("token"))
    want = Counter((r.id, r.token) for r in long.collect())
    got = FE.tokenize_ngrams(docs, "id", counted=True).collect()
    assert Counter({(r.id, r.token): r.n for r in got}) == want and len(got) == len(want)
    want = Counter((r.id, r.b) for r in long.select("id", bucket_of("token", 12).alias("b")).collect())
    got = FE.hashed_tf(docs, "id", bits=12).collect()
    assert Counter({(r.id, r.bucket): r.tf for r in got}) == want and len(got) == len(want)
    rows = FE.hashed_tf(docs, "id", bits=12, rows=True).collect()
    assert Counter({(r.id, b): n for r in rows for b, n in zip(r.bucket, r.tf)}) == want
    assert len({r.id for r in rows}) == len(rows)


def test_both_forms_normalise_alike(docs):
    flat, lists = (FE.l2_normalize(FE.hashed_tf(docs, "id", bits=12, rows=r), "id").collect() for r in (False, True))
    a, b = ({(r.id, r.bucket): r.x for r in x} for x in (flat, lists))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a) and len(a) == len(flat) == len(lists)
    norms = Counter()
    for (i, _), x in a.items():
        norms[i] += x * x
    assert all(abs(n - 1) < 1e-9 for n in norms.values()) and None not in norms


def test_texts_of_distinct_keys_are_not_exchanged(spark):
    docs = spark.createDataFrame([(i, f"aa b{i} cc") for i in range(50)], "id long, text string")
    for df in (FE.hashed_tf(docs, "id"), FE.tokenize_ngrams(docs, "id", counted=True),
               FE.l2_normalize(FE.hashed_tf(docs, "id", rows=True), "id")):
        df.collect()
        assert "Exchange hashpartitioning" not in _plan(df)


def test_slices_do_not_change_sparse_rows():
    tokens = pa.array(["aa bb aa", "", "cc"])
    one = [MD._count_cells(tokens.slice(i, 1), 20) for i in range(3)]
    b, x, first = MD._count_cells(tokens, 20)
    assert np.concatenate([c[0] for c in one]).tolist() == b.tolist() and first.tolist() == [0, 4, 4, 5]
    assert np.allclose(np.concatenate([c[1] for c in one]), x)


def test_checks_are_made_once(spark):
    df = spark.createDataFrame([("ab", "", "c"), ("x", "y", "z")], "vendor string, description string, category string")
    valid, rejected = V.validate_expenses(df, "api")
    assert "array_compact" not in _plan(valid) + _plan(rejected)
    assert valid.count() == 1 and rejected.first()["reasons"] == ["description_missing"]


def test_a_run_without_new_rows_tokenises_nothing(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("v", f"text {i % 5} word{i}", "ab"[i % 2]) for i in range(40)],
                               "vendor string, description string, category string")
    assert training.train_or_update(df, str(tmp_path)).kind == "first"
    monkeypatch.setattr(MD, "sparse_rows", lambda *a, **k: pytest.fail("tokenised"))
    again = training.train_or_update(df, str(tmp_path))
    assert again.kind == "noop" and again.rows_read == 40


@pytest.mark.parametrize("broadcast_bytes", [MD.BROADCAST_BYTES, 0])
def test_scoring_without_the_text_gives_the_same_scores(spark, broadcast_bytes):
    rows = spark.createDataFrame([(i, f"aa w{i % 7} cc", "xyz"[i % 3], 1) for i in range(30)],
                                 "id long, text string, category string, weight long")
    m = MD.fit(rows, MD.empty_model(spark, ["x", "y", "z"], 12, broadcast_bytes=broadcast_bytes), 2)
    whole, lean = MD.score_ovr(rows, m), MD.score_ovr(rows, m, keep_text=False)
    assert lean.columns == [c for c in whole.columns if c != "text"]
    assert sorted(lean.collect()) == sorted(whole.drop("text").collect())


def test_score_batch_gives_a_task_the_tokens_only(spark):
    rows = spark.createDataFrame([(1, "v", "aa bb", "x"), (2, "", "\u00a0Cc ", "y"), (3, None, " ", "x"), (4, " V", None, "y")],
                                 "id long, vendor string, description string, category string")
    m = MD.full_refit(C.with_row_id(C.build_text(rows)), steps=1, bits=12)
    scored, rejected = MD.score_batch(rows, m, "id")
    assert {r.id for r in scored.collect()} == {1, 2, 4} and [(r.id, r.reason) for r in rejected.collect()] == [(3, "empty_text")]
    plan = scored._jdf.queryExecution().optimizedPlan().toString().splitlines()
    given = next(x for x in plan if "MapInArrow" in x)
    assert "text#" not in given and "description#" not in given
    assert not [x for x in plan if "Filter" in x and "lower(" in x]


def test_text_of_stripped_fields(spark):
    fields = ["", None, " ", "\u00a0 A\u2003b \x85", "\x1cÉ", "I\u0307x", "a  b\t"]
    rows = spark.createDataFrame([(a, b) for a in fields for b in fields], "vendor string, description string")
    clean = [trim_ws(F.coalesce(c, F.lit(""))) for c in ("vendor", "description")]
    want = rows.select(trim_ws(F.lower(F.concat(clean[0], F.lit(" "), clean[1]))))
    assert [r[0] for r in C.build_text(rows, category=None).select("text").collect()] == [r[0] for r in want.collect()]


def test_holdout_moves_labels_and_ids_only(spark):
    rows = spark.createDataFrame([(i, f"id{i // 2:03}", None if i % 20 < 2 else "abc"[i // 2 % 3], "long text") for i in range(120)],
                                 "k long, row_id string, category string, text string")
    split = FE.stratified_holdout(rows, test_size=0.25, seed=7)
    got = {(r.category, r.row_id): r.split for r in split.collect()}
    assert split.count() == 120 and "Exchange hashpartitioning" not in _plan(split)
    for label in (None, *"abc"):
        ids = sorted((i for c, i in got if c == label), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
        held = int(len(ids) * 0.25 + 0.5) if label else 0
        assert [i for i in ids if got[label, i] == "test"] == ids[:held]
