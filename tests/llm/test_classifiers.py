"""Toxicity, language and quality classifiers."""

import zlib

import numpy as np
import pytest

from spendlabel.llm import language_id, quality_rank, toxicity
from spendlabel.llm.learn import Sparse
from spendlabel.llm.queries import QUERIES
from tests.oracle_harness import duck_connect

from .helpers import CHECK, auc, edge_rows, rows_of, table, with_clashes


def held(doc_id, folds, one):
    return zlib.crc32(str(doc_id).encode()) % folds == one


@pytest.fixture(scope="module")
def labels():
    return {i: (q, t, x, lang) for i, q, t, x, lang in duck_connect(CHECK).sql(
        "select doc_id, quality, toxic, text, lang from documents left join labels using (doc_id)").fetchall()}


@pytest.mark.parametrize("name, at, folds, one, threshold, least", [
    ("op7_toxicity", 1, 3, 1, 0.7, 0.9), ("op9_quality_classifier", 0, 5, 0, 0.3, 0.97)])
def test_held_out_scores(spark, labels, name, at, folds, one, threshold, least):
    rows = QUERIES[name](spark, CHECK).collect()
    assert len(rows) == len(labels) and all(r.held_out == held(r.doc_id, folds, one) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    known = [(labels[r.doc_id][at], r.score) for r in rows if r.held_out and labels[r.doc_id][at] is not None]
    assert auc(*zip(*known)) >= least


def test_held_out_languages(spark, labels):
    rows = QUERIES["op8_language_id"](spark, CHECK).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == labels[r.doc_id][3] for r in rows if r.held_out]) >= 0.97


def tiny(spark):
    """Two languages; toxic texts say 'vile'; bad texts are symbols."""
    rows = []
    for i in range(120):
        words = ["der", "und", "nicht"] if i % 2 else ["the", "and", "not"]
        text = " ".join(words[j % 3] + str(j * i % 7) for j in range(30 + i % 9))
        rows.append((1000 + i, text + (" vile" if i % 5 == 0 else "") + (" #$%&*|" * 30 if i % 7 == 0 else ""), "de" if i % 2 else "en", "s"))
    lab = [(1000 + i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(120)] + [(None, 1, 1), (1, None, None), (2, 0, None), (1000, 1, 1)]
    return rows, spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


def test_edge_rows_are_scored(spark):
    rows, lab = tiny(spark)
    docs = with_clashes(table(spark, rows + edge_rows()))
    tox = toxicity.toxicity(docs, toxicity.fit(docs, lab))
    got = tox.collect()
    assert len(got) == len(rows) + len(edge_rows()) and not any(np.isnan(r.score) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score  # no words: the bias
    assert min(by[1000 + i].score for i in range(0, 120, 5)) > max(by[1000 + i].score for i in range(120) if i % 5)
    left = toxicity.reject_toxic(docs, toxicity.fit(docs, lab))
    assert left.columns == docs.columns
    assert rows_of(left, "doc_id") == sorted(((r.doc_id,) for r in got if r.predicted == 0), key=repr)
    qual = quality_rank.quality(docs, quality_rank.fit(docs, lab)).collect()
    assert len(qual) == len(got) and all(0 <= r.score <= 1 for r in qual)
    ok = {r.doc_id: r.predicted for r in qual}
    assert all(ok[1000 + i] == int(i % 7 != 0) for i in range(120))
    lang = language_id.identify(docs, language_id.fit(docs)).collect()
    assert {r.lang_pred for r in lang if r.doc_id in (1, 2, 3, 7)} == {"und"} and len(lang) == len(got)
    assert all(r.lang_pred == ("de" if i % 2 else "en") for i in range(120) for r in lang if r.doc_id == 1000 + i)


def test_nothing_to_learn_from(spark):
    docs, none = table(spark, edge_rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = table(spark, [])
    assert len({r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()}) == 1
    assert {r.score for r in quality_rank.quality(docs, quality_rank.fit(docs, none)).collect()} == {0.5}
    no_lang = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.identify(no_lang, language_id.fit(no_lang)).collect()} == {"und"}
    one = docs.selectExpr("doc_id", "text", "'xx' as lang")
    assert {r.lang_pred for r in language_id.identify(one, language_id.fit(one)).collect()} == {"und", "xx"}
    for df in (toxicity.toxicity(empty, toxicity.fit(empty, none)), quality_rank.quality(empty, quality_rank.fit(empty, none)),
               language_id.identify(empty, language_id.fit(empty))):
        assert df.count() == 0


def test_non_negative_risk_separates_positives_hidden_among_unlabelled():
    rng = np.random.default_rng(0)
    n, d = 600, 6
    truth = rng.random(n) < 0.3
    x = rng.normal(size=(n, d)) + truth[:, None] * np.array([2.5, -2.5, 0, 0, 0, 0])
    positive = truth & (rng.random(n) < 0.4)  # the other positives stay among the unlabelled
    rows = Sparse([(np.arange(d, dtype=np.int32), r.astype(np.float32)) for r in x])
    w, b = toxicity.nn_pu(rows, positive, 0.25, d)
    assert auc(truth[~positive].astype(int).tolist(), (x @ w + b)[~positive].tolist()) > 0.95


def test_bradley_terry_orders_by_strength():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (200, 3)), rng.normal(0, 1, (200, 3))
    good[:, 2], bad[:, 2] = rng.normal(size=200), rng.normal(size=200)
    w = quality_rank.bradley_terry(good, bad)
    assert w[0] > 0.5 and w[1] > 0.5 and abs(w[2]) < 0.2


@pytest.mark.parametrize("n", [2, 3, 5, 7, 20, 120])
def test_codewords_stay_apart(n):
    code = language_id.codewords(n)
    far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert far >= (2 ** (n - 2) if n <= 7 else 6) and all(abs(code[:, c].sum()) < n for c in range(code.shape[1]))
    margins = code.astype(float) * 3
    wrong = margins.copy()
    wrong[:, 0] *= -1  # a wrong bit is corrected where the distance allows it
    m = language_id.Model([str(i) for i in range(n)], code.astype(float), np.zeros(0), np.zeros(0), np.zeros(0), np.ones(code.shape[1]))
    assert (m.decode(margins)[0] == np.arange(n)).all()
    if far >= 3:
        assert (m.decode(wrong)[0] == np.arange(n)).all()


def test_the_sample_is_bounded_by_rows(spark):
    """One id on very many rows, and repeated labels, add nothing to the sample."""
    from spendlabel.llm.learn import bounded_sample
    docs = spark.range(2_000).selectExpr("id doc_id", "concat('text ', id) text").union(
        spark.range(5_000).selectExpr("7L doc_id", "concat('other ', id) text"))
    ids = spark.range(2_000).selectExpr("id doc_id").union(spark.range(500).selectExpr("7L doc_id"))
    rows = bounded_sample(docs, ids, 2_000).collect()
    assert len(rows) == 2_000 and len({r.doc_id for r in rows}) == 2_000
    assert {r.text for r in rows if r.doc_id == 7} == {"other 0"}
    assert bounded_sample(docs, ids, 300).count() == 300


def test_languages_without_spaces(spark):
    """Held-out accuracy where a whole sentence is one word."""
    r = np.random.default_rng(5)
    han, kana = [chr(0x4e00 + i) for i in range(300)], [chr(0x3042 + i) for i in range(60)]

    def text(letters):
        return "".join(r.choice(letters, 60)) + "\u3002"
    rows = [(i, text(han) if i % 2 else text(han[:150] + kana), "zh" if i % 2 else "ja", "s") for i in range(400)]
    got = language_id.identify(df := table(spark, rows), language_id.fit(df)).collect()
    lang = {i: x for i, _, x, _ in rows}
    held_out = [g for g in got if g.held_out]
    assert len(held_out) > 50 and np.mean([g.lang_pred == lang[g.doc_id] for g in held_out]) > 0.95


@pytest.mark.parametrize("rare", [2, 10])
def test_quality_model_is_fitted_on_every_row(spark, monkeypatch, rare):
    rows = [(i, ("plain words number %d of a calm text. " % i) * 3 if i % rare else "!!! $$$ 99 BUY " * (1 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % rare > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    small = {r.doc_id: r.predicted for r in quality_rank.quality(docs, quality_rank.fit(docs, labels)).collect()}
    monkeypatch.setattr(quality_rank, "ROWS", 20)
    monkeypatch.setattr(quality_rank, "GROUP_ROWS", 30)
    monkeypatch.setattr(quality_rank, "bounded_sample", lambda *a: pytest.fail("a sample"))
    model = quality_rank.fit(docs, labels)
    assert {r.doc_id: r.predicted for r in quality_rank.quality(docs, model).collect()} == small
    learned = np.array([quality_rank.text_features(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5])
    assert np.allclose(model.mean, learned.mean(0)) and np.allclose(model.scale, learned.std(0) + 1e-6)
