"""Properties: partition-count invariance, idempotent retraining, conservation of rows
across splits, probability sums, exact serial ids under a hot group of copies,
model quality, and the end-to-end smoke case of the source application."""

import math

from pyspark.sql import functions as F

from spendlabel.operators import clean as C
from spendlabel.operators import features as FE
from spendlabel.operators import maintain as M
from spendlabel.operators import model as MD
from spendlabel.operators import sets as S
from spendlabel.operators import validate as V
from spendlabel.plans.fixtures import Fixtures
from spendlabel.plans.training import prepare_rows, train_or_update
from spendlabel.session import scratch_path
from spendlabel.sources.store import VersionedStore
from spendlabel.sources.synth import synthesize_expenses
from tests.conftest import SF_CHECK, SF_SMALL


def test_features_do_not_depend_on_partitioning(spark):
    docs = C.build_text(Fixtures(spark, SF_SMALL).labeled_text)
    out = []
    for parts in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        f = FE.l2_normalize(FE.hashed_tf(docs, "row_key"), "row_key").select("row_key", "bucket", F.round("x", 9).alias("x"))
        out.append(sorted(map(tuple, f.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def test_move_rows_conserves_rows(spark):
    e = Fixtures(spark, SF_SMALL).expenses
    kept, moved = M.move_rows(e, F.col("category").startswith("PROMO"))
    assert kept.count() + moved.count() == e.count()
    assert M.reconcile_move(e, kept, moved).first()["balanced"]
    changed = moved.withColumn("amount", F.when(F.col("amount") < 100_000, F.col("amount")))
    assert not M.reconcile_move(e, kept, changed).first()["balanced"]
    swapped = moved.withColumn("description", F.lower("vendor"))
    assert not M.reconcile_move(e, kept, swapped).first()["balanced"]


def test_publish_move_keeps_amounts_dates_and_earlier_seed_rows(spark):
    e = Fixtures(spark, SF_SMALL).expenses
    store = VersionedStore(spark, scratch_path(spark, "store"))
    M.publish_move(store, e, F.col("category").startswith("PROMO"))
    seed = store.read_latest("seed_expenses", "move")
    assert seed.columns == ["id", "vendor", "description", "category", "amount", "expense_date", "source"]
    M.publish_move(store, store.read_latest("expenses", "move"), F.col("category").startswith("SMALL"), seed=seed)
    kept, both = store.read_latest("expenses", "move"), store.read_latest("seed_expenses", "move")
    assert sorted(r[0] for r in both.select("id").collect()) == list(range(1, both.count() + 1))
    assert M.reconcile_move(e, kept, both).first()["balanced"]


def test_validation_conserves_rows(spark):
    st = C.parse_staging(Fixtures(spark, SF_SMALL).staging)
    valid, rejected = V.validate_expenses(st, "form", amount_text="amount_txt", date_value="expense_date")
    assert valid.count() + rejected.count() == st.count()
    assert rejected.count() > 0 and valid.count() > 0


def test_serial_ids_exact_with_hot_copies(spark):
    # one row copied 5,000 times (a third of the input and more), plus distinct rows
    hot = spark.range(5000).select(F.lit("hot").alias("a"), F.lit("x").alias("b"))
    rest = spark.range(3000).select(F.col("id").cast("string").alias("a"), F.lit("y").alias("b"))
    src = hot.unionByName(rest)
    df = M.number_rows(src, ["a", "b"], F.lit(100).cast("long"), "rid")
    # chunked expansion of the hot range, forced small
    assert df.count() == 8000
    ids = sorted(r[0] for r in df.select("rid").collect())
    assert ids == list(range(101, 8101))
    ranged = M.assign_positions(src.groupBy("a", "b").count(), F.md5("a"), ["a"], weight="count")
    chunked = M.expand_ranges(ranged, "pos", "count", out="p", chunk=7)
    assert sorted(r[0] for r in chunked.select("p").collect()) == list(range(1, 8001))


def test_latest_label_newest_wins(spark):
    fx = Fixtures(spark, SF_SMALL)
    lab = fx.user_labels_x
    out = M.latest_label(lab)
    keyed = out.filter(F.col("expense_id").isNotNull())
    assert keyed.groupBy("user_id", "expense_id").count().filter("count > 1").count() == 0
    second = out.filter(F.col("id") >= 100000000).filter(F.col("id") < 200000000).count()
    assert second == lab.filter(F.col("id") >= 100000000).filter(F.col("id") < 200000000).count()


def test_probabilities_sum_to_one_and_zero_token_rows_score(spark):
    fx = Fixtures(spark, SF_SMALL)
    docs = C.with_row_id(C.build_text(fx.labeled_text))
    classes = MD.register_classes(docs)
    m = MD.fit(MD.group_copies(docs), MD.empty_model(spark, classes), 2)
    extra = spark.createDataFrame([(-1, "a", "b"), (-2, "", "")], "row_key long, vendor string, description string")
    src = fx.labeled_text.select("row_key", "vendor", "description").unionByName(extra)
    scored, rejected = MD.score_batch(src, m, "row_key")
    assert scored.count() == fx.labeled_text.count() + 1      # "a b" has no tokens but scores
    assert rejected.count() == 1                               # empty text is routed out
    sums = [sum(r["prob"]) for r in scored.collect()]
    assert all(math.isclose(s, 1.0, rel_tol=1e-9) for s in sums)
    no_tok = scored.filter("row_key = -1").first()
    assert len(no_tok["top"]) == 3


def test_train_or_update_is_idempotent(spark):
    root = scratch_path(spark, "store")
    src = Fixtures(spark, SF_SMALL).labeled_text
    r1 = train_or_update(src, root)
    r2 = train_or_update(src, root)
    assert r1.changed and r1.kind == "first"
    assert not r2.changed and r2.kind == "noop" and r2.version == r1.version
    store = VersionedStore(spark, root)
    led = store.load_ledger()
    # the ledger is a set of learned ids; rows_new counts in-batch copies too
    assert led.count() == led.select("row_id").distinct().count() <= r1.rows_new


def test_write_reports_what_it_wrote(spark):
    rows = spark.range(1_000).selectExpr("id % 7 AS weight", "id % 3 AS c").groupBy("c").agg(F.sum("weight").alias("weight"))
    table, seen = MD.stored_with(rows, "seen", n=F.sum("weight"), k=F.count("c"))
    assert seen == {"n": table.agg(F.sum("weight")).first()[0], "k": table.count()} == {"n": 2_997, "k": 3}
    table, seen = MD.stored_with(rows.limit(0), "seen", n=F.coalesce(F.sum("weight"), F.lit(0)))
    assert seen == {"n": 0} and table.count() == 0


def test_train_or_update_counts_rows_in_the_writes(spark, monkeypatch):
    """An empty batch is a no-op; figures are those of the rows; a first run and an update ask
    for no count of rows beside the writes."""
    root = scratch_path(spark, "store")
    src = Fixtures(spark, SF_SMALL).labeled_text
    assert train_or_update(src.limit(0), root).kind == "noop"
    monkeypatch.setattr(MD, "register_classes", None)
    monkeypatch.setattr(S, "new_labels", None)
    r = train_or_update(src, root, holdout=False)
    prepared = prepare_rows(src)
    assert (r.rows_read, r.rows_new, r.rows_trained) == (prepared.count(),) * 3
    assert r.classes == prepared.select("category").distinct().count()
    m = VersionedStore(spark, root).load_latest_model()
    assert m.n_observed == m.weights.select("bucket").distinct().count()


def test_new_category_triggers_refit(spark):
    root = scratch_path(spark, "store")
    fx = Fixtures(spark, SF_SMALL)
    src = fx.labeled_text
    r1 = train_or_update(src, root)
    extra = src.limit(20).withColumn("category", F.lit("xx")).withColumn(
        "description", F.concat(F.col("description"), F.lit(" zzz")))
    r2 = train_or_update(src.unionByName(extra), root)
    assert r2.kind == "refit" and r2.new_classes == 1 and r2.classes == r1.classes + 1


def test_model_quality_on_documents(spark):
    """Holdout accuracy on documents (class = language) is high; the largest class
    alone would give about 0.62."""
    root = scratch_path(spark, "store")
    r = train_or_update(Fixtures(spark, SF_CHECK).labeled_text, root)
    assert r.accuracy >= 0.9, r


def test_smoke_case_hydro_one_is_utilities(spark):
    """The source application's smoke case, with a model trained on synthetic rows
    generated from the orders table."""
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey")
    syn = synthesize_expenses(orders, "o_orderkey")
    root = scratch_path(spark, "store")
    r = train_or_update(syn, root, holdout=False)
    assert r.changed
    model = VersionedStore(spark, root).load_latest_model()
    q = spark.createDataFrame([(1, "Hydro One", "Monthly electricity bill for office")],
                              "k long, vendor string, description string")
    scored, _ = MD.score_batch(q, model, "k")
    assert scored.first()["category"] == "Utilities"


def _vendor_rows(spark):
    e = Fixtures(spark, SF_SMALL).expenses
    return C.with_row_id(C.build_text(e.withColumn("category", F.concat("vendor", "category"))))


def _weights(model):
    return {(r[0], r[1]): (tuple(round(v, 10) for v in r[2]), tuple(round(v, 12) for v in r[3]))
            for r in model.weights.select("bucket", "block", "w", "g2").collect()}


def test_joined_and_broadcast_weights_give_the_same_model_and_scores(spark):
    """Broadcast in one piece, or joined by shuffle in blocks of classes: same weights after a
    first fit and after an update with other rows, same scores."""
    rows = _vendor_rows(spark)
    classes = MD.register_classes(rows)
    assert len(classes) > MD.CLASS_BLOCK  # several blocks
    low = F.col("row_id").substr(1, 1) < "8"
    outs = []
    for limit in (MD.BROADCAST_BYTES, 0):
        m = MD.fit(MD.group_copies(rows.filter(low)), MD.empty_model(spark, classes, 12, limit), 2)
        m = MD.fit(MD.group_copies(rows.filter(~low)), m, 1)
        scored = MD.score_ovr(rows.select("expense_id", "text"), m).select("expense_id", "predicted", "prob")
        outs.append((m.fits_broadcast(), m.rows_trained, _weights(m), [round(b, 10) for b in m.intercept],
                     sorted((r[0], r[1], tuple(round(p, 9) for p in r[2])) for r in scored.collect())))
    assert outs[0][0] and not outs[1][0] and outs[0][1] == rows.count()
    assert outs[0][1:] == outs[1][1:]
    assert len(outs[0][4]) == rows.count()


def test_an_update_keeps_every_weight(spark):
    """Buckets that an update does not touch stay (and decay), whatever their accumulators."""
    def rows(*texts):
        df = spark.createDataFrame([(f"{t}|{c}", t, c) for t, c in texts], "row_id string, text string, category string")
        return MD.group_copies(df)
    first = rows(("tie one", "a"), ("tie two", "b"), ("three", "c"))
    for limit in (MD.BROADCAST_BYTES, 0):
        m = MD.fit(first, MD.empty_model(spark, ["a", "b", "c"], 12, limit), 1)
        again = MD.fit(rows(("other words", "a"), ("else", "c")), m, 1)
        before, after = _weights(m), _weights(again)
        assert set(before) < set(after) and again.n_observed == len(after)
        assert all(len(w) == 3 for w, _ in after.values())


def test_a_row_larger_than_a_chunk_and_rows_without_tokens(spark, monkeypatch):
    monkeypatch.setattr(MD, "CHUNK_CELLS", 8)
    df = spark.createDataFrame([("1", " ".join(f"word{i}" for i in range(60)), "a"), ("2", "", "b"), ("3", "a b", "b"),
                                ("4", "word1 word2", "b"), ("5", None, "a")], "row_id string, text string, category string")
    out = []
    for limit in (MD.BROADCAST_BYTES, 0):
        m = MD.fit(MD.group_copies(df), MD.empty_model(spark, ["a", "b"], 10, limit), 2)
        out.append((_weights(m), sorted((r.row_id, tuple(round(v, 9) for v in r.m)) for r in MD.score_margins(df, m).collect())))
    assert out[0] == out[1] and len(out[0][1]) == 5


def test_a_fit_tokenises_each_text_once(spark):
    """Five steps read stored sparse rows; the tokenizer runs in one pass over the texts."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: seen.add(1) or t, "string")
    rows = MD._stored(MD.group_copies(_vendor_rows(spark)), "rows")
    counted = rows.withColumn("text", count.asNondeterministic()("text"))
    MD.fit(counted, MD.empty_model(spark, MD.register_classes(rows), 12), 5)
    assert seen.value == rows.count()


def test_sparse_rows_equal_the_feature_queries(spark):
    texts = ["", "a b", "the cat_1 sat on the mat the cat", "Ärger über ÑANDÚ 東京 x²", "tab\tand\u00a0nbsp \x1c end", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {(r.k, r.bucket): round(r.x, 12) for r in FE.l2_normalize(FE.hashed_tf(df, "k"), "k").collect()}
    sparse = MD.sparse_rows(df).collect()
    got = {(r.k, b): round(x, 12) for r in sparse for b, x in zip(r.b, r.x)}
    assert got == want and len(sparse) == len(texts)


def test_a_new_class_in_a_delta_loses_nothing(spark):
    """Micro-batches that bring new classes: every learned row and class stays, a spelling of
    a known class is no new class, and resending adds nothing."""
    root = scratch_path(spark, "store")

    def batch(cat, words, n=20):
        return spark.createDataFrame([(f"{words} {i}", f"{words} item {i}", cat) for i in range(n)],
                                     "vendor string, description string, category string")
    b0 = batch("Groceries", "apple").unionByName(batch("Rent", "flat"))
    b1, b2, b3 = batch("Fuel", "petrol"), batch("groceries", "pear", 5), batch("RENT ", "loft", 5)
    r = [train_or_update(b, root, batch_id=i, holdout=False) for i, b in enumerate((b0, b1, b2.unionByName(b3), b0))]
    assert [x.kind for x in r] == ["first", "refit", "update", "noop"]
    assert [x.rows_trained for x in r] == [40, 60, 10, 0]
    store = VersionedStore(spark, root)
    assert store.load_latest_model().classes == ["Fuel", "Groceries", "Rent"]
    assert store.load_ledger(distinct=True).count() == store.load_training_rows().count() == 70
    assert {x[0] for x in store.load_training_rows().select("category").distinct().collect()} == {"Fuel", "Groceries", "Rent"}


def test_scoring_does_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("source vendor", "text description", "lang category")
    m = MD.full_refit(C.with_row_id(C.build_text(docs)), steps=1)
    scored = MD.score_ovr(docs.withColumn("text", F.col("description")), m)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_uncommitted_version_is_invisible(spark):
    """Data of a version without its manifest row (a crash before commit) is never
    read: not as the latest model, not in the ledger."""
    fx = Fixtures(spark, SF_SMALL)
    docs = C.with_row_id(C.build_text(fx.labeled_text))
    classes = MD.register_classes(docs)
    m = MD.fit(MD.group_copies(docs), MD.empty_model(spark, classes), 1)
    store = VersionedStore(spark, scratch_path(spark, "store"))
    v1 = store.publish_model(m, learned=docs.limit(10).select("row_id"))
    # simulate a crash: version 2 data written, manifest row missing
    store.write(m.weights, "model_weights", v1 + 1)
    store.write_ledger(docs.select("row_id"), v1 + 1)
    assert store.load_latest_model().version == v1
    assert store.load_ledger(distinct=True).count() == docs.limit(10).select("row_id").distinct().count()
