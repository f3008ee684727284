"""Phase 4-5 queries: sources, sinks, the versioned store, training runs and streams
(O1-O8, O41, O42, O54-O56). Each writes into a new folder below the shared
checkpoint dir and reads back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import metrics as MT
from ..operators import model as MD
from ..operators import sets as S
from ..session import scratch_path
from ..sources import files as IO
from ..sources.store import VersionedStore
from ..streaming import jobs as ST
from . import oracle as Q
from .catalog import query
from .q_model import (_DOCS, _HOLDOUT, _docs, _holdout_sql, _one_step, _score_sql, _step_sql, _steps_sql,
                      _with_split)
from .q_sets import _LEDGER_SQL, _MERGE_SQL, _ledger, _train_csv


# -- O1 ----------------------------------------------------------------------------
@query("read_labeled_csv", Q.with_fixtures(["expenses"]) + """
SELECT expense_id, vendor, description, category FROM expenses""")
def read_labeled_csv(fx):
    p = scratch_path(fx.spark, "labeled_csv")
    raw = fx.expenses.select(F.col("vendor").alias("\ufeffSupplier"), F.col("description").alias("Memo"),
                             F.col("category").alias(" Label "), F.col("expense_id").alias("ID"))
    IO.write_csv(raw, p)
    back = C.conform_columns(IO.read_labeled_csv(fx.spark, p))
    return back.select(F.col("id").cast("long").alias("expense_id"), "vendor", "description", "category")


@query("read_labeled_csv_mixed", Q.with_fixtures(["expenses"]) + """
SELECT expense_id, vendor, description, category FROM expenses""")
def read_labeled_csv_mixed(fx):
    """Files of one folder with their columns in another order."""
    p = scratch_path(fx.spark, "mixed_csv")
    e = fx.expenses
    even = F.col("expense_id") % 2 == 0
    for part in (e.filter(even).select("expense_id", "vendor", "description", "category"),
                 e.filter(~even).select("category", "description", "expense_id", "vendor")):
        part.write.mode("append").options(header="true", escape='"').csv(p)
    back = C.conform_columns(IO.read_labeled_csv(fx.spark, p))
    return back.select(F.col("expense_id").cast("long"), "vendor", "description", "category")


# -- O2 ----------------------------------------------------------------------------
@query("read_staging_csv", Q.with_fixtures(["staging"]) + """
SELECT vendor, description, category, date_txt, amount_txt FROM staging""")
def read_staging_csv(fx):
    """A file headed as the seed file is: vendor,description,category,date,amount."""
    p = scratch_path(fx.spark, "staging_csv")
    IO.write_csv(fx.staging.select("vendor", "description", "category", F.col("date_txt").alias("date"),
                                   F.col("amount_txt").alias("amount")), p)
    return IO.read_staging_csv(fx.spark, p)


# -- O3 ----------------------------------------------------------------------------
@query("read_feedback", Q.with_fixtures(["feedback"]) + """
SELECT date, amount, vendor, description, category, source, created_at_utc FROM feedback""")
def read_feedback(fx):
    p = scratch_path(fx.spark, "feedback_csv")
    IO.write_csv(fx.feedback.select(*IO.FEEDBACK_FIELDS), p, files=4)
    return IO.read_feedback(fx.spark, p)


@query("read_feedback_mixed", Q.with_fixtures(["feedback"]) + """
SELECT date, amount, vendor, description, category,
       CASE WHEN fb_id % 2 = 0 THEN source END AS source, created_at_utc FROM feedback""")
def read_feedback_mixed(fx):
    """A log whose later files have another column order and lack a column."""
    p = scratch_path(fx.spark, "feedback_mixed")
    fb = fx.feedback
    even = F.col("fb_id") % 2 == 0
    for part in (fb.filter(even).select(*IO.FEEDBACK_FIELDS),
                 fb.filter(~even).select("vendor", "created_at_utc", "category", "description", "amount", "date")):
        part.write.mode("append").options(header="true", escape='"').csv(p)
    return IO.read_feedback(fx.spark, p)


def _mixed_log(fx) -> str:
    """A log of sub-folders: a plain file with a byte order mark, compressed files in another
    column order, and files that lack a column and repeat another."""
    p = scratch_path(fx.spark, "feedback_tree")
    fb, third = fx.feedback, F.col("fb_id") % 3
    fb.filter(third == 0).select(F.col("date").alias("\ufeffdate"), *IO.FEEDBACK_FIELDS[1:]).write.options(header="true", escape='"').csv(f"{p}/day=0")
    (fb.filter(third == 1).select(*reversed(IO.FEEDBACK_FIELDS))
     .write.options(header="true", escape='"', compression="gzip").csv(f"{p}/day=1"))
    (fb.filter(third == 2).select("amount", "vendor", "category", "description", F.upper("vendor").alias("Vendor "), "date")
     .write.options(header="true", escape='"').csv(f"{p}/old/2"))
    return p


_TREE_SQL = """SELECT date, amount, vendor, description, category, CASE WHEN fb_id % 3 < 2 THEN source END AS source,
       CASE WHEN fb_id % 3 < 2 THEN created_at_utc END AS created_at_utc FROM feedback"""


@query("read_feedback_tree", Q.with_fixtures(["feedback"]) + _TREE_SQL)
def read_feedback_tree(fx):
    return IO.read_feedback(fx.spark, _mixed_log(fx))


# -- O4 ----------------------------------------------------------------------------
@query("append_feedback", Q.with_fixtures(["feedback"]) + """
SELECT date, amount, vendor, description, category, 'feedback_api' AS source FROM feedback
UNION ALL
SELECT NULL, NULL, vendor, description, category, 'feedback_api' FROM feedback""")
def append_feedback(fx):
    p = scratch_path(fx.spark, "feedback_log")
    fb = fx.feedback
    IO.append_feedback(fb.select("date", "amount", "vendor", "description", "category"), p)
    # No date / amount: written as empty cells, which read back as NULL.
    IO.append_feedback(fb.select("vendor", "description", "category"), p)
    return IO.read_feedback(fx.spark, p).drop("created_at_utc")


# -- O5 ----------------------------------------------------------------------------
@query("write_training_set", _MERGE_SQL)
def write_training_set(fx):
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    merged = S.merge_feedback(_train_csv(fx), fx.feedback.drop("fb_id"))
    store.write_training_set(merged)
    return store.read_training_set()


# -- O6 ----------------------------------------------------------------------------
@query("seen_ledger", Q.with_fixtures(["expenses"]) + f"""
SELECT DISTINCT {Q.row_id_of(Q.text_of(), Q.clean_field('category'))} AS row_id FROM expenses""")
def seen_ledger(fx):
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    ids = C.with_row_id(C.build_text(fx.expenses)).select("row_id")
    lab = fx.user_labels.filter(F.col("source") == "confirm").withColumnRenamed("chosen_cat", "category")
    store.append_ledger(C.with_row_id(C.build_text(lab)).select("row_id"))
    store.append_ledger(ids)
    return store.load_ledger(distinct=True)


@query("filter_unseen_bucketed", Q.with_fixtures(["expenses", "user_labels"], _LEDGER_SQL) + f"""
SELECT expense_id, {Q.row_id_of(Q.text_of(), Q.clean_field('category'))} AS row_id FROM expenses
WHERE {Q.row_id_of(Q.text_of(), Q.clean_field('category'))} NOT IN (SELECT row_id FROM ledger)""")
def filter_unseen_bucketed(fx):
    """Rows against a stored ledger of three versions: buckets are read where they lie."""
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    ids = _ledger(fx)
    for k in range(3):
        store.append_ledger(ids.filter(F.pmod(F.crc32("row_id"), F.lit(3)) == k))
    rows = C.with_row_id(C.build_text(fx.expenses)).select("expense_id", "row_id")
    return S.filter_unseen(rows, store.load_ledger()).select("expense_id", "row_id")


# -- O5 / O30 by parts -------------------------------------------------------------
@query("merge_training_parts", _MERGE_SQL)
def merge_training_parts(fx):
    """The training set once, then two batches of feedback that rewrite their parts only."""
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    store.start_training_parts(_train_csv(fx), parts=32)
    first = F.pmod(F.col("fb_id"), F.lit(2)) == 0
    for batch in (fx.feedback.filter(first), fx.feedback.filter(~first | first.isNull())):
        store.merge_training_parts(batch.drop("fb_id"))
    return store.read_training_parts()


# -- O53 access paths --------------------------------------------------------------
@query("user_expenses_clustered", Q.with_fixtures(["expenses"]) + """
SELECT expense_id, expense_date, amount FROM expenses
WHERE user_id = 10 AND expense_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""")
def user_expenses_clustered(fx):
    """One user's range from a published table clustered by user and date."""
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    store.publish_clustered(fx.expenses, "expenses_by_user", ["user_id", "expense_date", "expense_id"])
    published = store.read_latest("expenses_by_user", "expenses_by_user")
    return MT.user_expenses(published, 10, "1994-01-01", "1996-12-31").select("expense_id", "expense_date", "amount")


# -- O7 / O8 -----------------------------------------------------------------------
def _published(fx):
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    docs = _docs(fx)
    m = _one_step(docs)
    store.publish_model(m, learned=docs.select("row_id"))
    return store, docs


@query("publish_model", Q.with_fixtures(["labeled_text"], _DOCS, _step_sql("docs")) + """
SELECT bucket, cls AS category, round(w, 6) + 0.0 AS w FROM wt""")
def publish_model(fx):
    store, _ = _published(fx)
    m = store.load_latest_model()
    return m.long_weights().select("bucket", m.class_name(F.col("class_id")).alias("category"),
                                   (F.round("w", 6) + F.lit(0.0)).alias("w"))


@query("load_latest_model", Q.with_fixtures(["labeled_text"], _DOCS, _step_sql("docs")) + """
SELECT class_id, cls AS category, round(b, 6) + 0.0 AS intercept FROM bias""")
def load_latest_model(fx):
    store, _ = _published(fx)
    m = store.load_latest_model()
    return (store.read("model_classes", m.version)
            .select("class_id", "category", (F.round("intercept", 6) + F.lit(0.0)).alias("intercept")))


# -- O41 ---------------------------------------------------------------------------
@query("full_refit", _holdout_sql(_steps_sql("train_docs", MD.STEPS_REFIT)) + """
SELECT row_key, predicted FROM pred""")
def full_refit(fx):
    d = _with_split(fx)
    train = d.filter(F.col("split") == "train")
    test = d.filter(F.col("split") == "test")
    m = MD.full_refit(train)
    return MD.score_ovr(test.select("row_key", "text"), m, keep_text=False).select("row_key", "predicted")


# -- O42 ---------------------------------------------------------------------------
@query("train_or_update", _HOLDOUT + """
SELECT true AS changed, 'first' AS kind, count(*) AS rows_read,
       (SELECT count(*) FROM train_docs) AS rows_new, (SELECT count(*) FROM train_docs) AS rows_trained,
       count(DISTINCT category) AS classes, 0::BIGINT AS new_classes,
       (SELECT round(avg(CASE WHEN predicted = category THEN 1.0 ELSE 0.0 END), 6) + 0.0 FROM pred) AS accuracy,
       1::BIGINT AS version
FROM docs WHERE length(text) > 0 AND length(category) > 0""")
def train_or_update(fx):
    from .training import train_or_update as run
    root = scratch_path(fx.spark, "store")
    src = fx.labeled_text
    run(src, root)          # first run: registers classes and trains
    run(src, root)          # same input again: nothing unseen, no new version
    return VersionedStore(fx.spark, root).run_metrics().withColumn("accuracy", F.round("accuracy", 6) + F.lit(0.0))


@query("train_or_update_delta", Q.with_fixtures(["labeled_text"], _DOCS, """
delta AS (
  SELECT CASE WHEN category NOT IN ('en', 'fr') THEN 3 WHEN substr(row_id, 1, 1) < '8' THEN 1 ELSE 2 END AS part, category
  FROM docs WHERE length(text) > 0 AND length(category) > 0),
per AS (SELECT part, count(*) AS n FROM delta GROUP BY part)""") + """
SELECT part::BIGINT AS version, CASE part WHEN 1 THEN 'first' WHEN 2 THEN 'update' ELSE 'refit' END AS kind,
       n AS rows_read, n AS rows_new, CASE part WHEN 3 THEN (SELECT sum(n) FROM per)::BIGINT ELSE n END AS rows_trained,
       CASE part WHEN 3 THEN (SELECT count(DISTINCT category) FROM delta) ELSE 2 END AS classes,
       CASE part WHEN 3 THEN (SELECT count(DISTINCT category) - 2 FROM delta) ELSE 0 END AS new_classes
FROM per""")
def train_or_update_delta(fx):
    """A first run, an update with other rows of the same classes, a refit for new classes."""
    from .training import train_or_update as run
    root = scratch_path(fx.spark, "store")
    docs = _docs(fx).select("row_id", *fx.labeled_text.columns[1:3], "category")
    known = F.col("category").isin("en", "fr")
    low = F.col("row_id").substr(1, 1) < "8"
    for delta in (docs.filter(known & low), docs.filter(known & ~low), docs.filter(~known)):
        run(delta.drop("row_id"), root, holdout=False)
    return VersionedStore(fx.spark, root).run_metrics().drop("changed", "accuracy", "v")


# -- O54 ---------------------------------------------------------------------------
def _feedback_valid_sql() -> str:
    nv, nd, nc = Q.normalized("vendor"), Q.normalized("description"), Q.normalized("category")
    amt = Q.form_amount("amount")
    return Q.with_fixtures(["feedback"]) + f"""
SELECT date, amount, {nv} AS vendor, {nd} AS description, {nc} AS category, source, created_at_utc
FROM feedback
WHERE {Q.iso_date('date')} IS NOT NULL
  AND coalesce({amt} >= 0.01 AND NOT isnan({amt}) AND {amt} < 'inf'::DOUBLE, false)
  AND length(coalesce(amount, '')) <= 12
  AND length({nv}) >= 3 AND length({nv}) <= 30
  AND length({nd}) >= 3 AND length({nd}) <= 255
  AND length({nc}) >= 1 AND length({nc}) <= 30"""


@query("stream_feedback", _feedback_valid_sql())
def stream_feedback(fx):
    spark = fx.spark
    src, dst, ck = (scratch_path(spark, n) for n in ("fb_src", "fb_dst", "fb_ck"))
    IO.write_csv(fx.feedback.select(*IO.FEEDBACK_FIELDS), src, files=4)
    q = ST.stream_feedback(spark, src, dst, ck)
    q.awaitTermination()
    return spark.read.parquet(f"{dst}/valid").drop("batch_id")


@query("stream_feedback_tree", _feedback_valid_sql().replace("FROM feedback\nWHERE", f"FROM ({_TREE_SQL}) t\nWHERE"))
def stream_feedback_tree(fx):
    """The same stream over files whose headers differ."""
    spark = fx.spark
    dst, ck = (scratch_path(spark, n) for n in ("fb_dst", "fb_ck"))
    ST.stream_feedback(spark, _mixed_log(fx), dst, ck, max_files_per_trigger=None).awaitTermination()
    return spark.read.parquet(f"{dst}/valid").drop("batch_id")


# -- O55 ---------------------------------------------------------------------------
_STREAM_SCHEMA = "row_key long, vendor string, description string, category string"


def _doc_stream(fx, name: str):
    """The documents in four micro-batches. A file with line ends in its cells is read by one
    task, so each batch has as many files as there are tasks."""
    spark = fx.spark
    src, tasks = scratch_path(spark, name), spark.sparkContext.defaultParallelism
    IO.write_csv(fx.labeled_text, src, files=4 * tasks)
    return (spark.readStream.options(header="true", escape='"', multiLine="true")
            .option("maxFilesPerTrigger", str(tasks)).schema(_STREAM_SCHEMA).csv(src))


@query("stream_train", Q.with_fixtures(["labeled_text"], _DOCS) + """
SELECT DISTINCT row_id FROM docs""")
def stream_train(fx):
    spark = fx.spark
    root = scratch_path(spark, "store")
    q = ST.stream_train(spark, _doc_stream(fx, "train_src"), root, scratch_path(spark, "train_ck"),
                        holdout=False)
    q.awaitTermination()
    return VersionedStore(spark, root).load_ledger(distinct=True)


def _class_by_class(fx):
    """A store trained by a stream whose micro-batches bring one class each, and then all
    rows again under upper-case spellings of the classes. Each batch is written in as many
    files as there are tasks; the stream then goes on from its checkpoint, so that one
    micro-batch reads them all and Spark splits them."""
    spark, src, root = fx.spark, scratch_path(fx.spark, "classes_src"), scratch_path(fx.spark, "store")
    docs, checkpoint = fx.labeled_text, scratch_path(fx.spark, "classes_ck")
    batches = [docs.filter(F.col("category") == r[0])
               for r in docs.select("category").distinct().orderBy("category").collect()]
    for batch in [*batches, docs.withColumn("category", F.upper("category"))]:
        batch.write.mode("append").parquet(src)
        stream = spark.readStream.schema(_STREAM_SCHEMA).parquet(src)
        ST.stream_train(spark, stream, root, checkpoint, holdout=False).awaitTermination()
    return VersionedStore(spark, root)


@query("stream_train_classes", Q.with_fixtures(["labeled_text"], _DOCS) + """
SELECT category, count(DISTINCT row_id) AS n_ids FROM docs WHERE length(text) > 0 GROUP BY category""")
def stream_train_classes(fx):
    """Classes of the model and learned rows of each: no class and no row is lost, and the
    other spellings add neither."""
    store = _class_by_class(fx)
    classes = store.read("model_classes", store.latest("model")["version"]).select("category")
    return (classes.join(store.load_training_rows(), "category", "left")
            .groupBy("category").agg(F.count("row_id").alias("n_ids")))


@query("stream_train_model", Q.with_fixtures(["labeled_text"], _DOCS, _steps_sql("docs", MD.STEPS_REFIT), _score_sql("docs")) + """
SELECT row_key, cls AS category FROM ranked_p WHERE rank = 1""")
def stream_train_model(fx):
    """Predictions of the model that saw its classes one by one: those of a refit on all rows."""
    model = _class_by_class(fx).load_latest_model()
    return MD.score_ovr(_docs(fx).select("row_key", "text"), model, keep_text=False).select("row_key", F.col("predicted").alias("category"))


# -- O56 ---------------------------------------------------------------------------
@query("stream_score", Q.with_fixtures(["labeled_text"], _DOCS, _step_sql("docs"), _score_sql("docs")) + """
SELECT row_key, cls AS category FROM ranked_p WHERE rank = 1""")
def stream_score(fx):
    spark = fx.spark
    store, _ = _published(fx)
    dst = scratch_path(spark, "score_dst")
    q = ST.stream_score(spark, _doc_stream(fx, "score_src"), dst, store.root,
                        scratch_path(spark, "score_ck"), key="row_key")
    q.awaitTermination()
    return spark.read.parquet(f"{dst}/scored").select("row_key", "category")


# -- O9 ----------------------------------------------------------------------------
from ..sources import synth as SY  # noqa: E402

_SYN_SEED, _SYN_AS_OF = 303, "2025-10-10"


def _sq(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _sql_list(vals) -> str:
    return "[" + ", ".join(_sq(v) if isinstance(v, str) else str(v) for v in vals) + "]"


def _synth_sql() -> str:
    def u(salt: str) -> str:
        return (f"(('0x' || substr(md5('{_SYN_SEED}:' || CAST(o_orderkey AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT"
                f" / 4294967296.0)")
    cats = SY.CATEGORIES
    vl = "[" + ", ".join(_sql_list(SY.VENDORS[c]) for c in cats) + f"][{u('cat_i')}]"
    dl = "[" + ", ".join(_sql_list(SY.DESCRIPTIONS[c]) for c in cats) + f"][{u('cat_i')}]"
    ci = f"CAST(floor({u('cat')} * {len(cats)}) AS INTEGER) + 1"
    vl, dl = vl.replace(u("cat_i"), "ci"), dl.replace(u("cat_i"), "ci")
    los = _sql_list([SY.AMOUNT_RANGES.get(c, SY.DEFAULT_RANGE)[0] for c in cats])
    his = _sql_list([SY.AMOUNT_RANGES.get(c, SY.DEFAULT_RANGE)[1] for c in cats])
    return f"""WITH base AS (
  SELECT o_orderkey, {ci} AS ci FROM orders),
parts AS (
  SELECT o_orderkey AS id, ci,
    {vl} AS vl, {dl} AS dl,
    {_sql_list(cats)}[ci] AS category,
    {los}[ci] AS lo, {his}[ci] AS hi
  FROM base),
picked AS (
  SELECT id, category, lo, hi,
    vl[CAST(floor({u('vendor').replace('o_orderkey', 'id')} * len(vl)) AS INTEGER) + 1] AS v0,
    dl[CAST(floor({u('desc').replace('o_orderkey', 'id')} * len(dl)) AS INTEGER) + 1] AS d0
  FROM parts),
shaped AS (
  SELECT id, category, lo, hi,
    CASE WHEN {u('suffix').replace('o_orderkey', 'id')} < {SY.VENDOR_SUFFIX_RATE}
         THEN v0 || ' #' || CAST(CAST(floor({u('suffix_n').replace('o_orderkey', 'id')} * 800) + 100 AS BIGINT) AS VARCHAR)
         ELSE v0 END AS vendor,
    d0
    || CASE WHEN {u('loc').replace('o_orderkey', 'id')} < {SY.LOCATION_RATE}
            THEN ' ' || {_sql_list(SY.LOCATIONS)}[CAST(floor({u('loc_w').replace('o_orderkey', 'id')} * {len(SY.LOCATIONS)}) AS INTEGER) + 1]
            ELSE '' END
    || CASE WHEN {u('mod').replace('o_orderkey', 'id')} < {SY.MODIFIER_RATE}
            THEN ' ' || {_sql_list(SY.MODIFIERS)}[CAST(floor({u('mod_w').replace('o_orderkey', 'id')} * {len(SY.MODIFIERS)}) AS INTEGER) + 1]
                 || ' #' || CAST(CAST(floor({u('mod_n').replace('o_orderkey', 'id')} * 9000) + 1000 AS BIGINT) AS VARCHAR)
            ELSE '' END AS t0
  FROM picked),
spaced AS (
  SELECT *, CASE WHEN {u('dbl').replace('o_orderkey', 'id')} < {SY.DOUBLE_SPACE_RATE}
    THEN (CASE WHEN len(string_split(t0, ' ')) > least(k, len(string_split(t0, ' ')) - 1) + 1
               THEN array_to_string(string_split(t0, ' ')[1:least(k, len(string_split(t0, ' ')) - 1) + 1], '  ')
                    || ' ' || array_to_string(string_split(t0, ' ')[least(k, len(string_split(t0, ' ')) - 1) + 2:len(string_split(t0, ' '))], ' ')
               ELSE array_to_string(string_split(t0, ' ')[1:least(k, len(string_split(t0, ' ')) - 1) + 1], '  ') END)
    ELSE t0 END AS t1
  FROM (SELECT *, CAST(floor({u('dbl_k').replace('o_orderkey', 'id')} * 3) + 1 AS INTEGER) AS k FROM shaped))
SELECT id, vendor,
  CASE WHEN {u('case').replace('o_orderkey', 'id')} < {SY.LOWER_RATE} THEN lower(t1)
       WHEN {u('case').replace('o_orderkey', 'id')} < {SY.LOWER_RATE + SY.TITLE_RATE} THEN {Q.title_words('lower(t1)')}
       ELSE t1 END AS description,
  category,
  DATE '{_SYN_AS_OF}' - CAST(floor({u('date').replace('o_orderkey', 'id')} * {SY.DAYS_BACK + 1}) AS INTEGER) AS date,
  CAST(CAST(lo * 100 + floor({u('amount').replace('o_orderkey', 'id')} * (hi - lo) * 100) AS DECIMAL(14,0)) / 100 AS DECIMAL(12,2)) AS amount
FROM spaced"""


@query("synthesize_balanced", f"""
SELECT id, {_sql_list(SY.CATEGORIES)}[CAST((pos - 1) % {len(SY.CATEGORIES)} AS INTEGER) + 1] AS category
FROM (SELECT o_orderkey AS id, row_number() OVER (
        ORDER BY md5('{_SYN_SEED}:' || CAST(o_orderkey AS VARCHAR) || ':deal'), o_orderkey) AS pos FROM orders)""")
def synthesize_balanced(fx):
    """Categories dealt in turn: equally many rows of each."""
    return SY.synthesize_expenses(fx.t.orders.select("o_orderkey"), "o_orderkey", _SYN_SEED, _SYN_AS_OF,
                                  balanced=True).select("id", "category")


@query("synthesize_expenses", _synth_sql())
def synthesize_expenses(fx):
    return SY.synthesize_expenses(fx.t.orders.select("o_orderkey"), "o_orderkey", _SYN_SEED, _SYN_AS_OF)
