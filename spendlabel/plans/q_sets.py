"""Phase 2 queries: set operations, joins and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import maintain as M
from ..operators import sets as S
from ..session import scratch_path
from ..sources.store import VersionedStore
from . import oracle as Q
from .catalog import query

_TEXT = Q.text_of()
_CAT = Q.clean_field("category")

_TV = """tv AS (
  SELECT vendor, description, chosen_cat AS category, 'user_label' AS source
  FROM user_labels WHERE chosen_cat IS NOT NULL
  UNION ALL
  SELECT vendor, description, category, 'seed' FROM expenses)"""


def _training_rows(fx):
    return S.training_view(fx.user_labels, fx.expenses)


# -- flagship: O11 -> O12 -> O29 -> counts ----------------------------------------
@query("training_view_summary", Q.with_fixtures(["expenses", "user_labels"], _TV) + f"""
SELECT {_CAT} AS category, source, count(*) AS n_rows,
       count(DISTINCT {Q.row_id_of(_TEXT, _CAT)}) AS n_ids
FROM tv GROUP BY 1, 2""")
def training_view_summary(fx):
    rows = C.with_row_id(C.build_text(_training_rows(fx)))
    return rows.groupBy("category", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_id").alias("n_ids"))


# -- O29 ---------------------------------------------------------------------------
@query("training_view", Q.with_fixtures(["expenses", "user_labels"], _TV) + """
SELECT vendor, description, category, source FROM tv""")
def training_view(fx):
    return _training_rows(fx)


# -- O29b --------------------------------------------------------------------------
@query("distinct_categories", Q.with_fixtures(["expenses"]) + """
SELECT DISTINCT category FROM expenses""")
def distinct_categories(fx):
    return S.distinct_categories(fx.expenses)


# -- O30 ---------------------------------------------------------------------------
def _train_csv(fx):
    e = fx.expenses
    return e.select(F.col("expense_date").cast("string").alias("Date"),
                    F.col("amount").cast("string").alias("Amount"),
                    F.col("vendor").alias("Vendor"), F.col("description").alias(" Description"),
                    F.col("category").alias("Category"))


_MERGE_SQL = Q.with_fixtures(["expenses", "feedback"], """
both_rows AS (
  SELECT coalesce(CAST(expense_date AS VARCHAR), '') AS date, coalesce(CAST(amount AS VARCHAR), '') AS amount,
         coalesce(vendor, '') AS vendor, coalesce(description, '') AS description,
         coalesce(category, '') AS category FROM expenses
  UNION ALL
  SELECT coalesce(date, ''), coalesce(amount, ''), coalesce(vendor, ''), coalesce(description, ''),
         coalesce(category, '') FROM feedback)""") + """
SELECT date, min(amount) AS amount, vendor, description, category
FROM both_rows
GROUP BY date, coalesce(CAST(TRY_CAST(amount AS DECIMAL(38,10)) AS VARCHAR), amount),
         vendor, description, category"""


@query("merge_feedback", _MERGE_SQL)
def merge_feedback(fx):
    fb = fx.feedback.drop("fb_id")
    return S.merge_feedback(_train_csv(fx), fb)


# -- O31 ---------------------------------------------------------------------------
@query("known_categories", Q.with_fixtures(["expenses", "feedback"]) + f"""
SELECT DISTINCT category FROM (
  SELECT category FROM expenses
  UNION ALL
  SELECT {Q.trim_ws("coalesce(category, '')")} FROM feedback
  WHERE length({Q.trim_ws("coalesce(category, '')")}) > 0) t""")
def known_categories(fx):
    classes = S.distinct_categories(fx.expenses)
    return S.known_categories(classes, fx.feedback)


# -- O23 ---------------------------------------------------------------------------
_LEDGER_SQL = f"""ledger AS (
  SELECT {Q.row_id_of(_TEXT, Q.clean_field('chosen_cat'))} AS row_id
  FROM user_labels WHERE source = 'confirm')"""


def _ledger(fx):
    lab = fx.user_labels.filter(F.col("source") == "confirm")
    return C.with_row_id(C.build_text(lab.withColumnRenamed("chosen_cat", "category"))).select("row_id")


@query("filter_unseen", Q.with_fixtures(["expenses", "user_labels"], _LEDGER_SQL) + f"""
SELECT expense_id, {Q.row_id_of(_TEXT, _CAT)} AS row_id FROM expenses
WHERE {Q.row_id_of(_TEXT, _CAT)} NOT IN (SELECT row_id FROM ledger)""")
def filter_unseen(fx):
    rows = C.with_row_id(C.build_text(fx.expenses)).select("expense_id", "row_id")
    return S.filter_unseen(rows, _ledger(fx))


# -- O24 ---------------------------------------------------------------------------
@query("new_labels", Q.with_fixtures(["expenses", "feedback"]) + """
SELECT DISTINCT category FROM feedback
WHERE category IS NOT NULL AND category NOT IN (SELECT category FROM expenses)""")
def new_labels(fx):
    classes = S.distinct_categories(fx.expenses)
    return S.new_labels(fx.feedback, classes)


# -- O25 ---------------------------------------------------------------------------
@query("get_or_create_repeated", Q.with_fixtures(["expenses", "feedback"], """
keys AS (SELECT DISTINCT vendor FROM (SELECT vendor FROM expenses UNION ALL SELECT vendor FROM feedback) t
         WHERE vendor IS NOT NULL)""") + """
SELECT k.vendor, min(s.s_suppkey) AS id, false AS created
FROM keys k JOIN supplier s ON s.s_name = k.vendor GROUP BY k.vendor
UNION ALL
SELECT vendor, (SELECT coalesce(max(s_suppkey), 0) + 1000 FROM supplier)
              + row_number() OVER (ORDER BY md5(vendor), vendor) AS id, true AS created
FROM keys WHERE vendor NOT IN (SELECT s_name FROM supplier)""")
def get_or_create_repeated(fx):
    """A dimension that holds every key twice."""
    dim = fx.t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("vendor"))
    incoming = fx.expenses.select("vendor").unionByName(fx.feedback.select("vendor"))
    return S.get_or_create(dim.unionByName(dim.withColumn("id", F.col("id") + 1000)), incoming, "vendor", "id")


@query("get_or_create", Q.with_fixtures(["expenses", "feedback"], """
keys AS (SELECT DISTINCT vendor FROM (SELECT vendor FROM expenses UNION ALL SELECT vendor FROM feedback) t
         WHERE vendor IS NOT NULL)""") + """
SELECT k.vendor, s.s_suppkey AS id, false AS created
FROM keys k JOIN supplier s ON s.s_name = k.vendor
UNION ALL
SELECT vendor, (SELECT coalesce(max(s_suppkey), 0) FROM supplier)
              + row_number() OVER (ORDER BY md5(vendor), vendor) AS id, true AS created
FROM keys WHERE vendor NOT IN (SELECT s_name FROM supplier)""")
def get_or_create(fx):
    dim = fx.t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("vendor"))
    incoming = fx.expenses.select("vendor").unionByName(fx.feedback.select("vendor"))
    return S.get_or_create(dim, incoming, "vendor", "id")


# -- O26 ---------------------------------------------------------------------------
_ACCENT = "CASE WHEN starts_with(category, 'ECONOMY') THEN 'É' || substr(category, 2) ELSE category END"
_DISPLAY = f"""disp AS (
  SELECT {Q.title_words('k')} AS category FROM (
    SELECT DISTINCT lower({Q.form_trim(f"coalesce({_ACCENT}, '')")}) AS k FROM expenses) t
  WHERE length(k) > 0)"""
# locale order of names of letters and spaces: letters, then accents, then case
_ORDER = "strip_accents(lower(category)), lower(category), category"
_QUERIES = f"""qs AS (
  SELECT DISTINCT lower({Q.form_trim('w')}) AS q FROM (
    SELECT unnest(string_split(category, ' ')) AS w FROM feedback
    UNION ALL SELECT unnest(['', 'e', 'É'])) t)"""


def _display(fx):
    """Display categories of the expenses, one family of them with an accent."""
    accent = F.when(F.col("category").startswith("ECONOMY"), F.concat(F.lit("É"), F.expr("substr(category, 2)")))
    return C.display_category(fx.expenses.withColumn("category", F.coalesce(accent, "category")), locale_order=False)


def _queries(fx):
    words = fx.feedback.select(F.explode(F.split("category", " ")).alias("q"))
    return words.unionByName(fx.spark.createDataFrame([("",), ("e",), ("É",)], "q string"))


@query("suggest_categories", Q.with_fixtures(["expenses", "feedback"], _DISPLAY, _QUERIES) + """
SELECT q, rank, category FROM (
  SELECT q, category, row_number() OVER (
           PARTITION BY q ORDER BY CASE WHEN starts_with(lower(category), q) THEN 0 ELSE 1 END,
                                   """ + _ORDER + """) AS rank
  FROM qs JOIN disp ON contains(lower(category), q) AND q <> '') t
WHERE rank <= 8
UNION ALL
SELECT q, rank, category FROM (SELECT '' AS q) e JOIN (
  SELECT category, row_number() OVER (ORDER BY """ + _ORDER + """) AS rank FROM disp) d
  ON rank <= 8
WHERE EXISTS (SELECT 1 FROM qs WHERE q = '')""")
def suggest_categories(fx):
    return S.suggest_categories(_queries(fx), _display(fx))


# -- O27 ---------------------------------------------------------------------------
@query("match_suggestion", Q.with_fixtures(["expenses", "feedback"], _DISPLAY, f"""
sug AS (SELECT {Q.normalized('category')} AS k, min(category) AS s FROM disp GROUP BY 1)""") + f"""
SELECT fb_id, coalesce(s, {Q.collapse_keep_case('category')}) AS category
FROM feedback LEFT JOIN sug ON sug.k = {Q.normalized('feedback.category')}""")
def match_suggestion(fx):
    return S.match_suggestion(fx.feedback, _display(fx)).select("fb_id", "category")


# -- O28 ---------------------------------------------------------------------------
@query("cascade_delete", Q.with_fixtures(["expenses", "user_labels_x"]) + """
SELECT id, expense_id FROM user_labels_x
WHERE expense_id IS NULL OR expense_id IN (SELECT expense_id FROM expenses)""")
def cascade_delete(fx):
    return S.cascade_delete(fx.user_labels_x, fx.expenses).select("id", "expense_id")


@query("cascade_delete_published", Q.with_fixtures(["expenses", "user_labels_x"]) + """
SELECT id, expense_id FROM user_labels_x
WHERE expense_id IS NULL OR expense_id IN (SELECT expense_id FROM expenses)""")
def cascade_delete_published(fx):
    """The rewritten label table as a committed version."""
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    store.publish_tables({"user_labels": S.cascade_delete(fx.user_labels_x, fx.expenses)}, "cascade_delete")
    return store.read_latest("user_labels", "cascade_delete").select("id", "expense_id")


# -- O33 ---------------------------------------------------------------------------
_USERS_SQL = """users AS (
  SELECT c_custkey AS id, c_name AS company, lower(c_name) || '@example.com' AS email FROM customer)"""


def _users(fx):
    c = fx.t.customer
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company"),
                    F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


_ST_COLS = "vendor, description, category, date_txt, amount_txt"


@query("import_expenses", Q.with_fixtures(["staging"], _USERS_SQL, f"""
numbered AS (
  SELECT {_ST_COLS},
         (SELECT coalesce(max(expense_id), 0) FROM expenses)
           + row_number() OVER (ORDER BY md5(concat_ws('|', {_ST_COLS})), {_ST_COLS}) AS expense_id
  FROM staging)""") + f"""
SELECT expense_id,
       (SELECT CAST(coalesce(min(CASE WHEN email = 'seed@system.local' THEN id END),
                             coalesce(max(id), 0) + 1) AS BIGINT) FROM users) AS user_id,
       {Q.staging_date('date_txt')} AS expense_date, {Q.staging_amount('amount_txt')} AS amount,
       vendor, description, category,
       ({Q.staging_date('date_txt')} IS NULL AND length({Q.trim_ws("coalesce(date_txt, '')")}) > 0) AS date_bad,
       ({Q.staging_amount('amount_txt')} IS NULL AND length({Q.trim_ws("coalesce(amount_txt, '')")}) > 0) AS amount_bad
FROM numbered""")
def import_expenses(fx):
    return M.import_expenses(fx.staging, fx.expenses, _users(fx))


# -- O34 / O51 ---------------------------------------------------------------------
def _move(fx):
    return M.move_rows(fx.expenses, F.col("category").startswith("PROMO"))


@query("move_rows", Q.with_fixtures(["expenses"]) + """
SELECT expense_id,
       CASE WHEN coalesce(starts_with(category, 'PROMO'), false) THEN 'moved' ELSE 'kept' END AS side,
       CASE WHEN coalesce(starts_with(category, 'PROMO'), false) THEN 'migrated_from_expenses' END AS source
FROM expenses""")
def move_rows(fx):
    kept, moved = _move(fx)
    return (kept.select("expense_id", F.lit("kept").alias("side"), F.lit(None).cast("string").alias("source"))
            .unionByName(moved.select("expense_id", F.lit("moved").alias("side"), "source")))


def _published_move(fx):
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    M.publish_move(store, fx.expenses, F.col("category").startswith("PROMO"))
    return store.read_latest("expenses", "move"), store.read_latest("seed_expenses", "move")


_SEED_COLS = "vendor, description, category, amount, expense_date"


@query("publish_move", Q.with_fixtures(["expenses"]) + f"""
SELECT 'expenses' AS side, expense_id AS id, {_SEED_COLS}, NULL AS source FROM expenses
WHERE NOT coalesce(starts_with(category, 'PROMO'), false)
UNION ALL
SELECT 'seed_expenses',
       row_number() OVER (ORDER BY md5(concat_ws('|', vendor, description, category, CAST(amount AS VARCHAR),
                                                 CAST(expense_date AS VARCHAR), 'migrated_from_expenses')), {_SEED_COLS}),
       {_SEED_COLS}, 'migrated_from_expenses' FROM expenses
WHERE coalesce(starts_with(category, 'PROMO'), false)""")
def publish_move(fx):
    """Both published tables, every column of the seed table included."""
    kept, seed = _published_move(fx)
    cols = [c.strip() for c in _SEED_COLS.split(",")]
    return (kept.select(F.lit("expenses").alias("side"), F.col("expense_id").alias("id"), *cols, F.lit(None).cast("string").alias("source"))
            .unionByName(seed.select(F.lit("seed_expenses").alias("side"), "id", *cols, "source")))


@query("reconcile_move", Q.with_fixtures(["expenses"]) + """
SELECT count(*) AS before,
       count(*) FILTER (WHERE NOT coalesce(starts_with(category, 'PROMO'), false)) AS kept,
       count(*) FILTER (WHERE coalesce(starts_with(category, 'PROMO'), false)) AS moved,
       sum(amount) AS amount_before,
       sum(amount) FILTER (WHERE NOT coalesce(starts_with(category, 'PROMO'), false)) AS amount_kept,
       sum(amount) FILTER (WHERE coalesce(starts_with(category, 'PROMO'), false)) AS amount_moved,
       true AS balanced
FROM expenses""")
def reconcile_move(fx):
    """Counts, amounts and content of what was read and of both published tables."""
    return M.reconcile_move(fx.expenses, *_published_move(fx))


_IMPORTED = Q.with_fixtures(["staging"], _USERS_SQL, f"""
seed AS (SELECT coalesce(min(CASE WHEN email = 'seed@system.local' THEN id END), coalesce(max(id), 0) + 1) AS id FROM users)""",
    f"""
numbered AS (
  SELECT {_ST_COLS},
         (SELECT coalesce(max(expense_id), 0) FROM expenses)
           + row_number() OVER (ORDER BY md5(concat_ws('|', {_ST_COLS})), {_ST_COLS}) AS expense_id
  FROM staging)""")


def _landed(fx):
    store = VersionedStore(fx.spark, scratch_path(fx.spark, "store"))
    M.publish_import(store, fx.staging, fx.expenses, _users(fx))
    return store.read_latest("expenses", "import"), store.read_latest("users", "import")


@query("publish_import", _IMPORTED + f"""
SELECT expense_id, CAST(user_id AS BIGINT) AS user_id, expense_date, amount, vendor FROM expenses
UNION ALL
SELECT expense_id, (SELECT CAST(id AS BIGINT) FROM seed), {Q.staging_date('date_txt')}, {Q.staging_amount('amount_txt')}, vendor
FROM numbered""")
def publish_import(fx):
    """Existing and imported rows read back from the committed version."""
    return _landed(fx)[0].select("expense_id", F.col("user_id").cast("long").alias("user_id"), "expense_date", "amount", "vendor")


@query("publish_import_users", _IMPORTED + """
SELECT CAST(id AS BIGINT) AS id, email FROM users
UNION ALL SELECT CAST((SELECT id FROM seed) AS BIGINT), 'seed@system.local'
WHERE NOT EXISTS (SELECT 1 FROM users WHERE email = 'seed@system.local')""")
def publish_import_users(fx):
    return _landed(fx)[1].select(F.col("id").cast("long").alias("id"), "email")


# -- O35 ---------------------------------------------------------------------------
@query("latest_label", Q.with_fixtures(["user_labels_x"]) + """
SELECT id, user_id, expense_id, chosen_cat, source FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, expense_id ORDER BY created_at DESC, id DESC) AS rn
  FROM user_labels_x WHERE user_id IS NOT NULL AND expense_id IS NOT NULL) t WHERE rn = 1
UNION ALL
SELECT id, user_id, expense_id, chosen_cat, source FROM user_labels_x
WHERE user_id IS NULL OR expense_id IS NULL""")
def latest_label(fx):
    return M.latest_label(fx.user_labels_x).select("id", "user_id", "expense_id", "chosen_cat", "source")
