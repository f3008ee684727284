"""Phase 1 queries: cleaning, typing, filters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import validate as V
from . import oracle as Q
from .catalog import query

_TEXT = Q.text_of()

# -- O11 ---------------------------------------------------------------------------
@query("build_text", Q.with_fixtures(["expenses"]) + f"""
SELECT expense_id, {Q.clean_field('vendor')} AS vendor, {Q.clean_field('description')} AS description,
       {Q.clean_field('category')} AS category, {_TEXT} AS text
FROM expenses""")
def build_text(fx):
    return C.build_text(fx.expenses).select("expense_id", "vendor", "description", "category", "text")


@query("build_text_messy", Q.with_fixtures(["messy"]) + f"""
SELECT expense_id, {Q.clean_field('vendor')} AS vendor, {Q.clean_field('description')} AS description,
       {Q.clean_field('category')} AS category, {_TEXT} AS text,
       {Q.row_id_of(_TEXT, Q.clean_field('category'))} AS row_id
FROM messy""")
def build_text_messy(fx):
    return C.with_row_id(C.build_text(fx.messy)).select("expense_id", "vendor", "description", "category", "text", "row_id")


# -- O12 ---------------------------------------------------------------------------
@query("row_id", Q.with_fixtures(["expenses"]) + f"""
SELECT expense_id, {Q.row_id_of(_TEXT, Q.clean_field('category'))} AS row_id FROM expenses""")
def row_id(fx):
    return C.with_row_id(C.build_text(fx.expenses)).select("expense_id", "row_id")


# -- O13 ---------------------------------------------------------------------------
@query("normalize_text", Q.with_fixtures(["feedback"]) + f"""
SELECT fb_id, {Q.normalized('vendor')} AS vendor, {Q.normalized('description')} AS description,
       {Q.normalized('category')} AS category FROM feedback""")
def normalize_text(fx):
    return C.normalize_text(fx.feedback, ["vendor", "description", "category"]).select(
        "fb_id", "vendor", "description", "category")


@query("normalize_text_messy", Q.with_fixtures(["messy"]) + f"""
SELECT expense_id, {Q.normalized('vendor')} AS vendor, {Q.normalized('description')} AS description,
       {Q.normalized('category')} AS category FROM messy""")
def normalize_text_messy(fx):
    return C.normalize_text(fx.messy, ["vendor", "description", "category"]).select(
        "expense_id", "vendor", "description", "category")


# -- O14 ---------------------------------------------------------------------------
@query("parse_staging", Q.with_fixtures(["staging"]) + f"""
SELECT expense_id, {Q.staging_date('date_txt')} AS expense_date,
       {Q.staging_amount('amount_txt')} AS amount,
       ({Q.staging_date('date_txt')} IS NULL AND length({Q.trim_ws("coalesce(date_txt, '')")}) > 0) AS date_bad,
       ({Q.staging_amount('amount_txt')} IS NULL AND length({Q.trim_ws("coalesce(amount_txt, '')")}) > 0) AS amount_bad
FROM staging""")
def parse_staging(fx):
    return C.parse_staging(fx.staging).select("expense_id", "expense_date", "amount",
                                               "date_bad", "amount_bad")


# -- O15 ---------------------------------------------------------------------------
@query("coerce_amount", Q.with_fixtures(["staging"]) + f"""
SELECT expense_id, {Q.form_amount('amount_txt')} AS amount_num,
       coalesce({Q.form_amount('amount_txt')} > 0 AND NOT isnan({Q.form_amount('amount_txt')})
                AND {Q.form_amount('amount_txt')} < 'inf'::DOUBLE, false) AS amount_ok,
       strftime({Q.iso_date('date_txt')}, '%Y-%m-%d') AS date_iso
FROM staging""")
def coerce_amount(fx):
    return C.coerce_amount(fx.staging, "amount_txt", "date_txt").select(
        "expense_id", "amount_num", "amount_ok", "date_iso")


def _coerce_sql(src: str) -> str:
    amt = Q.form_amount("amount_txt")
    return f"""
SELECT expense_id, {amt} AS amount_num,
       coalesce({amt} > 0 AND NOT isnan({amt}) AND {amt} < 'inf'::DOUBLE, false) AS amount_ok,
       strftime({Q.iso_date('date_txt')}, '%Y-%m-%d') AS date_iso
FROM {src}"""


@query("coerce_amount_messy", Q.with_fixtures(["messy"]) + _coerce_sql("messy"))
def coerce_amount_messy(fx):
    return C.coerce_amount(fx.messy, "amount_txt", "date_txt").select("expense_id", "amount_num", "amount_ok", "date_iso")


# -- O16 ---------------------------------------------------------------------------
@query("display_category", Q.with_fixtures(["feedback"]) + f"""
SELECT {Q.title_words('k')} AS category FROM (
  SELECT DISTINCT lower({Q.trim_ws("coalesce(category, '')")}) AS k FROM feedback) t
WHERE length(k) > 0""")
def display_category(fx):
    return C.display_category(fx.feedback)


# -- O17 ---------------------------------------------------------------------------
_CANON_INPUT = """canon_in AS (
  SELECT CAST(expense_id AS VARCHAR) AS rk, category FROM expenses
  UNION ALL SELECT 'f' || CAST(fb_id AS VARCHAR), category FROM feedback)"""


@query("canonicalize_category", Q.with_fixtures(["expenses", "feedback"], _CANON_INPUT, f"""
counted AS (SELECT {Q.normalized('category')} AS key, category AS spelling, count(*) AS n
            FROM canon_in WHERE length({Q.normalized('category')}) > 0 GROUP BY 1, 2)""", """
canon AS (SELECT key, arg_min(spelling, (-n, spelling)) AS canonical FROM counted GROUP BY key)""") + f"""
SELECT rk, coalesce(canonical, category) AS category
FROM canon_in LEFT JOIN canon ON canon.key = {Q.normalized('canon_in.category')}""")
def canonicalize_category(fx):
    src = (fx.expenses.select(F.col("expense_id").cast("string").alias("rk"), "category")
           .unionByName(fx.feedback.select(
               F.concat(F.lit("f"), F.col("fb_id").cast("string")).alias("rk"), "category")))
    return C.canonicalize_category(src).select("rk", "category")


# -- O18 ---------------------------------------------------------------------------
@query("stamp_provenance", Q.with_fixtures(["expenses"]) + """
SELECT expense_id, vendor, description, category, 'seed' AS source FROM expenses""")
def stamp_provenance(fx):
    return C.stamp_provenance(fx.expenses, "seed", with_time=False).select(
        "expense_id", "vendor", "description", "category", "source")


# -- O10 ---------------------------------------------------------------------------
@query("conform_columns", Q.with_fixtures(["expenses"]) + """
SELECT expense_id, vendor, description, category FROM expenses""")
def conform_columns(fx):
    raw = fx.expenses.select(
        F.col("expense_id").alias(" Expense_ID"), F.col("vendor").alias("\ufeffSupplier"),
        F.col("description").alias("MEMO "), F.col("category").alias("Label"))
    return C.conform_columns(raw).select("expense_id", "vendor", "description", "category")


# -- O19 ---------------------------------------------------------------------------
@query("drop_empty", Q.with_fixtures(["expenses", "feedback"], f"""
rows_in AS (
  SELECT CAST(expense_id AS VARCHAR) AS rk, vendor, description, category FROM expenses
  UNION ALL SELECT 'f' || CAST(fb_id AS VARCHAR), vendor, '', NULL FROM feedback
  UNION ALL SELECT 'g' || CAST(fb_id AS VARCHAR), NULL, '  ', category FROM feedback)""") + f"""
SELECT rk, {_TEXT} AS text, {Q.clean_field('category')} AS category FROM rows_in
WHERE length({_TEXT}) > 0 AND length({Q.clean_field('category')}) > 0""")
def drop_empty(fx):
    fb = fx.feedback
    rows = (fx.expenses.select(F.col("expense_id").cast("string").alias("rk"), "vendor",
                               "description", "category")
            .unionByName(fb.select(F.concat(F.lit("f"), F.col("fb_id").cast("string")).alias("rk"),
                                   "vendor", F.lit("").alias("description"),
                                   F.lit(None).cast("string").alias("category")))
            .unionByName(fb.select(F.concat(F.lit("g"), F.col("fb_id").cast("string")).alias("rk"),
                                   F.lit(None).cast("string").alias("vendor"),
                                   F.lit("  ").alias("description"), "category")))
    return V.drop_empty(C.build_text(rows)).select("rk", "text", "category")


# -- O20 ---------------------------------------------------------------------------
@query("labeled_only", Q.with_fixtures(["user_labels"]) + """
SELECT id, user_id, chosen_cat FROM user_labels WHERE chosen_cat IS NOT NULL""")
def labeled_only(fx):
    return V.labeled_only(fx.user_labels).select("id", "user_id", "chosen_cat")


@query("for_user", Q.with_fixtures(["user_labels"]) + """
SELECT id, expense_id, chosen_cat FROM user_labels WHERE user_id = 10""")
def for_user(fx):
    return V.for_user(fx.user_labels, 10).select("id", "expense_id", "chosen_cat")


# -- O21 ---------------------------------------------------------------------------
def _form_reasons_sql() -> str:
    amt = Q.form_amount("amount_txt")
    d = Q.staging_date("date_txt")
    nv, nd, nc = Q.normalized("vendor"), Q.normalized("description"), Q.normalized("category")
    rules = [
        (f"{d} IS NULL", "date_missing"),
        (f"NOT coalesce({amt} >= 0.01 AND NOT isnan({amt}) AND {amt} < 'inf'::DOUBLE, false)",
         "amount_invalid"),
        ("length(coalesce(amount_txt, '')) > 12", "amount_too_long"),
        (f"length({nv}) < 3 OR length(coalesce(vendor, '')) > 30", "vendor_length"),
        (f"length({nd}) < 3 OR length(coalesce(description, '')) > 255", "description_length"),
        (f"length({nc}) < 1 OR length(coalesce(category, '')) > 30", "category_length"),
    ]
    items = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


@query("validate_expenses", Q.with_fixtures(["staging"]) + f"""
SELECT expense_id, len(r) = 0 AS valid, array_to_string(r, ',') AS reasons
FROM (SELECT expense_id, {_form_reasons_sql()} AS r FROM staging) t""")
def validate_expenses(fx):
    checked = V.with_reasons(C.parse_staging(fx.staging), "form",
                             amount_text="amount_txt", date_value="expense_date")
    return checked.select("expense_id", (F.size("reasons") == 0).alias("valid"),
                          F.array_join("reasons", ",").alias("reasons"))


def _split_sql(src: str, reasons: str) -> str:
    return f"""
SELECT expense_id, CASE WHEN len(r) = 0 THEN 'valid' ELSE 'rejected' END AS side, array_to_string(r, ',') AS reasons
FROM (SELECT expense_id, {reasons} AS r FROM {src}) t"""


def _listed(rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in rules) + "], lambda x: x IS NOT NULL)"


_API_RULES = [(f"length(coalesce({c}, '')) < 1", f"{c}_missing") for c in ("vendor", "description", "category")]
_STORAGE_RULES = [(f"length(coalesce({c}, '')) > {n}", f"{c}_too_long")
                  for c, n in (("vendor", 255), ("description", 255), ("category", 100))]


def _both_sides(df, profile: str, **kw):
    """The (valid, rejected) split put together again."""
    valid, rejected = V.validate_expenses(df, profile, **kw)
    return (valid.select("expense_id", F.lit("valid").alias("side"), F.lit("").alias("reasons"))
            .unionByName(rejected.select("expense_id", F.lit("rejected").alias("side"), F.array_join("reasons", ",").alias("reasons"))))


@query("validate_split", Q.with_fixtures(["messy"]) + _split_sql("messy", _form_reasons_sql()))
def validate_split(fx):
    return _both_sides(C.parse_staging(fx.messy), "form", amount_text="amount_txt", date_value="expense_date")


@query("validate_api", Q.with_fixtures(["messy"]) + _split_sql("messy", _listed(_API_RULES)))
def validate_api(fx):
    return _both_sides(fx.messy, "api")


@query("validate_storage", Q.with_fixtures(["messy"]) + _split_sql("messy", _listed(_STORAGE_RULES)))
def validate_storage(fx):
    return _both_sides(fx.messy, "storage")


# -- O22 ---------------------------------------------------------------------------
_INTEGRITY = """
counts AS (
  SELECT 'not_null_user_id' AS rule, CAST(count(*) FILTER (WHERE user_id IS NULL) AS BIGINT) AS violations FROM user_labels_x
  UNION ALL SELECT 'not_null_vendor', CAST(count(*) FILTER (WHERE vendor IS NULL) AS BIGINT) FROM user_labels_x
  UNION ALL SELECT 'not_null_description', CAST(count(*) FILTER (WHERE description IS NULL) AS BIGINT) FROM user_labels_x
  UNION ALL SELECT 'not_null_chosen_cat', CAST(count(*) FILTER (WHERE chosen_cat IS NULL) AS BIGINT) FROM user_labels_x
  UNION ALL SELECT 'not_null_source', CAST(count(*) FILTER (WHERE source IS NULL) AS BIGINT) FROM user_labels_x
  UNION ALL SELECT 'not_null_created_at', CAST(count(*) FILTER (WHERE created_at IS NULL) AS BIGINT) FROM user_labels_x
  UNION ALL SELECT 'source_in_confirm_correction',
         CAST(count(*) FILTER (WHERE source IS NOT NULL AND source NOT IN ('confirm', 'correction')) AS BIGINT) FROM user_labels_x
  UNION ALL SELECT 'unique_user_expense', CAST(count(*) AS BIGINT) FROM (
         SELECT user_id, expense_id FROM user_labels_x WHERE expense_id IS NOT NULL
         GROUP BY 1, 2 HAVING count(*) > 1) d
  UNION ALL SELECT 'expense_exists', CAST(count(*) AS BIGINT) FROM user_labels_x l
         WHERE expense_id IS NOT NULL
           AND NOT EXISTS (SELECT 1 FROM expenses e WHERE e.expense_id = l.expense_id))"""
_VIOLATED = """
SELECT rule, violations FROM counts WHERE violations > 0"""


@query("integrity_report", Q.with_fixtures(["expenses", "user_labels_x"], _INTEGRITY) + _VIOLATED)
def integrity_report(fx):
    return V.integrity_report(fx.user_labels_x, fx.expenses)


@query("integrity_report_bad", Q.with_fixtures(
    ["expenses", "user_labels_bad"], _INTEGRITY.replace("user_labels_x", "user_labels_bad")) + _VIOLATED)
def integrity_report_bad(fx):
    """Every rule is broken in this fixture."""
    return V.integrity_report(fx.user_labels_bad, fx.expenses)
