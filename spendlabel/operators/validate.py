"""Filters, predicates and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import form_amount
from ..functions.text import normalized
from .model import stored_with

# The length limits enforced by the entry form, the API and storage.
FORM_LIMITS = {
    "vendor": (3, 30),
    "description": (3, 255),
    "category": (1, 30),
    "amount_max_chars": 12,
    "amount_min": 0.01,
}
STORAGE_LIMITS = {"vendor": 255, "description": 255, "category": 100}
LABEL_SOURCES = ("confirm", "correction")


def drop_empty(df: DataFrame, text: str = "text", category: str = "category") -> DataFrame:
    """Keep rows with non-empty text and category (run after ``build_text``)."""
    return df.filter((F.length(F.col(text)) > 0) & (F.length(F.coalesce(F.col(category), F.lit(""))) > 0))


def labeled_only(df: DataFrame, col: str = "chosen_cat") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def for_user(df: DataFrame, user_id, col: str = "user_id") -> DataFrame:
    return df.filter(F.col(col) == F.lit(user_id))


def _len(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit("")))


def _rules(profile: str, amount_text: str, date_value: str) -> list[tuple[Column, str]]:
    if profile == "form":
        amt = form_amount(amount_text)
        lim = FORM_LIMITS
        ok_amt = F.coalesce((amt >= lim["amount_min"]) & ~F.isnan(amt) & (amt < F.lit(float("inf"))),
                            F.lit(False))
        return [
            (F.col(date_value).isNull(), "date_missing"),
            (~ok_amt, "amount_invalid"),
            (_len(amount_text) > lim["amount_max_chars"], "amount_too_long"),
            ((F.length(normalized("vendor")) < lim["vendor"][0]) | (_len("vendor") > lim["vendor"][1]),
             "vendor_length"),
            ((F.length(normalized("description")) < lim["description"][0])
             | (_len("description") > lim["description"][1]), "description_length"),
            ((F.length(normalized("category")) < lim["category"][0])
             | (_len("category") > lim["category"][1]), "category_length"),
        ]
    if profile == "api":
        return [((_len(c) < 1), f"{c}_missing") for c in ("vendor", "description", "category")]
    if profile == "storage":
        return [((_len(c) > n), f"{c}_too_long") for c, n in STORAGE_LIMITS.items()]
    raise ValueError(f"unknown profile {profile!r}")


def with_reasons(df: DataFrame, profile: str = "form", amount_text: str = "amount_txt",
                 date_value: str = "expense_date") -> DataFrame:
    """Add ``reasons``: the array of violated rule names (empty when valid). One
    projection, no shuffle."""
    rules = _rules(profile, amount_text, date_value)
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules])))


def validate_expenses(df: DataFrame, profile: str = "form", **kw) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected); rejected rows keep their ``reasons``.

    The rows are checked once, into a scratch table that both sides are read from."""
    checked, _ = stored_with(with_reasons(df, profile, **kw), "checked")
    valid = checked.filter(F.size("reasons") == 0).drop("reasons")
    rejected = checked.filter(F.size("reasons") > 0)
    return valid, rejected


def integrity_report(labels: DataFrame, expenses: DataFrame) -> DataFrame:
    """One row per violated rule of the label table with the number of violations:
    NOT NULL columns, the source check, one label per (user_id, expense_id) (NULL
    expense ids never collide) and the foreign key to expenses."""
    not_null = ["user_id", "vendor", "description", "chosen_cat", "source", "created_at"]
    one = labels.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"not_null_{c}") for c in not_null],
        F.count_if(F.col("source").isNotNull() & ~F.col("source").isin(*LABEL_SOURCES))
         .alias("source_in_confirm_correction"))
    names = [f"not_null_{c}" for c in not_null] + ["source_in_confirm_correction"]
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in names
    ])).alias("s")).select("s.*")
    dup = (labels.filter(F.col("expense_id").isNotNull())
           .groupBy("user_id", "expense_id").count().filter(F.col("count") > 1)
           .agg(F.count(F.lit(1)).alias("violations"))
           .select(F.lit("unique_user_expense").alias("rule"), "violations"))
    orphans = (labels.filter(F.col("expense_id").isNotNull()).select("expense_id")
               .join(expenses.select("expense_id"), "expense_id", "left_anti")
               .agg(F.count(F.lit(1)).alias("violations"))
               .select(F.lit("expense_exists").alias("rule"), "violations"))
    return stacked.unionByName(dup).unionByName(orphans).filter(F.col("violations") > 0)
