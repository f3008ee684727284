"""Run, quality and usage metrics (O50, O52, O53). Evaluation and per-class metrics
(O44, O49) live with the model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_metrics(rows: DataFrame, ledger: DataFrame, text: str = "text",
                category: str = "category", id_col: str = "row_id") -> DataFrame:
    """One row for a run: rows read, valid rows, distinct ids, rows not yet in the
    ledger, classes. Copies of a row id are merged first (map-side, one small row each);
    the join with the ledger and the totals then see every id once."""
    valid = (F.length(F.coalesce(F.col(text), F.lit(""))) > 0) & (F.length(F.coalesce(F.col(category), F.lit(""))) > 0)
    ids = rows.groupBy(id_col, category).agg(F.count(F.lit(1)).alias("__n"), F.count_if(valid).alias("__v"))
    seen = ledger.select(id_col).distinct().withColumn("__seen", F.lit(True))
    flagged = ids.join(seen, id_col, "left")
    per_class = flagged.groupBy(category).agg(
        F.sum("__n").alias("__n"), F.sum("__v").alias("__v"), F.count(F.lit(1)).alias("__ids"),
        F.coalesce(F.sum(F.when(F.col("__seen").isNull(), F.col("__n"))), F.lit(0)).alias("__new"))
    return per_class.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_read"), F.coalesce(F.sum("__v"), F.lit(0)).alias("rows_valid"),
        F.coalesce(F.sum("__ids"), F.lit(0)).alias("distinct_ids"), F.coalesce(F.sum("__new"), F.lit(0)).alias("rows_new"),
        F.count(category).alias("classes"))


def acceptance_rate(labels: DataFrame, by: Sequence[str], predicted: str = "predicted",
                    chosen: str = "chosen_cat") -> DataFrame:
    """Share of labels where the prediction was accepted, per group. A label without a
    prediction counts and is not accepted."""
    hit = F.coalesce(F.col(predicted) == F.col(chosen), F.lit(False))
    return labels.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), F.avg(hit.cast("double")).alias("acceptance"))


def user_timeline(labels: DataFrame, n: int, user: str = "user_id",
                  order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Newest ``n`` labels of every user (``rank`` 1 = newest). The row_number <= n
    filter is planned as a partial top-n before the shuffle, so a user holding a
    large share of the labels sends at most n rows per map task."""
    w = Window.partitionBy(user).orderBy(*[F.col(o).desc() for o in order])
    return (labels.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("long")))


def user_expenses(expenses: DataFrame, user_id, lo, hi, user: str = "user_id",
                  date: str = "expense_date") -> DataFrame:
    """Expenses of one user in a date range: both predicates reach the Parquet scan
    (row-group skipping when files are clustered by user and date)."""
    return expenses.filter((F.col(user) == F.lit(user_id)) & F.col(date).between(F.lit(lo), F.lit(hi)))


def labels_of(labels: DataFrame, ids: DataFrame, key: str = "expense_id") -> DataFrame:
    """Labels of the given expenses (semi join; ids are not collected)."""
    return labels.join(ids.select(key), key, "left_semi")
