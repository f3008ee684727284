"""Fixture views F1-F5 derived from the shared Parquet tables (see FIXTURES.md).

The shared tables carry no vendor / description / category columns, so the labelled
transaction views are derived from them with joins. Every view reads whole tables;
the work grows with the scale factor.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy access to ``{sf_dir}/{name}.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # F1 ---------------------------------------------------------------------------
    @cached_property
    def expenses(self) -> DataFrame:
        """One expense per order: its first supplier and part give vendor/description/
        category. The aggregate shuffles lineitem once on l_orderkey; the join with
        orders reuses that partitioning. Dimension joins are left to AQE (broadcast
        when the runtime size allows it, sort-merge otherwise)."""
        t = self.t
        first = (t.lineitem.groupBy("l_orderkey")
                 .agg(F.min("l_suppkey").alias("sk"), F.min("l_partkey").alias("pk")))
        df = (t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
              .join(first, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(t.supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("sk"))
              .join(t.part.select("p_partkey", "p_name", "p_brand", "p_type"),
                    F.col("p_partkey") == F.col("pk")))
        return df.select(
            F.col("o_orderkey").alias("expense_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").cast("date").alias("expense_date"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
            F.col("s_name").alias("vendor"),
            F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("description"),
            F.col("p_type").alias("category"),
        )

    # F2 ---------------------------------------------------------------------------
    @cached_property
    def labeled_text(self) -> DataFrame:
        """Documents as labelled rows: the language is the class (learnable). Scoring is a map
        over the scan's tasks, so a table of fewer files than cores is spread once here; a
        larger one is read as it is split."""
        docs = self.t.documents.select(
            F.col("doc_id").alias("row_key"), F.col("source").alias("vendor"),
            F.col("text").alias("description"), F.col("lang").alias("category"))
        cores = self.spark.sparkContext.defaultParallelism
        return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs

    # F3 ---------------------------------------------------------------------------
    @cached_property
    def staging(self) -> DataFrame:
        """Raw text columns as a CSV load would give them, with mixed date and
        amount spellings."""
        e = self.expenses
        k4 = F.pmod(F.col("expense_id"), F.lit(4))
        k3 = F.pmod(F.col("expense_id"), F.lit(3))
        amt = F.col("amount").cast("string")
        return e.select(
            "expense_id", "vendor", "description", "category",
            F.when(k4 == 1, F.date_format("expense_date", "M/d/yyyy"))
             .when(k4 == 2, F.lit("n/a"))
             .otherwise(F.col("expense_date").cast("string")).alias("date_txt"),
            F.when(k3 == 0, F.concat(F.lit("$"), amt))
             .when(k3 == 1, amt)
             .otherwise(F.concat(amt, F.lit(" CAD"))).alias("amount_txt"),
        )

    # F4 ---------------------------------------------------------------------------
    def _labels_base(self) -> DataFrame:
        e = self.expenses
        h = F.conv(F.substring(F.md5(F.col("expense_id").cast("string")), 1, 2), 16, 10).cast("int")
        corr = h < 51
        return e.select(
            F.col("expense_id").alias("id"), "user_id", "expense_id", "vendor", "description",
            F.when(corr, F.lit("REVIEW")).otherwise(F.col("category")).alias("chosen_cat"),
            F.col("category").alias("predicted"),
            F.when(corr, F.lit("correction")).otherwise(F.lit("confirm")).alias("source"),
            F.col("expense_date").cast("timestamp").alias("created_at"),
            "amount", "expense_date",
        )

    @cached_property
    def user_labels(self) -> DataFrame:
        return self._labels_base().drop("amount", "expense_date")

    @cached_property
    def user_labels_x(self) -> DataFrame:
        """F4x: NULL expense ids, second (newer) labels and orphan labels."""
        b = self.user_labels
        k = F.pmod(F.col("id"), F.lit(10))
        base = b.withColumn("expense_id", F.when(k == 5, F.lit(None).cast("long"))
                            .otherwise(F.col("expense_id")))
        tens = b.filter(k == 0)
        second = tens.select(
            (F.col("id") + 100000000).alias("id"), "user_id", "expense_id", "vendor",
            "description", F.col("predicted").alias("chosen_cat"), "predicted",
            F.lit("correction").alias("source"),
            (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
        orphan = tens.select(
            (F.col("id") + 200000000).alias("id"), "user_id",
            (F.col("expense_id") + 1000000000).alias("expense_id"), "vendor", "description",
            "chosen_cat", "predicted", "source", "created_at")
        return base.unionByName(second).unionByName(orphan)

    @cached_property
    def user_labels_bad(self) -> DataFrame:
        """F4y: F4x with cells that break every integrity rule, and missing predictions."""
        k = F.pmod(F.col("id"), F.lit(50))

        def gone(c: str, *at: int):
            return F.when(~k.isin(*at), F.col(c)).alias(c)
        return self.user_labels_x.select(
            "id", gone("user_id", 1), "expense_id", gone("vendor", 2), gone("description", 3), gone("chosen_cat", 4),
            gone("predicted", 6, 9), F.when(k == 7, F.lit("guess")).when(k != 5, F.col("source")).alias("source"),
            gone("created_at", 8))

    # F6 ---------------------------------------------------------------------------
    @cached_property
    def messy(self) -> DataFrame:
        """Expenses with Unicode spaces, missing and overlong cells, dates of other shapes and
        amounts that only look like numbers."""
        k, c = F.pmod(F.col("expense_id"), F.lit(8)), F.col
        date, amount = c("expense_date").cast("string"), c("amount").cast("string")
        return self.expenses.select(
            "expense_id",
            F.when(k == 0, F.concat(F.lit("\u00a0"), "vendor", F.lit("\u2003")))
             .when(k == 1, F.concat(F.lit("\x1c"), "vendor", F.lit("\x85")))
             .when(k == 2, F.concat(F.lit("\ufeff"), "vendor", F.lit("\t")))
             .when(k == 6, F.lit("")).otherwise(c("vendor")).alias("vendor"),
            F.when(k == 3, F.replace("description", F.lit(" "), F.lit("\u00a0\u2009")))
             .when(k == 5, F.repeat(F.concat("description", F.lit(" ")), 12))
             .when(k != 7, c("description")).alias("description"),
            F.when(k == 4, F.concat(F.lit("\u3000"), F.lower("category"), F.lit("\u2028")))
             .otherwise(c("category")).alias("category"),
            F.when(k == 0, F.lit("2025")).when(k == 1, F.lit("2025-08")).when(k == 2, F.concat(date, F.lit("Tjunk")))
             .otherwise(date).alias("date_txt"),
            F.when(k == 0, F.concat(amount, F.lit("d"))).when(k == 1, F.concat(amount, F.lit("f")))
             .when(k == 2, F.lit("1e2")).when(k == 3, F.lit("0x10")).when(k == 4, F.lit("\u00a01,234.567 "))
             .when(k == 5, F.lit("Infinity")).otherwise(amount).alias("amount_txt"))

    # F5 ---------------------------------------------------------------------------
    @cached_property
    def feedback(self) -> DataFrame:
        """Feedback log rows (all text) from corrections: lower-cased vendor,
        description and category, as the UI sends them."""
        b = self._labels_base().filter(F.col("source") == "correction")
        return b.select(
            F.col("expense_date").cast("string").alias("date"),
            F.col("amount").cast("string").alias("amount"),
            F.lower("vendor").alias("vendor"),
            F.lower("description").alias("description"),
            F.lower("predicted").alias("category"),
            F.lit("feedback_api").alias("source"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at_utc"),
            F.col("id").alias("fb_id"),
        )
