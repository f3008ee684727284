"""Versioned publish of model, ledger and training set.

Layout under a shared root (any path the cluster can reach):

    <root>/model_weights/v=<n>/    bucket, block, w[], g2[]       (block: 64 classes)
    <root>/model_classes/v=<n>/    class_id, category, intercept, intercept_g2
    <root>/ledger/v=<n>/           row_id, model_version, learned_at  (rows learned in n), bucketed by row_id
    <root>/training_rows/v=<n>/    row_id, category, weight, b[], x[]  (their sparse rows, for refits)
    <root>/training_set/v=<n>/     the merged training rows
    <root>/training_parts/v=<n>/part=<k>/  the parts of the training set that n rewrote, whole
    <root>/training_touched/v=<n>/ part  (the parts that n rewrote)
    <root>/holdout/v=<n>/          category, threshold  (labels first seen in n)
    <root>/run_metrics/v=<n>/      one row per run
    <root>/_manifest/              one row per committed version

Data of version n is written first; the manifest row is appended last. Readers see
only versions listed in the manifest, so a crash between the two leaves nothing
visible, and model, ledger delta and stream batch id become visible together.
Single writer per root is assumed.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sets as S
from ..operators.clean import bounded_broadcast
from ..operators.model import Model
from .files import path_exists
from .layout import IdTable, write_clustered

MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("n_buckets", T.IntegerType()),
    T.StructField("n_observed", T.LongType()),
    T.StructField("rows_trained", T.LongType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
])

CLASSES_SCHEMA = T.StructType([
    T.StructField("class_id", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("intercept_g2", T.DoubleType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType()),
    T.StructField("model_version", T.LongType()),
    T.StructField("learned_at", T.TimestampType()),
])


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str, ledger_buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.ledger = IdTable(spark, f"{self.root}/ledger", "row_id",
                              "row_id STRING, model_version BIGINT, learned_at TIMESTAMP", ledger_buckets)

    # -- manifest ------------------------------------------------------------------
    @property
    def manifest_path(self) -> str:
        return f"{self.root}/_manifest"

    def manifest(self) -> DataFrame:
        if not path_exists(self.spark, self.manifest_path):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(self.manifest_path)

    def latest(self, kind: str | None = None):
        """Newest committed manifest row (of ``kind``), or None."""
        m = self.manifest()
        if kind is not None:
            m = m.filter(F.col("kind") == kind)
        rows = m.orderBy(F.col("version").desc()).limit(1).collect()
        return rows[0] if rows else None

    def next_version(self) -> int:
        r = self.manifest().agg(F.max("version")).first()[0]
        return int(r or 0) + 1

    def has_batch(self, batch_id: int) -> bool:
        return self.manifest().filter(F.col("batch_id") == batch_id).limit(1).count() > 0

    def commit(self, version: int, kind: str, batch_id: int | None = None, n_buckets: int | None = None,
               n_observed: int | None = None, rows_trained: int | None = None,
               classes: list[str] | None = None) -> None:
        row = (version, kind, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), batch_id,
               n_buckets, n_observed, rows_trained, classes)
        (self.spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1)
         .write.mode("append").parquet(self.manifest_path))

    # -- tables --------------------------------------------------------------------
    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version}"

    def write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(self.path(name, version))

    def publish_tables(self, tables: dict[str, DataFrame], kind: str) -> int:
        """Write several tables under one new version, then commit it: readers see all of
        them or none."""
        v = self.next_version()
        for name, df in tables.items():
            self.write(df, name, v)
        self.commit(v, kind)
        return v

    def read_latest(self, name: str, kind: str) -> DataFrame:
        r = self.latest(kind)
        if r is None:
            raise LookupError(f"no {kind} under {self.root}")
        return self.read(name, r["version"])

    def read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(name, version))

    def committed_versions(self, kinds: tuple[str, ...]) -> DataFrame:
        return self.manifest().filter(F.col("kind").isin(*kinds)).select("version")

    # -- O5 ------------------------------------------------------------------------
    def write_training_set(self, df: DataFrame) -> int:
        v = self.next_version()
        self.write(df, "training_set", v)
        self.commit(v, "training_set")
        return v

    def read_training_set(self, version: int | None = None) -> DataFrame:
        if version is None:
            r = self.latest("training_set")
            if r is None:
                raise LookupError(f"no training set under {self.root}")
            version = r["version"]
        return self.read("training_set", version)

    # -- O30 by parts --------------------------------------------------------------
    def start_training_parts(self, train: DataFrame, parts: int = 256) -> int:
        """Write the whole training set (exact duplicates removed) in ``parts`` parts by a
        hash of the row. Each later merge rewrites the parts that its rows fall into."""
        return self._write_parts(S.merge_rows(S.as_text_frame(train)), parts, self.next_version())

    def _write_parts(self, rows: DataFrame, parts: int, v: int) -> int:
        dealt = S.with_part(rows, parts).repartition("part")
        dealt.write.mode("overwrite").partitionBy("part").parquet(self.path("training_parts", v))
        made = self.spark.read.parquet(self.path("training_parts", v)).select("part").distinct()
        self.write(made.select(F.col("part").cast("int"), F.lit(parts).alias("parts")).coalesce(1), "training_touched", v)
        self.commit(v, "training_parts")
        return v

    def _parts_held(self) -> DataFrame:
        """(part, v, parts): the version that holds each part; as many rows as parts."""
        held = self.spark.read.parquet(f"{self.root}/training_touched").join(
            self.committed_versions(("training_parts",)).select(F.col("version").alias("v")), "v", "left_semi")
        return held.groupBy("part").agg(F.max("v").alias("v"), F.max("parts").alias("parts"))

    def read_training_parts(self) -> DataFrame:
        """The training set as the last merge left it."""
        return self._training_parts().select(*S.FEEDBACK_KEEP)

    def _training_parts(self) -> DataFrame:
        """Of each part the newest committed version, with ``part``. Both partition columns are
        in the join, so older files are pruned."""
        if self.latest("training_parts") is None:
            raise LookupError(f"no training parts under {self.root}")
        held = F.broadcast(self._parts_held().select("part", "v"))
        return self.spark.read.parquet(f"{self.root}/training_parts").join(held, ["part", "v"], "left_semi").drop("v")

    def merge_training_parts(self, feedback: DataFrame) -> int | None:
        """Merge a batch of feedback (see ``merge_feedback``): only the parts its rows fall
        into are read and written. None, and nothing written, when there is none."""
        if feedback.isEmpty():
            return None
        parts = self._parts_held().agg(F.max("parts")).first()[0]
        new = S.merge_rows(S.as_text_frame(feedback))
        touched = F.broadcast(S.with_part(new, parts).select("part").distinct())
        old = self._training_parts().join(touched, "part", "left_semi").drop("part")
        return self._write_parts(S.merge_rows(old.unionByName(new)), parts, self.next_version())

    # -- O53 access paths ----------------------------------------------------------
    def publish_clustered(self, df: DataFrame, name: str, by: list[str], group_bytes: int = 16 << 20) -> int:
        """Publish ``df`` as table ``name`` clustered by ``by``; read with ``read_latest(name, name)``."""
        v = self.next_version()
        write_clustered(df, self.path(name, v), by, group_bytes)
        self.commit(v, name)
        return v

    # -- O43 thresholds ------------------------------------------------------------
    def load_holdout(self) -> DataFrame | None:
        """(category, threshold) of all labels split so far; None before the first."""
        if not path_exists(self.spark, f"{self.root}/holdout"):
            return None
        return self._committed("holdout", ("model", "holdout"))

    # -- O6 ------------------------------------------------------------------------
    def load_ledger(self, distinct: bool = False) -> DataFrame:
        """Row ids learned by committed model versions (empty when none), bucketed by id: an
        anti join moves the batch only. The version filter prunes partitions of uncommitted
        writes; it is a small broadcast (counted), which keeps the bucketing."""
        if not self.ledger.exists():
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        versions = self.committed_versions(("model", "ledger")).select(F.col("version").alias("v"))
        led = self.ledger.read().join(bounded_broadcast(versions), "v", "left_semi").drop("v")
        return led.select("row_id").distinct() if distinct else led

    def write_ledger(self, learned: DataFrame, version: int) -> None:
        self.ledger.write(learned.select("row_id", F.lit(version).cast("long").alias("model_version"),
                                         F.current_timestamp().alias("learned_at")), version)

    def _committed(self, name: str, kinds: tuple[str, ...]) -> DataFrame:
        """Rows of table ``name`` whose version is committed. A semi join on the
        partition column (dynamic partition pruning), so the version list is never
        collected however many versions a long-running stream commits."""
        versions = self.committed_versions(kinds).select(F.col("version").alias("v"))
        return (self.spark.read.parquet(f"{self.root}/{name}")
                .join(versions, "v", "left_semi").drop("v"))

    def load_training_rows(self) -> DataFrame:
        """All rows committed model versions have learned from (empty when none)."""
        if not path_exists(self.spark, f"{self.root}/training_rows"):
            return self.spark.createDataFrame([], "row_id string, category string, weight long, b array<int>, x array<double>")
        return self._committed("training_rows", ("model",))

    def append_ledger(self, learned: DataFrame) -> int:
        """Record row ids as learned without a model change (own version)."""
        v = self.next_version()
        self.write_ledger(learned, v)
        self.commit(v, "ledger")
        return v

    # -- O7 ------------------------------------------------------------------------
    def publish_model(self, model: Model, learned: DataFrame | None = None,
                      batch_id: int | None = None, metrics: DataFrame | None = None,
                      holdout: DataFrame | None = None) -> int:
        """Write weights, classes, the ledger delta, run metrics and the ``holdout`` thresholds
        of new labels under a new version, then commit the manifest row. Returns the version."""
        v = self.next_version()
        self.write(model.weights.select("bucket", "block", "w", "g2"), "model_weights", v)
        classes = self.spark.createDataFrame(
            [(i, c, float(b), float(q)) for i, (c, b, q) in
             enumerate(zip(model.classes, model.intercept, model.intercept_g2))], CLASSES_SCHEMA)
        self.write(classes.coalesce(1), "model_classes", v)
        if learned is not None:
            self.write_ledger(learned, v)
            if {"category", "weight", "b", "x"} <= set(learned.columns):
                self.write(learned.select("row_id", "category", "weight", "b", "x"), "training_rows", v)
        if holdout is not None:
            self.write(holdout, "holdout", v)
        if metrics is not None:
            self.write(metrics.withColumn("version", F.lit(v).cast("long")).coalesce(1), "run_metrics", v)
        self.commit(v, "model", batch_id=batch_id, n_buckets=1 << model.bits, n_observed=model.n_observed,
                    rows_trained=model.rows_trained, classes=list(model.classes))
        return v

    # -- O8 ------------------------------------------------------------------------
    def load_latest_model(self) -> Model:
        r = self.latest("model")
        if r is None:
            raise LookupError(f"no model under {self.root}")
        return self.load_model(r)

    def load_model(self, r) -> Model:
        v = r["version"]
        cls = sorted(self.read("model_classes", v).collect(), key=lambda x: x["class_id"])
        bits = int(r["n_buckets"]).bit_length() - 1
        return Model(classes=[c["category"] for c in cls], weights=self.read("model_weights", v),
                     intercept=[c["intercept"] for c in cls], intercept_g2=[c["intercept_g2"] for c in cls],
                     bits=bits, n_observed=r["n_observed"], rows_trained=r["rows_trained"] or 0, version=v)

    def run_metrics(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.root}/run_metrics"):
            raise LookupError("no run metrics")
        return self._committed("run_metrics", ("model",))
