"""Files laid out for the reads that follow: bucketed by id, clustered by range."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import path_exists


class IdTable:
    """Parquet below ``path``: one partition ``v`` a version, bucketed and sorted by ``key``.

    A join on ``key`` reads each bucket where it lies, so only the other side is exchanged.
    Spark keeps bucketing in its catalog; the folder is registered there as an external
    table by every session that opens it. The number of buckets is fixed by the first write
    and stands beside the data; choose it for the size the table grows to (a bucket is one
    task of a join).
    """

    def __init__(self, spark: SparkSession, path: str, key: str, columns: str, buckets: int | None = None):
        self.spark, self.path, self.key, self.columns = spark, path, key, columns
        self.wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"spendlabel_{hashlib.md5(path.encode()).hexdigest()[:16]}"
        self.layout = f"{path}_layout"

    def exists(self) -> bool:
        return path_exists(self.spark, self.layout)

    def _open(self) -> int:
        """Register the folder with its committed layout and the partitions it has by now."""
        n = self.spark.read.schema("buckets int").parquet(self.layout).first()["buckets"]
        where = self.path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}, v BIGINT) USING parquet "
                       f"OPTIONS ('partitionOverwriteMode' = 'dynamic') PARTITIONED BY (v) "
                       f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {n} BUCKETS LOCATION '{where}'")
        return n

    def write(self, rows: DataFrame, version: int) -> None:
        """Replace the partition of ``version``: what a failed write left there is gone. The
        rows may come from earlier versions of this table (only the new partition is touched)."""
        if not self.exists():
            self.spark.createDataFrame([(self.wanted,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(self.layout)
        n = self._open()
        names = [c.split()[0] for c in self.columns.split(", ")]
        rows = rows.select(*names)
        if path_exists(self.spark, f"{self.path}/v={version}") and rows.isEmpty():  # a dynamic overwrite would leave it
            none = self.spark.createDataFrame([], rows.schema)
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (v = {int(version)}) SELECT * FROM {{none}}", none=none)
            return
        rows = rows.repartition(n, self.key).withColumn("v", F.lit(version).cast("long"))
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (v) SELECT * FROM {{rows}}", rows=rows)

    def read(self) -> DataFrame:
        """All versions, committed or not, with ``v``."""
        self._open()
        if path_exists(self.spark, self.path):
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        return self.spark.table(self.name)


def write_clustered(df: DataFrame, path: str, by: Sequence[str], group_bytes: int = 16 << 20) -> None:
    """Parquet files that follow each other in the order of ``by``, sorted inside, in row
    groups of ``group_bytes``: a predicate on a beginning of ``by`` skips the files and groups
    outside it by their statistics. Ranges are cut from a sample, so a value that holds many
    rows is spread over files by the later columns."""
    (df.repartitionByRange(*by).sortWithinPartitions(*by)
     .write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path))
