"""CSV sources and sinks (O1-O4). Everything stays text on read; typing happens in
the cleaning operators so that bad cells are quarantined, not fatal."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FORM_WS

# Column order of the staging load and of the feedback log.
STAGING_FIELDS = ("vendor", "description", "category", "date_txt", "amount_txt")
FEEDBACK_FIELDS = ("date", "amount", "vendor", "description", "category", "source", "created_at_utc")
FEEDBACK_SOURCE = "feedback_api"

STAGING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in STAGING_FIELDS])
FEEDBACK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in FEEDBACK_FIELDS])

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_CSV_OPTS = {"header": "true", "escape": '"', "encoding": "UTF-8"}


def _options(multi_line: bool) -> dict[str, str]:
    """``multi_line`` (the default everywhere) reads quoted line feeds right, and so one task
    reads a whole file: write such logs as many files. Turn it off for large files that hold
    none; they are then split."""
    return {**_CSV_OPTS, "multiLine": str(multi_line).lower()}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for any
    shared store the cluster mounts, not just local disk)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _files(paths: Sequence[str]) -> list[str]:
    """File URIs as the reader takes them: decoded, glob characters escaped."""
    return [re.sub(r"([\\[\]{}*?])", r"\\\1", unquote(p)) for p in paths]


def _names(line: str) -> list[str]:
    """Column names of a header line, stripped (byte order mark included). A nameless column is
    called _c<place>; a name that is there before, in any case, gets its place behind it
    (name_<place>), so the first of several keeps the name."""
    out: list[str] = []
    for i, h in enumerate(next(csv.reader([line]), [])):
        name = h.strip(FORM_WS) or f"_c{i}"
        out.append(f"{name}_{i}" if name.lower() in map(str.lower, out) else name)
    return out


def _headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Header line -> files that start with it. The lines are read and the first one of each
    file is found in the tasks (compressed files and sub-folders included); only the distinct
    headers and the names of their files reach the driver."""
    lines = (spark.read.option("recursiveFileLookup", "true").text(paths)
             .select("value", "_metadata.file_path", "_metadata.file_block_start")
             .where("file_block_start = 0").withColumn("at", F.monotonically_increasing_id()))
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    return {r["header"]: r["files"] for r in found.collect()}


def _by_name(spark: SparkSession, paths: str | list[str], multi_line: bool,
             header: Sequence[str] | None = None, called: Callable[[list[str]], list[str]] = list) -> DataFrame | None:
    """All files of ``paths``, columns matched by name; None when there is no line. Files with
    the same header are one scan, scans with other headers are united by column name.
    ``header``: all files are known to have these columns, so no pass looks for them.
    ``called`` gives the columns of a header their names."""
    def scan(names: Sequence[str], files: str | list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return spark.read.options(**_options(multi_line)).option("recursiveFileLookup", "true").schema(schema).csv(files)

    if header is not None:
        return scan(header, paths)
    headers, out = _headers(spark, paths), None
    for line, files in sorted(headers.items()):
        df = scan(called(_names(line)), paths if len(headers) == 1 else _files(files))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _field(df: DataFrame, *names: str) -> str | None:
    held = {c.lower(): c for c in df.columns}
    return next((held[n] for n in names if n in held), None)


def read_labeled_csv(spark: SparkSession, path: str, null_tokens: Sequence[str] = ("",),
                     multi_line: bool = True, header: Sequence[str] | None = None) -> DataFrame:
    """Header CSV, UTF-8 with optional BOM, RFC 4180 quotes (``""``), quoted newlines;
    every column a string. Files of one folder, its sub-folders and compressed files included,
    may order their columns differently: cells follow their header. Of columns with the same
    name the first keeps it. The headers cost a pass over the lines; give ``header`` when it is
    known to be that of all files. Cells equal to one of ``null_tokens`` are NULL (an empty cell
    is NULL by default)."""
    df = _by_name(spark, path, multi_line, header)
    if df is None:
        raise FileNotFoundError(path)
    extra = [t for t in null_tokens if t != ""]
    if extra:
        df = df.select(*[F.when(F.col(f"`{c}`").isin(*extra), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                         for c in df.columns])
    return df


def _staging_names(names: list[str]) -> list[str]:
    """Names of a staging header: date and amount may be called date_txt and amount_txt."""
    raw = {"date": "date_txt", "amount": "amount_txt"}
    out = [raw.get(n.lower(), n.lower()) for n in names]
    if lost := [c for c in STAGING_FIELDS if out.count(c) != 1]:
        raise ValueError(f"no single column for {', '.join(lost)} in the header {names}")
    return out


def read_staging_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Five raw text columns, matched by name: vendor, description, category, and date and
    amount, also as date_txt and amount_txt. A file without one of them is an error."""
    df = _by_name(spark, path, multi_line, called=_staging_names)
    return spark.createDataFrame([], STAGING_SCHEMA) if df is None else df.select(*STAGING_FIELDS)


def _feedback_of(spark: SparkSession, paths: str | list[str], multi_line: bool) -> DataFrame:
    df = _by_name(spark, paths, multi_line) if paths else None
    if df is None:
        return spark.createDataFrame([], FEEDBACK_SCHEMA)
    held = {c: _field(df, c) for c in FEEDBACK_FIELDS}
    return df.select(*[(F.col(f"`{held[c]}`") if held[c] else F.lit(None).cast("string")).alias(c) for c in FEEDBACK_FIELDS])


def read_feedback(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The feedback log with its fixed columns, matched by name, sub-folders and compressed files
    included; columns a file lacks are NULL, others are left out, and a missing log is an empty
    table."""
    return _feedback_of(spark, path if path_exists(spark, path) else [], multi_line)


def feedback_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The files of a feedback log as a stream (their contents are not read). Each micro-batch
    becomes rows by :func:`read_feedback_batch`."""
    r = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path).select("path")


def read_feedback_batch(batch: DataFrame, multi_line: bool = True) -> DataFrame:
    """Rows of the files of a micro-batch, columns matched by name as in a batch read."""
    return _feedback_of(batch.sparkSession, _files([r["path"] for r in batch.collect()]), multi_line)


def feedback_rows(df: DataFrame) -> DataFrame:
    """Shape rows as feedback-log rows: absent date/amount become '', the source
    is 'feedback_api' and the stamp is the UTC time of the write."""
    def txt(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return df.select(txt("date").alias("date"), txt("amount").alias("amount"),
                     F.col("vendor").cast("string").alias("vendor"),
                     F.col("description").cast("string").alias("description"),
                     F.col("category").cast("string").alias("category"),
                     F.lit(FEEDBACK_SOURCE).alias("source"), stamp.alias("created_at_utc"))


def append_feedback(df: DataFrame, path: str) -> None:
    """Append feedback rows (each written file carries the header)."""
    (feedback_rows(df).write.mode("append").options(**_options(True)).csv(path))


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write a header CSV in RFC 4180 form (doubled quotes), optionally as
    ``files`` files, e.g. to feed a file stream several micro-batches."""
    out = df.repartition(files) if files else df
    out.write.mode("overwrite").options(**_options(True)).csv(path)
