"""Projections and cleaning (O10-O18). Pure column expressions except
``display_category`` (distinct) and ``canonicalize_category`` (aggregate + join)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import form_amount, iso_date, iso_date_text, staging_amount, staging_date
from ..functions.text import (FORM_WS, clean_field, normalized, row_id_of, text_of_clean, title_words,
                              trim_ws)

# Header synonyms of the labelled CSV, applied in this order, each only
# when its target column is absent.
DEFAULT_SYNONYMS: tuple[tuple[str, str], ...] = (
    ("supplier", "vendor"),
    ("details", "description"),
    ("memo", "description"),
    ("label", "category"),
    ("class", "category"),
)
REQUIRED_COLUMNS = ("vendor", "description", "category")
#: Category mappings up to this many rows (short names) are broadcast.
MAPPING_ROWS = 50_000


def lower_headers(df: DataFrame) -> DataFrame:
    """Column names without byte-order mark and outer space, in lower case."""
    return df.toDF(*[c.strip(FORM_WS).lower() for c in df.columns])


def conform_columns(df: DataFrame, synonyms: Sequence[tuple[str, str]] = DEFAULT_SYNONYMS,
                    required: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Strip BOM and whitespace from headers, lower-case them, map synonyms and fail
    at plan time when a required column is missing."""
    out = lower_headers(df)
    for src, dst in synonyms:
        if src in out.columns and dst not in out.columns:
            out = out.withColumnRenamed(src, dst)
    missing = sorted(set(required) - set(out.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}; found: {out.columns}")
    return out


def build_text(df: DataFrame, vendor: str = "vendor", description: str = "description",
               category: str | None = "category") -> DataFrame:
    """Strip the three fields (NULL as ''), add ``text = lower(vendor + ' ' + description)``."""
    out = df.withColumn(vendor, clean_field(vendor)).withColumn(description, clean_field(description))
    if category is not None and category in df.columns:
        out = out.withColumn(category, clean_field(category))
    return out.withColumn("text", text_of_clean(vendor, description))


def with_row_id(df: DataFrame, text: str = "text", category: str = "category") -> DataFrame:
    """``row_id = sha256(text || '||' || category)`` in hex."""
    return df.withColumn("row_id", row_id_of(text, category))


def normalize_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """UI normalisation of the given columns (lower, collapse whitespace, strip)."""
    for c in cols:
        df = df.withColumn(c, normalized(c))
    return df


def parse_staging(df: DataFrame, date_col: str = "date_txt",
                  amount_col: str = "amount_txt") -> DataFrame:
    """Type the staging text. No row is dropped: bad values become NULL and are
    flagged so that validation can quarantine them."""
    return (df.withColumn("expense_date", staging_date(date_col))
              .withColumn("amount", staging_amount(amount_col))
              .withColumn("date_bad", F.col("expense_date").isNull()
                          & (F.length(trim_ws(F.coalesce(F.col(date_col), F.lit("")))) > 0))
              .withColumn("amount_bad", F.col("amount").isNull()
                          & (F.length(trim_ws(F.coalesce(F.col(amount_col), F.lit("")))) > 0)))


def coerce_amount(df: DataFrame, amount_col: str = "amount", date_col: str | None = "date") -> DataFrame:
    """Form-side typing: ``amount_num`` (commas dropped, cut to two decimals) and
    ``amount_ok`` (finite and > 0); ``date_iso`` as ``yyyy-MM-dd`` text."""
    out = df.withColumn("amount_num", form_amount(amount_col))
    out = out.withColumn("amount_ok", F.coalesce(
        (F.col("amount_num") > 0) & ~F.isnan("amount_num")
        & (F.col("amount_num") < F.lit(float("inf"))), F.lit(False)))
    if date_col is not None:
        out = out.withColumn("date_iso", iso_date_text(iso_date(date_col)))
    return out


def display_category(df: DataFrame, col: str = "category", locale_order: bool = True) -> DataFrame:
    """Distinct lower-case keys, title-cased per space and hyphen part, sorted.

    ``locale_order`` sorts with the UNICODE collation (a, A, b, C, é); ordering is
    for display only."""
    keys = (df.select(F.lower(trim_ws(F.coalesce(F.col(col), F.lit("")), FORM_WS)).alias("k"))
            .filter(F.length("k") > 0).distinct())
    out = keys.select(title_words("k").alias("category"))
    if locale_order:
        return out.orderBy(F.collate("category", "UNICODE"), "category")
    return out.orderBy(F.lower("category"), "category")


def canonical_spellings(df: DataFrame, col: str = "category") -> DataFrame:
    """One spelling per normalised key: the most frequent, ties alphabetical.

    Counting (key, spelling) first means a hot category is reduced map-side before
    anything moves; the result has one row per distinct key."""
    counted = (df.select(normalized(col).alias("key"), F.col(col).alias("spelling"))
               .filter(F.length("key") > 0)
               .groupBy("key", "spelling").count())
    return counted.groupBy("key").agg(
        F.min_by("spelling", F.struct((-F.col("count")).alias("nc"), F.col("spelling"))).alias("canonical"))


def bounded_broadcast(small: DataFrame, limit: int = MAPPING_ROWS) -> DataFrame:
    """A mapping of short names marked for broadcast when it has at most ``limit`` rows
    (counted here), as it is otherwise."""
    few = small.limit(limit + 1).collect()
    return F.broadcast(small.sparkSession.createDataFrame(few, small.schema)) if len(few) <= limit else small


def canonicalize_category(df: DataFrame, col: str = "category", known: list[str] | None = None) -> DataFrame:
    """Map every category to its canonical spelling; NULL/blank stays as is.

    ``known`` (a model's K class names) comes first: a spelling that normalises to a known
    class becomes that class, whatever the batch prefers. Other keys take the batch's most
    frequent spelling.

    Counting happens on (key, spelling) pairs before anything moves. The rows themselves
    must not be exchanged on a key with few values: the mapping is broadcast when its row
    count is within ``MAPPING_ROWS``, and joined by shuffle (AQE splits the hot keys) beyond."""
    m = canonical_spellings(df, col)
    if known:
        first = df.sparkSession.createDataFrame([(c,) for c in known], "name string")
        first = first.groupBy(normalized("name").alias("key")).agg(F.min("name").alias("name"))
        m = (m.join(F.broadcast(first), "key", "left")
             .select("key", F.coalesce("name", "canonical").alias("canonical")))
    m = bounded_broadcast(m)
    keyed = df.withColumn("__key", normalized(col))
    return (keyed.join(m, keyed["__key"] == m["key"], "left")
            .withColumn(col, F.coalesce(F.col("canonical"), F.col(col)))
            .drop("__key", "key", "canonical"))


def stamp_provenance(df: DataFrame, source: str, with_time: bool = True,
                     time_col: str = "created_at") -> DataFrame:
    out = df.withColumn("source", F.lit(source))
    if with_time:
        out = out.withColumn(time_col, F.current_timestamp())
    return out
