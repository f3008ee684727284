"""Cross-document line frequency rules (DataFrame functions only).

Base figures come from each whole text; the verdict of the method adds what other
documents of the same host say about its lines: lines are normalised (outer space
stripped, runs of space folded, lower case, digits to 0) and hashed, distinct documents
are counted per (host, line), lines held by more documents than the host's limit count
as removed, and a document that keeps too small a share of its words is rejected.

Edge cases. Null text: no words, one row, ``base_failed``. Null host: a host of its own.
Exact copies on a host count as one document, so a mirrored text does not make its own
lines boilerplate. Repeated rows (same id, host and text) each get the same row back.
Null ids keep their rows. Empty table: empty result. Extra columns are ignored.
Trigrams inside a text, normalised lines and texts are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: A line is above the limit of its host when more distinct documents hold it than
#: max(MIN_DOCS, SHARE of the host's distinct documents).
MIN_DOCS = 10
SHARE = 0.01
#: A document is depleted when its lines under the limit hold less than this share of its words.
MIN_LEFT = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array."""
    def starts(ws: Column) -> Column:
        grams = F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
        return _let(F.sort_array(grams), lambda g: F.sort_array(F.transform(
            F.filter(g, lambda x, j: (F.get(g, j - 1)["h"] == x["h"]) | (F.get(g, j + 1)["h"] == x["h"])),
            lambda x: x["i"])))

    def covered(st: Column) -> Column:
        return F.aggregate(
            F.transform(st, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(st, j + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(words, lambda ws: _let(starts(ws), covered))


def _stats(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.col("source").alias("host"), text.alias("text"), F.xxhash64("text").alias("fp"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    return base.select(
        "doc_id", "host", "fp",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
             lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, host, fp, pos, line, words): one row per line with a word."""
    raw = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64("text").alias("fp"),
                      F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0"))
    return raw.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", "host", "fp", "pos", F.xxhash64(norm).alias("line"),
        F.size(F.split(norm, " ")).alias("words"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, line, n_docs): the lines above their host's limit."""
    per_host = (docs.where(F.col("text").isNotNull())
                .groupBy(F.col("source").alias("host"))
                .agg(F.count_distinct(F.xxhash64("text")).alias("host_docs")))
    counts = (_lines(docs).groupBy("host", "line").agg(F.count_distinct("fp").alias("n_docs"))
              .where(F.col("n_docs") > min_docs))  # the least limit, before the join
    return (counts.alias("c").join(per_host.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
            .where(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), F.col("host_docs") * share))
            .select("c.host", "line", "n_docs"))


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE,
                  min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: base figures, words on removed lines, and the verdict.

    Plan: lines (hash, document hash, host) are pre-aggregated on the map side and counted
    in two hash aggregates, so a line found in a third of all rows arrives as one partial
    row per task and document hash range; the frequent lines then meet the lines in a
    semi join (small side first aggregated, AQE splits a skewed partition). Texts never
    enter a shuffle.
    """
    docs = docs.select("doc_id", "text", "source")
    hot = frequent_lines(docs, min_docs, share)
    ln, h = _lines(docs).alias("l"), hot.alias("h")
    hit = ln.join(h, (F.col("l.line") == F.col("h.line")) & F.col("l.host").eqNullSafe(F.col("h.host")), "left_semi")
    removed = (hit.dropDuplicates(["doc_id", "host", "fp", "pos"])
               .groupBy("doc_id", "host", "fp")
               .agg(F.sum("words").alias("n_removed_words"), F.count("*").alias("n_removed_lines")))
    s, r = _stats(docs).alias("s"), removed.alias("r")
    gone = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (s.join(r, F.col("s.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("s.host").eqNullSafe(F.col("r.host"))
                   & (F.col("s.fp") == F.col("r.fp")), "left")
            .select("s.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    gone.alias("n_removed_words"),
                    F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
                    base_failed.alias("base_failed"),
                    (~base_failed & (F.col("n_words") - gone >= F.col("n_words") * min_left)).alias("kept")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS host, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
ln AS (
  SELECT doc_id, host, text, line,
         trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS k
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d WHERE text IS NOT NULL GROUP BY host),
hot AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT text) AS n FROM ln GROUP BY host, k) c JOIN hosts USING (host)
  WHERE n > greatest(10.0, host_docs * 0.01)),
gone AS (
  SELECT doc_id, sum(len(string_split(k, ' '))) AS words, count(*) AS lines
  FROM ln JOIN hot USING (host, k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(words, 0) AS gone, coalesce(lines, 0) AS lines
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       gone::BIGINT AS n_removed_words, lines::BIGINT AS n_removed_lines, base_failed,
       (NOT base_failed AND n_words - gone >= n_words * 0.5) AS kept
FROM b
"""
