"""Joins, unions and suggestion operators.

Size rule for broadcasts: only tables with a bound known before the job runs are
broadcast explicitly (the model's K classes, a 4096-row offset table). Anything whose
size follows the data is joined plainly and AQE picks broadcast or shuffle from the
runtime size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FORM_WS, collapse_ws_keep_case, normalized, trim_ws
from .clean import bounded_broadcast, lower_headers

# The columns training rows and feedback rows share.
FEEDBACK_KEEP = ("date", "amount", "vendor", "description", "category")


def filter_unseen(df: DataFrame, ledger: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose id is not in the ledger. In-batch duplicates are kept (anti join,
    not distinct). The ledger is never collected; one read from a store lies bucketed by
    id and stays where it is, any other is exchanged or, when small, broadcast by AQE."""
    return df.join(ledger.select(key), key, "left_anti")


def new_labels(df: DataFrame, classes: DataFrame | list[str] | None, col: str = "category") -> DataFrame:
    """Distinct categories of ``df`` unknown to the model; all of them when the
    model is untrained (``classes`` is None). A model's class list (K names held by
    the driver) is a table of known size and is broadcast; a class table computed
    from data is joined plainly and AQE chooses the strategy."""
    cats = df.select(col).filter(F.col(col).isNotNull()).distinct()
    if classes is None:
        return cats
    if isinstance(classes, list):
        known = df.sparkSession.createDataFrame([(c,) for c in classes], f"{col} string")
        return cats.join(F.broadcast(known), col, "left_anti")
    return cats.join(classes.select(F.col("category").alias(col)), col, "left_anti")


def training_view(labels: DataFrame, seed: DataFrame) -> DataFrame:
    """User labels with a chosen category UNION ALL seed rows, tagged by source."""
    lab = (labels.filter(F.col("chosen_cat").isNotNull())
           .select("vendor", "description", F.col("chosen_cat").alias("category"),
                   F.lit("user_label").alias("source")))
    return lab.unionByName(seed.select("vendor", "description", "category",
                                       F.lit("seed").alias("source")))


def as_text_frame(df: DataFrame) -> DataFrame:
    df = lower_headers(df)
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns
                        else F.lit("")).alias(c) for c in FEEDBACK_KEEP])


def merge_feedback(train: DataFrame, feedback: DataFrame) -> DataFrame:
    """Training rows + feedback rows on the five shared columns, exact duplicates
    removed; the training set unchanged when there is no feedback.

    Amounts stay text until after the dedupe; they are compared as numbers (33 and
    33.0 are one amount) and the smallest spelling is kept, so the result does not
    depend on partitioning. The dedupe is one aggregation: copies are merged
    map-side before the shuffle."""
    if feedback.isEmpty():
        return as_text_frame(train)
    return merge_rows(as_text_frame(train).unionByName(as_text_frame(feedback)))


def _amount_key() -> Column:
    return F.coalesce(F.col("amount").try_cast("decimal(38,10)").cast("string"), F.col("amount"))


def merge_rows(rows: DataFrame) -> DataFrame:
    """Text rows without exact duplicates, amounts compared as numbers."""
    return (rows.withColumn("__akey", _amount_key())
            .groupBy("date", "__akey", "vendor", "description", "category")
            .agg(F.min("amount").alias("amount"))
            .select(*FEEDBACK_KEEP))


def with_part(rows: DataFrame, parts: int) -> DataFrame:
    """``part``: 0..parts-1 by a hash of what ``merge_rows`` compares, so copies share it."""
    key = F.xxhash64("date", _amount_key(), "vendor", "description", "category")
    return rows.withColumn("part", F.pmod(key, F.lit(parts)).cast("int"))


def known_categories(classes: DataFrame, feedback: DataFrame, col: str = "category") -> DataFrame:
    """Model classes plus stripped, non-blank feedback categories; unique
    (case-sensitive) and sorted without case."""
    fb = (feedback.select(trim_ws(F.coalesce(F.col(col), F.lit(""))).alias("category"))
          .filter(F.length("category") > 0))
    return (classes.select("category").unionByName(fb).distinct()
            .orderBy(F.lower("category"), "category"))


def suggestion_chips(scored: DataFrame, pred: str = "category", top: str = "top") -> DataFrame:
    """``chips``: predicted category followed by the top-k names, stripped, blank
    tops removed, first occurrence kept."""
    tops = F.filter(F.transform(F.col(top), lambda t: trim_ws(F.coalesce(t["category"], F.lit("")), FORM_WS)),
                    lambda x: F.length(x) > 0)
    chips = F.array_distinct(F.concat(F.array(trim_ws(F.coalesce(F.col(pred), F.lit("")), FORM_WS)), tops))
    return scored.withColumn("chips", chips)


def distinct_categories(df: DataFrame, col: str = "category") -> DataFrame:
    return df.select(col).distinct()


#: Length of the grams names are indexed by; a shorter query is a gram itself.
GRAM = 3


def gram_postings(names: DataFrame, col: str) -> DataFrame:
    """(gram, ``col``): the distinct lower-cased grams of 1 to ``GRAM`` characters of each name,
    at most ``GRAM`` times its length however long it is."""
    s = F.lower(F.col(col))
    starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(s, i, n)))))
    return names.select(F.explode(grams).alias("gram"), col).filter(F.length("gram") > 0)


def _query_grams(q: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, gram): the gram each query is looked up by. A query of up to ``GRAM`` characters is
    its own; a longer one takes the rarest of its grams of ``GRAM`` characters."""
    n = F.length("q")
    short = q.filter(n.between(1, GRAM)).select("q", F.col("q").alias("gram"))
    grams = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring("q", i, GRAM))
    held = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    cut = q.filter(n > GRAM).select("q", F.explode(grams).alias("gram")).join(held, "gram", "left")
    rare = cut.groupBy("q").agg(F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)), F.col("gram"))).alias("gram"))
    return short.unionByName(rare)


def suggest_categories(queries: DataFrame, categories: DataFrame, limit: int = 8,
                       qcol: str = "q", ccol: str = "category") -> DataFrame:
    """Per query: categories starting with it, then those containing it, first
    ``limit`` in display order (locale order: letters before accents before case, so É
    stands by E); an empty query gets the first ``limit``.

    A 'contains' match looks one gram of the query up in the grams of the categories (an
    equi-join, postings linear in a name's length) and verifies the rest of it. Ranking is
    a row_number <= limit filter, which Spark turns into a partial top-k before the shuffle."""
    q = queries.select(F.lower(trim_ws(F.coalesce(F.col(qcol), F.lit("")), FORM_WS)).alias("q")).distinct()
    cats = categories.select(F.col(ccol).alias("category")).distinct()
    postings = gram_postings(cats, "category")
    lower = F.lower("category")
    hits = (_query_grams(q, postings).join(postings, "gram")
            .filter(F.contains(lower, F.col("q"))))
    shown = [F.collate("category", "UNICODE"), F.col("category")]
    order = [F.when(F.startswith(lower, F.col("q")), 0).otherwise(1), *shown]
    w = Window.partitionBy("q").orderBy(*order)
    ranked = (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
              .withColumn("rank", F.col("rank").cast("long")))
    firsts = (cats.withColumn("q", F.lit(""))
              .withColumn("rank", F.row_number().over(
                  Window.partitionBy("q").orderBy(*shown)))
              .filter(F.col("rank") <= limit)
              .withColumn("rank", F.col("rank").cast("long")))
    # The empty query gets the first ``limit`` categories when it was asked at all
    # (a scalar-subquery filter, not a join on the constant key).
    asked = q.agg(F.count_if(F.length("q") == 0) > 0).scalar()
    empty = firsts.filter(asked)
    return ranked.select("q", "rank", "category").unionByName(empty.select("q", "rank", "category"))


def match_suggestion(labels: DataFrame, suggestions: DataFrame, col: str = "category",
                     scol: str = "category") -> DataFrame:
    """Replace free text by the suggestion equal to it after normalisation, else
    keep the whitespace-normalised text. Suggestions are reduced to one per key."""
    sug = (suggestions.select(normalized(scol).alias("__k"), F.col(scol).alias("__s"))
           .groupBy("__k").agg(F.min("__s").alias("__s")))
    keyed = labels.withColumn("__k", normalized(col))
    return (keyed.join(bounded_broadcast(sug), "__k", "left")
            .withColumn(col, F.coalesce(F.col("__s"), collapse_ws_keep_case(col)))
            .drop("__k", "__s"))


def match_chips(df: DataFrame, col: str = "category", chips: str = "chips") -> DataFrame:
    """Replace free text by the first of the row's own chips that equals it after
    normalisation, else keep the white-space-normalised text."""
    key = normalized(col)
    hit = F.get(F.filter(F.col(chips), lambda c: normalized(c) == key), F.lit(0))
    return df.withColumn(col, F.coalesce(hit, collapse_ws_keep_case(col)))


def cascade_delete(labels: DataFrame, expenses: DataFrame, key: str = "expense_id") -> DataFrame:
    """Drop labels whose expense no longer exists; labels without an expense stay."""
    linked = labels.filter(F.col(key).isNotNull()).join(expenses.select(key), key, "left_semi")
    return linked.unionByName(labels.filter(F.col(key).isNull()))


def get_or_create(dim: DataFrame, incoming: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Ids for every distinct incoming key: the existing id, or ``max(id) + n`` for
    new keys, numbered in (md5(key), key) order without a single-task window."""
    from .maintain import assign_positions

    keys = incoming.select(key).filter(F.col(key).isNotNull()).distinct()
    # a key that the dimension holds twice keeps its first id
    held = dim.groupBy(key).agg(F.min(id_col).alias(id_col))
    found = keys.join(held, key, "inner").withColumn("created", F.lit(False))
    new = keys.join(held, key, "left_anti")
    base = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    numbered = assign_positions(new, F.md5(F.col(key).cast("string")), [key])
    made = numbered.select(key, (base + F.col("pos")).alias(id_col), F.lit(True).alias("created"))
    return found.select(key, id_col, "created").unionByName(made)
