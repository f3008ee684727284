"""Table maintenance (O33-O35) and skew-safe row numbering.

Serial ids are assigned without a window over the whole table: rows are ordered by
a content hash, counted per hash-prefix bucket (at most 16^digits buckets, a bound
known before the job runs), the bucket offsets are a running sum over that small
table, and each row adds its rank inside its bucket. Identical rows are collapsed
to one weighted row first, so a hot group of copies never lands in one sort, and
their id ranges are expanded in bounded chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import parse_staging

# The seed table's default source, its columns besides id and source, and the
# column order of the staging load.
SEED_SOURCE = "migrated_from_expenses"
SEED_COLUMNS = ("vendor", "description", "category", "amount", "expense_date")
STAGING_COLUMNS = ("vendor", "description", "category", "date_txt", "amount_txt")
EXPAND_CHUNK = 1 << 20


def assign_positions(df: DataFrame, h: Column, order_cols: Sequence[str],
                     weight: str | None = None, digits: int = 3,
                     partition_cols: Sequence[str] = (), with_total: bool = False) -> DataFrame:
    """Add ``pos``: 1-based position in (h, order_cols) order, per ``partition_cols``
    group when given. With ``weight`` a row stands for ``weight`` rows and ``pos`` is
    the first of its range. ``with_total`` adds ``__total`` (rows in the group)."""
    pc = list(partition_cols)
    d = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, digits))
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    counts = d.groupBy(*pc, "__b").agg(F.sum(w).alias("__n"))
    # (groups x 16^digits) rows: the running sum over this small table is cheap.
    run = Window.partitionBy(*pc).orderBy("__b") if pc else Window.orderBy("__b")
    offs = counts.select(*pc, "__b", F.coalesce(F.sum("__n").over(
        run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        *([F.sum("__n").over(Window.partitionBy(*pc) if pc else Window.partitionBy())
           .alias("__total")] if with_total else []))
    inner = Window.partitionBy(*pc, "__b").orderBy("__h", *order_cols)
    before = F.coalesce(F.sum(w).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("__before", before)
    # Without groups the offset table has at most 16^digits rows: a proven bound.
    offs_j = offs if pc else F.broadcast(offs)
    return (d.join(offs_j, [*pc, "__b"])
            .withColumn("pos", F.col("__off") + F.col("__before") + 1)
            .drop("__h", "__b", "__off", "__before"))


def expand_ranges(df: DataFrame, start: str, n: str, out: str = "pos",
                  chunk: int = EXPAND_CHUNK) -> DataFrame:
    """One row per position in ``[start, start + n)``. Ranges longer than ``chunk``
    are cut into chunk descriptors that are spread over tasks before expanding, so
    a single huge group of copies is produced by many tasks."""
    parts = (df.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.floor((F.col(n) - 1) / chunk).cast("long"))))
             .withColumn("__s", F.col(start) + F.col("__k") * chunk)
             .withColumn("__len", F.least(F.lit(chunk).cast("long"), F.col(n) - F.col("__k") * chunk)))
    big = parts.filter(F.col(n) > chunk).repartition("__s")
    small = parts.filter(F.col(n) <= chunk)
    both = small.unionByName(big)
    return (both.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__len") - 1)))
            .withColumn(out, F.col("__s") + F.col("__i"))
            .drop("__k", "__s", "__len", "__i"))


def number_rows(df: DataFrame, cols: Sequence[str], base: Column, id_col: str) -> DataFrame:
    """Serial ids ``base + 1 ..`` over ``df`` in content-hash order, copies included."""
    content = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__cnt"))
    ranged = assign_positions(grouped, content, list(cols), weight="__cnt")
    return (expand_ranges(ranged, "pos", "__cnt", out="__p")
            .withColumn(id_col, base + F.col("__p"))
            .drop("__p", "pos", "__cnt"))


def seed_user_id(users: DataFrame, email: str) -> Column:
    """Scalar: the id of the user with ``email``, else ``max(id) + 1``."""
    return users.agg(F.coalesce(F.min(F.when(F.col("email") == email, F.col("id"))),
                                F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long")).scalar()


def import_expenses(staging: DataFrame, expenses: DataFrame, users: DataFrame,
                    seed_email: str = "seed@system.local") -> DataFrame:
    """Staging rows -> typed expense rows owned by the seed user, with new serial
    ids after the current maximum. Bad dates and amounts stay NULL and flagged."""
    raw = staging.select(*STAGING_COLUMNS)
    base = expenses.agg(F.coalesce(F.max("expense_id"), F.lit(0)).cast("long")).scalar()
    numbered = number_rows(raw, STAGING_COLUMNS, base, "expense_id")
    typed = parse_staging(numbered)
    return typed.select("expense_id", seed_user_id(users, seed_email).alias("user_id"),
                        "expense_date", "amount", "vendor", "description", "category",
                        "date_bad", "amount_bad")


def move_rows(src: DataFrame, cond: Column, source: str = SEED_SOURCE) -> tuple[DataFrame, DataFrame]:
    """(kept, moved): rows matching ``cond`` move to the seed table with the default
    source; the complement is NULL-safe so every row lands on exactly one side."""
    hit = F.coalesce(cond, F.lit(False))
    kept = src.filter(~hit)
    moved = src.filter(hit).withColumn("source", F.lit(source))
    return kept, moved


def reconcile_move(before: DataFrame, kept: DataFrame, moved: DataFrame,
                   cols: Sequence[str] = SEED_COLUMNS, amount: str = "amount") -> DataFrame:
    """One row: counts and amounts before and on each side, and whether they balance: rows,
    amounts, and the content of ``cols``, whose hashes add up to the same sum. Give it the
    published tables: what was read before and what can be read back."""
    def side(df: DataFrame, name: str) -> DataFrame:
        content = F.xxhash64(*[F.col(c).cast("string") for c in cols]).cast("decimal(38,0)")
        return df.agg(F.count(F.lit(1)).alias("c"), F.sum(amount).alias("a"),
                      F.coalesce(F.sum(content), F.lit(0)).cast("decimal(38,0)").alias("h")).select(F.lit(name).alias("side"), "c", "a", "h")

    names = ("before", "kept", "moved")
    sides = side(before, "before").unionByName(side(kept, "kept")).unionByName(side(moved, "moved"))

    def of(col: str, name: str) -> Column:
        return F.sum(F.when(F.col("side") == name, F.col(col)))
    one = sides.agg(*[of("c", x).alias(x) for x in names], *[of("a", x).alias(f"amount_{x}") for x in names],
                    *[of("h", x).alias(f"__{x}") for x in names])
    money = [F.coalesce(F.col(f"amount_{x}"), F.lit(0)) for x in names]
    return one.withColumn("balanced", (F.col("before") == F.col("kept") + F.col("moved")) & (money[0] == money[1] + money[2])
                          & (F.col("__before") == F.col("__kept") + F.col("__moved"))).drop(*[f"__{x}" for x in names])


def publish_move(store, src: DataFrame, cond: Column, source: str = SEED_SOURCE, seed: DataFrame | None = None) -> int:
    """Write both sides of :func:`move_rows` and commit them as one version: ``expenses`` keeps
    its columns; ``seed_expenses`` has id, ``SEED_COLUMNS`` and source, the moved rows with serial
    ids behind those of ``seed`` (the seed table so far). Returns the version."""
    kept, moved = move_rows(src, cond, source)
    base = F.lit(0).cast("long") if seed is None else seed.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    cols = ["id", *SEED_COLUMNS, "source"]
    rows = number_rows(moved.select(*SEED_COLUMNS, "source"), [*SEED_COLUMNS, "source"], base, "id").select(*cols)
    rows = rows if seed is None else seed.select(*cols).unionByName(rows)
    return store.publish_tables({"expenses": kept, "seed_expenses": rows}, "move")


def seed_users(users: DataFrame, email: str = "seed@system.local", company: str = "Seed") -> DataFrame:
    """``users`` (id, company, email) with the seed user, created with the next id when absent."""
    new = users.agg(F.max("id").alias("m"), F.count_if(F.col("email") == email).alias("n")).where("n = 0").select(
        (F.coalesce("m", F.lit(0)) + 1).cast("long").alias("id"), F.lit(company).alias("company"), F.lit(email).alias("email"))
    return users.select("id", "company", "email").unionByName(new)


def publish_import(store, staging: DataFrame, expenses: DataFrame, users: DataFrame,
                   seed_email: str = "seed@system.local") -> int:
    """Land an import: the seed user exists, the imported rows stand behind the existing
    ones, and both tables become visible as one version. Returns the version."""
    with_seed = seed_users(users, seed_email)
    rows = import_expenses(staging, expenses, with_seed, seed_email)
    cols = ["expense_id", "user_id", "expense_date", "amount", "vendor", "description", "category"]
    return store.publish_tables({"users": with_seed, "expenses": expenses.select(*cols).unionByName(rows.select(*cols))}, "import")


def latest_label(labels: DataFrame, keys: Sequence[str] = ("user_id", "expense_id"),
                 order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """One label per key, newest wins (ties by id); rows with a NULL key part are
    untouched. ``max_by`` is a partial aggregate, so a hot key is reduced map-side."""
    cols = labels.columns
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    keyed = labels.filter(~has_null)
    best = (keyed.groupBy(*keys)
            .agg(F.max_by(F.struct(*cols), F.struct(*[F.col(o) for o in order])).alias("__r"))
            .select("__r.*"))
    return best.select(*cols).unionByName(labels.filter(has_null))
