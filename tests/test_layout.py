"""Files laid out for the reads that follow: what is moved, read and rewritten."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spendlabel.operators import features as FE
from spendlabel.operators import sets as S
from spendlabel.operators.metrics import user_expenses
from spendlabel.plans.fixtures import Fixtures
from spendlabel.session import scratch_path
from spendlabel.sources.store import VersionedStore

from .conftest import SF_CHECK


@pytest.fixture
def store(spark):
    return VersionedStore(spark, scratch_path(spark, "layout"), ledger_buckets=4)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def ids(spark, lo, hi):
    return spark.range(lo, hi).select(F.md5(F.col("id").cast("string")).alias("row_id"))


def test_only_the_batch_moves(spark, store):
    for k in range(6):
        store.append_ledger(ids(spark, k * 50, k * 50 + 50))
    store.write_ledger(ids(spark, 300, 320), store.next_version())  # no manifest row: not committed
    copies = ids(spark, 290, 310).collect() + ids(spark, 305, 310).collect()
    batch = spark.createDataFrame(copies, "row_id string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = S.filter_unseen(batch, store.load_ledger())
        text = plan(left)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted(r.row_id for r in left.collect()) == sorted(r.row_id for r in ids(spark, 300, 310).collect() +
                                                              ids(spark, 305, 310).collect())
    assert text.count("Exchange hashpartitioning(row_id") == 1, text  # the batch's own
    assert "Bucketed: true" in text, text


def test_a_failed_ledger_write_is_replaced(spark, store):
    store.append_ledger(ids(spark, 0, 5))
    store.write_ledger(ids(spark, 5, 9), 2)
    assert store.load_ledger().count() == 5
    assert store.append_ledger(ids(spark, 20, 22)) == 2
    assert store.load_ledger().count() == 7
    store.write_ledger(ids(spark, 40, 44), 3)
    store.append_ledger(ids(spark, 0, 0))  # an empty version replaces the leftover as well
    assert store.load_ledger().count() == 7
    store.append_ledger(store.load_ledger().filter("row_id < '8'"))  # rows that come from the ledger itself
    n = 7 + store.load_ledger(distinct=True).filter("row_id < '8'").count()
    spark.sql(f"DROP TABLE {store.ledger.name}")  # another session does not have it in its catalog
    again = VersionedStore(spark, store.root, ledger_buckets=9)
    again.append_ledger(ids(spark, 30, 31))
    assert again.load_ledger().count() == n + 1


def test_a_merge_rewrites_its_parts_only(spark, store):
    cols = "date string, amount string, vendor string, description string, category string"
    base = [(f"2024-01-{i % 28 + 1:02d}", str(i), f"v{i}", "d", "c") for i in range(200)]
    store.start_training_parts(spark.createDataFrame(base + base[:5], cols), parts=16)
    batches = [[("2024-01-01", "0.0", "v0", "d", "c"), ("x", None, None, "new", "c")], [("y", "1", "z", "d", "c")] * 3]
    for rows in batches:
        before = set(store.read_training_parts().inputFiles())
        v = store.merge_training_parts(spark.createDataFrame(rows, cols))
        new = glob.glob(f"{store.root.removeprefix('file:')}/training_parts/v={v}/part=*")
        assert 1 <= len(new) <= 2
        assert all(os.path.exists(f.removeprefix("file://")) for f in before)
    assert store.merge_training_parts(spark.createDataFrame([], cols)) is None
    whole = S.merge_feedback(spark.createDataFrame(base + base[:5], cols), spark.createDataFrame(sum(batches, []), cols))
    got = store.read_training_parts()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert got.count() == 202


def test_a_users_range_reads_few_row_groups(spark, store):
    e = Fixtures(spark, SF_CHECK).expenses
    user = e.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    lo, hi = e.filter(F.col("user_id") == user).agg(F.min("expense_date"), F.max("expense_date")).first()
    v = store.publish_clustered(e, "by_user", ["user_id", "expense_date"], group_bytes=20_000)
    groups = read = 0
    for path in glob.glob(f"{store.path('by_user', v).removeprefix('file:')}/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("user_id")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups += 1
            read += s.min <= user <= s.max
    assert groups >= 20 and 1 <= read <= groups / 10
    found = user_expenses(store.read_latest("by_user", "by_user"), user, lo, hi)
    assert "PushedFilters: [IsNotNull(user_id)" in plan(found)
    assert found.count() == e.filter(F.col("user_id") == user).count()


def test_learned_ids_never_move_to_the_test_side(spark, store):
    def rows(lo, hi, cat):
        return ids(spark, lo, hi).withColumn("category", F.lit(cat))

    learned, deltas = set(), [rows(0, 40, "a").unionByName(rows(100, 101, "b")),
                              rows(0, 400, "a").unionByName(rows(100, 140, "b")).unionByName(rows(900, 950, "c"))]
    for delta in deltas:
        store.publish_tables({"holdout": FE.holdout_thresholds(delta, store.load_holdout())}, "holdout")
        split = FE.stable_holdout(delta, store.load_holdout()).collect()
        assert not learned & {r.row_id for r in split if r.split == "test"}
        learned |= {r.row_id for r in split if r.split == "train"}
        if delta is deltas[0]:
            assert sum(r.split == "test" for r in split) == 8
    assert store.load_holdout().count() == 3
    assert sum(r.split == "test" and r.category == "c" for r in split) == 10
