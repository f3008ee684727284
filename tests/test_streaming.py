"""Streams: the micro-batch results add up to the batch result, and a restart from
the checkpoint adds nothing."""

from pyspark.sql import functions as F

from spendlabel.plans.fixtures import Fixtures
from spendlabel.session import scratch_path
from spendlabel.sources import files as IO
from spendlabel.sources.store import VersionedStore
from spendlabel.streaming import jobs as ST
from tests.conftest import SF_SMALL


def test_feedback_stream_equals_batch_and_restart_adds_nothing(spark):
    fb = Fixtures(spark, SF_SMALL).feedback.select(*IO.FEEDBACK_FIELDS)
    src, dst, ck = (scratch_path(spark, n) for n in ("src", "dst", "ck"))
    IO.write_csv(fb, src, files=3)
    ST.stream_feedback(spark, src, dst, ck).awaitTermination()
    valid = spark.read.parquet(f"{dst}/valid")
    quarantine = spark.read.parquet(f"{dst}/quarantine")
    assert valid.select("batch_id").distinct().count() == 3          # one batch per file
    batch_valid, batch_rej = ST.clean_feedback(IO.read_feedback(spark, src))
    assert sorted(map(tuple, valid.drop("batch_id").collect())) == sorted(map(tuple, batch_valid.collect()))
    assert quarantine.count() == batch_rej.count()
    n = valid.count()
    ST.stream_feedback(spark, src, dst, ck).awaitTermination()       # restart: nothing new
    assert spark.read.parquet(f"{dst}/valid").count() == n


def test_train_stream_skips_committed_batches(spark):
    docs = Fixtures(spark, SF_SMALL).labeled_text
    src, root, ck = (scratch_path(spark, n) for n in ("tsrc", "store", "tck"))
    IO.write_csv(docs, src, files=2)
    stream = (spark.readStream.options(header="true", escape='"', multiLine="true")
              .option("maxFilesPerTrigger", "1")
              .schema("row_key long, vendor string, description string, category string").csv(src))
    ST.stream_train(spark, stream, root, ck, holdout=False).awaitTermination()
    store = VersionedStore(spark, root)
    versions = store.manifest().filter(F.col("kind") == "model").count()
    assert versions == 2
    assert store.has_batch(0) and store.has_batch(1)
    from spendlabel.plans.training import train_or_update
    replay = train_or_update(docs, root, batch_id=1)                 # a replayed batch id
    assert not replay.changed and replay.kind == "replayed"
    assert store.manifest().filter(F.col("kind") == "model").count() == versions


def test_class_batches_are_read_from_many_files(spark, monkeypatch):
    import glob
    import json
    from types import SimpleNamespace

    from spendlabel.plans import q_io

    paths, scratch = {}, q_io.scratch_path
    monkeypatch.setattr(q_io, "scratch_path", lambda s, n: paths.setdefault(n, scratch(s, n)))
    docs = spark.createDataFrame([(i, f"vendor {i}", f"about {i % 7} things", "abc"[i % 3]) for i in range(60)],
                                 "row_key long, vendor string, description string, category string").repartition(4)
    store = q_io._class_by_class(SimpleNamespace(spark=spark, labeled_text=docs))
    root = paths["classes_ck"].removeprefix("file:")
    files = {}  # micro-batch -> files it read
    for log in glob.glob(f"{root}/sources/0/*"):
        for line in open(log).read().splitlines()[1:]:
            entry = json.loads(line)
            files.setdefault(entry["batchId"], set()).add(entry["path"])
    assert len(files) == 4 and all(len(x) > 1 for x in files.values())
    classes = [r.category for r in store.read("model_classes", store.latest("model")["version"]).collect()]
    assert sorted(classes) == ["a", "b", "c"] and store.load_training_rows().count() == 60
