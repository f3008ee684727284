"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(cpus: str | int | None = None, shuffle_partitions: int | None = None,
              app: str = "spendlabel", event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and benchmarks.

    On a cluster the session comes from the launcher; nothing here is required there
    except :func:`ensure_checkpoint_dir`, which only fills in an unset checkpoint dir.
    """
    cpus = cpus or os.environ.get("SPENDLABEL_CPUS", "*")
    parts = shuffle_partitions or int(os.environ.get("SPENDLABEL_SHUFFLE_PARTITIONS", "8"))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("SPENDLABEL_DRIVER_MEMORY", "8g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if event_log_dir:
        b = (b.config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", event_log_dir))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names; set one only when unset.

    ``spark.checkpoint.dir`` is the folder every executor can reach. Lineage cuts and
    scratch tables go below it, never into a machine-local temporary folder. Only a local
    session with nothing configured (as in tests) gets a folder of its own; on a cluster
    an unset folder is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        d = tempfile.mkdtemp(prefix="spendlabel-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers (once per application), so that tasks can
    import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(to)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder name under the shared checkpoint dir (not created)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/spendlabel-scratch/{name}-{uuid.uuid4().hex[:12]}"
