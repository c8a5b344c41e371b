"""Session construction and the shared scratch location.

Library code never creates a session; it receives one. ``build_session`` is for
tests, the bench and command-line use. Intermediate tables and lineage cuts go
under ``spark.checkpoint.dir`` (a shared folder on a cluster); a local default is
set only when the session has none.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK = "/tmp/regionlens-checkpoints"
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``regionlens`` importable in the executors' Python workers.

    Grouped-map and map-in-pandas functions are pickled by reference to this
    package, so the workers must be able to import it. The package is zipped
    once per application on the driver and handed to ``addPyFile`` (what
    ``--py-files`` does); Spark distributes it to every executor.
    """
    import tempfile
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="regionlens-pyfiles-")
    zpath = os.path.join(out_dir, "regionlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "regionlens") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REGIONLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = conf_dir or _LOCAL_FALLBACK
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for an intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/regionlens/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
