"""Spark session helpers.

The cluster owns ``spark.checkpoint.dir`` (a shared folder every executor can
reach).  We only read it.  Where it is unset, a one-machine session (master ``local``)
gets a private folder, and any other session an error: a driver-only folder would lose data.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "ledgerscope", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  If unset: a new private one on a one-machine
    session (tests, bench), a ``RuntimeError`` on a cluster."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not _one_machine(sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver "
                           "and all executors share")
    path = tempfile.mkdtemp(prefix="ledgerscope-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerscope`` importable in Python workers, once per application.

    Operators that run Python tasks (file hashing, the large-sender running median) call
    this.  When the package is installed or on PYTHONPATH nothing happens; otherwise the
    package is zipped and handed to ``SparkContext.addPyFile``, which Spark distributes to
    every executor (the programmatic form of ``--py-files``).
    """
    import site
    import sys
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg)
    visible = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    visible += list(site.getsitepackages()) + [site.getusersitepackages()]
    if any(os.path.abspath(p) == parent for p in visible):
        _SHIPPED.add(sc.applicationId)
        return
    out = os.path.join(tempfile.mkdtemp(prefix="ledgerscope-pyfiles-"), "ledgerscope.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(out)
    if out not in sys.path:
        sys.path.append(out)  # harmless on the driver; keeps imports consistent
    _SHIPPED.add(sc.applicationId)
