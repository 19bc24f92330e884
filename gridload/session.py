"""Spark session and shared-folder helpers.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a
shared folder; we only read it. A private folder is created only when the
setting is missing (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "gridload", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``; only when it is unset (local
    tests) a private folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gridload-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


_SHIPPED: set[str] = set()


def _workers_can_import(spark: SparkSession) -> bool:
    """Probe job: can the Python workers of every task import the package already?"""
    import pandas as pd

    def probe(it):
        try:
            import gridload  # noqa: F401
            ok = True
        except ImportError:
            ok = False
        for _ in it:
            pass
        yield pd.DataFrame({"ok": [ok]})

    tasks = max(8, 2 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, tasks, 1, tasks).mapInPandas(probe, "ok boolean").groupBy("ok").count().collect()
    return all(r["ok"] for r in rows)


def ship_package(spark: SparkSession) -> None:
    """Make ``gridload`` importable in Python workers (Arrow UDFs, ``applyInPandas``).

    On a cluster the package is normally installed or passed with ``--py-files``; then the
    probe succeeds and nothing is shipped. Otherwise (ad-hoc or local sessions) the package is
    zipped once on the driver and handed to ``SparkContext.addPyFile``, which distributes it.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if _workers_can_import(spark):
        _SHIPPED.add(sc.applicationId)
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="gridload-pyfiles-"), "gridload.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
