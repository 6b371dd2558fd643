"""Session settings and the shared folder that long jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Safe to set on a session that somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_local_folder: tempfile.TemporaryDirectory | None = None


def build_session(app_name: str = "ludoscope", master: str | None = None, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        # Recording the Python line of every column expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on (UTC above all) to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only ever used in local mode, where driver and tasks share one disk;
    it goes away with the process. On a cluster the folder's retention rule removes old results.
    """
    global _local_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _local_folder = _local_folder or tempfile.TemporaryDirectory(prefix="ludoscope-")
        root = _local_folder.name
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
