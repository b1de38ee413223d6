"""The SparkSession that the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: ANSI mode is off: overflowing sums wrap and bad casts give NULL, as in the dialect; UTC makes results repeatable.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.debug.maxToStringFields": "2000",
}


def session(app: str = "millrace", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more``: further settings, with _ for the dots. The cluster's own sizes are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def dialect_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the dialect's settings; the given one keeps its own."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.sources.partitionOverwriteMode", "spark.sql.debug.maxToStringFields"):
        own.conf.set(k, SETTINGS[k])
    return own


def place(spark: SparkSession, name: str) -> str:
    """A new folder's name, under the folder that driver and executors share; with one process it may be local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='millrace-')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once for an application, where their PYTHONPATH hasn't it already."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_millrace_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "millrace").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._millrace_shipped = True
