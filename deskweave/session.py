"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "deskweave", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset and let spark-submit decide.  AQE does
    the partition coalescing and splits skewed join partitions, so the shuffle
    width is only an upper bound there.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of every column expression are only useful when debugging a plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Give the tasks this package, so that they need no installation of it; once for each application."""
    context = spark.sparkContext
    if getattr(context, "_deskweave_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="deskweave-")) / "deskweave.zip"  # the driver's; Spark hands it on
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._deskweave_shipped = True


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str:
    """Folder that driver and executors share, for materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, ``default`` or a new temporary
    folder serves a local master, which has one machine; with any other master a folder of one machine
    would lose rows, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return default or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="deskweave-")


def cut_lineage(df: DataFrame, default_dir: str | None = None) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; survives executor loss."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(checkpoint_dir(spark, default_dir), "deskweave"))
    return df.checkpoint()
