"""Session helpers: settings for local runs and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: str | int = "*", memory: str = "8g", shuffle_partitions: int = 8, name: str = "loomlog") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once a session)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="loomlog-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, one of this
    machine, but only if the session is on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomlog.local.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("loomlog.local.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path that all executors share: below ``spark.checkpoint.dir``, or a local folder where
    that is unset, as in tests."""
    return f"{shared_dir(spark)}/loomlog-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settled(table: DataFrame, label: str) -> DataFrame:
    """``table``, written to the shared folder and read again: state that later steps build on."""
    path = shared_path(table.sparkSession, label)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
