"""The session used by tests, the bench and local work; a cluster brings its own."""

from __future__ import annotations

import os

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds the package.
ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def share_package(spark: SparkSession) -> SparkSession:
    """Lets the Python workers import this package: by path, and on a cluster also as a file sent to the executors."""
    context = spark.sparkContext
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    if not context.master.startswith("local") and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        archive = Path(tempfile.mkdtemp(prefix="orrery-")) / "orrery.zip"
        with zipfile.ZipFile(archive, "w") as file:
            for path in sorted((ROOT / "orrery").rglob("*.py")):
                file.write(path, path.relative_to(ROOT))
        context.addPyFile(str(archive))
    return spark


def local_session(cores: int | None = None, name: str = "orrery", **conf: str) -> SparkSession:
    """A local session with UTC time, adaptive execution and as many shuffle partitions as cores."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ORRERY_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return share_package(spark)
