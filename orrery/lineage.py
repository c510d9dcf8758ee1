"""Cutting lineage with tables in the folder all executors share.

Loops over DataFrames would otherwise recompute every earlier round. A written table also survives the loss of
an executor, carries column statistics and is read back with pruning.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all work is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


class Cuts:
    """Written tables of one operator run; ``drop`` removes those that no later plan reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def cut(self, df: DataFrame, sort_within: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the table read back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        out = df.sortWithinPartitions(*sort_within) if sort_within else df
        out.write.option("compression", "lz4").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self) -> int:
        return self.count

    def drop(self, *numbers: int) -> None:
        """Remove written tables by their number (1 is the first)."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for number in numbers:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
            path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Remove all tables this application has written here; results that still read them must be stored before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write one table to the shared folder and return it read back."""
    return Cuts(df.sparkSession, label).cut(df)
