"""File events as a stream or a table, from a log of JSON lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from orrery.functions.globs import is_ignored

SCHEMA = "repo string, path string, kind string, ts timestamp"
KINDS = ("add", "change", "unlink")


def file_events(spark: SparkSession, folder: str, streaming: bool = True, files_at_once: int = 100) -> DataFrame:
    """Events ``repo, path, kind, ts`` of JSON lines; lines of another kind or without a path or time are left out.

    At most ``files_at_once`` new files make a micro-batch, which keeps a burst from piling up.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_at_once) if streaming else spark.read
    return reader.schema(SCHEMA).json(folder).filter(F.col("kind").isin(*KINDS) & F.col("path").isNotNull() & F.col("ts").isNotNull())


def without_ignored(events: DataFrame, options: DataFrame) -> DataFrame:
    """Events of paths that neither a hard exclude nor the repository's ``ignore_extra`` leaves out."""

    joined = events.join(options.select("repo", "ignore_extra"), "repo", "left")
    return joined.filter(~ignored("path", "ignore_extra")).drop("ignore_extra")


@F.pandas_udf(BooleanType())
def ignored(paths: pd.Series, lines: pd.Series) -> pd.Series:
    """Whether each path is left out by its list, in Arrow batches."""
    return pd.Series([is_ignored(p, tuple(x) if x is not None else ()) for p, x in zip(paths, lines)], dtype=bool)
