"""Reading the tables of a data folder, and the row that is current of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], newest: str, *ties: str | Column) -> DataFrame:
    """One row per key: the one with the largest ``newest``; ``ties`` order the rows that are equally new.

    Nulls in ``newest`` count as oldest; rows that are equal in all ordering columns are interchangeable copies.
    A rank limit of one is applied before the shuffle as well (WindowGroupLimit), so a key that holds a large part
    of all rows sends one row per input partition. Keys that are null form one group of their own.
    """
    rank = "__rank_of_row"
    order = [F.col(newest).desc_nulls_last(), *ties]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)


def current_symbols(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The current row of each symbol id (largest ``updated_at_epoch``)."""
    want = list(dict.fromkeys(["id", "updated_at_epoch", *columns]))
    rows = table(spark, folder, "symbols").select(*want)
    ties = [c for c in want if c not in ("id", "updated_at_epoch")]
    return latest(rows, ["id"], "updated_at_epoch", *ties)


def current_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The current version of each source file (largest ``seen_at``)."""
    want = list(dict.fromkeys(["file_path", "seen_at", *columns]))
    return latest(table(spark, folder, "source_files").select(*want), ["file_path"], "seen_at", *[c for c in want if c not in ("file_path", "seen_at")])


def current_walks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The current visit of each symbol (largest ``walked_at``)."""
    want = list(dict.fromkeys(["symbol_id", "walked_at", *columns]))
    return latest(table(spark, folder, "walk_contexts").select(*want), ["symbol_id"], "walked_at", *[c for c in want if c not in ("symbol_id", "walked_at")])


def current_clusters(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The current row of each cluster (largest ``index_epoch``)."""
    want = list(dict.fromkeys(["id", "index_epoch", *columns]))
    return latest(table(spark, folder, "clusters").select(*want), ["id"], "index_epoch", *[c for c in want if c not in ("id", "index_epoch")])


def run_limit(spark: SparkSession, folder: str, name: str) -> int:
    """One value of the small table ``run_limits``."""
    row = table(spark, folder, "run_limits").filter(F.col("name") == name).select("int_value").head()
    if row is None or row[0] is None:
        raise ValueError(f"run_limits has no {name}")
    return int(row[0])
