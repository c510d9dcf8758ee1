"""Writing tables: upserts without a merge statement, epochs, the ready marker and the feedback log."""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.shared import Shared

#: Sort order of arrival is a column of the caller; these columns keep their old value when the new one is null.
KEEP_OLD = ("signature", "docstring", "updated_at_commit")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep_old: tuple[str, ...] = KEEP_OLD, untouched: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``old`` and ``new`` by key; new values win, but a null does not overwrite ``keep_old`` columns and
    ``untouched`` columns stay as they are. Within ``new`` later rows (by ``order``) win in the same way."""
    columns = [c for c in old.columns if c != key]
    last = new.groupBy(key).agg(
        *[(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if c in keep_old else F.max_by(c, order)).alias(f"__{c}") for c in columns if c in new.columns]
    )
    joined = old.withColumn("__old", F.lit(True)).join(last.withColumn("__new", F.lit(True)), key, "full_outer")
    out = []
    for c in columns:
        if c not in new.columns or c in untouched:
            out.append(F.col(c))
        elif c in keep_old:
            out.append(F.coalesce(f"__{c}", c).alias(c))
        else:
            out.append(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(key, *out)


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of both tables by keys; a null value counts 1."""
    both = old.select(*keys, value).unionByName(new.select(*keys, value))
    return both.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(1.0))).alias(value))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key by ``order``."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def append_feedback(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The log with new rows behind it, numbered on from the greatest id. A batch of feedback is small and bounded by its writer."""
    start = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    numbered = new.withColumn("__n", F.row_number().over(Window.orderBy(order))).crossJoin(F.broadcast(start))
    return old.unionByName(numbered.withColumn("id", (F.col("m") + F.col("__n")).cast("bigint")).select(*old.columns))


def truncate_note(note: str | None, limit: int = 2048) -> str | None:
    """A note of at most ``limit`` bytes of UTF-8; a sign cut in two becomes the replacement sign."""
    if note is None:
        return None
    raw = note.encode()
    return note if len(raw) <= limit else raw[:limit].decode("utf-8", "replace")


# The version of the tables' layout, and the columns of each table.
LAYOUT = 3
SCHEMAS = {
    "symbols": "id string, path string, language string, kind string, range_start_line int, range_end_line int, signature string, docstring string, pagerank double, cluster_id string, updated_at_commit string, updated_at_epoch bigint",
    "edges": "from_id string, to_id string, kind string, weight double",
    "class_inheritance": "class_id string, base_name string, base_path string",
    "clusters": "id string, name string, name_status string, description string, description_embedding array<float>, size int, algorithm string, algorithm_version string, modularity double, index_epoch bigint",
    "cluster_members": "cluster_id string, symbol_id string, is_bridge boolean",
    "skills": "id string, slug string, name string, description string, body string, body_sha256 string, source_cluster_id string, maturity string, confidence double, evidence_count bigint, observed_days int, emitted_at timestamp, embedding array<float>",
    "symbol_embeddings": "symbol_id string, embedding array<float>",
    "feedback": "id bigint, recorded_at timestamp_ntz, tool string, request_id string, signal string, note string",
    "index_meta": "current_epoch bigint, embedder_id string, embedder_dim int, embedder_quant string, updated_at timestamp",
}
#: Seconds after which the lock of a writer that did not end counts as left behind.
LOCK_SECONDS = 3600
#: Feedback rows of one batch.
FEEDBACK_BATCH = 10_000


def upsert_inheritance(old: DataFrame, new: DataFrame, order: str, symbols: DataFrame | None = None) -> DataFrame:
    """``class_id, base_name, base_path`` by class and base: a later row refreshes the path. With ``symbols`` only classes
    that are symbols are taken from ``new``; rows without a class or a base are left out."""
    if symbols is not None:
        new = new.join(symbols.select(F.col("id").alias("class_id")), "class_id", "left_semi")
    keys = ["class_id", "base_name"]
    last = last_wins(new.filter("class_id is not null and base_name is not null"), keys, order).select(*keys, "base_path")
    return old.select(*keys, "base_path").join(last, keys, "left_anti").unionByName(last)


def replace_embeddings(old: DataFrame, new: DataFrame, order: str, dim: int) -> DataFrame:
    """``symbol_id, embedding``: the last new vector of a symbol replaces the old one; a vector of another length than
    ``dim`` (or none) is an error when the table is written."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    checked = new.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"a vector is not of length {dim}: "), F.col("symbol_id"))).cast("array<float>")))
    last = last_wins(checked, ["symbol_id"], order).select("symbol_id", "embedding")
    return old.select("symbol_id", "embedding").join(last, "symbol_id", "left_anti").unionByName(last)


class FeedbackLog:
    """The feedback table of one folder, written by one call at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._turn = spark, path, threading.Lock()

    def read(self) -> DataFrame:
        if not Shared(self.spark).exists(self.path):
            return self.spark.createDataFrame([], SCHEMAS["feedback"])
        return self.spark.read.schema(SCHEMAS["feedback"]).parquet(self.path)

    def append(self, rows: list[tuple]) -> list[int]:
        """Adds rows ``recorded_at, tool, request_id, signal, note`` and returns their ids."""
        if len(rows) > FEEDBACK_BATCH:
            raise ValueError(f"more than {FEEDBACK_BATCH} rows of feedback at once")
        with self._turn:
            start = self.read().agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
            ids = list(range(start + 1, start + 1 + len(rows)))
            self.spark.createDataFrame([(i, *r) for i, r in zip(ids, rows)], SCHEMAS["feedback"]).coalesce(1).write.mode("append").parquet(self.path)
            return ids


class EpochStore:
    """Tables of one index as folders ``epoch=N`` with a marker written last; readers see whole epochs only.

    Works on any file system Spark reaches. The layout's version is stamped once and checked on every start.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str | None = None, lock_seconds: float = LOCK_SECONDS):
        self.spark, self.root, self.lock_seconds = spark, root.rstrip("/"), lock_seconds
        self.owner = owner or f"{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.files = Shared(spark)

    @property
    def marker(self) -> str:
        return f"{self.root}/ready.json"

    @property
    def lock(self) -> str:
        return f"{self.root}/writer.lock"

    def read_marker(self) -> dict | None:
        """The marker, or None where there is none; a malformed one raises ValueError."""
        text = self.files.read(self.marker)
        if text is None:
            return None
        value = json.loads(text)
        if not isinstance(value, dict) or not isinstance(value.get("epoch"), int) or value["epoch"] < 1:
            raise ValueError("malformed marker")
        return value

    def bootstrap(self) -> int:
        """Stamps the layout's version where none is; another version raises ValueError. May be repeated."""
        text = self.files.read(f"{self.root}/layout.json")
        if text is None:
            self.files.replace(f"{self.root}/layout.json", json.dumps({"versions": list(range(1, LAYOUT + 1)), "tables": sorted(SCHEMAS)}))
            return LAYOUT
        version = max(json.loads(text)["versions"])
        if version != LAYOUT:
            raise ValueError(f"the tables are of layout {version}, not {LAYOUT}")
        return version

    def begin(self) -> int:
        """The number of the next epoch; a writer that dies leaves the marker as it was.

        The lock names its owner and time. One held by another writer is refused, but one older than ``lock_seconds`` was
        left behind and is taken over.
        """
        self.bootstrap()
        own = json.dumps({"owner": self.owner, "at": datetime.now(timezone.utc).timestamp()})
        if not self.files.write(self.lock, own, new_only=True):
            held = json.loads(self.files.read(self.lock) or "{}")
            if datetime.now(timezone.utc).timestamp() - held.get("at", 0) < self.lock_seconds:
                raise RuntimeError(f"another writer is open: {held.get('owner')}")
            self.files.write(self.lock, own)
        now = self.read_marker()
        return (now["epoch"] if now else 0) + 1

    def _holds(self) -> None:
        held = json.loads(self.files.read(self.lock) or "{}")
        if held.get("owner") != self.owner:
            raise RuntimeError("the lock is not held by this writer")

    def write(self, epoch: int, name: str, df: DataFrame) -> None:
        self._holds()
        df.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}/{name}")

    def write_meta(self, epoch: int, embedder_id: str, embedder_dim: int, embedder_quant: str) -> None:
        """The one row of ``index_meta``, written over that of an earlier start of this epoch."""
        row = [(epoch, embedder_id, embedder_dim, embedder_quant, datetime.now(timezone.utc).replace(tzinfo=None))]
        self.write(epoch, "index_meta", self.spark.createDataFrame(row, SCHEMAS["index_meta"]).coalesce(1))

    def commit(self, epoch: int, **facts) -> None:
        """Writes the marker beside and renames it, so that it is there whole or not at all."""
        self._holds()
        self.files.replace(self.marker, json.dumps({"epoch": epoch, "written_at": datetime.now(timezone.utc).isoformat(), **facts}))
        self.files.delete(self.lock)

    def abort(self) -> None:
        self._holds()
        self.files.delete(self.lock)

    def table(self, name: str) -> DataFrame:
        """A table of the epoch the marker names; RuntimeError where none is ready."""
        now = self.read_marker()
        if now is None:
            raise RuntimeError("the index is not ready")
        return self.spark.read.parquet(f"{self.root}/epoch={now['epoch']}/{name}")
