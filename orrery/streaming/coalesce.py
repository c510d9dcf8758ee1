"""Coalescing file events into batches: the batch form and the streaming form have the same meaning.

Events of one repository belong to one batch until no event comes for a gap. Within a batch the last kind of every path
wins; the reason is the kind all paths share, or ``mixed``. Batches above a size are cut in slices in the order of paths.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Silence that ends a batch, and paths of a batch.
GAP, MOST_PATHS = "600 milliseconds", 500
#: Slots, each as long as the gap, that one window looks at.
SPAN = 1 << 16


@dataclass
class StreamStats:
    """Micro-batches waiting, being written and written, and whether writing is held back."""

    queued: int = 0
    inflight: int = 0
    written: int = 0
    paused: bool = False


def sessions(events: DataFrame, gap_seconds: float = 0.6, keys: tuple[str, ...] = ("repo",), span: int = SPAN) -> DataFrame:
    """Last kind of every path in every batch: ``repo, batch_start, batch_end, path, kind, ts``.

    ``events``: ``repo, path, kind, ts``; rows without a time are left out, equal times go by the greater kind. A batch
    ends when the gap has passed without an event; null keys form a group of their own.

    Events are first reduced to the least and greatest time of every slot as long as the gap (two events in one slot are
    always of one batch), pre-aggregated. Batches are found among the slots, whose number depends on the time spanned and
    not on the events: within spans of ``span`` slots first, and what is open at the end of a span is carried into the next
    by a window over the spans, so that no key is one task. They go back to the events by an equi-join on the slot.
    """
    gap = int(gap_seconds * 1e6)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.filter("ts is not null").withColumn("__us", micros).withColumn("__slot", F.floor(F.col("__us") / gap))
    slots = own.groupBy(*keys, "__slot").agg(F.min("__us").alias("a"), F.max("__us").alias("b"))
    slots = slots.withColumn("__span", F.floor(F.col("__slot") / span))
    order = Window.partitionBy(*keys, "__span").orderBy("__slot")
    # Starts within a span; whether its first slot starts a batch depends on the span before.
    slots = slots.withColumn("f", F.when(F.col("a") - F.lag("b").over(order) >= gap, F.col("a")))
    slots = slots.withColumn("inner", F.last("f", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = slots.groupBy(*keys, "__span").agg(F.min("a").alias("first"), F.max("b").alias("last"), F.max("f").alias("f"))
    spans_in_order = Window.partitionBy(*keys).orderBy("__span")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(spans_in_order) >= gap, F.lit(True))
    whole = whole.withColumn("begun", F.when(fresh, F.col("first"))).withColumn("open", F.coalesce("f", "begun"))
    carried = F.last("open", ignorenulls=True).over(spans_in_order.rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("__span").alias("w_span"), F.coalesce("begun", carried).alias("enters"))
    same = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys] + [F.col("__span") == F.col("w_span")]
    slots = slots.join(whole, same).withColumn("start", F.coalesce("inner", "enters"))
    spans = slots.groupBy(*keys, "start").agg(F.max("b").alias("end"))
    named = slots.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__slot").alias("__s"), F.col("start").alias("__start"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__slot") == F.col("__s")]
    window = Window.partitionBy(*keys, "path", "__start").orderBy(F.col("__us").desc(), F.col("kind").desc())
    last = own.join(named, on).withColumn("__n", F.row_number().over(window)).filter("__n = 1")
    ends = spans.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("start").alias("e_start"), "end")
    joined = last.join(ends, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys] + [F.col("__start") == F.col("e_start")])
    return joined.select(*keys, F.timestamp_micros("__start").alias("batch_start"), F.timestamp_micros(F.col("end") + gap).alias("batch_end"), "path", "kind", "ts")


def reasons(batch_paths: DataFrame, keys: list[str]) -> DataFrame:
    """One row per batch: number of paths and the reason."""
    return batch_paths.groupBy(*keys).agg(F.count("*").alias("paths"), F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("reason"))


def split_floods(batch_paths: DataFrame, keys: list[str], most: int = MOST_PATHS) -> DataFrame:
    """Adds ``slice``: batches in slices of at most ``most`` paths in order."""
    order = Window.partitionBy(*keys).orderBy("path")
    return batch_paths.withColumn("slice", F.floor((F.row_number().over(order) - 1) / most).cast("int"))


def stream_batches(events: DataFrame, sink: str, gap: str = GAP, watermark: str = "10 seconds", keys: tuple[str, ...] = ("repo",), paused=None, stats: StreamStats | None = None):
    """A streaming query that writes finished batches ``repo, batch_start, batch_end, n_events, last`` to Parquet at ``sink``.

    ``events``: a streaming DataFrame ``repo, path, kind, ts``. A batch is finished when the watermark has passed its end;
    its paths are the keys of ``last`` (path to kind, the last wins, of equal times the greater kind). ``paused``, a
    function, defers a micro-batch's results while it returns True; ``stats`` keeps count. Runs over what is there and ends
    (``availableNow``).

    The checkpoint lies in the sink's folder ``_checkpoint``, so a later start goes on where this one stopped, in any
    process; a micro-batch is written to a folder named by its number, over what an unfinished try of it left, so nothing
    is written twice. Events of one path are reduced to one map entry as they arrive.
    """
    where, stats = sink.rstrip("/"), stats or StreamStats()
    own = events.withWatermark("ts", watermark).groupBy(*keys, F.session_window("ts", gap).alias("w"))
    # One entry a path: entries are ordered by path and time, and of each path the last one stays.
    ordered = F.array_sort(F.collect_set(F.struct("path", "ts", "kind")))
    lasts = F.filter(ordered, lambda x, i: (i == F.size(ordered) - 1) | (F.get(ordered, i + 1)["path"] != x["path"]))
    pairs = F.transform(lasts, lambda x: F.struct(x["path"].alias("key"), x["kind"].alias("value")))
    out = own.agg(F.count("*").alias("n_events"), F.map_from_entries(pairs).alias("last"))
    out = out.select(*keys, F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"), "n_events", "last")

    def write(df: DataFrame, number: int) -> None:
        stats.queued += 1
        while paused is not None and paused():
            stats.paused = True
            time.sleep(0.25)
        stats.paused = False
        stats.queued, stats.inflight = stats.queued - 1, stats.inflight + 1
        try:
            df.write.mode("overwrite").parquet(f"{where}/micro_batch={number}")
        finally:
            stats.inflight -= 1
            stats.written += 1

    return out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{where}/_checkpoint").trigger(availableNow=True).start()


def drain(query, seconds: float | None = None) -> None:
    """Ends a query after all that has arrived is written."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(seconds)
