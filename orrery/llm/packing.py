"""Filling containers of fixed capacity (problem 8) by patterns of lengths fitted to the histogram of lengths."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.lineage import Cuts
from orrery.llm import tokens

#: Lengths that patterns are enumerated from besides the exact complement, and the space a pattern may leave.
GRID, SLACK = 40, 4
#: Steps of the least-squares fit.
FIT_STEPS = 400
#: Rows of one length that one task numbers.
NUMBERED = 100_000


def patterns(counts: np.ndarray, grid: int = GRID, slack: int = SLACK) -> np.ndarray:
    """Patterns of two to four lengths that fill a container up to ``slack``; one row each, 0 for no length.

    The last length of every pattern is the largest one present that still fits; the ones before it come from all
    lengths (first) and from ``grid`` lengths spread evenly over the documents.
    """
    capacity = len(counts) - 1
    present = np.flatnonzero(counts[1:]) + 1
    if not len(present):
        return np.zeros((0, 4), np.int64)
    largest = np.zeros(capacity + 1, np.int64)
    largest[present] = present
    largest = np.maximum.accumulate(largest)
    mass = np.cumsum(counts[present])
    spread = np.unique(present[np.searchsorted(mass, np.linspace(0, mass[-1], grid + 1)[1:], side="left").clip(0, len(present) - 1)])
    few = spread[:: max(1, len(spread) // 12)]
    two = present[:, None]
    three = np.stack(np.meshgrid(present, spread, indexing="ij"), -1).reshape(-1, 2)
    four = np.stack(np.meshgrid(spread, few, few, indexing="ij"), -1).reshape(-1, 3)
    out = []
    for rows in (two, three, four):
        left = capacity - rows.sum(axis=1)
        rows, left = rows[left > 0], left[left > 0]
        last = largest[left]
        good = (last > 0) & (left - last <= slack)
        rows = np.column_stack([rows[good], last[good]])
        out.append(np.pad(rows, ((0, 0), (0, 4 - rows.shape[1]))))
    found = np.sort(np.concatenate(out), axis=1)
    return np.unique(found, axis=0)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared error to the histogram (accelerated projected gradient)."""
    if not len(rows):
        return np.zeros(0)
    # Longer documents weigh more, as they are the harder ones to place later.
    weight = np.sqrt(np.arange(len(counts), dtype=float) / len(counts))
    weight[0] = 0
    target = counts * weight

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, i], x, len(counts)) for i in range(rows.shape[1])) * weight

    def back(y: np.ndarray) -> np.ndarray:
        return (y * weight)[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        if norm == 0:
            return np.zeros(len(rows))
        v /= norm
    step = 1 / (norm * 1.05)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * back(forward(y) - target), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """Patterns with their repeat counts that use every document of the histogram exactly once.

    ``counts[s]`` documents have size ``s``; the last index is the capacity. Fitted counts are rounded down, and what is
    left is packed by patterns too: the largest length first, then always the largest that fits.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    capacity, out = len(counts) - 1, []
    if left[capacity]:
        out.append((Counter({capacity: 1}), int(left[capacity])))
        left[capacity] = 0
    rows = patterns(left)
    x = fit(rows, left.astype(float))
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        use = Counter(int(s) for s in rows[i] if s)
        times = min([int(x[i]), *(int(left[s]) // m for s, m in use.items())])
        if times > 0:
            for s, m in use.items():
                left[s] -= times * m
            out.append((use, times))
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return out
        use: Counter = Counter()
        space, at = capacity, len(present) - 1
        while at >= 0:
            at = min(at, int(np.searchsorted(present, space, side="right")) - 1)
            if at < 0:
                break
            s = int(present[at])
            m = min(space // s, int(left[s]))
            use[s] += m
            space -= m * s
            at -= 1
        times = min(int(left[s]) // m for s, m in use.items())
        for s, m in use.items():
            left[s] -= times * m
        out.append((use, times))


def pack(df: DataFrame, ident: str, text: str, capacity: int, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``container_id, doc_id, piece_no, token_start, n_tokens``: every document in containers of ``capacity`` tokens.

    A document is split only if it is larger than the capacity: into full pieces and a rest. Null and empty texts take
    no space and are listed in container 0. Repeated rows are packed as often as they occur; an empty table gives an
    empty result. Extra columns do not matter.

    Scale: the driver sees the histogram (at most one number per size up to the capacity) and makes the plan from it;
    documents are numbered within their size in salted parts and find their container by a join with the plan, whose
    rows are bounded by the capacity, not by the data. The plan is checked to hold every piece exactly once.
    """
    spark, cuts = df.sparkSession, Cuts(df.sparkSession, "pack")
    sized = tokens.with_sizes(df.withColumnsRenamed({ident: "doc_id"}), text, ["doc_id"], vocabulary)
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    rest = F.col("n_tokens") % capacity
    last = F.greatest(full + F.when(rest > 0, 1).otherwise(0), F.lit(1)) - 1
    pieces = sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    size = F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("int")
    pieces = pieces.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), start.alias("token_start"), size.alias("size"))
    pieces = cuts.cut(pieces)
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("size").count().collect():
        histogram[row["size"]] = row["count"]
    made, base, at, table = plan(histogram), 0, np.zeros(capacity + 1, np.int64), []
    for use, times in made:
        for s, m in sorted(use.items()):
            table.append((s, int(at[s]), int(at[s] + times * m), base, m))
            at[s] += times * m
        base += times
    held = np.where(np.arange(capacity + 1) > 0, histogram, 0)
    if (at != held).any():
        raise RuntimeError(f"the plan does not hold every piece once: sizes {np.flatnonzero(at != held)[:5].tolist()}")
    places = spark.createDataFrame(table or [(-1, 0, 0, 0, 1)], "psize int, first bigint, beyond bigint, base bigint, per int")
    # Numbers within a size: salted parts are numbered on their own and moved by the sizes of the parts before.
    salts = max(1, int(-(-histogram.max() // NUMBERED)))
    salted = pieces.filter("size > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("size", "salt").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    )
    parts = parts.select(F.col("size").alias("s2"), F.col("salt").alias("t2"), "before")
    window = Window.partitionBy("size", "salt").orderBy("doc_id", "piece_no")
    numbered = salted.withColumn("n", F.row_number().over(window) - 1).join(parts, (F.col("size") == F.col("s2")) & (F.col("salt") == F.col("t2")))
    numbered = numbered.withColumn("n", F.col("n") + F.col("before"))
    found = numbered.join(F.broadcast(places), (F.col("size") == F.col("psize")) & (F.col("n") >= F.col("first")) & (F.col("n") < F.col("beyond")))
    container = (F.col("base") + F.floor((F.col("n") - F.col("first")) / F.col("per"))).cast("bigint")
    out = found.select(container.alias("container_id"), "doc_id", "piece_no", "token_start", F.col("size").cast("bigint").alias("n_tokens"))
    # Texts without a token take no place.
    none = pieces.filter("size = 0").select(F.lit(0).cast("bigint").alias("container_id"), "doc_id", "piece_no", "token_start", F.lit(0).cast("bigint").alias("n_tokens"))
    return out.unionByName(none)
