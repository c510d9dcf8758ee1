"""Mixing sources to target shares of all tokens (problem 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.lineage import Cuts
from orrery.llm import tokens

#: Seed of the random keys.
SEED = 20_260


def source_name(column: str) -> Column:
    """A source without regard to case, outer blanks and ``-`` for ``_``."""
    return F.translate(F.lower(F.trim(F.col(column))), "-", "_")


def budgets(have: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, tuple[float, int, int]]:
    """Share, full epochs and tokens of the last epoch of every source with documents.

    Shares of sources without a token are spread over the others in proportion. Without ``total`` the mixture is the
    largest one in which no source needs more than its repeats; a larger ``total`` is lowered to that.
    """
    usable = [(s, share, most) for s, share, most in targets if have.get(s, 0) > 0 and share and share > 0 and most and most > 0]
    whole = sum(share for _, share, _ in usable)
    if not usable:
        return {}
    largest = min(have[s] * most * whole / share for s, share, most in usable)
    size = largest if total is None else min(total, largest)
    out = {}
    for s, share, most in usable:
        budget = min(round(size * share / whole), have[s] * most)
        out[s] = (share / whole, budget // have[s], budget % have[s])
    return out


def mix(df: DataFrame, targets: DataFrame, ident: str, text: str, source: str, total: int | None = None, seed: int = SEED, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture ``doc_id, source, epoch, n_tokens`` and the report of the shares reached.

    ``targets``: ``source, target_share, max_repeats``. Documents whose source is null, blank or no target take no part
    and are reported under ``(none)``. Every source is put in random order by a hash of the id and cut where its sum of
    tokens is nearest to its budget; a source smaller than its budget is taken in whole epochs first, never more than
    ``max_repeats`` in all. Texts that are null or empty count 0 tokens. Ids must be unique. Empty tables give an empty
    mixture.

    Scale: rows are range-sorted by (source, key), so a source that holds most rows spreads over many partitions. Prefix
    sums are sums within a partition moved by the sums of the partitions before, a table of partitions times sources.
    """
    spark, cuts = df.sparkSession, Cuts(df.sparkSession, "mix")
    # A small table, one row a source.
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select(source_name("source").alias("source"), "target_share", "max_repeats").collect()]
    named = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), source_name(source).alias("name"))
    known = F.col("name").isin([s for s, _, _ in wanted if s]) if wanted else F.lit(False)
    named = named.withColumn("source", F.when(known, F.col("name")).otherwise("(none)"))
    # Written before the sort by range, which reads its input twice: texts are tokenized once.
    sized = cuts.cut(tokens.with_sizes(named, "text", ["doc_id", "source"], vocabulary))
    keyed = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    # No number of partitions is given, so adaptive execution chooses it by size.
    ordered = keyed.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    ordered = cuts.cut(ordered.withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sums = cuts.cut(sums)
    have = {r["source"]: (r["tokens"], r["docs"]) for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).collect()}
    plan = budgets({s: t for s, (t, _) in have.items()}, wanted, total)
    table = spark.createDataFrame([(s, e, rest) for s, (_, e, rest) in plan.items()] or [("", 0, 0)], "source string, epochs int, rest bigint")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select("source", "part", (F.sum("tokens").over(before) - F.col("tokens")).alias("before"))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ordered.withColumn("upto", F.sum("n_tokens").over(within)).join(offsets, ["source", "part"]).join(F.broadcast(table), "source")
    upto = F.col("upto") + F.col("before")
    # The document that crosses the budget is taken if that comes nearer to it.
    taken = (upto <= F.col("rest")) | ((upto - F.col("n_tokens") < F.col("rest")) & (upto - F.col("rest") < F.col("rest") - upto + F.col("n_tokens")))
    times = F.col("epochs") + F.when(taken & (F.col("rest") > 0), 1).otherwise(0)
    copies = running.withColumn("times", times).filter("times > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"), "n_tokens")
    shares = {s: (share, most) for s, share, most in wanted}
    facts = [(s, shares.get(s, (None, None))[0], plan[s][0] if s in plan else None, shares.get(s, (None, None))[1], *have.get(s, (0, 0))) for s in dict.fromkeys([*shares, *have])]
    known_facts = spark.createDataFrame(facts or [("", None, None, None, 0, 0)], "source string, target_share double, feasible_share double, max_repeats int, tokens_available bigint, documents_available bigint")
    reached = copies.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"), F.max("epoch").alias("repeats"))
    report = known_facts.join(reached, "source", "left").fillna(0, ["tokens", "rows", "repeats"])
    report = report.withColumn("share_reached", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    return copies, report
