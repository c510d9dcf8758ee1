"""Weights between nodes, cluster assembly, naming, bridges and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import path_affinity, short_name

#: Weights of cosine, time and path, and the weight below which an edge is dropped.
COSINE, TEMPORAL, AFFINITY, PRUNE = 0.4, 0.05, 0.4, 0.3
#: Content shorter than this is short.
SHORT = 100
# Words that name nothing.
STOP_WORDS = ("get", "set", "do", "make", "run", "is", "has", "to")


def temporal_proximity(a: str, b: str) -> Column:
    """1 / (1 + days apart); 0 if a time is missing."""
    return F.coalesce(1 / (1 + F.abs(F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / F.lit(86_400_000_000.0)), F.lit(0.0))


def fused_weights(edges: DataFrame, symbols: DataFrame, cos: Column | None = None, temporal: Column | None = None, prune: float = PRUNE) -> DataFrame:
    """Edges between known symbols with the fused weight, those below ``prune`` left out. Without vectors or times only paths count."""
    a, b = symbols.select(F.col("id").alias("from_id"), F.col("path").alias("pa")), symbols.select(F.col("id").alias("to_id"), F.col("path").alias("pb"))
    pairs = edges.select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id")
    weight = F.lit(COSINE) * (cos if cos is not None else F.lit(0.0)) + F.lit(TEMPORAL) * (temporal if temporal is not None else F.lit(0.0)) + F.lit(AFFINITY) * path_affinity("pa", "pb")
    return pairs.select("from_id", "to_id", weight.alias("weight")).filter(F.col("weight") >= prune)


def short_content_penalty(members: DataFrame, short: int = SHORT) -> DataFrame:
    """Members that stay when communities of more than three, most of them short, lose their least ranked short ones.

    ``members``: ``community, id, pagerank, content``. In closed form: of L long and S short members the first
    ``max(L, 3 - L)`` short ones by pagerank stay where L + S > 3. Nulls count as empty content and rank 0.
    """
    is_short = F.length(F.coalesce("content", F.lit(""))) < short
    # Counts come from a pre-aggregated table, so that a community that holds most rows is not gathered for them.
    counts = members.groupBy("community").agg(F.count_if(is_short).alias("s"), F.count_if(~is_short).alias("l"))
    rank = F.row_number().over(Window.partitionBy("community", is_short).orderBy(F.coalesce("pagerank", F.lit(0.0)).desc(), F.col("id").desc()))
    keep = F.when(F.col("s") + F.col("l") > 3, F.least(F.col("s"), F.greatest(F.col("l"), 3 - F.col("l")))).otherwise(F.col("s"))
    return members.withColumn("__r", rank).join(counts, "community").filter(~is_short | (F.col("__r") <= keep)).drop("__r", "s", "l")


def dominant_words(members: DataFrame, least_length: int = 3, least_count: int = 2) -> DataFrame:
    """``cluster_id, word, n``: the most frequent word of the members' names, ties by word."""
    words = members.select("cluster_id", F.explode(split_identifier_of_id("id")).alias("word")).filter((F.length("word") >= least_length) & ~F.col("word").isin(*STOP_WORDS))
    counts = words.groupBy("cluster_id", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    return counts.groupBy("cluster_id").agg(F.min_by("word", F.struct((-F.col("n")).alias("k"), "word")).alias("word"), F.max("n").alias("n"))


def split_identifier_of_id(column: str) -> Column:
    """Words of the last name of an id, but of nothing for a file itself."""
    last = F.element_at(F.split(F.col(column), "::"), -1)
    spaced = F.regexp_replace(last, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.when(F.col(column).contains("::"), F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\-.\s]+", " ")), " "), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def dominant_basenames(members: DataFrame) -> DataFrame:
    """``cluster_id, basename, n``: the file name most members are in, ties by name."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    counts = members.filter("path is not null").groupBy("cluster_id", base.alias("basename")).agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(F.min_by("basename", F.struct((-F.col("n")).alias("k"), "basename")).alias("basename"), F.max("n").alias("n"))


def anchors(members: DataFrame) -> DataFrame:
    """``cluster_id, anchor``: the member of highest pagerank (NaN and null lowest), ties by id."""
    rank = F.when(F.isnan("pagerank"), None).otherwise(F.col("pagerank"))
    return members.groupBy("cluster_id").agg(F.min_by("id", F.struct((-F.coalesce(rank, F.lit(float("-inf")))).alias("k"), "id")).alias("anchor"))


def names(members: DataFrame) -> DataFrame:
    """``cluster_id, anchor, stable_id, name``: a name from the dominant word and file, else the anchor, and an id that only depends on the anchor."""
    whole = anchors(members).join(dominant_words(members).select("cluster_id", "word"), "cluster_id", "left").join(dominant_basenames(members).select("cluster_id", "basename"), "cluster_id", "left")
    anchor = F.lower(short_name("anchor"))
    name = (
        F.when(F.col("word").isNotNull() & F.col("basename").isNotNull(), F.concat_ws("-", "word", "basename"))
        .when(F.col("word").isNotNull(), F.concat_ws("-", "word", anchor))
        .when(F.col("basename").isNotNull(), F.concat(F.lit("cluster-"), "basename"))
        .otherwise(F.concat(F.lit("cluster-"), anchor))
    )
    return whole.select("cluster_id", "anchor", F.substring(F.sha2(F.concat_ws("|", F.lit("louvain"), "anchor"), 256), 1, 16).alias("stable_id"), name.alias("name"))


def bridges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``cluster_id, id``: members with an edge to a member of another cluster."""
    m = members.select("id", "cluster_id").filter("cluster_id is not null")
    out = edges.select("from_id", "to_id").distinct().join(m.select(F.col("id").alias("from_id"), F.col("cluster_id").alias("ca")), "from_id")
    out = out.join(m.select(F.col("id").alias("to_id"), F.col("cluster_id").alias("cb")), "to_id").filter(F.col("ca") != F.col("cb"))
    return out.select(F.col("ca").alias("cluster_id"), F.col("from_id").alias("id")).distinct()


def assemble(symbols: DataFrame, edges: DataFrame, resolution: float = 1.5) -> DataFrame:
    """Clusters from nothing: fused weights, communities, penalty, names, bridges: ``stable_id, name, anchor, size, n_bridges``."""
    from orrery.operators.graph import louvain

    member = louvain(fused_weights(edges, symbols), resolution=resolution)
    rows = symbols.join(member, "id").select("id", "path", "pagerank", F.col("community"), F.coalesce("docstring", "signature").alias("content"))
    kept = short_content_penalty(rows).withColumn("cluster_id", F.col("community"))
    size = kept.groupBy("cluster_id").agg(F.count("*").alias("size"))
    n_bridges = bridges(kept, edges).groupBy("cluster_id").agg(F.count("*").alias("n_bridges"))
    out = names(kept).join(size, "cluster_id").join(n_bridges, "cluster_id", "left").fillna(0, ["n_bridges"])
    return out.select("stable_id", "name", "anchor", "size", "n_bridges")


def mirror(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """Symbols with ``cluster_id`` set from the memberships (the smallest id of several), null where none holds."""
    own = members.groupBy("symbol_id").agg(F.min("cluster_id").alias("__c"))
    return symbols.drop("cluster_id").join(own, F.col("id") == F.col("symbol_id"), "left").withColumnRenamed("__c", "cluster_id").drop("symbol_id")
