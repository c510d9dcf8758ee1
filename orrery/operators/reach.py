"""Reachability over typed edges: callers, callees, impact and file context, from many starting points at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.lineage import Cuts


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, towards: str = "callers", kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """``seed, id, depth``: what every seed reaches within ``max_depth`` links, with the least depth.

    ``edges``: ``from_id, to_id, kind``; ``seeds``: ``seed, id`` (several ids may share a seed, such as a file). Callers
    are followed against the edges, callees along them. A seed counts only if a cycle leads back to it. Edges with a null
    end lead nowhere; an unknown seed reaches nothing; ``max_depth <= 0`` gives an empty result.

    Each level is one join of the frontier with the edges, one distinct (pre-aggregated) and one anti join with what was
    visited, and is written to the shared folder, so plans stay flat. All seeds share one plan.
    """
    spark, cuts = edges.sparkSession, Cuts(edges.sparkSession, "reach")
    here, there = ("to_id", "from_id") if towards == "callers" else ("from_id", "to_id")
    links = edges.filter(F.col("kind").isin(list(kinds)) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    links = links.select(F.col(here).alias("at"), F.col(there).alias("next")).distinct()
    frontier = seeds.select("seed", "id").filter("seed is not null and id is not null").distinct()
    levels: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        found = frontier.join(links, F.col("id") == F.col("at")).select("seed", F.col("next").alias("id")).distinct()
        if levels:
            found = found.join(reduce(DataFrame.unionByName, [x.select("seed", "id") for x in levels]), ["seed", "id"], "left_anti")
        frontier = cuts.cut(found)
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    if not levels:
        return spark.createDataFrame([], "seed string, id string, depth int")
    return reduce(DataFrame.unionByName, levels)


def ranked_hits(hits: DataFrame, symbols: DataFrame, limit: int, per: str = "seed") -> DataFrame:
    """Hits joined with their symbols, the first ``limit`` per seed by pagerank (nulls last), then id."""
    from pyspark.sql import Window

    order = Window.partitionBy(per).orderBy(F.col("pagerank").desc_nulls_last(), "id")
    joined = hits.join(symbols.select("id", "path", "range_start_line", "range_end_line", "pagerank"), "id")
    return joined.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def impact(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, max_depth: int = 5, limit: int = 100) -> DataFrame:
    """What breaks if a seed changes: callers up to ``max_depth``, without the seed's own symbols.

    Adds ``path_kind``: ``exact`` for direct callers, else ``approximate``. Hits of several starting symbols of one seed
    are merged by least depth before the limit is applied.
    """
    hits = reach(edges, seeds, max_depth).join(seeds.select("seed", "id"), ["seed", "id"], "left_anti")
    return ranked_hits(hits, symbols, limit).withColumn("path_kind", F.when(F.col("depth") == 1, "exact").otherwise("approximate"))


def file_context(edges: DataFrame, symbols: DataFrame, paths: DataFrame, max_depth: int = 2, limit: int = 50) -> DataFrame:
    """Callers from outside of every file in ``paths (path)``: ``path, id, depth`` and the caller's columns."""
    members = symbols.join(paths.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("seed"), "id")
    hits = ranked_outside(reach(edges, members, max_depth), symbols)
    return ranked_hits(hits, symbols, limit)


def ranked_outside(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits that do not lie in the seed's own file."""
    own = symbols.select("id", F.col("path").alias("own_path"))
    return hits.join(own, "id").filter(F.col("own_path") != F.col("seed")).drop("own_path")


def imports_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, direction, other``: distinct import edges in and out of every id."""
    imports = edges.filter(F.col("kind") == "imports").select("from_id", "to_id").distinct()
    out = imports.join(ids, imports.from_id == ids.id).select("id", F.lit("out").alias("direction"), F.col("to_id").alias("other"))
    into = imports.join(ids, imports.to_id == ids.id).select("id", F.lit("in").alias("direction"), F.col("from_id").alias("other"))
    return out.unionByName(into)
