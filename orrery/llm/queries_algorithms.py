"""Queries of the problems on vectors, groups, pieces, containers and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import knn, mixing, packing, pieces, topn
from orrery.tables import current_clusters, current_files, current_symbols, run_limit, table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ``top_n`` current symbols of every cluster by pagerank, then id."""
    rows = current_symbols(spark, folder, "cluster_id", "pagerank").filter(F.col("cluster_id").rlike(r"\S"))
    found = topn.top_n(rows, "cluster_id", "pagerank", "id", run_limit(spark, folder, "top_n"))
    return found.select(F.col("group_id").alias("cluster_id"), F.col("item_id").alias("symbol_id"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ``knn_k`` most similar clusters of every current cluster with a usable description vector."""
    rows = current_clusters(spark, folder, "description_embedding")
    dim = table(spark, folder, "index_meta").agg(F.max("embedder_dim")).head()[0]
    return knn.nearest(rows, "id", "description_embedding", dim, run_limit(spark, folder, "knn_k"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the nearest of the other."""
    found = p3_neighbours(spark, folder)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every current symbol whose text is longer than ``piece_max``."""
    limit, overlap = run_limit(spark, folder, "piece_max"), run_limit(spark, folder, "piece_overlap")
    symbols = current_symbols(spark, folder, "path", "range_start_line", "range_end_line", "signature")
    long = pieces.oversized_symbols(symbols, current_files(spark, folder, "text"), limit)
    return pieces.cut_items(long, limit, overlap).withColumnRenamed("item_id", "symbol_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols that had to be cut."""
    return p6_pieces(spark, folder).filter("piece_no = 0").select("symbol_id")


def p6_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of every symbol that was cut: the lines its pieces cover without gaps, and pieces that break a rule (none)."""
    limit, overlap = run_limit(spark, folder, "piece_max"), run_limit(spark, folder, "piece_overlap")
    before = Window.partitionBy("symbol_id").orderBy("piece_no")
    rows = p6_pieces(spark, folder).withColumn("before", F.lag("last_line").over(before))
    # A piece goes on where the one before ended, in the same line only if that was broken, and repeats no more lines than asked for.
    gap = (F.col("before").isNotNull()) & ~F.col("new_from_line").isin(F.col("before"), F.col("before") + 1)
    wrong = (F.col("n_chars") > limit) | (F.length("text") != F.col("n_chars")) | gap | (F.col("new_from_line") - F.col("first_line") > overlap)
    return rows.groupBy("symbol_id").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count_if(wrong).alias("wrong"))


def p8_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers, and what breaks a rule (none): containers above the capacity, tokens lost, split documents
    that would have fitted."""
    capacity = run_limit(spark, folder, "pack_capacity")
    rows = p8_packed(spark, folder)
    full = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("over_capacity"))
    per = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.countDistinct("piece_no").alias("d"), F.sum("n_tokens").alias("n"), F.max(F.col("token_start") + F.col("n_tokens")).alias("upto"))
    lost = F.count_if((F.col("k") != F.col("d")) | (F.col("n") != F.col("upto")))
    split = F.count_if((F.col("k") > 1) & (F.col("n") <= capacity))
    # Both sides are one row.
    return per.agg(F.count("*").alias("documents"), lost.alias("lost"), split.alias("split")).join(F.broadcast(full), F.lit(True))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of one that is too large, with its container."""
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", run_limit(spark, folder, "pack_capacity"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of space used."""
    capacity = run_limit(spark, folder, "pack_capacity")
    full = p8_packed(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    out = full.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.sum("k").alias("pieces"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: one row for every time a document is used."""
    return _mixed(spark, folder)[0]


def p9_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of every source of the mixture the repeats it may have, and what breaks a rule (none): documents used more often,
    epochs left out, documents of another source."""
    targets = table(spark, folder, "mix_targets").select(mixing.source_name("source").alias("source"), "max_repeats")
    known = table(spark, folder, "documents").select("doc_id", mixing.source_name("source").alias("named"))
    per = p9_mixture(spark, folder).groupBy("doc_id", "source").agg(F.count("*").alias("k"), F.max("epoch").alias("most"))
    per = per.join(targets, "source").join(known, "doc_id")
    wrong = (F.col("k") > F.col("max_repeats")) | (F.col("k") != F.col("most")) | ~F.col("named").eqNullSafe(F.col("source"))
    return per.groupBy("source").agg(F.max("max_repeats").alias("max_repeats"), F.count_if(wrong).alias("wrong"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached."""
    return _mixed(spark, folder)[1]


QUERIES = {
    "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p5_found": p5_found, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_cover": p6_cover, "p8_cover": p8_cover, "p9_cover": p9_cover,
    "p8_packed": p8_packed, "p8_report": p8_report, "p9_mixture": p9_mixture, "p9_report": p9_report,
}

_NEAREST = """
        WITH c AS (SELECT id, description_embedding AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY index_epoch DESC NULLS LAST, description_embedding NULLS FIRST) AS rn FROM clusters) WHERE rn = 1),
        u AS (SELECT id, v::DOUBLE[] AS v FROM c WHERE v IS NOT NULL AND len(v) = (SELECT max(embedder_dim) FROM index_meta) AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
        n AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 13) DESC, b.id) AS rank FROM u a JOIN u b ON a.id <> b.id
              QUALIFY rank <= (SELECT int_value FROM run_limits WHERE name = 'knn_k'))"""
_LINES = r"""
        s AS (SELECT * FROM (SELECT id, path, range_start_line AS a, range_end_line AS b,
                     row_number() OVER (PARTITION BY id ORDER BY updated_at_epoch DESC NULLS LAST, path, range_start_line, range_end_line, signature) AS rn FROM symbols) WHERE rn = 1),
        f AS (SELECT file_path, regexp_split_to_array(ltrim(text, chr(65279)), '\r\n|\n') AS lines FROM
                (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seen_at DESC NULLS LAST, text) AS rn FROM source_files) WHERE rn = 1)"""
ORACLES = {
    "p3_found": f"{_NEAREST} SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM n",
    "p6_cover": f"""WITH {_LINES}
        SELECT s.id AS symbol_id, greatest(least(a, b), 1) AS first_line, least(greatest(a, b), len(lines))::INT AS last_line, 0 AS wrong FROM s JOIN f ON f.file_path = s.path
        WHERE length(array_to_string(f.lines[greatest(least(a, b), 1):greatest(a, b)], chr(10))) > (SELECT int_value FROM run_limits WHERE name = 'piece_max')""",
    "p8_cover": "SELECT count(DISTINCT doc_id) AS documents, 0 AS lost, 0 AS split, 0 AS over_capacity FROM documents",
    "p9_cover": """SELECT t.source, any_value(t.max_repeats) AS max_repeats, 0 AS wrong FROM (SELECT replace(lower(trim(source)), '-', '_') AS source, max_repeats FROM mix_targets) t
        JOIN (SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS source FROM documents WHERE text <> '') d USING (source) GROUP BY t.source""",
    "p5_found": r"""
        WITH s AS (SELECT * FROM (SELECT id, cluster_id, pagerank,
                     row_number() OVER (PARTITION BY id ORDER BY updated_at_epoch DESC NULLS LAST, cluster_id, pagerank) AS rn FROM symbols) WHERE rn = 1),
        r AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY pagerank DESC, id) AS k FROM s
              WHERE regexp_matches(cluster_id, '\S') AND pagerank IS NOT NULL AND NOT isnan(pagerank))
        SELECT cluster_id, id AS symbol_id FROM r WHERE k <= (SELECT int_value FROM run_limits WHERE name = 'top_n')""",
    "p6_found": r"""
        WITH s AS (SELECT * FROM (SELECT id, path, range_start_line AS a, range_end_line AS b,
                     row_number() OVER (PARTITION BY id ORDER BY updated_at_epoch DESC NULLS LAST, path, range_start_line, range_end_line, signature) AS rn FROM symbols) WHERE rn = 1),
        f AS (SELECT file_path, regexp_split_to_array(ltrim(text, chr(65279)), '\r\n|\n') AS lines FROM
                (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seen_at DESC NULLS LAST, text) AS rn FROM source_files) WHERE rn = 1)
        SELECT s.id AS symbol_id FROM s JOIN f ON f.file_path = s.path
        WHERE length(array_to_string(f.lines[greatest(least(a, b), 1):greatest(a, b)], chr(10))) > (SELECT int_value FROM run_limits WHERE name = 'piece_max')""",
}
