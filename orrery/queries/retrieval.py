"""Named queries of retrieval with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.globs import glob_to_regex
from orrery.functions.text import cosine, dot
from orrery.operators import retrieval as R
from orrery.tables import current_clusters, current_symbols, table

WORDS, LANGUAGES, GLOBS = "merge cached snapshot_", ["python", "go"], ["**/src/**/*.py", "mono-harbor/**"]
SYMBOL = ("path", "language", "kind", "signature", "docstring", "pagerank", "cluster_id", "updated_at_commit", "range_start_line", "range_end_line")

#: Current symbols and clusters as common tables of the SQL.
S = """s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at_epoch DESC NULLS LAST, path, language, kind, signature, docstring,
  pagerank, cluster_id, updated_at_commit, range_start_line, range_end_line) AS rn FROM symbols) WHERE rn = 1)"""
C = """c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY index_epoch DESC NULLS LAST, name, description, size, algorithm, modularity) AS rn FROM clusters) WHERE rn = 1)"""


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Current symbols with all columns the queries use; each query's plan reads only its own."""
    return current_symbols(spark, folder, *SYMBOL)


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return current_clusters(spark, folder, "name", "description", "size", "algorithm", "modularity", "name_status")


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector of the embedding with the smallest id."""
    row = table(spark, folder, "embeddings").orderBy("vec_id").select("embedding").head()
    return [float(x) for x in row[0]]


def lexical_search(spark, folder):
    # Nine places in binary arithmetic, halves away from zero; NaN stays, and so does what is infinite when multiplied.
    size = F.abs("pagerank") * 1e9
    low = F.floor(size).cast("double")
    whole = F.when(size < 2.0**52, low + F.when(size - low >= 0.5, 1.0).otherwise(0.0)).otherwise(size)
    places = F.when(size < float("inf"), F.signum("pagerank") * whole / 1e9).otherwise(F.col("pagerank"))
    # In the order NaN is as large as infinity.
    order = F.when(F.isnan("pagerank"), float("inf")).otherwise(F.col("pagerank"))
    found = R.lexical(symbols(spark, folder), WORDS).orderBy(order.desc_nulls_last(), "id").limit(80)
    return found.select("id", "path", places.alias("pagerank"))


def lexical_lang_filter(spark, folder):
    return R.lexical(symbols(spark, folder), WORDS, languages=LANGUAGES).select("id", "language")


def glob_filter(spark, folder):
    return R.lexical(symbols(spark, folder), "packet", paths=GLOBS).select("id", "path")


def language_dispatch(spark, folder):
    from orrery.functions.text import language_of

    files = table(spark, folder, "source_files").select("file_path").distinct()
    return files.groupBy(F.coalesce(language_of("file_path"), F.lit("none")).alias("language")).agg(F.count("*").alias("files"))


def bare_name_suffix(spark, folder):
    return symbols(spark, folder).filter(F.lower("id").endswith("::entry") | F.lower("id").endswith("::request")).select("id", "path", "kind")


def batch_hydrate(spark, folder):
    """The 50 most linked ids joined to their symbols, in the order of their links."""
    best = table(spark, folder, "edges").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("links")).orderBy(F.col("links").desc(), "id").limit(50)
    return symbols(spark, folder).join(F.broadcast(best), "id").select("id", "links", "path", F.coalesce("signature", F.concat_ws(" ", "kind", "id")).alias("summary"))


def path_equality(spark, folder):
    """The first 50 symbols of every file by pagerank (NaN and null last), then id."""
    from pyspark.sql import Window

    rank = F.when(F.isnan("pagerank"), None).otherwise(F.col("pagerank"))
    order = Window.partitionBy("path").orderBy(rank.desc_nulls_last(), "id")
    return symbols(spark, folder).withColumn("n", F.row_number().over(order)).filter("n <= 50").select("path", "id", "n")


def knn_l2(spark, folder):
    return R.nearest_l2(table(spark, folder, "embeddings"), query_vector(spark, folder), 40).withColumn("distance", F.round("distance", 6))


def knn_cosine(spark, folder):
    return R.nearest_cosine(table(spark, folder, "embeddings"), query_vector(spark, folder), 40).withColumn("similarity", F.round("similarity", 6))


def knn_filtered(spark, folder):
    return R.nearest_l2(table(spark, folder, "embeddings").filter("label = 3"), query_vector(spark, folder), 20).withColumn("distance", F.round("distance", 6))


def cosine_to_centroid(spark, folder):
    """Cosine of every vector with the mean vector of its label: means by position, pre-aggregated."""
    rows = table(spark, folder, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))
    return rows.join(means, "label").select("vec_id", F.round(cosine("embedding", "mean"), 6).alias("similarity"))


def semantic_match_dot(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("q", F.array(*[F.lit(x) for x in query_vector(spark, folder)]))
    return rows.select("vec_id", F.round(dot("embedding", "q"), 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(5)


def _lanes(spark, folder):
    docs = table(spark, folder, "documents").filter("text is not null")
    lex = docs.filter(F.lower("text").contains("settings")).select("doc_id", F.length("text").alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(40)
    vec = R.nearest_l2(table(spark, folder, "embeddings"), query_vector(spark, folder), 40)
    return {
        "lexical": R.ranked(lex, F.col("n").desc(), "doc_id").select("doc_id", "rank"),
        "vector": R.ranked(vec, "distance", "vec_id").select(F.col("vec_id").alias("doc_id"), "rank"),
    }


def rrf_fusion(spark, folder):
    return R.fuse(_lanes(spark, folder), "doc_id").select("doc_id", F.round("score", 6).alias("score"), "reasons")


def hybrid_query(spark, folder):
    """The fused first ten with their documents."""
    fused = R.fuse(_lanes(spark, folder), "doc_id").withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "doc_id").limit(10)
    return table(spark, folder, "documents").join(F.broadcast(fused), "doc_id").select("doc_id", "score", "reasons", F.length("text").alias("n"))


def cluster_name_match(spark, folder):
    return clusters(spark, folder).filter(F.lower("name").contains("cluster")).orderBy(F.col("size").desc(), "id").limit(50).select("id", "name", "size")


def cluster_description_match(spark, folder):
    return clusters(spark, folder).filter(F.lower("description").contains("unresolved")).select("id", "name")


def any_token_match(spark, folder):
    from functools import reduce

    hay = F.lower(F.concat_ws(" ", "name", "description"))
    hit = reduce(lambda a, b: a | b, [hay.contains(t) for t in "harbor deadline".split()])
    return clusters(spark, folder).filter(hit).select("id")


def skill_token_fraction(spark, folder):
    """Share of the task's words that a cluster's name and description hold."""
    rows = clusters(spark, folder).withColumn("embedding", F.lit(None).cast("array<float>"))
    return R.mixed_similarity(rows, [1.0], "nested symbols harbor job").filter("score > 0").select("id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (lexical_search, lexical_lang_filter, glob_filter, language_dispatch, bare_name_suffix, batch_hydrate, path_equality, knn_l2, knn_cosine, knn_filtered, cosine_to_centroid, semantic_match_dot, rrf_fusion, hybrid_query, cluster_name_match, cluster_description_match, any_token_match, skill_token_fraction)}

_HIT = " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for t in ("merge", "cached", "snapshot_") for c in R.FIELDS)
_PACKET = " OR ".join(f"contains(lower(coalesce({c}, '')), 'packet')" for c in R.FIELDS)
_GLOB = " OR ".join(f"regexp_matches(path, '{glob_to_regex(g)}')" for g in GLOBS)
_Q = "q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_L2 = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = f"({_DOT.format('{0}', '{1}')} / sqrt({_DOT.format('{0}', '{0}')}) / sqrt({_DOT.format('{1}', '{1}')}))"
_LANES = f"""{_Q}, lex AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE contains(lower(text), 'settings') QUALIFY rank <= 40),
  vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_L2}, vec_id) AS rank FROM embeddings, q QUALIFY rank <= 40),
  lanes AS (SELECT doc_id, 1.0::DOUBLE / (60 + rank) AS part, 'lexical' AS lane FROM lex UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + rank), 'vector' FROM vec),
  fused AS (SELECT doc_id, sum(part) AS raw, string_agg(lane, '+' ORDER BY lane) AS reasons FROM lanes GROUP BY doc_id),
  scored AS (SELECT doc_id, round(raw / max(raw) OVER (), 6) AS score, reasons FROM fused)"""
_TOKENS = " + ".join(f"contains(lower(concat_ws(' ', name, description)), '{t}')::INT" for t in "nested symbols harbor job".split())

ORACLES = {
    "lexical_search": f"WITH {S} SELECT id, path, round(pagerank, 9) AS pagerank FROM s WHERE {_HIT} ORDER BY CASE WHEN isnan(pagerank) THEN 'Infinity'::DOUBLE ELSE pagerank END DESC NULLS LAST, id LIMIT 80",
    "lexical_lang_filter": f"WITH {S} SELECT id, language FROM s WHERE ({_HIT}) AND language IN ('python', 'go')",
    "glob_filter": f"WITH {S} SELECT id, path FROM s WHERE ({_PACKET}) AND ({_GLOB})",
    "language_dispatch": """SELECT coalesce(CASE WHEN e IN ('ts','tsx','mts','cts') THEN 'typescript' WHEN e IN ('js','jsx','mjs','cjs') THEN 'javascript' WHEN e IN ('py','pyi') THEN 'python'
        WHEN e = 'go' THEN 'go' WHEN e = 'rs' THEN 'rust' END, 'none') AS language, count(*) AS files FROM (SELECT DISTINCT file_path, regexp_extract(lower(file_path), '\\.([a-z]+)$', 1) AS e FROM source_files) GROUP BY 1""",
    "bare_name_suffix": f"WITH {S} SELECT id, path, kind FROM s WHERE lower(id) LIKE '%::entry' OR lower(id) LIKE '%::request'",
    "batch_hydrate": f"""WITH {S}, b AS (SELECT to_id AS id, count(*) AS links FROM edges GROUP BY 1 ORDER BY links DESC, id LIMIT 50)
        SELECT id, links, path, coalesce(signature, concat_ws(' ', kind, id)) AS summary FROM s JOIN b USING (id)""",
    "path_equality": f"WITH {S} SELECT path, id, n::INT AS n FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY pagerank DESC NULLS LAST, id) AS n FROM s WHERE NOT isnan(coalesce(pagerank, 0))) WHERE n <= 50",
    "knn_l2": f"WITH {_Q} SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings, q ORDER BY {_L2}, vec_id LIMIT 40",
    "knn_cosine": f"WITH {_Q} SELECT vec_id, round({_COS.format('embedding', 'q')}, 6) AS similarity FROM embeddings, q ORDER BY {_COS.format('embedding', 'q')} DESC, vec_id LIMIT 40",
    "knn_filtered": f"WITH {_Q} SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY {_L2}, vec_id LIMIT 20",
    "cosine_to_centroid": f"""WITH e AS (SELECT vec_id, label, embedding, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
        m AS (SELECT label, pos, avg(x::DOUBLE) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS mean FROM m GROUP BY 1)
        SELECT vec_id, round({_COS.format('embedding', 'mean')}, 6) AS similarity FROM embeddings JOIN c USING (label)""",
    "semantic_match_dot": f"WITH {_Q} SELECT vec_id, round({_DOT.format('embedding', 'q')}, 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 5",
    "rrf_fusion": f"WITH {_LANES} SELECT doc_id, score, reasons FROM scored",
    "hybrid_query": f"WITH {_LANES}, t AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 10) SELECT doc_id, score, reasons, length(text) AS n FROM t JOIN documents USING (doc_id)",
    "cluster_name_match": f"WITH {C} SELECT id, name, size FROM c WHERE contains(lower(name), 'cluster') ORDER BY size DESC, id LIMIT 50",
    "cluster_description_match": f"WITH {C} SELECT id, name FROM c WHERE contains(lower(description), 'unresolved')",
    "any_token_match": f"WITH {C} SELECT id FROM c WHERE contains(lower(concat_ws(' ', name, description)), 'harbor') OR contains(lower(concat_ws(' ', name, description)), 'deadline')",
    "skill_token_fraction": f"WITH {C} SELECT id, round(({_TOKENS}) / 4.0::DOUBLE, 6) AS score FROM c WHERE ({_TOKENS}) > 0",
}
