"""Named queries of sources, parsing and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.functions.text import language_of
from orrery.operators.retrieval import embed_column
from orrery.queries.retrieval import S, symbols
from orrery.sources import files as L
from orrery.sources import parse as P
from orrery.tables import current_files, table


def _files(spark, folder) -> DataFrame:
    rows = current_files(spark, folder, "text", "n_bytes").filter(F.col("n_bytes") <= L.MOST_BYTES)
    return rows.select(F.col("file_path").alias("path"), language_of("file_path").alias("language"), "text")


def parse_symbols(spark, folder):
    """Symbols parsed from the current files: kinds, lines and owners."""
    return P.tables_of(P.parse(_files(spark, folder)))[0].select("id", "kind", "range_start_line", "range_end_line").dropDuplicates(["id"])


def parse_edges(spark, folder):
    """Parsed edges resolved against the parsed symbols: by language, kind and whether they are resolved."""
    found, edges, _ = P.tables_of(P.parse(_files(spark, folder)))
    resolved = G.resolve_edges(edges, found)[0]
    return resolved.groupBy(language_of_id("from_id").alias("language"), "kind", "resolved").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def language_of_id(column: str):
    return F.regexp_extract(F.split(F.col(column), "::")[0], r"\.([a-z]+)$", 1)


def parse_inheritance(spark, folder):
    return P.tables_of(P.parse(_files(spark, folder)))[2]


def parse_warnings(spark, folder):
    rows = P.parse(_files(spark, folder)).filter(F.size("warnings") > 0)
    return rows.select("path", F.array_join("warnings", "; ").alias("warnings"))


def parser_agreement(spark, folder):
    """How the parsed symbols agree with the given ones, by kind."""
    mine = parse_symbols(spark, folder).select("id", F.col("kind").alias("parsed_kind"), F.col("range_start_line").alias("a"))
    both = symbols(spark, folder).select("id", "kind", "range_start_line", "range_end_line").join(mine, "id", "left")
    same = (F.col("kind") == F.col("parsed_kind")) & (F.col("a") == F.least("range_start_line", "range_end_line"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("parsed_kind").isNotNull()).alias("found"), F.count_if(same).alias("same"))


def snippet_window(spark, folder):
    """Hash and lines of the snippet of every current symbol."""
    files = current_files(spark, folder, "text").withColumnRenamed("file_path", "path")
    rows = L.snippets(symbols(spark, folder), files)
    return rows.filter("snippet is not null").select("id", F.sha2("snippet", 256).alias("hash"), F.size(F.split("snippet", "\n")).alias("n_lines"))


def hash_embeddings(spark, folder):
    """Deterministic vectors of all symbol ids, rounded."""
    rows = embed_column(symbols(spark, folder).select("id"), "id", 16)
    return rows.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def walk_size_filter(spark, folder):
    """Files within the size limit and of a known language, by language."""
    return _files(spark, folder).filter("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


def ignored_files(spark, folder):
    """Current files by whether their repository's list leaves them out."""
    from orrery.sources.events import ignored

    options = table(spark, folder, "watcher_options").select("repo", "ignore_extra").dropDuplicates(["repo"])
    rows = table(spark, folder, "source_files").select("repo", "file_path").distinct().join(options, "repo", "left")
    below = F.expr("substring(file_path, length(repo) + 2)")
    return rows.groupBy("repo", ignored(below, "ignore_extra").alias("ignored")).agg(F.count("*").alias("files"))


def signal_cards(spark, folder):
    """Front matter of the cards of all named clusters, by hash."""
    from orrery.operators import skills as B
    from orrery.queries.retrieval import clusters

    rows = clusters(spark, folder).filter("name_status = 'named'")
    head = B.front_matter({"id": F.col("id"), "name": F.col("name"), "size": F.col("size")})
    return rows.select("id", F.sha2(head, 256).alias("head_sha256"), F.length(head).alias("n_chars"))


QUERIES = {f.__name__: f for f in (parse_symbols, parse_edges, parse_inheritance, parse_warnings, parser_agreement, snippet_window, hash_embeddings, walk_size_filter, ignored_files, signal_cards)}

_F = """f AS (SELECT file_path AS path, text, n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seen_at DESC NULLS LAST, text, n_bytes) AS rn FROM source_files) WHERE rn = 1)"""
ORACLES = {
    "snippet_window": f"""WITH {S}, {_F}, j AS (SELECT s.*, regexp_split_to_array(f.text, '\\r?\\n') AS ls FROM s LEFT JOIN f USING (path)),
      k AS (SELECT *, greatest(least(range_start_line, range_end_line) - 5, 1) AS lo, least(greatest(range_start_line, range_end_line) + 5, len(ls)) AS hi FROM j),
      c AS (SELECT id, signature, docstring, CASE WHEN ls IS NOT NULL AND hi >= lo THEN array_to_string(ls[lo + (greatest(hi - lo + 1 - 40, 0) // 2) : lo + (greatest(hi - lo + 1 - 40, 0) // 2) + least(hi - lo + 1, 40) - 1], chr(10)) END AS cut FROM k),
      o AS (SELECT id, coalesce(cut, signature, docstring) AS snippet FROM c)
      SELECT id, sha256(snippet) AS hash, len(string_split(snippet, chr(10)))::INT AS n_lines FROM o WHERE snippet IS NOT NULL""",
    "walk_size_filter": f"""WITH {_F}, l AS (SELECT text, regexp_extract(lower(path), '\\.([a-z]+)$', 1) AS e FROM f WHERE n_bytes <= 5242880),
      m AS (SELECT text, CASE WHEN e IN ('ts','tsx','mts','cts') THEN 'typescript' WHEN e IN ('js','jsx','mjs','cjs') THEN 'javascript' WHEN e IN ('py','pyi') THEN 'python' WHEN e = 'go' THEN 'go' WHEN e = 'rs' THEN 'rust' END AS language FROM l)
      SELECT language, count(*) AS files, sum(length(text))::BIGINT AS chars FROM m WHERE language IS NOT NULL GROUP BY 1""",
}
