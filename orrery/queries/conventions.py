"""Named queries of conventions and of a whole ingest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import clustering as K
from orrery.operators import conventions as C
from orrery.operators import graph as G
from orrery.operators import scanners as N
from orrery.queries.parsing import _files
from orrery.sources import parse as P
from orrery.tables import table


def _sites(spark, folder) -> DataFrame:
    """Modules by file: targets of import edges, and the modules bases are written with."""
    edges = table(spark, folder, "edges").filter("kind = 'imports'").select(F.split("from_id", "::")[0].alias("file"), F.split("to_id", "::")[0].alias("module"))
    bases = table(spark, folder, "class_inheritance").filter("base_name like '%.%'")
    bases = bases.select(F.split("class_id", "::")[0].alias("file"), F.regexp_extract("base_name", r"^(.*)\.[^.]*$", 1).alias("module"))
    return edges.unionByName(bases).filter("file is not null and module != ''").distinct()


def library_conventions(spark, folder):
    """The library of every purpose that most files import, and all frameworks."""
    return C.library_conventions(_sites(spark, folder))


def test_convention(spark, folder):
    """Test files and the framework they import."""
    paths = table(spark, folder, "source_files").select(F.col("file_path").alias("file"))
    return C.test_framework(C.test_files(paths), _sites(spark, folder))


def _parsed(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    return P.tables_of(P.parse(_files(spark, folder)))


def seed_skills(spark, folder):
    """The seed cards of all scanners over the parsed current files."""
    symbols, edges, inheritance = _parsed(spark, folder)
    cards = C.seed_skills(C.import_sites(edges), symbols.select(F.col("path").alias("file")), inheritance)
    return cards.select("id", "slug", "name", "library", "evidence_count", F.array_join("sample_paths", "\n").alias("sample_paths"))


def ingest(spark, folder):
    """A whole ingest as one row per step: files parsed to symbols and edges, names resolved, the graph built and ranked,
    clusters assembled and named, conventions found."""
    from orrery.lineage import Cuts

    cuts = Cuts(spark, "ingest")
    parsed = cuts.cut(P.parse(_files(spark, folder)))
    symbols, edges, inheritance = (cuts.cut(x) for x in P.tables_of(parsed))
    symbols = cuts.cut(symbols.dropDuplicates(["id"]))
    resolved, unresolved = G.resolve_edges(edges, symbols)
    known = cuts.cut(resolved.filter("resolved").select("from_id", F.col("to_id"), "kind", "weight"))
    graph = cuts.cut(G.build_graph(symbols, known))
    ranks = G.pagerank(symbols.select("id"), graph)
    ranked = cuts.cut(symbols.join(ranks.withColumnRenamed("rank", "pagerank"), "id", "left"))
    clusters = K.assemble(ranked, graph)
    cards = C.seed_skills(C.import_sites(edges), symbols.select(F.col("path").alias("file")), inheritance)
    steps = [("files", parsed), ("symbols", symbols), ("edges", graph), ("unresolved names", unresolved), ("ranked symbols", ranked.filter("pagerank is not null")), ("clusters", clusters), ("seed cards", cards)]
    out = None
    for name, df in steps:
        row = df.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (library_conventions, test_convention, seed_skills, ingest)}


def _values(name: str, libraries) -> str:
    return f"{name}(place, library, needle) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(libraries)) + ")"


def _users(name: str, source: str = "sites") -> str:
    return f"""{name}_users AS (SELECT file, library FROM {source} JOIN {name} ON module = needle OR starts_with(module, needle || '/') OR starts_with(module, needle || '.')
        QUALIFY row_number() OVER (PARTITION BY file, module ORDER BY place) = 1)"""


def _count(name: str) -> str:
    return f"SELECT library, count(DISTINCT file) AS files, (SELECT min(place) FROM {name} x WHERE x.library = u.library) AS place FROM {name}_users u GROUP BY library HAVING count(DISTINCT file) >= 2"


_SITES = r"""sites AS (SELECT DISTINCT * FROM (SELECT string_split(from_id, '::')[1] AS file, string_split(to_id, '::')[1] AS module FROM edges WHERE kind = 'imports'
    UNION ALL SELECT string_split(class_id, '::')[1], regexp_extract(base_name, '^(.*)\.[^.]*$', 1) FROM class_inheritance WHERE base_name LIKE '%.%') WHERE file IS NOT NULL AND module <> '')"""
ORACLES = {
    "library_conventions": f"""WITH {_SITES}, {_values("lo", C.LOGGERS)}, {_values("co", C.CONFIGURATION)}, {_values("pe", C.PERSISTENCE)}, {_values("fr", C.FRAMEWORKS)},
      {_users("lo")}, {_users("pe")}, {_users("fr")},
      co_known AS (SELECT file, module, library FROM sites JOIN co ON module = needle OR starts_with(module, needle || '/') OR starts_with(module, needle || '.')
        QUALIFY row_number() OVER (PARTITION BY file, module ORDER BY place) = 1),
      co_users AS (SELECT file, library FROM co_known UNION ALL SELECT file, '{C.OWN_CONFIG_NAME}' FROM sites WHERE module LIKE '%/%' AND regexp_matches(module, '(?i)(^|[./])config(\\.[a-z]+)?$') AND (file, module) NOT IN (SELECT (file, module) FROM co_known)),
      c AS (SELECT 'logging' AS scanner, * FROM ({_count("lo")}) UNION ALL SELECT 'config-env', library, files, coalesce(place, 99) FROM ({_count("co")}) UNION ALL SELECT 'persistence', * FROM ({_count("pe")}))
      SELECT scanner, library, files FROM c QUALIFY row_number() OVER (PARTITION BY scanner ORDER BY files DESC, place) = 1 UNION ALL SELECT 'framework', library, files FROM ({_count("fr")})""",
    "test_convention": f"""WITH {_SITES}, t AS (SELECT DISTINCT file_path AS file FROM source_files WHERE regexp_matches(file_path, '{N.TEST_PATHS}')), ts AS (SELECT * FROM sites WHERE file IN (SELECT file FROM t)),
      {_values("te", C.TEST_FRAMEWORKS)}, {_users("te", "ts")}, b AS (SELECT library FROM (SELECT library, count(DISTINCT file) AS n, (SELECT min(place) FROM te x WHERE x.library = u.library) AS place FROM te_users u GROUP BY library) ORDER BY n DESC, place LIMIT 1)
      SELECT coalesce((SELECT library FROM b), CASE WHEN (SELECT bool_and(regexp_matches(file, '{C.GO_TEST_FILE}')) FROM t) THEN '{C.GO_TESTS}' END) AS library, count(*) AS files FROM t HAVING count(*) >= 2""",
}
