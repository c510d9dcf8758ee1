"""Named queries of reachability, graph building, name resolution and ranking with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.lineage import cut
from orrery.operators import graph as G
from orrery.operators import reach as R
from orrery.queries.retrieval import S, symbols
from orrery.tables import table

ROUNDS = 6


def _seeds(spark, folder) -> DataFrame:
    """The 20 symbols with most callers."""
    calls = table(spark, folder, "edges").filter("kind = 'calls'").groupBy(F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("n"))
    return cut(calls.orderBy(F.col("n").desc(), "id").limit(20).select(F.col("id").alias("seed"), "id"), "seeds")


def callers_depth3(spark, folder):
    return R.reach(table(spark, folder, "edges"), _seeds(spark, folder), 3)


def callees_depth3(spark, folder):
    return R.reach(table(spark, folder, "edges"), _seeds(spark, folder), 3, towards="callees")


def impact_symbol(spark, folder):
    """What breaks if one of the most called symbols changes."""
    out = R.impact(table(spark, folder, "edges"), symbols(spark, folder), _seeds(spark, folder))
    return out.select("seed", "id", "path", "depth", "path_kind")


def impact_files(spark, folder):
    """The same for whole files: all symbols of a file are one start."""
    syms = symbols(spark, folder)
    paths = _seeds(spark, folder).select(F.split("id", "::")[0].alias("path")).distinct()
    seeds = syms.join(paths, "path").select(F.col("path").alias("seed"), "id")
    return R.impact(table(spark, folder, "edges"), syms, seeds).groupBy("seed", "depth", "path_kind").agg(F.count("*").alias("n"))


def file_context(spark, folder):
    paths = _seeds(spark, folder).select(F.split("id", "::")[0].alias("path")).distinct()
    return R.file_context(table(spark, folder, "edges"), symbols(spark, folder), paths).select("seed", "id", "depth")


def imports_in_out(spark, folder):
    ids = _seeds(spark, folder).select("id")
    return R.imports_of(table(spark, folder, "edges"), ids)


def file_ranges(spark, folder):
    """First and last line of every file's symbols."""
    syms = symbols(spark, folder)
    return syms.groupBy("path").agg(F.min(F.least("range_start_line", "range_end_line")).alias("first_line"), F.max(F.greatest("range_start_line", "range_end_line")).alias("last_line"))


def build_graph_weights(spark, folder):
    return G.build_graph(symbols(spark, folder), table(spark, folder, "edges")).withColumn("weight", F.round("weight", 6))


def external_edges(spark, folder):
    """Edges with an end that is no symbol, kept where external stubs are wanted."""
    edges = table(spark, folder, "edges")
    whole = G.build_graph(symbols(spark, folder), edges, include_external=True)
    return whole.join(G.build_graph(symbols(spark, folder), edges), ["from_id", "to_id", "kind"], "left_anti").select("from_id", "to_id", "kind", F.round("weight", 6).alias("weight"))


def file_as_module(spark, folder):
    return G.file_modules(symbols(spark, folder).filter("kind <> 'module'"))


def _parser_edges(spark, folder) -> DataFrame:
    """Classes and their bases as parser edges: the base is a name that has to be resolved."""
    rows = table(spark, folder, "class_inheritance").filter("class_id is not null and base_name is not null").distinct()
    name = F.element_at(F.split(F.regexp_replace("base_name", r"<.*$", ""), r"\."), -1)
    return rows.select(F.col("class_id").alias("from_id"), name.alias("to_name"), F.lit(None).cast("string").alias("to_path"), F.lit("extends").alias("kind"))


def resolve_edges(spark, folder):
    """Exact id, same file, only one of the name, or unresolved."""
    return G.resolve_edges(_parser_edges(spark, folder), symbols(spark, folder).filter("kind = 'class'"))[0]


def unresolved_names(spark, folder):
    return G.resolve_edges(_parser_edges(spark, folder), symbols(spark, folder).filter("kind = 'class'"))[1]


def resolve_path_hint(spark, folder):
    """Every class looked for from its own file by name and a hint of the file it is in."""
    classes = symbols(spark, folder).filter("kind = 'class'")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z]+$", "")
    edges = classes.select(F.col("path").alias("from_id"), G.tail_name("id").alias("to_name"), F.concat(F.lit("./"), stem).alias("to_path"), F.lit("imports").alias("kind"))
    return G.resolve_edges(edges, classes)[0]


def pagerank_fixed(spark, folder):
    return G.pagerank(symbols(spark, folder), table(spark, folder, "edges"), fixed=ROUNDS).withColumn("rank", F.round("rank", 9))


def pagerank_converged(spark, folder):
    """Ranks of all symbols at convergence by the library's rule (see the README)."""
    return G.pagerank(symbols(spark, folder), table(spark, folder, "edges")).withColumn("rank", F.round("rank", 9))


def pagerank_mass(spark, folder):
    """Number of ranks, their sum, and ranks that are not positive (none), at convergence."""
    ranks = G.pagerank(symbols(spark, folder), table(spark, folder, "edges"))
    return ranks.agg(F.count("*").alias("n"), F.round(F.sum("rank"), 6).alias("mass"), F.count_if(~(F.col("rank") > 0)).alias("wrong"))


def louvain_cover(spark, folder):
    """Nodes of the summed graph, and those in no or in several communities (none). The graph is built once."""
    graph = cut(G.build_graph(symbols(spark, folder), table(spark, folder, "edges")), "graph")
    member = G.louvain(graph).groupBy("id").agg(F.count("*").alias("k"))
    nodes = graph.select(F.col("from_id").alias("id")).unionByName(graph.select(F.col("to_id").alias("id"))).distinct()
    return nodes.join(member, "id", "left").agg(F.count("*").alias("nodes"), F.count_if(~F.col("k").eqNullSafe(1)).alias("wrong"))


def louvain(spark, folder):
    """Communities of the summed graph with their sizes."""
    member = G.louvain(G.build_graph(symbols(spark, folder), table(spark, folder, "edges")))
    return member.groupBy("community").agg(F.count("*").alias("size"))


def unreferenced_symbols(spark, folder):
    """Functions nothing calls, by language."""
    syms = symbols(spark, folder).filter("kind = 'function'")
    called = table(spark, folder, "edges").filter("kind = 'calls'").select(F.col("to_id").alias("id"))
    return syms.join(called, "id", "left_anti").groupBy("language").agg(F.count("*").alias("n"))


def hub_symbols(spark, folder):
    """In-degree and its share for the 100 most linked symbols of each kind of edge."""
    deg = table(spark, folder, "edges").groupBy("kind", F.col("to_id").alias("id")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), "id")
    return deg.withColumn("k", F.row_number().over(order)).filter("k <= 100")


QUERIES = {f.__name__: f for f in (callers_depth3, callees_depth3, impact_symbol, impact_files, file_context, imports_in_out, file_ranges, build_graph_weights, external_edges, file_as_module, resolve_edges, unresolved_names, resolve_path_hint, pagerank_fixed, pagerank_converged, pagerank_mass, louvain, louvain_cover, unreferenced_symbols, hub_symbols)}

_SEEDS = "seeds AS (SELECT to_id AS id, to_id AS seed FROM (SELECT to_id, count(DISTINCT from_id) AS n FROM edges WHERE kind = 'calls' GROUP BY 1) ORDER BY n DESC, to_id LIMIT 20)"
_CALLS = "calls AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'calls')"


def _walk(start: str, here: str, there: str, depth: int) -> str:
    return f"""w AS (SELECT s.seed, e.{there} AS id, 1 AS depth FROM {start} s JOIN calls e ON e.{here} = s.id
        UNION SELECT w.seed, e.{there}, w.depth + 1 FROM w JOIN calls e ON e.{here} = w.id WHERE w.depth < {depth}),
      hits AS (SELECT seed, id, min(depth)::INT AS depth FROM w GROUP BY 1, 2)"""


_FILES = "files AS (SELECT DISTINCT string_split(id, '::')[1] AS path FROM seeds), fseeds AS (SELECT s.path AS seed, s.id FROM s JOIN files USING (path))"
_GRAPH = "ids AS (SELECT DISTINCT id FROM s), g AS (SELECT from_id, to_id, kind, sum(coalesce(weight, 1)) AS weight FROM edges WHERE from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids) GROUP BY 1, 2, 3)"
_CLS = "cls AS (SELECT DISTINCT id, path, list_last(string_split(id, '::')) AS tail FROM s WHERE kind = 'class')"
_PE = "pe AS (SELECT DISTINCT class_id AS from_id, base_name, base_path, list_last(string_split(regexp_replace(base_name, '<.*$', ''), '.')) AS to_name FROM class_inheritance WHERE class_id IS NOT NULL AND base_name IS NOT NULL)"
_RES = f"""{_CLS}, {_PE}, same AS (SELECT path, tail, min(id) AS id FROM cls GROUP BY 1, 2), uniq AS (SELECT tail, min(id) AS id FROM cls GROUP BY 1 HAVING count(*) = 1),
  r AS (SELECT pe.from_id, pe.to_name, coalesce(x.id, same.id, uniq.id) AS target FROM pe LEFT JOIN cls x ON x.id = pe.to_name
        LEFT JOIN same ON same.path = string_split(pe.from_id, '::')[1] AND same.tail = pe.to_name LEFT JOIN uniq ON uniq.tail = pe.to_name)"""


def _pagerank(rounds: int) -> str:
    parts = [f"""WITH {S}, {_GRAPH}, n AS (SELECT count(*)::DOUBLE AS n FROM ids), ft AS (SELECT from_id, to_id, sum(weight) AS w FROM g GROUP BY 1, 2),
      tot AS (SELECT from_id, sum(w) AS t FROM ft GROUP BY 1), sh AS MATERIALIZED (SELECT from_id, to_id, w / t AS share FROM ft JOIN tot USING (from_id)),
      p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank, id IN (SELECT from_id FROM tot) AS linked FROM ids, n)"""]
    for k in range(1, rounds + 1):
        parts.append(f""", p{k} AS MATERIALIZED (SELECT p.id, 0.85::DOUBLE * coalesce(f.flow, 0) + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM p{k - 1} WHERE NOT linked) / (SELECT n FROM n)
          + (1 - 0.85::DOUBLE) / (SELECT n FROM n) AS rank, linked FROM p{k - 1} p
          LEFT JOIN (SELECT to_id, sum(q.rank * sh.share) AS flow FROM sh JOIN p{k - 1} q ON q.id = sh.from_id GROUP BY 1) f ON f.to_id = p.id)""")
    return "".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM p{rounds}"


ORACLES = {
    "callers_depth3": f"WITH RECURSIVE {_SEEDS}, {_CALLS}, {_walk('seeds', 'to_id', 'from_id', 3)} SELECT seed, id, depth FROM hits",
    "callees_depth3": f"WITH RECURSIVE {_SEEDS}, {_CALLS}, {_walk('seeds', 'from_id', 'to_id', 3)} SELECT seed, id, depth FROM hits",
    "impact_symbol": f"""WITH RECURSIVE {S}, {_SEEDS}, {_CALLS}, {_walk('seeds', 'to_id', 'from_id', 5)},
      x AS (SELECT h.seed, h.id, s.path, h.depth, row_number() OVER (PARTITION BY h.seed ORDER BY CASE WHEN isnan(s.pagerank) THEN 'Infinity'::DOUBLE ELSE s.pagerank END DESC NULLS LAST, h.id) AS n
            FROM hits h JOIN s USING (id) WHERE h.id <> h.seed)
      SELECT seed, id, path, depth, CASE WHEN depth = 1 THEN 'exact' ELSE 'approximate' END AS path_kind FROM x WHERE n <= 100""",
    "impact_files": f"""WITH RECURSIVE {S}, {_SEEDS}, {_FILES}, {_CALLS}, {_walk('fseeds', 'to_id', 'from_id', 5)},
      x AS (SELECT h.seed, h.depth, row_number() OVER (PARTITION BY h.seed ORDER BY CASE WHEN isnan(s.pagerank) THEN 'Infinity'::DOUBLE ELSE s.pagerank END DESC NULLS LAST, h.id) AS n
            FROM hits h JOIN s USING (id) WHERE (h.seed, h.id) NOT IN (SELECT (seed, id) FROM fseeds))
      SELECT seed, depth, CASE WHEN depth = 1 THEN 'exact' ELSE 'approximate' END AS path_kind, count(*) AS n FROM x WHERE n <= 100 GROUP BY 1, 2, 3""",
    "file_context": f"""WITH RECURSIVE {S}, {_SEEDS}, {_FILES}, {_CALLS}, {_walk('fseeds', 'to_id', 'from_id', 2)},
      x AS (SELECT h.seed, h.id, h.depth, row_number() OVER (PARTITION BY h.seed ORDER BY CASE WHEN isnan(s.pagerank) THEN 'Infinity'::DOUBLE ELSE s.pagerank END DESC NULLS LAST, h.id) AS n
            FROM hits h JOIN s USING (id) WHERE s.path <> h.seed) SELECT seed, id, depth FROM x WHERE n <= 50""",
    "imports_in_out": f"""WITH {_SEEDS}, i AS (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'imports')
      SELECT id, 'out' AS direction, to_id AS other FROM i JOIN seeds ON from_id = id UNION ALL SELECT id, 'in', from_id FROM i JOIN seeds ON to_id = id""",
    "file_ranges": f"WITH {S} SELECT path, min(least(range_start_line, range_end_line)) AS first_line, max(greatest(range_start_line, range_end_line)) AS last_line FROM s GROUP BY 1",
    "build_graph_weights": f"WITH {S}, {_GRAPH} SELECT from_id, to_id, kind, round(weight, 6) AS weight FROM g",
    "external_edges": f"WITH {S}, ids AS (SELECT DISTINCT id FROM s) SELECT from_id, to_id, kind, round(sum(coalesce(weight, 1)), 6) AS weight FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND NOT (from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids)) GROUP BY 1, 2, 3",
    "file_as_module": f"WITH {S}, k AS (SELECT * FROM s WHERE kind <> 'module') SELECT path AS id, path, min(language) AS language, 'module' AS kind FROM k WHERE path NOT IN (SELECT id FROM k) GROUP BY path",
    "resolve_edges": f"WITH {S}, {_RES} SELECT from_id, coalesce(target, to_name) AS to_id, 'extends' AS kind, target IS NOT NULL AS resolved, count(*)::DOUBLE AS weight FROM r GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"),
    "unresolved_names": f"WITH {S}, {_RES} SELECT DISTINCT to_name AS name FROM r WHERE target IS NULL",
    "resolve_path_hint": f"""WITH {S}, {_CLS}, st AS (SELECT *, regexp_replace(regexp_replace(path, '\\.[A-Za-z]+$', ''), '/(index|__init__|mod)$', '') AS stem, regexp_replace(path, '\\.[A-Za-z]+$', '') AS hint FROM cls),
      h AS (SELECT stem, tail, min(id) AS id FROM st GROUP BY 1, 2),
      ex AS (SELECT st.path AS from_id, st.tail AS to_name, coalesce(x.id, h.id) AS target FROM st LEFT JOIN cls x ON x.id = st.tail LEFT JOIN h ON h.stem = st.hint AND h.tail = st.tail)
      SELECT from_id, coalesce(target, to_name) AS to_id, 'imports' AS kind, target IS NOT NULL AS resolved, count(*)::DOUBLE AS weight FROM ex GROUP BY 1, 2, 3, 4""",
    "pagerank_fixed": _pagerank(ROUNDS),
    "pagerank_mass": f"WITH {S} SELECT count(DISTINCT id) AS n, 1.0::DOUBLE AS mass, 0 AS wrong FROM s",
    "louvain_cover": f"WITH {S}, e AS (SELECT from_id, to_id FROM edges WHERE from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM s)) SELECT count(*) AS nodes, 0 AS wrong FROM (SELECT from_id FROM e UNION SELECT to_id FROM e)",
    "unreferenced_symbols": f"WITH {S} SELECT language, count(*) AS n FROM s WHERE kind = 'function' AND id NOT IN (SELECT to_id FROM edges WHERE kind = 'calls' AND to_id IS NOT NULL) GROUP BY 1",
    "hub_symbols": "SELECT kind, id, n, k::INT AS k FROM (SELECT kind, to_id AS id, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, to_id) AS k FROM edges GROUP BY kind, to_id) WHERE k <= 100",
}
