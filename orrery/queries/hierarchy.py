"""Problem 4: hierarchies of walked symbols and of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import hierarchy as H
from orrery.tables import current_symbols, table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """Both kinds of link in one table; ids carry their kind so that one contraction serves both."""
    walk = H.walk_links(table(spark, folder, "walk_contexts"))
    inherit = H.with_parents_as_nodes(H.inherit_links(table(spark, folder, "class_inheritance"), current_symbols(spark, folder, "path", "kind")))

    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(kind), "node_id").alias("node_id"), F.concat(F.lit(kind), "parent_id").alias("parent_id"))

    return tagged(walk, "w ").unionByName(tagged(inherit, "i "))


def _link() -> Column:
    return F.when(F.col("node_id").startswith("w "), "walk").otherwise("inherit").alias("link")


def _bare(column: str) -> Column:
    return F.when(F.col(column) == H.CYCLE, F.col(column)).otherwise(F.substring(column, 3, 1 << 30))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every walked symbol that has a parent and of every class with a base."""
    found = H.resolve_hierarchy(_links(spark, folder)).filter(F.col("depth") != 0)
    return found.select(_link(), _bare("node_id").alias("node_id"), _bare("root_id").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path from the root of every node, roots included; null for nodes on or below a cycle."""
    found = H.resolve_hierarchy(_links(spark, folder), with_path=True)
    path = F.array_join(F.transform("path", lambda x: F.substring(x, 3, 1 << 30)), " > ")
    return found.select(_link(), _bare("node_id").alias("node_id"), _bare("root_id").alias("root_id"), "depth", path.alias("full_path"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every ancestor-descendant pair of the walked symbols and the classes."""
    found = H.resolve_hierarchy(_links(spark, folder), with_path=True)
    pairs = H.descendants(found).withColumn("node_id", F.col("ancestor_id"))
    return pairs.select(_link(), _bare("ancestor_id").alias("ancestor_id"), _bare("descendant_id").alias("descendant_id"), "distance")


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants}

_LINKS = r"""
w AS (SELECT * FROM (SELECT regexp_replace(replace(symbol_id, '\', '/'), '^(\./)+', '') AS node_id,
        regexp_replace(replace(parent_symbol_id, '\', '/'), '^(\./)+', '') AS parent_id,
        row_number() OVER (PARTITION BY regexp_replace(replace(symbol_id, '\', '/'), '^(\./)+', '')
                           ORDER BY walked_at DESC NULLS LAST, regexp_replace(replace(parent_symbol_id, '\', '/'), '^(\./)+', '') NULLS FIRST) AS rn
      FROM walk_contexts) WHERE rn = 1),
s AS (SELECT id, path, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at_epoch DESC, path, kind) AS rn FROM symbols) WHERE rn = 1),
cls AS (SELECT id, path, list_last(string_split(id, '::')) AS name FROM s WHERE kind = 'class'),
ci AS (SELECT DISTINCT class_id AS node_id,
         list_last(regexp_split_to_array(trim(regexp_replace(base_name, '[<\[(].*$', '')), '\.|::')) AS base,
         regexp_replace(replace(base_path, '\', '/'), '^(\./)+', '') AS base_path FROM class_inheritance),
infile AS (SELECT path, name, min(id) AS id FROM cls GROUP BY ALL),
inrepo AS (SELECT string_split(path, '/')[1] AS repo, name, min(id) AS id FROM cls GROUP BY ALL HAVING count(*) = 1),
il AS (SELECT ci.node_id, coalesce(f.id, CASE WHEN ci.base_path IS NULL THEN r.id END, ci.base) AS parent_id
       FROM ci LEFT JOIN infile f ON f.path = coalesce(ci.base_path, string_split(ci.node_id, '::')[1]) AND f.name = ci.base
               LEFT JOIN inrepo r ON r.repo = string_split(ci.node_id, '/')[1] AND r.name = ci.base),
links AS (SELECT 'walk' AS link, node_id, CASE WHEN parent_id IN (SELECT node_id FROM w) THEN parent_id END AS parent_id FROM w
          UNION ALL SELECT 'inherit', node_id, parent_id FROM il
          UNION ALL SELECT DISTINCT 'inherit', parent_id, NULL FROM il WHERE parent_id NOT IN (SELECT node_id FROM il)),
up AS (SELECT link, node_id, node_id AS root_id, 0 AS depth, node_id AS full_path FROM links WHERE parent_id IS NULL
       UNION ALL SELECT l.link, l.node_id, u.root_id, u.depth + 1, u.full_path || ' > ' || l.node_id
       FROM links l JOIN up u ON u.link = l.link AND u.node_id = l.parent_id),
allrows AS (SELECT l.link, l.node_id, coalesce(u.root_id, '(cycle)') AS root_id, coalesce(u.depth, -1)::INT AS depth, u.full_path
            FROM links l LEFT JOIN up u ON u.link = l.link AND u.node_id = l.node_id)
"""

ORACLES = {
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT link, node_id, root_id, depth FROM allrows WHERE depth <> 0",
    "p4_paths": f"WITH RECURSIVE {_LINKS} SELECT link, node_id, root_id, depth, full_path FROM allrows",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS}, anc AS (
        SELECT link, node_id AS descendant_id, parent_id AS ancestor_id, 1 AS distance FROM links
          WHERE parent_id IS NOT NULL AND (link, node_id) IN (SELECT (link, node_id) FROM up)
        UNION ALL SELECT a.link, a.descendant_id, l.parent_id, a.distance + 1 FROM anc a JOIN links l ON l.link = a.link AND l.node_id = a.ancestor_id
          WHERE l.parent_id IS NOT NULL)
      SELECT link, ancestor_id, descendant_id, distance::INT AS distance FROM anc""",
}
