"""Named queries of clustering and cards with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import path_affinity, slug, split_identifier
from orrery.operators import clustering as K
from orrery.operators import skills as B
from orrery.queries.retrieval import C, S, clusters, symbols
from orrery.tables import table

NOW = datetime.datetime(2025, 12, 7)


def _members(spark, folder) -> DataFrame:
    return symbols(spark, folder).filter(F.col("cluster_id").rlike(r"\S"))


def path_affinity_edges(spark, folder):
    edges = table(spark, folder, "edges").select("from_id", "to_id").distinct().filter("from_id is not null and to_id is not null")
    e = edges.select("from_id", "to_id", F.split("from_id", "::")[0].alias("pa"), F.split("to_id", "::")[0].alias("pb"))
    return e.select("from_id", "to_id", F.round(path_affinity("pa", "pb"), 6).alias("affinity"))


def fused_weight_prune(spark, folder):
    return K.fused_weights(table(spark, folder, "edges"), symbols(spark, folder)).withColumn("weight", F.round("weight", 6))


def temporal_proximity(spark, folder):
    """How near a symbol's current visit is to that of its file."""
    walks = table(spark, folder, "walk_contexts").groupBy("symbol_id", "file_path").agg(F.max("walked_at").alias("a"))
    files = walks.filter("symbol_id = file_path").select(F.col("file_path").alias("fp"), F.col("a").alias("b"))
    return walks.join(files, F.col("file_path") == F.col("fp")).select("symbol_id", "file_path", F.round(K.temporal_proximity("a", "b"), 9).alias("proximity"))


def short_content_penalty(spark, folder):
    rows = _members(spark, folder).select(F.col("cluster_id").alias("community"), "id", F.when(F.isnan("pagerank"), None).otherwise(F.col("pagerank")).alias("pagerank"), F.col("docstring").alias("content"))
    return K.short_content_penalty(rows).select("community", "id")


def dominant_token(spark, folder):
    return K.dominant_words(_members(spark, folder))


def dominant_basename(spark, folder):
    return K.dominant_basenames(_members(spark, folder))


def compose_name(spark, folder):
    return K.names(_members(spark, folder)).select("cluster_id", "name")


def stable_cluster_id(spark, folder):
    return K.names(_members(spark, folder)).select("cluster_id", "anchor", "stable_id")


def bridges(spark, folder):
    return K.bridges(_members(spark, folder), table(spark, folder, "edges"))


def top_bridges(spark, folder):
    """The first ten bridges of every cluster by pagerank."""
    rows = K.bridges(_members(spark, folder), table(spark, folder, "edges")).join(symbols(spark, folder).select("id", "pagerank"), "id")
    order = Window.partitionBy("cluster_id").orderBy(F.when(F.isnan("pagerank"), None).otherwise(F.col("pagerank")).desc_nulls_last(), "id")
    return rows.withColumn("n", F.row_number().over(order)).filter("n <= 10").select("cluster_id", "id", "n")


def cluster_members_topk(spark, folder):
    """Members of every cluster with its current name, at most thirty by pagerank."""
    rank = F.when(F.isnan("pagerank"), None).otherwise(F.col("pagerank"))
    order = Window.partitionBy("cluster_id").orderBy(rank.desc_nulls_last(), "id")
    top = _members(spark, folder).withColumn("n", F.row_number().over(order)).filter("n <= 30")
    return top.join(clusters(spark, folder).select(F.col("id").alias("cluster_id"), "name"), "cluster_id", "left").select("cluster_id", "name", "id", "n")


def stale_cluster_size(spark, folder):
    """Clusters whose recorded size is not the number of their members."""
    n = _members(spark, folder).groupBy("cluster_id").agg(F.count("*").alias("members"))
    c = clusters(spark, folder).join(n, F.col("id") == F.col("cluster_id"), "left").fillna(0, ["members"])
    return c.filter("size <> members").select("id", "size", "members")


def cluster_mirror(spark, folder):
    """Cluster ids of symbols that name no current cluster are taken off."""
    known = clusters(spark, folder).select(F.col("id").alias("cluster_id"))
    members = symbols(spark, folder).select(F.col("id").alias("symbol_id"), "cluster_id").join(known, "cluster_id", "left_semi")
    return K.mirror(symbols(spark, folder), members).select("id", "cluster_id")


def symbol_cluster_name(spark, folder):
    c = clusters(spark, folder).select(F.col("id").alias("cluster_id"), "name")
    return symbols(spark, folder).join(c, "cluster_id", "left").groupBy("kind", F.coalesce("name", F.lit("(none)")).alias("name")).agg(F.count("*").alias("n"))


def split_ident(spark, folder):
    """How often every word of part names and class names occurs."""
    names = symbols(spark, folder).filter("kind = 'class'").select(F.element_at(F.split("id", "::"), -1).alias("name"))
    return names.select(F.explode(split_identifier("name")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _scored(spark, folder) -> DataFrame:
    """Clusters with their members, bridges and the days between the first and last visit of a member."""
    members = _members(spark, folder)
    seen = table(spark, folder, "walk_contexts").groupBy(F.col("symbol_id").alias("id")).agg(F.min("walked_at").alias("a"), F.max("walked_at").alias("b"))
    per = members.join(seen, "id", "left").groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("a").alias("first"), F.max("b").alias("last"))
    nb = K.bridges(members, table(spark, folder, "edges")).groupBy("cluster_id").agg(F.count("*").alias("nb"))
    per = per.join(nb, "cluster_id", "left").fillna(0, ["nb"]).withColumn("days", B.observed_days("first", "last"))
    return per.join(clusters(spark, folder).select(F.col("id").alias("cluster_id"), "name", "description", "modularity"), "cluster_id")


def observed_days(spark, folder):
    return _scored(spark, folder).select("cluster_id", "days")


def confidence(spark, folder):
    return _scored(spark, folder).select("cluster_id", F.round(B.confidence("n", "days", "modularity", "nb"), 6).alias("confidence"))


def emit_gate(spark, folder):
    return _scored(spark, folder).select("cluster_id", F.coalesce(B.gate("n", "days", "nb"), F.lit("emit")).alias("verdict"))


def maturity(spark, folder):
    return _scored(spark, folder).groupBy(B.maturity("days").alias("maturity")).agg(F.count("*").alias("n"))


def slugify(spark, folder):
    return clusters(spark, folder).select("id", slug("description", "id").alias("slug"))


def skill_id(spark, folder):
    c = clusters(spark, folder)
    return c.select("id", B.skill_id("cluster", F.col("id"), slug("name", "id")).alias("skill_id"))


def skill_body(spark, folder):
    """Cards of the clusters that pass the gate: hash and length of the body over their first ten members."""
    order = Window.partitionBy("cluster_id").orderBy("id")
    top = _members(spark, folder).withColumn("k", F.row_number().over(order)).filter("k <= 10").groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    rows = _scored(spark, folder).filter(B.gate("n", "days", "nb", 0).isNull()).join(top, "cluster_id")
    text = B.body("name", "description", "members")
    return rows.select("cluster_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("body_sha256"))


def archive_expired(spark, folder):
    """Documents as cards: those older than sixty days with their archive names."""
    docs = table(spark, folder, "documents").filter("created_at is not null and source is not null")
    cards = docs.select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("slug"), F.col("created_at").alias("emitted_at"))
    return B.expired(cards, NOW).select("id", "archive_name")


def changed_cards(spark, folder):
    """Clusters as cards that a run at the current epoch would write: new ones, those with another description than at
    their first epoch, and those that had no vector."""
    rows = table(spark, folder, "clusters").select("id", "index_epoch", F.sha2(F.coalesce("description", F.lit("")), 256).alias("body_sha256"), F.col("description_embedding").isNotNull().alias("has_vector"))
    at = F.struct("index_epoch", "body_sha256", "has_vector")
    per = rows.groupBy("id").agg(F.min(at).alias("old"), F.max(at).alias("new"), F.count_distinct("index_epoch").alias("epochs"))
    new = per.select("id", "new.body_sha256")
    return B.changed_cards(new, per.filter("epochs > 1").select("id", "old.body_sha256", "old.has_vector"))


def newest_per_group(spark, folder):
    """The newest document of every repository, ties by id."""
    docs = table(spark, folder, "documents").filter("repo is not null and created_at is not null")
    order = Window.partitionBy("repo").orderBy(F.col("created_at").desc(), "doc_id")
    return docs.withColumn("n", F.row_number().over(order)).filter("n = 1").select("repo", "doc_id")


def cluster_assembly(spark, folder):
    return K.assemble(symbols(spark, folder), table(spark, folder, "edges"))


QUERIES = {f.__name__: f for f in (path_affinity_edges, fused_weight_prune, temporal_proximity, short_content_penalty, dominant_token, dominant_basename, compose_name, stable_cluster_id, bridges, top_bridges, cluster_members_topk, stale_cluster_size, cluster_mirror, symbol_cluster_name, split_ident, observed_days, confidence, emit_gate, maturity, slugify, skill_id, skill_body, archive_expired, changed_cards, newest_per_group, cluster_assembly)}

_M = "m AS (SELECT * FROM s WHERE regexp_matches(cluster_id, '\\S'))"
_RANK = "CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END"


def _aff(a: str, b: str) -> str:
    """Affinity of two paths in SQL."""
    x, y = f"string_split({a}, '/')", f"string_split({b}, '/')"
    same = f"list_transform(range(1, least(len({x}), len({y})) + 1), lambda i: ({x})[i] = ({y})[i])"
    return f"(coalesce(list_position({same}, false) - 1, len({same}))::DOUBLE / greatest(len({x}), len({y})))"


def _split(expr: str) -> str:
    return f"list_filter(string_split(lower(regexp_replace(regexp_replace({expr}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-.\\s]+', ' ', 'g')), ' '), lambda x: x <> '')"


_LAST = "list_last(string_split(id, '::'))"
_BASE = "regexp_replace(list_last(string_split(path, '/')), '\\.[A-Za-z0-9]+$', '')"
_WORDS = f"""w AS (SELECT cluster_id, unnest({_split(_LAST)}) AS word FROM m WHERE contains(id, '::')),
  wc AS (SELECT cluster_id, word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN {K.STOP_WORDS} GROUP BY 1, 2 HAVING count(*) >= 2),
  dw AS (SELECT cluster_id, word, n FROM wc QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, word) = 1)"""
_BASES = f"""bc AS (SELECT cluster_id, {_BASE} AS basename, count(*) AS n FROM m GROUP BY 1, 2),
  db AS (SELECT cluster_id, basename, n FROM bc QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, basename) = 1)"""
_ANCHOR = f"an AS (SELECT cluster_id, id AS anchor FROM m QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY {_RANK} DESC NULLS LAST, id) = 1)"
_BRIDGES = "br AS (SELECT DISTINCT a.cluster_id, e.from_id AS id FROM edges e JOIN m a ON a.id = e.from_id JOIN m b ON b.id = e.to_id WHERE a.cluster_id <> b.cluster_id)"
_SCORED = f"""{S}, {C}, {_M}, {_BRIDGES}, seen AS (SELECT symbol_id AS id, min(walked_at) AS a, max(walked_at) AS b FROM walk_contexts GROUP BY 1),
  per AS (SELECT cluster_id, count(*) AS n, coalesce(greatest(0, floor(epoch_us(max(b)) / 86400000000.0::DOUBLE - epoch_us(min(a)) / 86400000000.0::DOUBLE)), 0)::INT AS days FROM m LEFT JOIN seen USING (id) GROUP BY 1),
  nb AS (SELECT cluster_id, count(*) AS nb FROM br GROUP BY 1),
  sc AS (SELECT per.cluster_id, n, days, coalesce(nb, 0) AS nb, c.name, c.description, c.modularity FROM per LEFT JOIN nb USING (cluster_id) JOIN c ON c.id = per.cluster_id)"""


def _slug(expr: str) -> str:
    s = f"regexp_replace(lower(coalesce({expr}, '')), '[\\s_]+', '-', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '[^a-z0-9\\-]', '', 'g'), '-+', '-', 'g')"
    s = f"regexp_replace(left(regexp_replace({s}, '^-|-$', '', 'g'), 60), '-$', '')"
    return f"CASE WHEN {s} = '' THEN 'cluster-' || left(id, 8) ELSE {s} END"


_GATE = "CASE WHEN n < 3 THEN 'too_small' WHEN n > 50 THEN 'too_large' WHEN days < {0} THEN 'too_young' WHEN nb >= n THEN 'orphan' ELSE 'emit' END"
_BODY = "'# ' || name || chr(10) || chr(10) || coalesce(description, '') || chr(10) || chr(10) || '## Members' || chr(10) || chr(10) || members || chr(10)"
_HEX = "sha256('skill|cluster|' || id || '|' || ({0}))"

ORACLES = {
    "path_affinity_edges": f"SELECT from_id, to_id, round({_aff('pa', 'pb')}, 6) AS affinity FROM (SELECT DISTINCT from_id, to_id, string_split(from_id, '::')[1] AS pa, string_split(to_id, '::')[1] AS pb FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL)",
    "fused_weight_prune": f"WITH {S}, p AS (SELECT e.from_id, e.to_id, 0.4::DOUBLE * {_aff('a.path', 'b.path')} AS weight FROM (SELECT DISTINCT from_id, to_id FROM edges) e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id) SELECT from_id, to_id, round(weight, 6) AS weight FROM p WHERE weight >= 0.3",
    "temporal_proximity": """WITH w AS (SELECT symbol_id, file_path, max(walked_at) AS a FROM walk_contexts GROUP BY 1, 2)
      SELECT w.symbol_id, w.file_path, round(1 / (1 + abs(epoch_us(w.a) - epoch_us(f.a)) / 86400000000.0::DOUBLE), 9) AS proximity FROM w JOIN w f ON f.symbol_id = w.file_path AND f.file_path = w.file_path""",
    "short_content_penalty": f"""WITH {S}, {_M}, x AS (SELECT cluster_id AS community, id, length(coalesce(docstring, '')) < 100 AS short, row_number() OVER (PARTITION BY cluster_id, length(coalesce(docstring, '')) < 100 ORDER BY coalesce({_RANK}, 0) DESC, id DESC) AS r,
        count(*) FILTER (length(coalesce(docstring, '')) < 100) OVER (PARTITION BY cluster_id) AS sn, count(*) FILTER (length(coalesce(docstring, '')) >= 100) OVER (PARTITION BY cluster_id) AS ln FROM m)
      SELECT community, id FROM x WHERE NOT short OR r <= CASE WHEN sn + ln > 3 THEN least(sn, greatest(ln, 3 - ln)) ELSE sn END""",
    "dominant_token": f"WITH {S}, {_M}, {_WORDS} SELECT cluster_id, word, n FROM dw",
    "dominant_basename": f"WITH {S}, {_M}, {_BASES} SELECT cluster_id, basename, n FROM db",
    "compose_name": f"""WITH {S}, {_M}, {_WORDS}, {_BASES}, {_ANCHOR}
      SELECT an.cluster_id, CASE WHEN word IS NOT NULL AND basename IS NOT NULL THEN word || '-' || basename WHEN basename IS NOT NULL THEN 'cluster-' || basename
        WHEN word IS NOT NULL THEN word || '-' || lower(list_last(string_split(anchor, '::'))) ELSE 'cluster-' || lower(list_last(string_split(anchor, '::'))) END AS name FROM an LEFT JOIN dw USING (cluster_id) LEFT JOIN db USING (cluster_id)""",
    "stable_cluster_id": f"WITH {S}, {_M}, {_ANCHOR} SELECT cluster_id, anchor, left(sha256('louvain|' || anchor), 16) AS stable_id FROM an",
    "bridges": f"WITH {S}, {_M}, {_BRIDGES} SELECT cluster_id, id FROM br",
    "top_bridges": f"WITH {S}, {_M}, {_BRIDGES} SELECT br.cluster_id, br.id, row_number() OVER (PARTITION BY br.cluster_id ORDER BY {_RANK} DESC NULLS LAST, br.id)::INT AS n FROM br JOIN s ON s.id = br.id QUALIFY n <= 10",
    "cluster_members_topk": f"WITH {S}, {C}, {_M}, t AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY {_RANK} DESC NULLS LAST, id)::INT AS n FROM m) SELECT t.cluster_id, c.name, t.id, t.n FROM t LEFT JOIN c ON c.id = t.cluster_id WHERE t.n <= 30",
    "stale_cluster_size": f"WITH {S}, {C}, {_M}, k AS (SELECT cluster_id, count(*) AS members FROM m GROUP BY 1) SELECT id, size, coalesce(members, 0) AS members FROM c LEFT JOIN k ON k.cluster_id = c.id WHERE size <> coalesce(members, 0)",
    "cluster_mirror": f"WITH {S}, {C} SELECT s.id, c.id AS cluster_id FROM s LEFT JOIN c ON c.id = s.cluster_id",
    "symbol_cluster_name": f"WITH {S}, {C} SELECT s.kind, coalesce(c.name, '(none)') AS name, count(*) AS n FROM s LEFT JOIN c ON c.id = s.cluster_id GROUP BY 1, 2",
    "split_ident": f"WITH {S} SELECT word, count(*) AS n FROM (SELECT unnest({_split(_LAST)}) AS word FROM s WHERE kind = 'class') GROUP BY 1",
    "observed_days": f"WITH {_SCORED} SELECT cluster_id, days FROM sc",
    "confidence": f"""WITH {_SCORED} SELECT cluster_id, round(greatest(0, least(1, 0.2 + least(n / 10.0::DOUBLE, 1) * 0.3 + least(days / 30.0::DOUBLE, 1) * 0.3 + greatest(0, least(1, coalesce(modularity, 0))) * 0.25
        - least(nb / n::DOUBLE, 1) * 0.15)), 6) AS confidence FROM sc""",
    "emit_gate": f"WITH {_SCORED} SELECT cluster_id, {_GATE.format(2)} AS verdict FROM sc",
    "maturity": f"WITH {_SCORED} SELECT CASE WHEN days >= 30 THEN 'observed' ELSE 'emerging' END AS maturity, count(*) AS n FROM sc GROUP BY 1",
    "slugify": f"WITH {C} SELECT id, {_slug('description')} AS slug FROM c",
    "skill_id": f"WITH {C}, h AS (SELECT id, {_HEX.format(_slug('name'))} AS x FROM c) SELECT id, concat_ws('-', x[1:8], x[9:12], x[13:16], x[17:20], x[21:32]) AS skill_id FROM h",
    "skill_body": f"""WITH {_SCORED}, tk AS (SELECT cluster_id, id FROM m QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY id) <= 10),
      tm AS (SELECT cluster_id, string_agg('- `' || id || '`', chr(10) ORDER BY id) AS members FROM tk GROUP BY 1)
      SELECT cluster_id, length({_BODY})::INT AS n_chars, sha256({_BODY}) AS body_sha256 FROM sc JOIN tm USING (cluster_id) WHERE {_GATE.format(0)} = 'emit'""",
    "changed_cards": """WITH r AS (SELECT id, index_epoch AS e, sha256(coalesce(description, '')) AS h, description_embedding IS NOT NULL AS v FROM clusters),
      n AS (SELECT id, h FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY e DESC, h DESC, v DESC) = 1), o AS (SELECT id, h, v FROM r WHERE id IN (SELECT id FROM r GROUP BY 1 HAVING count(DISTINCT e) > 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY e, h, v) = 1)
      SELECT n.id, n.h AS body_sha256 FROM n LEFT JOIN o ON o.id = n.id WHERE o.h IS NULL OR o.h <> n.h OR NOT o.v""",
    "archive_expired": f"""SELECT id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS archive_name FROM (SELECT doc_id AS id, lower(trim(source)) AS slug, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY created_at, doc_id) AS k
      FROM documents WHERE source IS NOT NULL AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 60 DAY)""",
    "newest_per_group": "SELECT repo, doc_id FROM documents WHERE repo IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, doc_id) = 1",
}
