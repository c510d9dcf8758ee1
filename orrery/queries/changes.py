"""Named queries of scanners, changes, stores, events and guards with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import scanners as N
from orrery.operators import store as T
from orrery.queries.retrieval import S, symbols
from orrery.streaming import coalesce as E
from orrery.tables import table

LIBRARIES = (("errors", "errors"), ("zone", "zone"), ("compat", "compat"), ("option", "option"), ("thread", "thread"), ("cursor", "cursor"), ("window", "window"), ("stream", "stream"))


def _imports(spark, folder) -> DataFrame:
    """Modules that bases are written with, by file."""
    rows = table(spark, folder, "class_inheritance").filter("base_name like '%.%'")
    return rows.select(F.split("class_id", "::")[0].alias("file"), F.regexp_extract("base_name", r"^(.*)\.[^.]*$", 1).alias("module")).distinct()


def _libraries(spark) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(LIBRARIES)], "position int, library string, needle string")


def scanner_first_match_argmax(spark, folder):
    return N.best_library(N.first_match(_imports(spark, folder), _libraries(spark)), _libraries(spark))


def scanner_multi(spark, folder):
    return N.all_libraries(N.first_match(_imports(spark, folder), _libraries(spark)))


def error_hierarchy(spark, folder):
    return N.error_families(table(spark, folder, "class_inheritance"))


def error_largest_family(spark, folder):
    return N.largest_family(N.error_families(table(spark, folder, "class_inheritance")))


def test_path_scan(spark, folder):
    files = table(spark, folder, "source_files").select("repo", "file_path").distinct()
    hit = F.count_if(F.col("file_path").rlike(N.TEST_PATHS))
    return files.groupBy("repo").agg(F.count("*").alias("files"), hit.alias("tests"))


def _commits(spark, folder) -> DataFrame:
    """Deliveries as commits: hash, first time and files."""
    rows = table(spark, folder, "source_files").filter("commit_hash is not null")
    return rows.groupBy("repo", F.substring("commit_hash", 1, 7).alias("hash")).agg(F.min("seen_at").alias("ts"), F.countDistinct("file_path").alias("files"))


def commit_buckets(spark, folder):
    """Commits of every repository, newest first, the first twenty, with the symbols of their files."""
    order = Window.partitionBy("repo").orderBy(F.col("ts").desc(), "hash")
    top = _commits(spark, folder).withColumn("n", F.row_number().over(order)).filter("n <= 20")
    files = table(spark, folder, "source_files").select("repo", F.substring("commit_hash", 1, 7).alias("hash"), F.col("file_path").alias("path")).distinct()
    syms = symbols(spark, folder).groupBy("path").agg(F.count("*").alias("k"))
    per = files.join(syms, "path").groupBy("repo", "hash").agg(F.sum("k").alias("symbols"))
    return top.join(per, ["repo", "hash"], "left").select("repo", "hash", "files", "n", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def commit_time_lookup(spark, folder):
    """Symbols whose commit is known by its first seven signs, by age in whole days of the commit."""
    known = table(spark, folder, "source_files").filter("commit_hash is not null").groupBy(F.substring("commit_hash", 1, 7).alias("h")).agg(F.max("seen_at").alias("ts"))
    rows = symbols(spark, folder).filter("updated_at_commit is not null").withColumn("h", F.substring("updated_at_commit", 1, 7))
    return rows.join(known, "h").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def recent_symbols(spark, folder):
    from orrery.tables import current_symbols

    rows = current_symbols(spark, folder, "path", "kind", "signature")
    return rows.orderBy(F.col("updated_at_epoch").desc(), "id").limit(100).select("id", "updated_at_epoch", F.coalesce("signature", F.concat_ws(" ", "kind", "id")).alias("summary"))


def top25_per_file(spark, folder):
    order = Window.partitionBy("updated_at_commit", "path").orderBy("id")
    rows = symbols(spark, folder).filter("updated_at_commit is not null").withColumn("n", F.row_number().over(order)).filter("n <= 25")
    return rows.groupBy("updated_at_commit", "path").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def upsert_coalesce(spark, folder):
    """Symbol rows of later epochs written over those of earlier ones."""
    rows = table(spark, folder, "symbols").select("id", "path", "kind", "signature", "docstring", "updated_at_epoch")
    middle = 405
    old = rows.filter(F.col("updated_at_epoch") < middle).groupBy("id").agg(*[F.max_by(c, F.struct("updated_at_epoch", F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in ("path", "kind", "signature", "docstring")])
    new = rows.filter(F.col("updated_at_epoch") >= middle).withColumn("seq", F.struct("updated_at_epoch", F.coalesce("signature", F.lit("")), F.coalesce("docstring", F.lit("")), "path", "kind"))
    return T.upsert(old, new, "id", "seq").select("id", "path", "kind", F.sha2(F.coalesce("signature", F.lit("")), 256).alias("signature"), F.sha2(F.coalesce("docstring", F.lit("")), 256).alias("docstring"))


def upsert_accumulate(spark, folder):
    """Line items of two halves added up by part and supplier."""
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    out = T.accumulate(rows.filter("l_linenumber <= 3"), rows.filter("l_linenumber > 3"), ["l_partkey", "l_suppkey"], "l_quantity")
    return out.withColumn("l_quantity", F.round("l_quantity", 3))


def dedup_last_wins(spark, folder):
    """The last event of every user and type."""
    return T.last_wins(table(spark, folder, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def hash_short_circuit(spark, folder):
    """Documents whose text is not the one of the last document of the same source and length."""
    docs = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return groups.filter("n > 1").select(F.col("first").alias("doc_id"), "n")


def epoch_gate(spark, folder):
    """Symbols by whether their epoch is the current one."""
    now = table(spark, folder, "index_meta").select("current_epoch")
    rows = table(spark, folder, "symbols").crossJoin(F.broadcast(now.limit(1)))
    return rows.groupBy((F.col("updated_at_epoch") == F.col("current_epoch")).alias("current")).agg(F.count("*").alias("n"))


def feedback_append(spark, folder):
    """Reviews of each day as feedback behind an empty log."""
    new = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    rows = new.select(F.concat_ws(" ", F.col("day").cast("string"), "event_type").alias("note"), F.lit(None).cast("bigint").alias("id"))
    return T.append_feedback(rows.filter("false").select("id", "note"), rows.select("note"), "note")


def feedback_summary(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def _events(spark, folder) -> DataFrame:
    """Events as file events: the user's tens are the repository, the user the path, the type the kind."""
    rows = table(spark, folder, "events")
    return rows.select((F.col("user_id") % 10).cast("string").alias("repo"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def event_coalesce_session(spark, folder):
    """Batches that five minutes of silence end: paths and reason."""
    paths = E.sessions(_events(spark, folder), 300)
    out = E.reasons(paths, ["repo", "batch_start"])
    return out.select("repo", F.unix_micros("batch_start").alias("batch_start"), "paths", "reason")


def batch_reason(spark, folder):
    return event_coalesce_session(spark, folder).groupBy("reason").agg(F.count("*").alias("batches"), F.sum("paths").alias("paths"))


def flood_split(spark, folder):
    """Batches in slices of four paths."""
    sliced = E.split_floods(E.sessions(_events(spark, folder), 1800), ["repo", "batch_start"], 4)
    return sliced.groupBy("repo", F.unix_micros("batch_start").alias("batch_start"), "slice").agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


def byte_budget_truncate(spark, folder):
    """Rows of every repository that fit into 4096 bytes as JSON, in order of ids."""
    rows = table(spark, folder, "documents").filter("repo is not null").select("repo", "doc_id", F.octet_length(F.coalesce("source", F.lit(""))).alias("b"))
    order = Window.partitionBy("repo").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(F.col("b") + 40).over(order)).filter("used <= 4096").groupBy("repo").agg(F.count("*").alias("rows"), F.max("used").alias("used"))


def row_cap(spark, folder):
    """The first thousand line items as a capped result shows them."""
    rows = table(spark, folder, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(1000)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


def pipeline_summary(spark, folder):
    """Counts of files, symbols, edges and clusters of the index."""
    syms = symbols(spark, folder)
    parts = [
        table(spark, folder, "source_files").agg(F.lit("files").alias("what"), F.countDistinct("file_path").alias("n")),
        syms.agg(F.lit("symbols").alias("what"), F.count("*").alias("n")),
        table(spark, folder, "edges").groupBy("from_id", "to_id", "kind").count().agg(F.lit("edges").alias("what"), F.count("*").alias("n")),
        syms.agg(F.lit("clusters").alias("what"), F.countDistinct("cluster_id").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {f.__name__: f for f in (scanner_first_match_argmax, scanner_multi, error_hierarchy, error_largest_family, test_path_scan, commit_buckets, commit_time_lookup, recent_symbols, top25_per_file, upsert_coalesce, upsert_accumulate, dedup_last_wins, hash_short_circuit, epoch_gate, feedback_append, feedback_summary, event_coalesce_session, batch_reason, flood_split, byte_budget_truncate, row_cap, pipeline_summary)}

_LIBS = "libs(position, library, needle) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(LIBRARIES)) + ")"
_IMP = """imp AS (SELECT DISTINCT string_split(class_id, '::')[1] AS file, regexp_extract(base_name, '^(.*)\\.[^.]*$', 1) AS module FROM class_inheritance WHERE base_name LIKE '%.%'),
  fm AS (SELECT file, module, library FROM imp JOIN libs ON module = needle OR starts_with(module, needle || '/') OR starts_with(module, needle || '.') OR starts_with(module, needle || '::')
         QUALIFY row_number() OVER (PARTITION BY file, module ORDER BY position) = 1),
  lc AS (SELECT library, count(DISTINCT file) AS files FROM fm GROUP BY 1 HAVING count(DISTINCT file) >= 2)"""
_ROOTS = "roots(o, root) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(N.ERROR_ROOTS)) + ")"
_FAM = f"""{_ROOTS}, ci AS (SELECT DISTINCT class_id, list_last(regexp_split_to_array(regexp_replace(base_name, '[<\\[(].*$', ''), '\\.|::')) AS base, list_last(string_split(class_id, '::')) AS name FROM class_inheritance WHERE class_id IS NOT NULL AND base_name IS NOT NULL),
  w AS (SELECT root, class_id, name, 1 AS depth FROM ci JOIN roots ON base = root UNION SELECT w.root, ci.class_id, ci.name, w.depth + 1 FROM w JOIN ci ON ci.base = w.name WHERE w.depth < 20),
  fam AS (SELECT root, class_id, min(depth)::INT AS depth FROM w GROUP BY 1, 2)"""
_EV = """ev AS (SELECT (user_id % 10)::VARCHAR AS repo, user_id::VARCHAR AS path, event_type AS kind, ts FROM events WHERE ts IS NOT NULL),
  lagged AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts) < INTERVAL {0} MINUTE THEN 0 ELSE 1 END AS fresh FROM ev),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM lagged),
  started AS (SELECT *, epoch_us(min(ts) OVER (PARTITION BY repo, b)) AS batch_start FROM numbered),
  last AS (SELECT repo, batch_start, path, kind FROM started QUALIFY row_number() OVER (PARTITION BY repo, batch_start, path ORDER BY ts DESC, kind DESC) = 1)"""
_SESSION = "SELECT repo, batch_start, count(*) AS paths, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'mixed' END AS reason FROM last GROUP BY 1, 2"

ORACLES = {
    "scanner_first_match_argmax": f"WITH {_LIBS}, {_IMP} SELECT library, files FROM lc JOIN libs USING (library) ORDER BY files DESC, position LIMIT 1",
    "scanner_multi": f"WITH {_LIBS}, {_IMP} SELECT library, files FROM lc",
    "error_hierarchy": f"WITH RECURSIVE {_FAM} SELECT root, class_id, depth FROM fam",
    "error_largest_family": f"WITH RECURSIVE {_FAM} SELECT root, count(DISTINCT class_id) AS members FROM fam JOIN roots USING (root) GROUP BY root, o HAVING count(DISTINCT class_id) >= 2 ORDER BY members DESC, o LIMIT 1",
    "test_path_scan": f"SELECT repo, count(*) AS files, count(*) FILTER (regexp_matches(file_path, '{N.TEST_PATHS}')) AS tests FROM (SELECT DISTINCT repo, file_path FROM source_files) GROUP BY 1",
    "commit_buckets": f"""WITH {S}, co AS (SELECT repo, left(commit_hash, 7) AS hash, min(seen_at) AS ts, count(DISTINCT file_path) AS files FROM source_files WHERE commit_hash IS NOT NULL GROUP BY 1, 2),
      tp AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash)::INT AS n FROM co QUALIFY n <= 20), k AS (SELECT path, count(*) AS k FROM s GROUP BY 1),
      per AS (SELECT repo, hash, sum(k)::BIGINT AS symbols FROM (SELECT DISTINCT repo, left(commit_hash, 7) AS hash, file_path AS path FROM source_files) JOIN k USING (path) GROUP BY 1, 2)
      SELECT repo, hash, files, n, coalesce(symbols, 0) AS symbols FROM tp LEFT JOIN per USING (repo, hash)""",
    "commit_time_lookup": f"""WITH {S}, k AS (SELECT left(commit_hash, 7) AS h, max(seen_at) AS ts FROM source_files WHERE commit_hash IS NOT NULL GROUP BY 1)
      SELECT ts::DATE AS day, count(*) AS n FROM s JOIN k ON h = left(updated_at_commit, 7) WHERE updated_at_commit IS NOT NULL GROUP BY 1""",
    "recent_symbols": f"WITH {S} SELECT id, updated_at_epoch, coalesce(signature, concat_ws(' ', kind, id)) AS summary FROM s ORDER BY updated_at_epoch DESC, id LIMIT 100",
    "top25_per_file": f"WITH {S}, t AS (SELECT updated_at_commit, path, id FROM s WHERE updated_at_commit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY updated_at_commit, path ORDER BY id) <= 25) SELECT updated_at_commit, path, count(*) AS n, max(id) AS last_id FROM t GROUP BY 1, 2",
    "upsert_coalesce": """WITH r AS (SELECT id, path, kind, signature, docstring, updated_at_epoch AS e FROM symbols),
      o AS (SELECT id, arg_max_null(path, (e, path)) AS path, arg_max_null(kind, (e, kind)) AS kind, arg_max_null(signature, (e, coalesce(signature, ''))) AS signature, arg_max_null(docstring, (e, coalesce(docstring, ''))) AS docstring FROM r WHERE e < 405 GROUP BY 1),
      n AS (SELECT *, (e, coalesce(signature, ''), coalesce(docstring, ''), path, kind) AS q FROM r WHERE e >= 405),
      l AS (SELECT id, arg_max_null(path, q) AS path, arg_max_null(kind, q) AS kind, arg_max(signature, q) FILTER (signature IS NOT NULL) AS signature, arg_max(docstring, q) FILTER (docstring IS NOT NULL) AS docstring FROM n GROUP BY 1)
      SELECT coalesce(l.id, o.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.path ELSE o.path END AS path, CASE WHEN l.id IS NOT NULL THEN l.kind ELSE o.kind END AS kind,
        sha256(coalesce(l.signature, o.signature, '')) AS signature, sha256(coalesce(l.docstring, o.docstring, '')) AS docstring FROM o FULL JOIN l ON o.id = l.id""",
    "upsert_accumulate": "SELECT l_partkey, l_suppkey, round(sum(coalesce(l_quantity, 1)), 3) AS l_quantity FROM lineitem GROUP BY 1, 2",
    "dedup_last_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "hash_short_circuit": "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "epoch_gate": "SELECT updated_at_epoch = (SELECT current_epoch FROM index_meta) AS current, count(*) AS n FROM symbols GROUP BY 1",
    "feedback_append": "SELECT row_number() OVER (ORDER BY note) AS id, note FROM (SELECT DISTINCT ts::DATE::VARCHAR || ' ' || event_type AS note FROM events)",
    "feedback_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "event_coalesce_session": f"WITH {_EV.format(5)} {_SESSION}",
    "batch_reason": f"WITH {_EV.format(5)}, x AS ({_SESSION}) SELECT reason, count(*) AS batches, sum(paths)::BIGINT AS paths FROM x GROUP BY 1",
    "flood_split": f"WITH {_EV.format(30)}, x AS (SELECT *, ((row_number() OVER (PARTITION BY repo, batch_start ORDER BY path) - 1) // 4)::INT AS slice FROM last) SELECT repo, batch_start, slice, count(*) AS paths, min(path) AS first_path FROM x GROUP BY 1, 2, 3",
    "byte_budget_truncate": """WITH x AS (SELECT repo, sum(strlen(coalesce(source, '')) + 40) OVER (PARTITION BY repo ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents WHERE repo IS NOT NULL)
      SELECT repo, count(*) AS rows, max(used) AS used FROM x WHERE used <= 4096 GROUP BY 1""",
    "row_cap": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000",
    "pipeline_summary": f"""WITH {S} SELECT 'files' AS what, count(DISTINCT file_path) AS n FROM source_files UNION ALL SELECT 'symbols', count(*) FROM s
      UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT from_id, to_id, kind FROM edges) UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM s""",
}
