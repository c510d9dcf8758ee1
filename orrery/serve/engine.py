"""The tools over one index: each takes what a caller asks and returns a DataFrame; ``call`` wraps it in an envelope."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.since import parse_since
from orrery.functions.text import dot, matches_any_glob
from orrery.operators import emit
from orrery.operators import reach as G
from orrery.operators import retrieval as R
from orrery.operators import store as T
from orrery.serve import envelope, guards
from orrery.tables import current_clusters, current_symbols, table

#: Bounds of the tools: results of a query, of changes, of skills, clusters and members by granularity.
QUERY_MOST, CHANGES_MOST, SKILLS_MOST, CLUSTERS_MOST = 50, 100, 20, 5
MEMBERS = {"coarse": 10, "medium": 30, "fine": 50}


class Engine:
    """Tools over the tables of one folder.

    ``vectors``: stored vectors ``symbol_id, embedding`` of the symbols; without them the ids are embedded on every query.
    ``skills``: cards ``id, slug, name, description, body, maturity, embedding``; without them clusters stand for cards.
    ``cards``: the folder cards were written to; a body there goes before the stored one. ``log``: where feedback is kept.
    """

    def __init__(self, spark: SparkSession, folder: str, embed=R.hash_embedding, dim: int = 64, marker: dict | None = None, age_seconds: float = 0.0, vectors: DataFrame | None = None, skills: DataFrame | None = None, cards: str | None = None, log: str | None = None):
        self.spark, self.folder, self.embed, self.dim = spark, folder, embed, dim
        self.marker, self.age = marker, age_seconds
        self.vectors, self.skills, self.cards = vectors, skills, cards
        self.log = T.FeedbackLog(spark, log) if log else None
        self.calls = guards.InFlight()
        self.symbols = current_symbols(spark, folder, "path", "language", "kind", "range_start_line", "range_end_line", "signature", "docstring", "pagerank", "cluster_id", "updated_at_commit")
        self.edges = table(spark, folder, "edges")
        self.clusters = current_clusters(spark, folder, "name", "description", "description_embedding", "size")

    def query(self, question: str, top_k: int = 10, languages: list[str] | None = None, paths: list[str] | None = None, since: str | None = None) -> DataFrame:
        """Hybrid search: ``id, score, reasons, path, summary``. Filters apply before both lanes; ``top_k`` is clamped to 50."""
        top_k = max(1, min(QUERY_MOST, top_k))
        pool = self.symbols if not languages else self.symbols.filter(F.col("language").isin(languages))
        pool = pool.filter(matches_any_glob("path", paths or []))
        if since:
            pool = self._since(pool, since)
        lex = R.ranked(R.top(R.lexical(pool, question), 4 * top_k), F.col("pagerank").desc_nulls_last(), "id").select("id", "rank")
        if self.vectors is not None:
            vectors = self.vectors.select(F.col("symbol_id").alias("id"), "embedding").join(pool.select("id"), "id", "left_semi")
        else:
            one = self.embed
            whole = R.hash_embeddings if one is R.hash_embedding else lambda texts, dim: [one(t, dim) for t in texts]
            vectors = R.embed_column(pool.select("id"), "id", self.dim, embed=whole)
        vec = R.ranked(R.nearest_l2(vectors, self.embed(question, self.dim), 4 * top_k, ident="id"), "distance", "id").select("id", "rank")
        fused = R.fuse({"lexical": lex, "vector": vec}, "id").orderBy(F.col("score").desc(), "id").limit(top_k)
        return self.symbols.join(F.broadcast(fused), "id").select("id", "score", "reasons", "path", F.coalesce("signature", F.concat_ws(" ", "kind", "id")).alias("summary")).orderBy(F.col("score").desc(), "id")

    def _commits(self) -> DataFrame:
        files = table(self.spark, self.folder, "source_files").filter("commit_hash is not null")
        return files.select(F.col("commit_hash").alias("hash"), F.col("seen_at").alias("ts"), "file_path")

    def _since(self, pool: DataFrame, since: str) -> DataFrame:
        when = parse_since(since)
        if when.kind == "commit":
            row = self._commits().filter(F.col("hash").startswith(when.commit)).agg(F.min("ts")).head()
            if row is None or row[0] is None:
                return pool
            return R.since_filter(pool, self._commits(), row[0])
        return R.since_filter(pool, self._commits(), datetime.fromtimestamp(when.cutoff / 1000, timezone.utc).replace(tzinfo=None))

    def _start(self, name: str) -> DataFrame:
        """Symbols a name stands for: a qualified id, a file, or the last part of ids without regard to case."""
        if "::" in name:
            hit = F.col("id") == name
        elif "/" in name or name.rpartition(".")[2] in ("ts", "tsx", "js", "jsx", "mjs", "py", "go", "rs"):
            hit = F.col("path") == name
        else:
            hit = F.lower("id").endswith("::" + name.lower())
        return self.symbols.filter(hit).select(F.lit(name).alias("seed"), "id")

    def impact(self, name: str) -> DataFrame:
        """What breaks if a symbol or a file changes."""
        return G.impact(self.edges, self.symbols, self._start(name)).drop("seed").orderBy(F.col("pagerank").desc_nulls_last(), "id")

    def context(self, name: str) -> DataFrame:
        """Callers, callees, imports and cluster of a symbol or file: ``relation, id, depth``."""
        start = self._start(name)
        depth = 2 if "::" not in name and "/" in name else 3
        parts = []
        for relation, towards in (("caller", "callers"), ("callee", "callees")):
            hits = G.ranked_hits(G.reach(self.edges, start, depth, towards), self.symbols, 50)
            parts.append(hits.select(F.lit(relation).alias("relation"), "id", "depth"))
        near = G.imports_of(self.edges, start.select("id"))
        parts.append(near.select(F.concat(F.lit("import_"), "direction").alias("relation"), F.col("other").alias("id"), F.lit(1).alias("depth")).distinct())
        owner = self.symbols.join(start.select("id"), "id", "left_semi").join(self.clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id")
        parts.append(owner.select(F.lit("cluster").alias("relation"), F.col("name").alias("id"), F.lit(0).alias("depth")).distinct())
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def cluster(self, name_or_query: str, granularity: str = "medium") -> DataFrame:
        """At most five clusters by name, else by meaning, else by description, with their first members."""
        low = name_or_query.lower()
        by_name = self.clusters.filter(F.lower("name").contains(low)).select("id", "name", F.lit(2.0).alias("score"), "size")
        q = self.clusters.withColumn("__q", F.array(*[F.lit(x) for x in self.embed(name_or_query, self.dim)]))
        by_vector = q.select("id", "name", dot("description_embedding", "__q").alias("score"), "size").filter("score is not null and not isnan(score)").orderBy(F.col("score").desc(), "id").limit(CLUSTERS_MOST)
        both = by_name.unionByName(by_vector).groupBy("id", "name", "size").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), F.col("size").desc(), "id").limit(CLUSTERS_MOST)
        order = Window.partitionBy("cluster_id").orderBy(F.col("pagerank").desc_nulls_last(), "id")
        chosen = self.symbols.join(F.broadcast(both.select(F.col("id").alias("cluster_id"), "name", "score")), "cluster_id")
        top = chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MEMBERS[granularity])
        return top.groupBy("cluster_id", "name", "score").agg(F.array_sort(F.collect_list("id")).alias("members"))

    def skills_for(self, task: str, top_k: int = 5) -> DataFrame:
        """Cards by meaning where they have a vector, else by words: ``id, name, score`` and, of stored cards, ``body``."""
        top_k, target = max(1, min(SKILLS_MOST, top_k)), self.embed(task, self.dim)
        if self.skills is None:
            rows = self.clusters.withColumnRenamed("description_embedding", "embedding")
            out = R.mixed_similarity(rows, target, task)
            return out.filter("not isnan(score)").orderBy(F.col("score").desc(), "id").limit(top_k).select("id", "name", "score")
        out = R.mixed_similarity(self.skills, target, task).filter("not isnan(score)").orderBy(F.col("score").desc(), "id").limit(top_k)
        out = out.select("id", "slug", "name", "score", "body")
        if self.cards:
            on_disk = emit.card_bodies(self.spark, self.cards).withColumnRenamed("body", "disk_body")
            out = out.join(on_disk, "slug", "left").withColumn("body", F.coalesce("disk_body", "body")).drop("disk_body")
        return out.select("id", "name", "score", "body").orderBy(F.col("score").desc(), "id")

    def recent_changes(self, since: str = "2 weeks ago", top_k: int = 20, paths: list[str] | None = None, now: datetime | None = None) -> DataFrame:
        """Commits with their files, newest first: ``hash, ts, files``; commits without a file of the paths are left out.

        Where no commit is known, the commits that symbols name stand in, newest epoch first, without a time.
        """
        when = parse_since(since, now)
        known = self._commits()
        if known.isEmpty():
            rows = self.symbols.filter("updated_at_commit is not null").filter(matches_any_glob("path", paths or []))
            per = rows.groupBy(F.substring("updated_at_commit", 1, 7).alias("hash")).agg(F.max("updated_at_epoch").alias("epoch"), F.array_sort(F.collect_set("path")).alias("files"))
            return per.orderBy(F.col("epoch").desc(), "hash").limit(max(1, min(CHANGES_MOST, top_k))).select("hash", F.lit(None).cast("timestamp").alias("ts"), "files")
        commits = known.filter(matches_any_glob("file_path", paths or []))
        if when.cutoff is not None:
            commits = commits.filter(F.col("ts") >= F.lit(datetime.fromtimestamp(when.cutoff / 1000, timezone.utc).replace(tzinfo=None)))
        per = commits.groupBy(F.substring("hash", 1, 7).alias("hash")).agg(F.max("ts").alias("ts"), F.array_sort(F.collect_set("file_path")).alias("files"))
        return per.orderBy(F.col("ts").desc(), "hash").limit(max(1, min(CHANGES_MOST, top_k)))

    @staticmethod
    def _feedback_row(tool: str, request_id: str, signal: str, note: str | None) -> tuple:
        if not envelope.is_uuid7(request_id):
            raise guards.Refused("request_id is no identifier of version 7")
        if signal not in ("used", "ignored", "wrong", "helpful"):
            raise guards.Refused(f"unknown signal {signal!r}")
        return datetime.now(timezone.utc).replace(tzinfo=None), tool, request_id, signal, T.truncate_note(note)

    def feedback(self, log: DataFrame, tool: str, request_id: str, signal: str, note: str | None = None) -> DataFrame:
        """The log with one more row; identifiers and signals are checked, notes cut at 2048 bytes."""
        row = [self._feedback_row(tool, request_id, signal, note)]
        new = self.spark.createDataFrame(row, "recorded_at timestamp_ntz, tool string, request_id string, signal string, note string")
        return T.append_feedback(log, new, "recorded_at")

    def record_feedback(self, tool: str, request_id: str, signal: str, note: str | None = None) -> DataFrame:
        """Writes one row to the log of this engine, one call at a time, and returns its id."""
        if self.log is None:
            raise guards.Refused("no feedback is kept here")
        ids = self.log.append([self._feedback_row(tool, request_id, signal, note)])
        return self.spark.createDataFrame([(i,) for i in ids], "id bigint")

    def sql(self, statement: str) -> tuple[DataFrame, bool]:
        """A guarded statement over the views ``symbols``, ``edges`` and ``clusters``."""
        for name in ("symbols", "edges", "clusters"):
            getattr(self, name).createOrReplaceTempView(name)
        return guards.run_sql(self.spark, statement)

    def tools(self) -> dict:
        """The tools by name, in order."""
        found = {n: getattr(self, n) for n in ("cluster", "context", "impact", "query", "recent_changes", "skills_for", "sql")}
        return dict(sorted((found | {"feedback": self.record_feedback}).items()))

    def call(self, name: str, /, **arguments) -> envelope.Envelope:
        """Runs a tool and wraps what it returns; refused and unknown calls become error envelopes."""
        epoch = table(self.spark, self.folder, "index_meta").agg(F.max("current_epoch")).head()[0]
        where = envelope.provenance(self.marker or {"epoch": epoch}, epoch, self.age)
        if where.source == "not_ready":
            return envelope.failed("the index is not ready", where)
        tool = self.tools().get(name)
        if tool is None:
            return envelope.failed(f"unknown tool {name!r}", where)
        try:
            with self.calls.slot():
                found = tool(**arguments)
                df, truncated = found if isinstance(found, tuple) else (found, False)
                rows, cut = guards.fit_bytes([r.asDict(recursive=True) for r in df.limit(guards.ROWS).collect()])
                return envelope.ok(rows, where, truncated or cut)
        except (guards.Refused, ValueError) as e:
            return envelope.failed(str(e), where)


def default_window(now: datetime) -> datetime:
    """The start of the default window of changes: fourteen days back."""
    return now - timedelta(days=14)
