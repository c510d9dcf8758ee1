import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import conventions as C
from orrery.operators import emit, retrieval, skills, store
from orrery.serve import envelope, report
from orrery.serve.engine import Engine
from orrery.streaming import coalesce


def sites(spark, rows):
    return spark.createDataFrame(rows, "file string, module string")


def test_library_conventions(spark):
    rows = [
        ("a.ts", "express"), ("b.ts", "express/lib"), ("c.ts", "koa"), ("d.py", "flask"), ("e.py", "flask.views"), ("f.ts", "expressive"),
        ("a.ts", "pino"), ("b.ts", "winston"), ("c.ts", "winston/x"), ("d.py", "logging"), ("e.py", "logging.config"),
        ("a.ts", "./config"), ("b.ts", "../app/config.js"), ("c.ts", "dotenv"), ("d.ts", "config"), ("e.ts", "./configure"),
        ("a.go", "gorm.io/gorm"), ("b.ts", "pg"),
    ]
    got = {tuple(r) for r in C.library_conventions(sites(spark, rows)).collect()}
    # Of winners with equal files the earlier one; one file is no convention.
    assert got == {("framework", "Express", 2), ("framework", "Flask", 2), ("logging", "winston", 2), ("config-env", "project-local config module", 2)}
    assert C.library_conventions(sites(spark, [])).count() == 0


def test_test_framework(spark):
    paths = spark.createDataFrame([("a.test.ts",), ("t/tests/x.rs",), ("tests/y.py",), ("src/a.ts",), ("test_z.py",), ("k_test.go",)], "file string")
    files = C.test_files(paths)
    assert {r["file"] for r in files.collect()} == {"a.test.ts", "t/tests/x.rs", "tests/y.py", "test_z.py", "k_test.go"}
    found = C.test_framework(files, sites(spark, [("tests/y.py", "pytest"), ("a.test.ts", "vitest"), ("test_z.py", "pytest"), ("src/a.ts", "vitest")]))
    assert tuple(found.head()) == ("pytest", 5)
    go = spark.createDataFrame([("a_test.go",), ("b/b_test.go",)], "file string")
    assert tuple(C.test_framework(go, sites(spark, [])).head()) == ("Go test", 2)
    assert tuple(C.test_framework(files, sites(spark, [])).head()) == (None, 5)
    assert C.test_framework(go.limit(1), sites(spark, [])).count() == 0


def test_seed_skills(spark):
    imports = spark.createDataFrame([("a.ts", "x", "'express'", "imports"), ("b.ts::f", "express", None, "imports"), ("b.ts", "koa", "", "calls"), ("c.ts", None, None, "imports")], "from_id string, to_name string, to_path string, kind string")
    where = C.import_sites(imports)
    assert {tuple(r) for r in where.collect()} == {("a.ts", "express"), ("b.ts", "express")}
    classes = spark.createDataFrame([("m.ts::A", "Error", None), ("n.ts::B", "A", None)], "class_id string, base_name string, base_path string")
    paths = spark.createDataFrame([(f"p{i}.test.ts",) for i in range(7)], "file string")
    cards = {r["slug"]: r for r in C.seed_skills(where, paths, classes).collect()}
    assert set(cards) == {"framework-express", "errors", "tests"}
    assert cards["errors"]["evidence_count"] == 2 and cards["errors"]["library"] == "Error"
    assert cards["tests"]["sample_paths"] == [f"p{i}.test.ts" for i in range(5)] and cards["tests"]["evidence_count"] == 7
    again = {r["slug"]: r["id"] for r in C.seed_skills(where, paths, classes).collect()}
    assert again == {s: r["id"] for s, r in cards.items()}


def test_hash_embeddings():
    def slow(text, dim):
        state = 0
        for unit in np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist():
            state = (state * 31 + unit) % 2**32
        out = []
        for _ in range(dim):
            state ^= state << 13 & 0xFFFFFFFF
            state ^= state >> 17
            state ^= state << 5 & 0xFFFFFFFF
            out.append(state % 10_000 / 10_000 - 0.5)
        return np.array(out) / np.linalg.norm(out)

    texts = ["", "a", "src/a.ts::f", "ü€😀" * 40]
    assert np.allclose(retrieval.hash_embeddings(texts, 12), [slow(t, 12) for t in texts])


def test_keyed_upserts(spark):
    old = spark.createDataFrame([("a", "X", "p"), ("b", "Y", None)], "class_id string, base_name string, base_path string")
    new = spark.createDataFrame([("a", "X", "q", 1), ("a", "X", "r", 2), ("c", "Z", None, 1), ("d", None, "p", 1)], "class_id string, base_name string, base_path string, seq int")
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {tuple(r) for r in store.upsert_inheritance(old, new, "seq").collect()} == {("a", "X", "r"), ("b", "Y", None), ("c", "Z", None)}
    assert {tuple(r) for r in store.upsert_inheritance(old, new, "seq", known).collect()} == {("a", "X", "r"), ("b", "Y", None)}
    was = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], store.SCHEMAS["symbol_embeddings"])
    fresh = spark.createDataFrame([("a", [2.0, 2.0], 1), ("a", [3.0, 3.0], 2), ("c", [5.0, 5.0], 1)], "symbol_id string, embedding array<float>, seq int")
    assert {(r[0], tuple(r[1])) for r in store.replace_embeddings(was, fresh, "seq", 2).collect()} == {("a", (3.0, 3.0)), ("b", (0.0, 1.0)), ("c", (5.0, 5.0))}
    with pytest.raises(Exception, match="not of length 3"):
        store.replace_embeddings(was, fresh, "seq", 3).collect()


def test_skills_are_embedded_only_when_changed(spark):
    row = lambda i, body: (i, f"s{i}", f"n{i}", "d", body, None, None, "observed", 1.0, 3, 40, None)
    schema = store.SCHEMAS["skills"]
    wide = [c.split()[0] for c in schema.split(", ")]
    plain = ", ".join(c for c in schema.split(", ") if c.split()[0] != "embedding")
    new = spark.createDataFrame([row("1", "x"), row("2", "y")], plain).drop("body_sha256")
    first = skills.write_skills(spark.createDataFrame([], schema), new, dim=4)
    assert first.columns == wide and first.filter("size(embedding) = 4").count() == 2
    kept = spark.createDataFrame(first.collect(), schema)
    calls = []

    def embed(texts, dim):
        return [[9.0] * dim for _ in texts]

    again = {r["id"]: r["embedding"] for r in skills.write_skills(kept, new.withColumn("body", F.when(F.col("id") == "1", "z").otherwise(F.col("body"))), embed, 4).collect()}
    assert again["1"] == [9.0] * 4 and again["2"] != [9.0] * 4 and not calls


def test_lock_of_a_dead_writer(spark, tmp_path):
    dead = store.EpochStore(spark, str(tmp_path))
    dead.begin()
    with pytest.raises(RuntimeError, match="another writer"):
        store.EpochStore(spark, str(tmp_path)).begin()
    late = store.EpochStore(spark, str(tmp_path), lock_seconds=0)
    epoch = late.begin()
    with pytest.raises(RuntimeError, match="not held"):
        dead.write(epoch, "t", spark.range(1))
    late.write(epoch, "t", spark.range(2))
    late.write_meta(epoch, "hash", 4, "f32")
    late.commit(epoch, commit="abcdef0123")
    assert late.table("t").count() == 2 and late.table("index_meta").head()["embedder_dim"] == 4
    found = report.status(late)
    assert found["ready"] and found["epoch"] == epoch and not found["clock_skew"]
    early = report.status(late, now=datetime.datetime.now(datetime.timezone.utc) - datetime.timedelta(minutes=1))
    assert early["clock_skew"] and early["age_seconds"] == 0
    (tmp_path / "layout.json").write_text('{"versions": [1]}')
    with pytest.raises(ValueError, match="layout"):
        late.begin()


def test_reports(spark, monkeypatch):
    assert report.same_commit("abcdef0", "abcdef0123") and not report.same_commit("abcdef", "abcdef0123") and not report.same_commit("abcdef1", "abcdef0123")
    changed = spark.createDataFrame([("a\\x.py",), ("a/x.py",), ("docs/b.md",), ("z",), (" ",)], "path string")
    plan = [tuple(r) for r in report.plan_tests(spark, changed, [(["a/**"], "core", "pytest"), (["**/*.py"], "style", "lint")]).collect()]
    assert plan == [("core", "pytest", 1), ("style", "lint", 1), ("other", None, 2)]
    report.need_network("x")
    monkeypatch.setenv(report.OFFLINE, "1")
    with pytest.raises(report.Offline):
        report.need_network("models")


def test_engine_over_stored_tables(spark, data, tmp_path):
    skill_rows = [("1", "good", "retry rows", "how rows are retried", "stored", "observed", None), ("2", "other", "walk trees", "walks", "kept", "observed", None)]
    cards = spark.createDataFrame(skill_rows, "id string, slug string, name string, description string, body string, maturity string, embedding array<float>")
    emit.emit_cards(spark.createDataFrame([("1", "good", "observed", "from disk"), ("1", "good", "emerging", "older")], "id string, slug string, maturity string, body string"), str(tmp_path / "cards")).collect()
    from orrery.tables import current_symbols

    ids = current_symbols(spark, data).select(F.col("id").alias("symbol_id"))
    vectors = retrieval.embed_column(ids, "symbol_id", 8)
    engine = Engine(spark, data, dim=8, vectors=vectors, skills=cards, cards=str(tmp_path / "cards"), log=str(tmp_path / "feedback"))
    first = engine.skills_for("retry rows").collect()[0]
    assert first["id"] == "1" and first["body"] == "from disk"
    assert engine.query("packet", 5).count() == 5
    assert list(engine.tools()) == sorted(engine.tools()) and "feedback" in engine.tools()
    assert engine.call("feedback", tool="query", request_id=envelope.uuid7(), signal="used").data == [{"id": 1}]
    assert engine.call("feedback", tool="query", request_id=envelope.uuid7(), signal="helpful", note="x").data == [{"id": 2}]
    assert engine.log.read().count() == 2


def test_unique_paths(spark):
    rows = [("c", "b", 1), ("c", "a", 2), ("c", "b", 3), ("c", None, 4), ("c", "d", 5)]
    top = emit.top_unique_paths(spark.createDataFrame(rows, "cluster_id string, path string, rank int"), 2)
    assert {tuple(r) for r in top.collect()} == {("c", "b", 1), ("c", "a", 2)}


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "repo string, path string, kind string, ts timestamp"
    t0 = datetime.datetime(2025, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    stats = coalesce.StreamStats()

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        coalesce.stream_batches(spark.readStream.schema(schema).parquet(src), sink, stats=stats).awaitTermination(90)
        return sorted((r["path"], r["kind"], r["n_events"]) for r in spark.read.parquet(sink).selectExpr("n_events", "explode(last) as (path, kind)").collect())

    first = run([("r", "a", "add", at(0)), ("r", "a", "change", at(0.1)), ("r", "z", "add", at(1000))])
    assert first == [("a", "change", 2)]
    second = run([("r", "b", "add", at(1000.2)), ("r", "y", "add", at(5000))])
    assert second == [("a", "change", 2), ("b", "add", 2), ("z", "add", 2)]
    # A start that finds nothing new writes nothing again.
    coalesce.stream_batches(spark.readStream.schema(schema).parquet(src), sink).awaitTermination(90)
    assert spark.read.parquet(sink).count() == 2
    assert stats.written >= 2 and stats.inflight == 0 and stats.queued == 0 and not stats.paused
