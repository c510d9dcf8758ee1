import datetime
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import globs, since, text
from orrery.operators import clustering, retrieval, scanners, skills
from orrery.queries.retrieval import ORACLES, lexical_search, path_equality


def test_globs():
    ok = [("src/**/*.ts", "src/a/b/c.ts", True), ("src/**/*.ts", "src/c.ts", True), ("src/*.ts", "src/a/c.ts", False), ("?.py", "a.py", True), ("a.b", "axb", False)]
    for pattern, path, want in ok:
        assert bool(re.search(globs.glob_to_regex(pattern), path)) is want


def test_ignore_lists():
    lines = ["# copies", "vendor/**", "*.local.ts", "tmp/", "/root.txt", "!vendor/patches/**", "", None, "a/b"]
    rules = globs.ignore_rules(tuple(lines))
    hit = {p: globs.ignored_by(rules, p) for p in ("vendor/x/y.js", "vendor/patches/y.js", "src/q.local.ts", "src/tmp/z", "root.txt", "src/root.txt", "src/a/b", "a/b/c", "main.go")}
    assert hit["vendor/x/y.js"].remark == "copies" and hit["vendor/patches/y.js"].negated
    assert hit["src/q.local.ts"] and hit["src/tmp/z"] and hit["root.txt"] and hit["a/b/c"]
    assert hit["src/root.txt"] is None and hit["src/a/b"] is None and hit["main.go"] is None
    assert globs.is_ignored("x/node_modules/y.js", ["!**"]) and not globs.is_ignored("vendor/patches/y.js", lines)


NOW = datetime.datetime(2026, 1, 15, tzinfo=datetime.timezone.utc)


@pytest.mark.parametrize("value,kind", [("abc1234", "commit"), ("20260401", "commit"), ("1 week ago", "relative"), ("24h", "relative"), ("2w", "relative"), ("14 days", "relative"), ("2026-01-01", "date"), ("2026-01-01T10:00:00Z", "date"), ("100d", "commit")])
def test_since(value, kind):
    found = since.parse_since(value, NOW)
    assert found.kind == kind
    if value == "1 week ago":
        assert found.cutoff == int((NOW - datetime.timedelta(days=7)).timestamp() * 1000)


@given(st.text(alphabet="ghijkz !?", max_size=8))
def test_since_rejects_other_text(value):
    with pytest.raises(ValueError):
        since.parse_since(value)


def test_text_columns(spark):
    df = spark.createDataFrame([("src/a/x.ts", "src/a/y.ts", "getHTTPServer_name", "  Hello__World! é "), ("a", "b", "", "***")], "a string, b string, n string, s string").withColumn("id", F.lit("0123456789"))
    rows = df.select(text.path_affinity("a", "b").alias("p"), text.split_identifier("n").alias("w"), text.slug("s", "id").alias("g"), text.language_of("a").alias("l")).collect()
    assert rows[0]["p"] == pytest.approx(2 / 3) and rows[1]["p"] == 0
    assert rows[0]["w"] == ["get", "httpserver", "name"] and rows[1]["w"] == []
    assert rows[0]["g"] == "hello-world" and rows[1]["g"] == "cluster-01234567"
    assert rows[0]["l"] == "typescript" and rows[1]["l"] is None
    assert text.query_terms("A the_fox, jumps! x") == ["the_fox", "jumps"]


def test_penalty_matches_the_loop(spark):
    import random

    rng, rows, want = random.Random(3), [], set()
    for c in range(40):
        members = [(f"c{c}", f"m{i}", rng.random(), "x" * rng.choice([10, 200])) for i in range(rng.randrange(1, 9))]
        rows += members
        kept = list(members)
        while len(kept) > 3 and sum(len(m[3]) < 100 for m in kept) / len(kept) > 0.5:
            kept.remove(min((m for m in kept if len(m[3]) < 100), key=lambda m: m[2]))
        want |= {(m[0], m[1]) for m in kept}
    df = spark.createDataFrame(rows, "community string, id string, pagerank double, content string")
    assert {(r["community"], r["id"]) for r in clustering.short_content_penalty(df).collect()} == want


def test_cards(spark):
    df = spark.createDataFrame([(2, 5, 0.5, 0), (60, 5, 0.5, 0), (5, 1, 0.5, 0), (5, 5, 0.5, 5), (10, 30, None, 0)], "n int, d int, m double, b int")
    rows = df.select(skills.gate("n", "d", "b").alias("g"), skills.confidence("n", "d", "m", "b").alias("c"), skills.maturity("d").alias("t")).collect()
    assert [r["g"] for r in rows] == ["too_small", "too_large", "too_young", "orphan", None]
    assert rows[4]["c"] == pytest.approx(0.8) and rows[4]["t"] == "observed" and rows[0]["t"] == "emerging"


def test_retrieval(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in retrieval.nearest_l2(vectors, [0.9, 0.1], 5).collect()] == [2, 1, 5]
    lanes = {"a": spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int"), "b": spark.createDataFrame([("y", 1)], "id string, rank int")}
    fused = {r["id"]: (r["score"], r["reasons"]) for r in retrieval.fuse(lanes, "id").collect()}
    assert fused["y"] == (1.0, "a+b") and fused["x"][0] == pytest.approx((1 / 61) / (1 / 62 + 1 / 61))
    assert retrieval.hash_embedding("abc", 8) == retrieval.hash_embedding("abc", 8)
    assert sum(x * x for x in retrieval.hash_embedding("abc", 8)) == pytest.approx(1)
    out = retrieval.embed_column(spark.createDataFrame([("a",), (None,)], "t string"), "t", 4).collect()
    assert len(out[0]["embedding"]) == 4 and out[1]["embedding"] is None


def test_scanners(spark):
    libs = spark.createDataFrame([(0, "express", "express"), (1, "koa", "koa"), (2, "other", "express/x")], "position int, library string, needle string")
    imports = spark.createDataFrame([("f1", "express"), ("f2", "express/x"), ("f3", "koa"), ("f4", "koa.y"), ("f5", "expressive"), ("f1", "koa")], "file string, module string")
    hits = scanners.first_match(imports, libs)
    assert {tuple(r) for r in hits.collect()} == {("f1", "express"), ("f2", "express"), ("f3", "koa"), ("f4", "koa"), ("f1", "koa")}
    assert tuple(scanners.best_library(hits, libs).head()) == ("koa", 3)
    rows = [("a::A", "Error"), ("a::B", "x.A"), ("a::C", "B"), ("b::D", "TypeError"), ("c::E", "C"), ("c::B", "E")]
    fam = scanners.error_families(spark.createDataFrame(rows, "class_id string, base_name string"))
    assert {(r["class_id"], r["depth"]) for r in fam.filter("root = 'Error'").collect()} == {("a::A", 1), ("a::B", 2), ("a::C", 3), ("c::E", 4), ("c::B", 5)}
    assert tuple(scanners.largest_family(fam).head()) == ("Error", 5)


def test_error_families_of_any_depth(spark):
    chain = [("a::C1", "Error")] + [(f"a::C{i}", f"C{i - 1}") for i in range(2, 28)] + [("b::C5", "C27")]
    fam = scanners.error_families(spark.createDataFrame(chain, "class_id string, base_name string"))
    assert {(r["class_id"], r["depth"]) for r in fam.collect()} == {(f"a::C{i}", i) for i in range(1, 28)} | {("b::C5", 28)}
    assert tuple(scanners.largest_family(fam).head()) == ("Error", 28)


def test_path_equality_keeps_symbols_without_a_rank(spark, tmp_path):
    rows = [("f::a", "f", float("nan"), 1), ("f::b", "f", 0.1, 1), ("f::c", "f", None, 1), ("f::d", "f", 0.3, 1), ("f::e", "f", float("nan"), 1), ("g::x", "g", float("nan"), 1)]
    syms = spark.createDataFrame(rows, "id string, path string, pagerank double, updated_at_epoch int")
    for c in ("language", "kind", "signature", "docstring", "cluster_id", "updated_at_commit"):
        syms = syms.withColumn(c, F.lit(None).cast("string"))
    syms.withColumn("range_start_line", F.lit(1)).withColumn("range_end_line", F.lit(1)).write.parquet(f"{tmp_path}/symbols.parquet")
    got = {(r["path"], r["n"]): r["id"] for r in path_equality(spark, str(tmp_path)).collect()}
    assert got == {("f", 1): "f::d", ("f", 2): "f::b", ("f", 3): "f::a", ("f", 4): "f::c", ("f", 5): "f::e", ("g", 1): "g::x"}


def test_lexical_search_of_large_and_infinite_ranks(spark, tmp_path):
    """As its SQL: infinity and NaN go first by id and stay what they are, large ranks are rounded, not cut at the greatest integer."""
    import math

    import duckdb

    inf, nan = float("inf"), float("nan")
    ranks = [("a", inf), ("b", nan), ("c", inf), ("d", -inf), ("e", None), ("f", 9.3e9), ("g", 1e300), ("h", 2.5e-9), ("i", -2.5e-9), ("j", 2107054.9932206185), ("k", 4.999999999999999e-10), ("l", 1e5 + 0.123456789049), ("m", 0.0)]
    rows = [(f"merge::{i}", "f", r, 1) for i, r in ranks]
    syms = spark.createDataFrame(rows, "id string, path string, pagerank double, updated_at_epoch int")
    for c in ("language", "kind", "signature", "docstring", "cluster_id", "updated_at_commit"):
        syms = syms.withColumn(c, F.col("path"))
    for c in ("range_start_line", "range_end_line"):
        syms = syms.withColumn(c, F.lit(1))
    syms.coalesce(1).write.parquet(f"{tmp_path}/symbols.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW symbols AS SELECT * FROM '{tmp_path}/symbols.parquet/*.parquet'")

    def plain(rows):
        return [(r[0], r[1], "nan" if r[2] is not None and math.isnan(r[2]) else r[2]) for r in rows]

    got = plain(lexical_search(spark, str(tmp_path)).collect())
    assert got == plain(con.execute(ORACLES["lexical_search"]).fetchall()) and len(got) == len(ranks)
