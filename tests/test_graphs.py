import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import hierarchy as H
from orrery.operators import reach as R
from orrery.queries.graphs import louvain_cover, pagerank_converged


def brute(parents):
    out = {}
    for n in parents:
        seen, at, path = set(), n, [n]
        while True:
            seen.add(at)
            p = parents[at]
            if p is None or p not in parents:
                out[n] = (at, len(path) - 1, path[::-1])
                break
            if p in seen:
                out[n] = ("(cycle)", -1, None)
                break
            at = p
            path.append(at)
    return out


@pytest.mark.parametrize("seed,n,shape", [(1, 200, "random"), (2, 150, "chain"), (3, 300, "hot"), (4, 40, "loops")])
def test_hierarchy_against_walking_up(spark, seed, n, shape):
    rng = random.Random(seed)
    parents = {}
    for i in range(n):
        if shape == "chain":
            p = None if i == 0 else f"n{i - 1}"
        elif shape == "hot":
            p = None if i == 0 else "n0" if rng.random() < 0.7 else f"n{rng.randrange(i)}"
        elif shape == "loops":
            p = f"n{rng.randrange(n)}"
        else:
            p = rng.choice([None, "outside", f"n{rng.randrange(n)}", f"n{rng.randrange(max(1, i))}"])
        parents[f"n{i}"] = p
    rows = [(k, v, 1) for k, v in parents.items()] + [(None, "n1", 2)]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, depth int")
    got = {r["node_id"]: (r["root_id"], r["depth"], r["path"]) for r in H.resolve_hierarchy(df, with_path=True).collect()}
    want = brute(parents)
    assert got == want
    paths = H.resolve_hierarchy(df, with_path=True)
    pairs = {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in H.descendants(paths).collect()}
    assert pairs == {(a, k, len(p) - 1 - i) for k, (_, d, p) in want.items() if p for i, a in enumerate(p[:-1])}


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "node_id string, parent_id string")
    assert H.resolve_hierarchy(empty).count() == 0
    assert H.descendant_counts(H.resolve_hierarchy(empty, with_path=True)).count() == 0


def test_inherit_links(spark):
    symbols = spark.createDataFrame([("r/a.ts::A", "r/a.ts", "class"), ("r/b.ts::B", "r/b.ts", "class"), ("r/c.ts::B", "r/c.ts", "class"), ("r/a.ts::C", "r/a.ts", "class"), ("r/d.ts::Only", "r/d.ts", "class")], "id string, path string, kind string")
    rows = [("r/a.ts::C", "mod.A<K, V>", None), ("r/x.ts::X", "B", "./r/b.ts"), ("r/x.ts::Y", "B", None), ("r/x.ts::Z", "m::Only", None), ("r/x.ts::W", "compat.Only", "r/outside.ts"), ("r/a.ts::A", "A", None), ("r/x.ts::N", None, None)]
    links = H.inherit_links(spark.createDataFrame(rows + rows[:1], "class_id string, base_name string, base_path string"), symbols)
    got = {r["node_id"]: r["parent_id"] for r in links.collect()}
    assert got == {"r/a.ts::C": "r/a.ts::A", "r/x.ts::X": "r/b.ts::B", "r/x.ts::Y": "B", "r/x.ts::Z": "r/d.ts::Only", "r/x.ts::W": "Only", "r/a.ts::A": "r/a.ts::A", "r/x.ts::N": None}


def test_reach_against_search(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", "calls") for _ in range(70)] + [("n1", "n1", "calls"), (None, "n2", "calls"), ("n3", "n4", "imports")]
    df = spark.createDataFrame([(a, b, k, 1.0) for a, b, k in edges], "from_id string, to_id string, kind string, weight double")
    seeds = spark.createDataFrame([("s1", "n1"), ("s2", "n2"), ("s2", "n3"), ("unknown", "zz")], "seed string, id string")
    want = set()
    for seed, starts in (("s1", ["n1"]), ("s2", ["n2", "n3"])):
        seen, level = {}, set(starts)
        for depth in range(1, 4):
            level = {a for a, b, k in edges if k == "calls" and a and b in level} - set(seen)
            seen.update(dict.fromkeys(level, depth))
        want |= {(seed, i, d) for i, d in seen.items()}
    got = {(r["seed"], r["id"], r["depth"]) for r in R.reach(df, seeds, 3).collect()}
    assert got == want
    assert ("s1", "n1", 1) in got
    assert R.reach(df, seeds.filter("seed = 'unknown'"), 3).count() == 0


def test_pagerank(spark):
    tri = [(a, b, "calls", None) for a, b in ("ab", "bc", "ca", "xy", "yz", "zx")]
    edges = spark.createDataFrame(tri + [("a", "outside", "calls", 1.0)], "from_id string, to_id string, kind string, weight double")
    ids = spark.createDataFrame([(x,) for x in "abcxyz"], "id string")
    ranks = {r["id"]: r["rank"] for r in G.pagerank(ids, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and abs(ranks["a"] - ranks["x"]) < 1e-9
    assert G.pagerank(ids.limit(0), edges).count() == 0
    assert G.pagerank(ids.limit(1), edges).head()["rank"] == pytest.approx(1.0)


def test_build_and_resolve(spark):
    symbols = spark.createDataFrame([("src/a.ts", "src/a.ts", "ts"), ("src/a.ts::f", "src/a.ts", "ts"), ("src/b.ts::f", "src/b.ts", "ts"), ("src/b.ts::g", "src/b.ts", "ts"), ("src/d/index.ts::h", "src/d/index.ts", "ts")], "id string, path string, language string")
    edges = [("src/a.ts::f", "src/b.ts::g", None), ("src/a.ts::f", "f", None), ("src/b.ts::g", "g", None), ("src/a.ts", "h", "./d"), ("src/a.ts", "f", "./b"), ("src/a.ts", "f", "./zz"), ("src/x.ts", "f", None), ("src/x.ts", "lodash", None), ("src/a.ts::f", "f", None)]
    df = spark.createDataFrame([(a, b, c, "calls") for a, b, c in edges], "from_id string, to_name string, to_path string, kind string")
    resolved, missing = G.resolve_edges(df, symbols)
    got = {(r["from_id"], r["to_id"], r["resolved"], r["weight"]) for r in resolved.collect()}
    assert got == {("src/a.ts::f", "src/b.ts::g", True, 1.0), ("src/a.ts::f", "src/a.ts::f", True, 2.0), ("src/b.ts::g", "src/b.ts::g", True, 1.0), ("src/a.ts", "src/d/index.ts::h", True, 1.0), ("src/a.ts", "src/b.ts::f", True, 1.0), ("src/a.ts", "f", False, 1.0), ("src/x.ts", "f", False, 1.0), ("src/x.ts", "lodash", False, 1.0)}
    assert {r["name"] for r in missing.collect()} == {"f", "lodash"}
    assert {r["id"] for r in G.file_modules(symbols).collect()} == {"src/b.ts", "src/d/index.ts"}


def test_louvain_finds_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]
    df = spark.createDataFrame(edges, "from_id string, to_id string, weight double")
    member = G.louvain(df, resolution=1.0)
    one = {r["id"]: r["community"] for r in member.collect()}
    assert len(set(one.values())) == 2 and all(one[x] == one[x[0] + "0"] for x in one)
    assert one == {r["id"]: r["community"] for r in G.louvain(df, resolution=1.0).collect()}
    assert G.modularity(df, member) > 0.4
    assert G.louvain(df.filter(F.lit(False))).count() == 0


def test_louvain_runs_to_its_end(spark):
    n, resolution = 200, 0.1
    edges = [(f"n{i}", f"n{(i + 1) % n}", 1.0) for i in range(n)]
    df = spark.createDataFrame(edges, "from_id string, to_id string, weight double")
    one = {r["id"]: r["community"] for r in G.louvain(df, resolution=resolution).collect()}
    strength, links = {}, {}
    for a, b, w in edges:
        for x, y in ((one[a], one[b]), (one[b], one[a])):
            strength[x] = strength.get(x, 0) + w
            if x != y:
                links[x, y] = links.get((x, y), 0) + w
    total = sum(strength.values())
    assert not [p for p, w in links.items() if w - resolution * strength[p[0]] * strength[p[1]] / total > 1e-6]
    with pytest.raises(RuntimeError):
        G.louvain(df, resolution=resolution, bound=2)


def test_pagerank_converged_returns_every_symbol(spark, tmp_path):
    rows = [(f"f::s{i}", "f", "s", None, 1) for i in range(1100)]
    syms = spark.createDataFrame(rows, "id string, path string, kind string, text string, updated_at_epoch int")
    for c in ("language", "signature", "docstring", "cluster_id", "updated_at_commit"):
        syms = syms.withColumn(c, F.col("text"))
    syms = syms.withColumn("pagerank", F.lit(0.0)).withColumn("range_start_line", F.lit(1)).withColumn("range_end_line", F.lit(1))
    syms.write.parquet(f"{tmp_path}/symbols.parquet")
    edges = [(f"f::s{i}", "f::s0", "calls", 1.0) for i in range(1, 50)]
    spark.createDataFrame(edges, "from_id string, to_id string, kind string, weight double").write.parquet(f"{tmp_path}/edges.parquet")
    ranks = {r["id"]: r["rank"] for r in pagerank_converged(spark, str(tmp_path)).collect()}
    assert set(ranks) == {r[0] for r in rows} and max(ranks, key=ranks.get) == "f::s0"
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("few", [0, 20])
@pytest.mark.parametrize("shape", ["random", "chain", "loops"])
def test_hierarchy_in_rounds(spark, few, shape):
    """The rounds over tables, to the end or until one task takes over, give what one task gives."""
    rng = random.Random(9)
    parents = {f"n{i}": (None if i == 0 else f"n{i - 1}") if shape == "chain" else f"n{rng.randrange(90)}" if shape == "loops" else rng.choice([None, "outside", f"n{rng.randrange(max(1, i))}"]) for i in range(90)}
    df = spark.createDataFrame(list(parents.items()), "node_id string, parent_id string")
    got = {r["node_id"]: (r["root_id"], r["depth"], r["path"]) for r in H.resolve_hierarchy(df, with_path=True, few=few).collect()}
    assert got == brute(parents)
    assert {(r["node_id"], r["depth"]) for r in H.resolve_hierarchy(df, few=few).collect()} == {(k, d) for k, (_, d, _) in got.items()}


def test_louvain_in_one_task_and_in_rounds(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}", float(rng.randrange(1, 4))) for _ in range(120)] + [("n01", None, 1.0), ("x", "x", 2.0)]
    df = spark.createDataFrame(edges, "from_id string, to_id string, weight double")
    one = {r["id"]: r["community"] for r in G.louvain(df, resolution=1.0).collect()}
    rounds = {r["id"]: r["community"] for r in G.louvain(df, resolution=1.0, few=0).collect()}
    assert one == rounds and one["x"] == "x" and None not in one
    assert all(c == min(i for i, d in one.items() if d == c) for c in one.values())


def test_louvain_numbers_ids_in_their_order(spark, monkeypatch):
    """Ids do not count towards the size of a task, so long ones make no rounds over tables."""
    written, cut = [], G.Cuts.cut
    monkeypatch.setattr(G.Cuts, "cut", lambda self, df, *a: written.append(1) or cut(self, df, *a))
    n = 100_000
    name = F.format_string("%s%08d", F.lit("é" * 300), F.col("id"))
    df = spark.range(n).select(name.alias("from_id"), F.format_string("%s%08d", F.lit("é" * 300), F.col("id") - F.col("id") % 5).alias("to_id"), F.lit(1.0).alias("weight"))
    member = G.louvain(df)
    assert len(written) <= 5
    assert member.count() == n and member.groupBy("community").count().filter("count = 5").count() == n / 5
    ids = ["b", "Z", "é", "a/b", "a", "ab", "\U0001f600", "z"]
    got = G.numbered(G.Cuts(spark, "numbers"), spark.createDataFrame([(x,) for x in ids + ids[:3]], "id string")).orderBy("a").collect()
    assert [r["id"] for r in got] == sorted(ids, key=lambda x: x.encode()) and [r["a"] for r in got] == list(range(len(ids)))


@pytest.mark.parametrize("at_once", [7, 1_000_000])
def test_louvain_works_out_only_what_moves_changed(monkeypatch, at_once):
    """The same communities as by working out every node in every round."""
    monkeypatch.setattr(G, "LINKS_AT_ONCE", at_once)
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = 60
        w = np.zeros((n, n))
        for x, y in zip(rng.integers(0, n, 150), np.minimum(rng.integers(0, n, 150), rng.integers(0, n, 150))):
            w[x, y] += (weight := float(rng.integers(1, 4)))
            w[y, x] += weight
        used = np.flatnonzero(w.sum(axis=1))
        w = w[np.ix_(used, used)]
        coins = rng.integers(0, 2**63, len(w)).astype(np.uint64)
        a, b = np.nonzero(w)
        mixed = rng.permutation(len(a))
        got = G.settle(a[mixed], b[mixed], w[a, b][mixed], coins, 1.0)
        assert got.tolist() == plain_louvain(w, coins.tolist())


def plain_louvain(w, coins):
    total, label, names = w.sum(), list(range(len(w))), list(range(len(w)))
    while True:
        n, k, turn, moved = len(w), w.sum(axis=1), 0, False
        c = list(range(n))
        while True:
            tot = [sum(k[y] for y in range(n) if c[y] == z) for z in range(n)]
            wants = {}
            for x in range(n):
                links = {}
                for y in np.flatnonzero(w[x]):
                    if y != x:
                        links[c[y]] = links.get(c[y], 0) + w[x, y]
                gains = {z: round(v - k[x] * (tot[z] - (k[x] if z == c[x] else 0)) / total, 9) for z, v in links.items()}
                if gains:
                    best = max(gains, key=lambda z: (gains[z], z))
                    if best != c[x] and gains[best] > max(gains.get(c[x], 0), 0) + 1e-9:
                        wants[x] = best
            if not wants:
                break
            for x, z in wants.items():
                if coins[names[x]] >> turn % 64 & 1:
                    c[x], moved = z, True
            turn += 1
        if not moved:
            return [names[x] for x in label]
        least = {z: c.index(z) for z in set(c)}
        order = sorted(least, key=least.get)
        new = [order.index(z) for z in c]
        label, names = [new[x] for x in label], [names[least[z]] for z in order]
        one = np.eye(len(order))[new]
        w = one.T @ w @ one


def test_louvain_cover_builds_the_graph_once(spark, data):
    out = louvain_cover(spark, data)
    assert not [f for f in out.inputFiles() if "symbols.parquet" in f or "edges.parquet" in f]
    assert out.head()["nodes"] > 0 and out.head()["wrong"] == 0
