"""Parent-child rows to full hierarchies, by parallel tree contraction.

Each round removes leaves (rake) and an independent set of unary-chain nodes (compress), recording for every removed
node the link it had when it went. What is left at the end are roots and one self-linked node per cycle; the
recorded links, replayed backwards, give every node its root, depth and path. The number of rounds is logarithmic in
the number of nodes whatever the depth, and the live table shrinks geometrically; when it is small, one task makes the
remaining rounds of the same contraction in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orrery.lineage import Cuts

#: Root id of nodes that are on a cycle or below one.
CYCLE = "(cycle)"
#: Live nodes, and characters of their ids, up to which one task finishes the contraction.
FEW, FEW_CHARACTERS = 200_000, 40_000_000
#: Ids in paths that the last task gives out at once.
PATH_IDS = 500_000


def contract(parent: np.ndarray, weight: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Root (as an index, -1 on or below a cycle) and depth of nodes whose parent is an index, or -1 for a root; ``weight``
    is the length of the link. Rake and compress with coins, replayed backwards; all nodes of a round at once."""
    n = len(parent)
    up, length, live = parent.copy(), weight.astype(np.int64), np.arange(n)
    records: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rng = np.random.default_rng(seed)
    while True:
        linked = live[(up[live] >= 0) & (up[live] != live)]
        if not len(linked):
            break
        children = np.bincount(up[linked], minlength=n)
        looped = live[up[live] == live]
        children[looped] += 1
        rake = linked[children[linked] == 0]
        heads = rng.random(n) < 0.5
        coin = np.zeros(n, bool)
        coin[linked[(children[linked] == 1) & heads[linked]]] = True
        raked = np.zeros(n, bool)
        raked[rake] = True
        # Who hangs on a coin and stays itself takes over its link.
        taker = linked[coin[up[linked]] & ~coin[linked] & ~raked[linked]]
        out = up[taker]
        gone = np.concatenate([rake, out])
        if len(gone):
            records.append((gone, up[gone].copy(), length[gone].copy()))
        new_up, new_length = up[out].copy(), length[taker] + length[out]
        up[taker], length[taker] = new_up, new_length
        stay = np.ones(n, bool)
        stay[gone] = False
        live = live[stay[live]]
    root, depth = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    ends = live[up[live] < 0]
    root[ends], depth[ends] = ends, 0
    for gone, above, far in reversed(records):
        good = depth[above] >= 0
        root[gone], depth[gone] = root[above], np.where(good, depth[above] + far, -1)
    return root, depth


def _finish(with_path: bool):
    """The rest of a contraction in one task: ``n, p, w, via`` of all live nodes, each once, to ``n, root, depth, path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        # Parents that are not among them are roots.
        codes, names = pd.factorize(np.concatenate([rows["n"].to_numpy(), rows["p"].to_numpy()]))
        size = len(rows)
        parent, weight = np.full(len(names), -1, np.int64), np.zeros(len(names), np.int64)
        parent[:size], weight[:size] = codes[size:], rows["w"]
        root, depth = contract(parent, weight)
        via = rows["via"].to_numpy() if with_path else None
        at = 0
        while at < size:
            end, paths, used = at, [], 0
            while end < size and used < PATH_IDS:
                if with_path and depth[end] >= 0:
                    back, node = [], end
                    while node >= 0:
                        back.append(names[node])
                        back.extend(reversed(list(via[node])) if node < size else ())
                        node = parent[node]
                    paths.append(back[::-1])
                    used += len(back)
                else:
                    paths.append(None)
                    used += 1
                end += 1
            some = slice(at, end)
            roots = np.where(depth[some] < 0, CYCLE, names[np.maximum(root[some], 0)])
            yield pd.DataFrame({"n": names[some], "root": roots, "depth": depth[some].astype(np.int32), "path": pd.Series(paths, dtype=object)})
            at = end

    return run


def resolve_hierarchy(links: DataFrame, node: str = "node_id", parent: str = "parent_id", with_path: bool = False, max_rounds: int = 200, few: int = FEW) -> DataFrame:
    """Root, depth and (on request) path of every node.

    ``links`` has one row per node; a null parent, or a parent that is no node, makes the row a root. Rows with a
    null node are left out; where a node is repeated, the smallest parent counts. Columns of ``links`` other than
    the two named do not matter. An empty table gives an empty result.

    Returns ``node_id, root_id, depth`` (a root has itself and 0; nodes on or below a cycle have ``(cycle)`` and -1)
    and, with ``with_path``, ``path``: the ids from the root down to the node, null for cycles.

    Plan: the parent side of every join holds each key once, so a parent with very many children only makes the
    child side skewed, which adaptive execution splits. Child counts are pre-aggregated before the shuffle. A round
    writes two tables and counts what is left while it writes; up to ``few`` live nodes, of bounded size, one task ends it.
    """
    spark = links.sparkSession
    cuts = Cuts(spark, "hierarchy")
    own = links.select(F.col(node).cast("string").alias("n"), F.col(parent).cast("string").alias("p")).filter(F.col("n").isNotNull())
    own = own.groupBy("n").agg(F.min("p").alias("p"))
    known = own.select(F.col("n").alias("known"))
    via = F.array().cast("array<string>")

    def counted(df: DataFrame) -> tuple[DataFrame, dict]:
        """The table written, and how many of its rows stay, are still linked, and how long their ids are."""
        seen = Observation()
        linked = F.col("p").isNotNull() & (F.col("p") != F.col("n"))
        stays = ~F.col("gone")
        size = F.length("n") + F.coalesce(F.length("p"), F.lit(0))
        facts = [F.count_if(stays & F.col("p").isNotNull()).alias("live"), F.count_if(stays & linked).alias("open"), F.count_if(F.col("gone")).alias("gone"), F.coalesce(F.sum(F.when(stays & F.col("p").isNotNull(), size)), F.lit(0)).alias("characters")]
        out = cuts.cut(df.observe(seen, *facts))
        return out, seen.get

    first = own.join(known, F.col("p") == F.col("known"), "left").select("n", F.col("known").alias("p"), F.lit(1).alias("w"), via.alias("via"), F.lit(False).alias("gone"))
    table, facts = counted(first)
    # Roots are solved at once; live are the nodes with a link.
    roots = table.filter("p is null").select("n", F.col("n").alias("root"), F.lit(0).alias("depth"), F.when(F.lit(with_path), F.array("n")).alias("path"))
    records: list[DataFrame] = []
    for turn in range(max_rounds):
        live = table.filter("not gone and p is not null").select("n", "p", "w", "via")
        if not facts["open"] or facts["live"] <= few and facts["characters"] <= FEW_CHARACTERS:
            break
        children = live.groupBy(F.col("p").alias("q")).agg(F.count("*").alias("k"))
        heads = F.pmod(F.xxhash64("n", F.lit(turn)), F.lit(2)) == 0
        linked = F.col("p") != F.col("n")
        counts = F.coalesce("k", F.lit(0))
        # A chain node is spliced out if its coin shows heads and its only child stays: no two neighbours go at once.
        marked = live.join(children, F.col("n") == F.col("q"), "left").select("n", "p", "w", "via", (linked & (counts == 0)).alias("rake"), (linked & (counts == 1) & heads).alias("coin"))
        marked = cuts.cut(marked)
        marked_number = cuts.last()
        upper = marked.filter("coin").select(F.col("n").alias("un"), F.col("p").alias("up"), F.col("w").alias("uw"), F.col("via").alias("uvia"))
        # Of a coin's only child whether it stays; one row a parent.
        below = marked.filter(~F.col("coin") & ~F.col("rake")).select(F.col("p").alias("bp")).distinct()
        splice = F.col("un").isNotNull() & ~F.col("coin") & ~F.col("rake")
        joined_via = F.concat("uvia", F.array("p"), "via") if with_path else F.col("via")
        state = marked.join(upper, F.col("p") == F.col("un"), "left").join(below, F.col("coin") & (F.col("n") == F.col("bp")), "left").select(
            "n", F.when(splice, F.col("up")).otherwise(F.col("p")).alias("p"), F.when(splice, F.col("w") + F.col("uw")).otherwise(F.col("w")).alias("w"),
            F.when(splice, joined_via).otherwise(F.col("via")).alias("via"), (F.col("rake") | F.col("coin") & F.col("bp").isNotNull()).alias("gone"),
        )
        table, facts = counted(state)
        cuts.drop(marked_number)
        if facts["gone"]:
            records.append(table.filter("gone").select("n", "p", "w", "via"))
    else:
        raise RuntimeError(f"tree contraction did not end within {max_rounds} rounds")
    schema = "n string, root string, depth int, path array<string>"
    if facts["open"]:
        solved = cuts.cut(live.repartition(1).mapInPandas(_finish(with_path), schema))
    else:
        # Only cores that are linked to themselves are left.
        solved = live.select("n", F.lit(CYCLE).alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    solved = solved.unionByName(roots)
    for gone in reversed(records):
        above = solved.select(F.col("n").alias("pn"), F.col("root"), F.col("depth"), F.col("path"))
        path = F.concat("path", "via", F.array("n")) if with_path else F.lit(None).cast("array<string>")
        fresh = gone.join(above, F.col("p") == F.col("pn")).select(
            "n", "root", F.when(F.col("depth") < 0, F.lit(-1)).otherwise(F.col("depth") + F.col("w")).cast("int").alias("depth"), path.alias("path")
        )
        solved = cuts.cut(fresh).unionByName(solved)
    columns = [F.col("n").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth")]
    return solved.select(*columns, *([F.col("path")] if with_path else []))


def descendants(paths: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` of every node that has a path, from ``resolve_hierarchy(with_path=True)``.

    One row per ancestor-descendant pair is the size of the answer itself; each node's own path is exploded, so no
    join is needed and no group is gathered. A node is not its own descendant; cycles have no rows.
    """
    at = paths.filter(F.col("path").isNotNull()).select("node_id", "depth", F.posexplode("path").alias("level", "ancestor_id"))
    return at.filter(F.col("level") < F.col("depth")).select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("level")).cast("int").alias("distance"))


def descendant_counts(paths: DataFrame) -> DataFrame:
    """``ancestor_id, n_descendants, n_children`` of every node with at least one descendant."""
    return descendants(paths).groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"), F.count_if(F.col("distance") == 1).alias("n_children"))


def norm_path(column: str) -> Column:
    """A path or id with ``/`` as separator and without leading ``./``."""
    return F.regexp_replace(F.translate(F.col(column), "\\", "/"), r"^(\./)+", "")


def walk_links(walks: DataFrame) -> DataFrame:
    """``node_id, parent_id`` of walk rows ``symbol_id, parent_symbol_id, walked_at``: the newest row of each normalised id."""
    from orrery.tables import latest

    rows = walks.select(norm_path("symbol_id").alias("node_id"), norm_path("parent_symbol_id").alias("parent_id"), "walked_at")
    return latest(rows.filter(F.col("node_id").isNotNull()), ["node_id"], "walked_at", "parent_id").select("node_id", "parent_id")


def inherit_links(inheritance: DataFrame, symbols: DataFrame) -> DataFrame:
    """``node_id, parent_id`` of each class.

    ``inheritance``: ``class_id, base_name, base_path``; ``symbols``: current rows ``id, path, kind``. The parent is
    the class named by the last part of ``base_name`` in ``base_path``; where that is null, the one in the class's
    own file, else the only class of that name in the repository; otherwise the bare name. A class of a null or
    blank base name is a root of its own. Repeated rows count once.
    """
    name = F.element_at(F.split(F.trim(F.regexp_replace("base_name", r"(?s)[<\[(].*$", "")), r"\.|::"), -1)
    rows = inheritance.filter(F.col("class_id").isNotNull()).select(
        norm_path("class_id").alias("node_id"), F.trim(name).alias("base"), norm_path("base_path").alias("base_path")
    ).groupBy("node_id").agg(F.min_by(F.struct("base", "base_path"), F.struct("base", "base_path")).alias("b"))
    rows = rows.select("node_id", "b.base", F.col("b.base_path").alias("base_path"))
    own_file = F.split("node_id", "::")[0]
    rows = rows.withColumns({"look": F.coalesce("base_path", own_file), "repo": F.split("node_id", "/")[0]})
    classes = symbols.filter(F.col("kind") == "class").select(
        norm_path("id").alias("cid"), norm_path("path").alias("cpath"), F.element_at(F.split("id", "::"), -1).alias("cname")
    )
    in_file = classes.groupBy("cpath", "cname").agg(F.min("cid").alias("file_class"))
    in_repo = classes.groupBy(F.split("cpath", "/")[0].alias("crepo"), F.col("cname").alias("rname")).agg(
        F.min("cid").alias("repo_class"), F.max("cid").alias("repo_other")
    ).filter(F.col("repo_class") == F.col("repo_other")).drop("repo_other")
    found = rows.join(in_file, (F.col("look") == F.col("cpath")) & (F.col("base") == F.col("cname")), "left")
    found = found.join(in_repo, (F.col("repo") == F.col("crepo")) & (F.col("base") == F.col("rname")) & F.col("base_path").isNull(), "left")
    bare = F.when(F.col("base") != "", F.col("base"))
    return found.select("node_id", F.coalesce("file_class", F.when(F.col("base_path").isNull(), F.col("repo_class")), bare).alias("parent_id"))


def with_parents_as_nodes(links: DataFrame) -> DataFrame:
    """Adds a root row for every parent that has no row of its own."""
    parents = links.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id")).distinct()
    extra = parents.join(links.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(None).cast("string").alias("parent_id"))
    return links.unionByName(extra)
