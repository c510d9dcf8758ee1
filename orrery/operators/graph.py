"""Building the property graph, resolving names to symbols, and ranking nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.lineage import Cuts


def build_graph(symbols: DataFrame, edges: DataFrame, include_external: bool = False) -> DataFrame:
    """``from_id, to_id, kind, weight``: one edge per (from, to, kind) with the sum of weights, a null weight counting 1.

    Edges with an end that is no symbol are dropped, unless ``include_external``. Self-loops stay. Null ends are dropped.
    """
    agg = edges.filter("from_id is not null and to_id is not null").groupBy("from_id", "to_id", "kind").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    if include_external:
        return agg
    ids = symbols.select("id").distinct()
    return agg.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "kind", "weight")


def file_modules(symbols: DataFrame) -> DataFrame:
    """A module symbol (id = path, lines 1-1) for every path that has none."""
    paths = symbols.filter("path is not null").groupBy("path").agg(F.min("language").alias("language"))
    new = paths.join(symbols.select(F.col("id").alias("path")), "path", "left_anti")
    return new.select(F.col("path").alias("id"), "path", "language", F.lit("module").alias("kind"))


def tail_name(column: str) -> Column:
    """The part of an id behind its last ``::``; null for ids without one."""
    return F.when(F.col(column).contains("::"), F.element_at(F.split(column, "::"), -1))


def resolve_edges(parser_edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of parser edges resolved to symbols; the resolved edges and the distinct unresolved names.

    ``parser_edges``: ``from_id, to_name, to_path, kind``. Order of strategies: an exact id; with a path hint the symbols
    of that name in the hinted file (with or without extension, or its index file), without a match unresolved; without a
    hint the symbol of that name in the same file, else the only one of that name, else unresolved. Unresolved edges keep
    their name as target. Edges with the same (from, to, kind) add up to a weight.
    """
    own = symbols.select("id", "path").distinct().withColumn("tail", tail_name("id"))
    edges = parser_edges.withColumn("from_path", F.split("from_id", "::")[0])
    slot = F.regexp_replace(F.concat_ws("/", F.regexp_extract("from_path", r"^(.*)/[^/]*$", 1), F.col("to_path")), r"(^|/)\./", "$1")
    slot = F.regexp_replace(F.regexp_replace(slot, r"[^/]+/\.\./", ""), r"\.[A-Za-z]+$", "")
    edges = edges.withColumn("hint", F.when(F.col("to_path").isNotNull(), slot))
    stem = F.regexp_replace("path", r"\.[A-Za-z]+$", "")
    in_file = own.filter("tail is not null").withColumn("stem", F.regexp_replace(stem, r"/(index|__init__|mod)$", ""))
    exact = own.select(F.col("id").alias("exact_id")).distinct()
    hinted = in_file.groupBy(F.col("stem").alias("h_stem"), F.col("tail").alias("h_tail")).agg(F.min("id").alias("hinted_id"))
    same = in_file.groupBy(F.col("path").alias("s_path"), F.col("tail").alias("s_tail")).agg(F.min("id").alias("same_id"))
    unique = in_file.groupBy(F.col("tail").alias("u_tail")).agg(F.min("id").alias("unique_id"), F.max("id").alias("u_max")).filter("unique_id = u_max").drop("u_max")
    joined = (
        edges.join(exact, F.col("to_name") == F.col("exact_id"), "left")
        .join(hinted, (F.col("hint") == F.col("h_stem")) & (F.col("to_name") == F.col("h_tail")), "left")
        .join(same, (F.col("from_path") == F.col("s_path")) & (F.col("to_name") == F.col("s_tail")), "left")
        .join(unique, F.col("to_name") == F.col("u_tail"), "left")
    )
    target = F.coalesce("exact_id", F.when(F.col("to_path").isNotNull(), F.col("hinted_id")).otherwise(F.coalesce("same_id", "unique_id")))
    out = joined.select("from_id", F.coalesce(target, F.col("to_name")).alias("to_id"), "kind", target.isNotNull().alias("resolved"))
    resolved = out.groupBy("from_id", "to_id", "kind", "resolved").agg(F.count("*").cast("double").alias("weight"))
    return resolved, out.filter("not resolved").select(F.col("to_id").alias("name")).distinct()


def pagerank(symbols: DataFrame, edges: DataFrame, alpha: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """``id, rank`` by weighted PageRank with the mass of nodes without out-edges spread evenly.

    Ends when the summed change falls below nodes * ``tolerance``, after ``max_rounds`` rounds, or after exactly ``fixed``
    rounds. A single node has rank 1; no nodes give an empty result. Edges are summed over kinds; only edges between
    nodes count.

    Plan: out-shares are computed once; a round is one join and one pre-aggregated sum per target, so a target with very
    many in-edges is combined before the shuffle. Each round is written to the shared folder.
    """
    cuts = Cuts(symbols.sparkSession, "pagerank")
    nodes = cuts.cut(symbols.select("id").filter("id is not null").distinct())
    total = nodes.count()
    if total == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    plain = build_graph(nodes, edges).groupBy("from_id", "to_id").agg(F.sum("weight").alias("w"))
    out = plain.groupBy("from_id").agg(F.sum("w").alias("total"))
    shares = cuts.cut(plain.join(out, "from_id").select("from_id", "to_id", (F.col("w") / F.col("total")).alias("share")))
    sources = shares.select(F.col("from_id").alias("id")).distinct()
    ranks = nodes.join(sources.withColumn("linked", F.lit(True)), "id", "left").select("id", F.lit(1.0 / total).alias("rank"), F.coalesce("linked", F.lit(False)).alias("linked"))
    ranks = cuts.cut(ranks)
    rounds = fixed if fixed is not None else max_rounds
    last = cuts.last()
    for _ in range(rounds):
        loose = ranks.filter(~F.col("linked")).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).head()[0]
        base = alpha * loose / total + (1 - alpha) / total
        flow = shares.join(ranks.select(F.col("id").alias("from_id"), "rank"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        fresh = ranks.join(flow, "id", "left").select("id", (F.lit(alpha) * F.coalesce("flow", F.lit(0.0)) + F.lit(base)).alias("rank"), "linked", F.col("rank").alias("old"))
        fresh = cuts.cut(fresh)
        cuts.drop(last)
        last = cuts.last()
        change = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0]
        ranks = fresh.drop("old")
        if fixed is None and change < total * tolerance:
            break
    return ranks.select("id", "rank")


def write_back_ranks(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """Symbols with their new pagerank; symbols without a rank keep the old one."""
    return symbols.join(ranks.withColumnRenamed("rank", "__rank"), "id", "left").withColumn("pagerank", F.coalesce("__rank", "pagerank")).drop("__rank")


#: Links (both directions counted) up to which one task goes on with Louvain's moves, of some 50 bytes each at most; links whose gains
#: are worked out together.
FEW_LINKS, LINKS_AT_ONCE = 6_000_000, 1_000_000


def _rows_of(start: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Numbers of the links of the given nodes, in order; the links of node i are those from start[i] to start[i + 1]."""
    size = start[nodes + 1] - start[nodes]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[nodes] - ends + size, size)


def _moves_of(nodes: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, c: np.ndarray, k: np.ndarray, tot: np.ndarray, scale: float, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the given nodes (in order, each with links) the community of greatest gain, and whether a move there gains."""
    n, links = len(c), _rows_of(start, nodes)
    key = np.repeat(nodes, start[nodes + 1] - start[nodes]) * n + c[y[links]]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    node, nc = key[starts] // n, key[starts] % n
    sums = np.add.reduceat(weight[links[order]], starts)
    own = nc == c[node]
    gain = np.floor((sums - scale * k[node] * (tot[nc] - np.where(own, k[node], 0)) / total) * 1e9 + 0.5) / 1e9
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    most = np.maximum.reduceat(gain, first)
    # The last of those with the greatest gain; none where a gain is no number.
    at = np.where(gain == np.repeat(most, np.diff(np.r_[first, len(node)])), np.arange(len(node)), -1)
    best = nc[np.maximum(np.maximum.reduceat(at, first), 0)]
    stay = np.maximum.reduceat(np.where(own, np.maximum(gain, 0), 0), first)
    return best, (most > stay + 1e-9) & (best != c[nodes])


def settle(a: np.ndarray, b: np.ndarray, w: np.ndarray, coins: np.ndarray, resolution: float, bound: int = 1000) -> np.ndarray:
    """Community of every node, named by its smallest member, after the passes of ``louvain`` on links between numbers.

    ``a, b, w``: links in both directions, loops once with their whole weight; numbers are in the order of names and each
    has a link; ``coins`` holds 64 bits a node, one for each round in turn. A round works out anew only what the moves of
    the round before can have changed: nodes in a community that took or lost a node, and those linked to them.
    """
    total = float(w.sum())
    first = np.arange(len(coins))  # the name of every number of this pass
    label = np.arange(len(coins))
    for _ in range(bound):
        n = len(first)
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        del order
        k = np.bincount(a, w, n)
        apart = a != b
        y, weight = b[apart], w[apart]
        start = np.r_[0, np.cumsum(np.bincount(a[apart], minlength=n))]
        linked = start[1:] > start[:-1]
        del apart
        c, best, wants, flips = np.arange(n), np.arange(n), np.zeros(n, bool), coins[first]
        todo, moved_any = np.flatnonzero(linked), False
        for turn in range(bound):
            tot = np.bincount(c, k, n)
            ends = np.cumsum(start[todo + 1] - start[todo])
            for part in np.split(todo, np.searchsorted(ends, np.arange(LINKS_AT_ONCE, ends[-1], LINKS_AT_ONCE))) if len(todo) else ():
                if len(part):
                    best[part], wants[part] = _moves_of(part, start, y, weight, c, k, tot, resolution, total)
            if not wants.any():
                break
            moves = np.flatnonzero(wants)
            moves = moves[((flips[moves] >> np.uint64(turn % 64)) & np.uint64(1)).astype(bool)]
            touched = np.zeros(n, bool)
            touched[c[moves]] = True
            c[moves] = best[moves]
            touched[c[moves]] = True
            touched = touched[c]
            near = touched.copy()
            near[y[_rows_of(start, np.flatnonzero(touched))]] = True
            todo = np.flatnonzero(near & linked)
            moved_any |= bool(len(moves))
        else:
            raise RuntimeError(f"louvain: nodes still move after {bound} rounds")
        if not moved_any:
            return first[label]
        # Communities in the order of their smallest members are the numbers of the next pass.
        names = np.full(n, n)
        np.minimum.at(names, c, np.arange(n))
        kept = np.unique(names[c])
        new = np.searchsorted(kept, names[c])
        label, first = new[label], first[kept]
        found, back = np.unique(new[a] * len(kept) + new[b], return_inverse=True)
        a, b, w = (found // len(kept)).astype(np.int32), (found % len(kept)).astype(np.int32), np.bincount(back, w)
    raise RuntimeError(f"louvain: communities still merge after {bound} passes")


def _settled(links: int, nodes: int, resolution: float, bound: int):
    """``settle`` on rows ``a, b, w`` of the links and, without ``b``, ``a, h`` of the nodes; numbers may have gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w, name, coins = np.empty(links, np.int64), np.empty(links, np.int64), np.empty(links), np.empty(nodes, np.int64), np.empty(nodes, np.uint64)
        at = n = 0
        for batch in batches:
            whole = batch.column("b").is_valid()
            part, own = batch.filter(whole), batch.filter(pc.invert(whole))
            for to, column in ((a, "a"), (b, "b"), (w, "w")):
                to[at : at + len(part)] = part.column(column).to_numpy()
            name[n : n + len(own)] = own.column("a").to_numpy()
            coins[n : n + len(own)] = own.column("h").to_numpy().view(np.uint64)
            at, n = at + len(part), n + len(own)
        if (at, n) != (links, nodes):
            raise RuntimeError(f"louvain: {at} links and {n} nodes came of {links} and {nodes}")
        order = np.argsort(name)
        name, coins = name[order], coins[order]
        a, b = np.searchsorted(name, a).astype(np.int32), np.searchsorted(name, b).astype(np.int32)
        label = settle(a, b, w, coins, resolution, bound)
        for at in range(0, len(name), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(name[at : at + 50_000]), pa.array(name[label[at : at + 50_000]])], ["a", "c"])

    return run


def numbered(cuts: Cuts, ids: DataFrame) -> DataFrame:
    """``id, a, h``: distinct ids numbered from 0 in their byte order, with a hash of each; by one range sort."""
    ordered = ids.distinct().repartitionByRange("id").sortWithinPartitions("id")
    low = (1 << 33) - 1
    ordered = cuts.cut(ordered.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("at")))
    # One row a partition.
    sizes = dict(ordered.groupBy("p").count().collect())
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    offset = F.get(F.array(*[F.lit(x).cast("bigint") for x in offsets or [0]]), F.col("p"))
    return ordered.select("id", (F.col("at") + offset).alias("a"), F.xxhash64("id").alias("h"))


def louvain(edges: DataFrame, resolution: float = 1.5, bound: int = 1000, few: int = FEW_LINKS) -> DataFrame:
    """``id, community`` by synchronous local moving with modularity gains, then contraction, until neither changes anything.

    Undirected weights are summed. A node moves to the neighbouring community of greatest gain (ties: larger name); only
    half of the nodes, by the bits of a hash in turn, may move at once, so that neighbours do not swap for ever.
    A pass ends when no node gains by a move, whether or not the hash lets it; the last pass is one without a move. More
    than ``bound`` rounds in a pass or ``bound`` passes are an error, never a result.
    Deterministic. Communities are named by their smallest member id. Nodes without edges do not appear. All moves are made
    on numbers in the order of the ids. A pass over at most ``few`` links and all later ones are made by one task, with the
    same moves and coins.
    """
    cuts = Cuts(edges.sparkSession, "louvain")
    plain = edges.filter("from_id is not null and to_id is not null").groupBy("from_id", "to_id").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
    plain = cuts.cut(plain)
    nodes = numbered(cuts, plain.select(F.col("from_id").alias("id")).unionByName(plain.select(F.col("to_id").alias("id"))))
    ends = plain.join(nodes.select(F.col("id").alias("from_id"), "a"), "from_id").join(nodes.select(F.col("id").alias("to_id"), F.col("a").alias("b")), "to_id").select("a", "b", "w")
    level = cuts.cut(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    level_at, member_at = cuts.last(), None
    cuts.drop(1)
    total = level.agg(F.coalesce(F.sum("w"), F.lit(0.0))).head()[0]
    member = nodes.select("a", F.col("a").alias("c"))

    def named(member: DataFrame) -> DataFrame:
        out = member.join(nodes.select("id", "a"), "a").select("id", "c")
        return out.join(nodes.select(F.col("id").alias("community"), F.col("a").alias("c")), "c").select("id", "community")

    if not total:
        return named(member)
    for _ in range(bound):
        links = level.count()
        here = level.select("a").distinct()
        if links <= few:
            rows = level.select("a", "b", "w", F.lit(None).cast("bigint").alias("h"))
            rows = rows.unionByName(nodes.join(here, "a").select("a", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("w"), "h"))
            rest = rows.repartition(1).mapInArrow(_settled(links, here.count(), resolution, bound), "a bigint, c bigint")
            try:
                rest = cuts.cut(rest)
            except PySparkException as e:
                if "louvain: " in str(e):
                    raise RuntimeError("louvain: " + str(e).split("louvain: ")[1].split("\n")[0]) from None
                raise
            return named(rest if member_at is None else member.join(rest.select(F.col("a").alias("c"), F.col("c").alias("to")), "c").select("a", F.col("to").alias("c")))
        state = cuts.cut(level.groupBy("a").agg(F.sum("w").alias("k")).join(nodes.select("a", "h"), "a").select("a", F.col("a").alias("c"), "k", "h"))
        state_at = cuts.last()
        moved_any = False
        for turn in range(bound):
            sums = state.groupBy("c").agg(F.sum("k").alias("tot"))
            to = level.filter("a <> b").join(state.select(F.col("a").alias("b"), F.col("c").alias("nc")), "b").groupBy("a", "nc").agg(F.sum("w").alias("w"))
            own = state.select("a", "c", "k")
            cand = to.join(own, "a").join(sums.withColumnRenamed("c", "nc"), "nc")
            rest = F.col("tot") - F.when(F.col("nc") == F.col("c"), F.col("k")).otherwise(0.0)
            cand = cand.withColumn("gain", F.round(F.col("w") - F.lit(resolution) * F.col("k") * rest / F.lit(total), 9))
            stay = cand.filter("nc = c").select("a", F.col("gain").alias("stay"))
            best = cand.groupBy("a").agg(F.max_by("nc", F.struct("gain", F.col("nc"))).alias("nc"), F.max("gain").alias("gain"))
            chosen = state.join(best, "a", "left").join(stay, "a", "left")
            may = F.shiftrightunsigned("h", turn % 64).bitwiseAND(F.lit(1)) == 1
            wants = F.coalesce((F.col("gain") > F.greatest(F.coalesce("stay", F.lit(0.0)), F.lit(0.0)) + 1e-9) & (F.col("nc") != F.col("c")), F.lit(False))
            chosen = chosen.withColumn("wants", wants).withColumn("moved", F.col("wants") & may)
            fresh = cuts.cut(chosen.select("a", F.when(F.col("moved"), F.col("nc")).otherwise(F.col("c")).alias("c"), "k", "h", "wants", "moved"))
            cuts.drop(state_at)
            state_at = cuts.last()
            wanting, moves = fresh.agg(F.count_if("wants"), F.count_if("moved")).head()
            state = fresh.select("a", "c", "k", "h")
            moved_any |= moves > 0
            if not wanting:
                break
        else:
            raise RuntimeError(f"louvain: nodes still move after {bound} rounds")
        if not moved_any:
            return named(member)
        names = state.groupBy("c").agg(F.min("a").alias("name"))
        state = state.join(names, "c").select("a", F.col("name").alias("c"))
        member = cuts.cut(member.join(state.select(F.col("a").alias("c"), F.col("c").alias("to")), "c").select("a", F.col("to").alias("c")))
        old, member_at = [level_at, state_at] + [member_at] * (member_at is not None), cuts.last()
        level = level.join(state.select("a", F.col("c").alias("ca")), "a").join(state.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b")
        level = cuts.cut(level.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        level_at = cuts.last()
        cuts.drop(*old)
    raise RuntimeError(f"louvain: communities still merge after {bound} passes")


def modularity(edges: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a partition of the undirected weighted graph."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    tagged = both.join(member.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = tagged.groupBy("ca").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    row = inside.agg(F.sum("tot").alias("m"), F.sum("inner").alias("inner"), F.sum(F.col("tot") * F.col("tot")).alias("square")).head()
    return (row["inner"] / row["m"] - resolution * row["square"] / row["m"] ** 2) if row["m"] else 0.0


