"""What operators of an index ask: its state, which tests a change calls for, and whether the network may be used."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import matches_any_glob
from orrery.operators.store import EpochStore
from orrery.sources.commits import tree_state

#: Seconds by which a marker may lie in the future before clocks count as skewed; least signs by which commits are told apart.
SKEW_SECONDS, COMMIT_SIGNS = 5, 7
#: The variable whose value "1", and no other, means that no network is used.
OFFLINE = "ORRERY_OFFLINE"


class Offline(RuntimeError):
    """Network use was asked for while it is ruled out."""


def need_network(reason: str) -> None:
    """To be called before any use of the network, with what it is for; raises ``Offline`` where that is ruled out."""
    if not reason:
        raise TypeError("a reason is needed")
    if os.environ.get(OFFLINE) == "1":
        raise Offline(f"no network for: {reason}")


def same_commit(a: str, b: str) -> bool:
    """Whether two hashes, of which one may be shortened to at least seven signs, name one commit."""
    return min(len(a), len(b)) >= COMMIT_SIGNS and (a.startswith(b) or b.startswith(a))


def status(store: EpochStore, tree: str | None = None, now: datetime | None = None) -> dict:
    """The state of an index: ``ready, epoch, written_at, age_seconds, clock_skew, indexed_commit, head_commit, matches, warnings``.

    ``matches`` is None where a commit is unknown. A missing marker is not ready; a malformed one is told in ``warnings``.
    """
    out: dict = {"ready": False, "epoch": None, "written_at": None, "age_seconds": None, "clock_skew": False, "indexed_commit": None, "head_commit": None, "matches": None, "warnings": []}
    try:
        marker = store.read_marker()
    except ValueError as e:
        return out | {"warnings": [str(e)]}
    if marker is None:
        return out
    age = ((now or datetime.now(timezone.utc)) - datetime.fromisoformat(marker["written_at"])).total_seconds()
    out |= {"ready": True, "epoch": marker["epoch"], "written_at": marker["written_at"], "age_seconds": max(0, int(age)), "clock_skew": age < -SKEW_SECONDS, "indexed_commit": marker.get("commit")}
    state = tree_state(tree) if tree else {"commit": None, "dirty": None}
    out["head_commit"] = state["commit"]
    if out["indexed_commit"] and state["commit"]:
        out["matches"] = same_commit(out["indexed_commit"], state["commit"])
        if not out["matches"]:
            out["warnings"].append(f"indexed at {out['indexed_commit']}, the head is {state['commit']}")
    if marker.get("dirty"):
        out["warnings"].append("indexed from a tree with changes")
    if state["dirty"] and out["indexed_commit"]:
        out["warnings"].append("the tree has changes")
    return out


def plan_tests(spark: SparkSession, changed: DataFrame, rules: list[tuple[list[str], str, str]]) -> DataFrame:
    """``scope, command, paths``: the commands that changed paths call for, by rules ``(globs, scope, command)``, and how many
    paths call for each. Paths may use either separator; a path without a rule has the scope ``other`` and no command.
    """
    paths = changed.select(F.translate(F.trim("path"), "\\", "/").alias("path")).filter("path != ''").distinct()
    parts = [paths.filter(matches_any_glob("path", globs)).select("path", F.lit(scope).alias("scope"), F.lit(command).alias("command"), F.lit(i).alias("place")) for i, (globs, scope, command) in enumerate(rules)]
    known = parts[0] if parts else spark.createDataFrame([], "path string, scope string, command string, place int")
    for p in parts[1:]:
        known = known.unionByName(p)
    rest = paths.join(known.select("path").distinct(), "path", "left_anti").select("path", F.lit("other").alias("scope"), F.lit(None).cast("string").alias("command"), F.lit(len(rules)).alias("place"))
    return known.unionByName(rest).groupBy("scope", "command", "place").agg(F.countDistinct("path").alias("paths")).orderBy("place").drop("place")
