"""``python -m orrery status|reindex|seed-skills``: the commands that have to do with data."""

from __future__ import annotations

import argparse
import difflib
import json
import sys

COMMANDS = ("reindex", "seed-skills", "status")


def suggest(word: str) -> str | None:
    """The command a mistyped one most likely stands for: one it begins, else the nearest."""
    starts = [c for c in COMMANDS if word and c.startswith(word)]
    near = difflib.get_close_matches(word, COMMANDS, 1)
    return starts[0] if starts else near[0] if near else None


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if arguments and not arguments[0].startswith("-") and arguments[0] not in COMMANDS:
        meant = suggest(arguments[0])
        print(f"unknown command {arguments[0]!r}" + (f", did you mean {meant!r}?" if meant else ""), file=sys.stderr)
        return 2
    parser = argparse.ArgumentParser("orrery")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("tree", help="a source tree")
    parser.add_argument("--index", required=True, help="the folder of the index")
    given = parser.parse_args(arguments)

    from pyspark.sql import functions as F

    from orrery.operators import conventions, graph, store
    from orrery.serve import report
    from orrery.session import local_session
    from orrery.sources import commits, files, parse

    spark = local_session()
    index = store.EpochStore(spark, given.index)
    if given.command == "status":
        found = report.status(index, given.tree)
        print(json.dumps(found, indent=2))
        return 0 if found["ready"] else 1
    symbols, edges, inheritance = parse.tables_of(parse.parse(files.source_tree(spark, given.tree)))
    symbols = symbols.dropDuplicates(["id"])
    if given.command == "seed-skills":
        cards = conventions.seed_skills(conventions.import_sites(edges), symbols.select(F.col("path").alias("file")), inheritance)
        for row in cards.toLocalIterator():
            print(json.dumps(row.asDict()))
        return 0
    epoch = index.begin()
    try:
        index.write(epoch, "symbols", symbols)
        index.write(epoch, "class_inheritance", inheritance)
        known = spark.read.parquet(f"{index.root}/epoch={epoch}/symbols")
        resolved, _ = graph.resolve_edges(edges, known)
        index.write(epoch, "edges", graph.build_graph(known, resolved.filter("resolved")))
        index.write_meta(epoch, "none", 0, "none")
        state = commits.tree_state(given.tree)
        index.commit(epoch, commit=state["commit"], dirty=state["dirty"])
    except BaseException:
        index.abort()
        raise
    print(json.dumps({"epoch": epoch}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
