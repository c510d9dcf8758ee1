"""Writing cards to disk: one folder per slug, only what changed, failures kept apart."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.shared import Shared

STATUS = "id string, slug string, status string, error string"
_SLUG = re.compile(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")


def render(fields: dict, body: str) -> str:
    """A card's file: fenced head of JSON values by key, then the body."""
    return "---\n" + "".join(f"{k}: {json.dumps(v)}\n" for k, v in fields.items()) + "---\n" + body


def read_card(text: str) -> tuple[dict, str]:
    """Head and body of a card's file; a text without a head is all body."""
    m = re.match(r"---\n(.*?)\n?---\n(.*)\Z", text, re.S)
    if not m:
        return {}, text
    head = dict(line.split(": ", 1) for line in m.group(1).split("\n") if ": " in line)
    return {k: json.loads(v) for k, v in head.items()}, m.group(2)


def write_card(root: str, ident: str, slug: str, maturity: str, body: str) -> str:
    """``written``, ``unchanged`` if head and body on disk have the same hash, or ``refused`` for an unsafe slug."""
    if not _SLUG.match(slug or ""):
        return "refused"
    digest = hashlib.sha256(body.encode()).hexdigest()
    path = os.path.join(root, maturity, slug, "SKILL.md")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            head, old = read_card(file.read())
        if head.get("sha256") == digest and hashlib.sha256(old.encode()).hexdigest() == digest:
            return "unchanged"
        ident = head.get("id", ident)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = path + ".tmp"
    with open(temporary, "w", encoding="utf-8") as file:
        file.write(render({"id": ident, "slug": slug, "maturity": maturity, "sha256": digest}, body))
    os.replace(temporary, path)
    return "written"


# Folders of cards by maturity, those looked at first before the others.
MATURITIES = ("observed", "emerging", "deterministic_seed")


def card_bodies(spark: SparkSession, root: str) -> DataFrame:
    """``slug, body`` of the cards below a folder, each read whole; of a slug in several folders the first maturity counts.

    Slugs that are no safe name and texts without a head are left out; a folder that is not there gives nothing.
    """
    if not Shared(spark).exists(root):
        return spark.createDataFrame([], "slug string, body string")
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="SKILL.md").select("value", F.col("_metadata.file_path").alias("at"))
    parts = F.split("at", "/")
    rows = files.select(F.element_at(parts, -2).alias("slug"), F.element_at(parts, -3).alias("maturity"), F.regexp_extract("value", r"(?s)\A---\n.*?\n?---\n(.*)\z", 1).alias("body"))
    rows = rows.filter(F.col("slug").rlike(_SLUG.pattern) & F.col("maturity").isin(*MATURITIES) & (F.col("body") != ""))
    place = F.array_position(F.array(*[F.lit(m) for m in MATURITIES]), F.col("maturity"))
    return rows.groupBy("slug").agg(F.min_by("body", place).alias("body"))


def top_unique_paths(members: DataFrame, most: int = 10) -> DataFrame:
    """``cluster_id, path, place``: the first ``most`` different paths of the members ``cluster_id, path, rank`` in the order of
    their first appearance, for a card. Null paths are left out."""
    first = members.filter("path is not null").groupBy("cluster_id", "path").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("rank", "path"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("cluster_id", "path", "place")


def emit_cards(cards: DataFrame, root: str) -> DataFrame:
    """Writes ``cards (id, slug, maturity, body)`` below a shared folder from the tasks that hold them: one status row each.

    A card that cannot be written is a row with its error, not a failed job. Writing is atomic and may be repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, slug, maturity, body in zip(batch["id"], batch["slug"], batch["maturity"], batch["body"]):
                try:
                    out.append((ident, slug, write_card(root, ident, slug, maturity, body or ""), None))
                except OSError as e:
                    out.append((ident, slug, "failed", str(e)[:200]))
            yield pd.DataFrame(out, columns=["id", "slug", "status", "error"])

    return cards.select("id", "slug", "maturity", "body").mapInPandas(run, STATUS)
