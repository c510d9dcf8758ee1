"""Cutting oversized items into pieces under a limit (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of a cut after a line, by what follows or precedes it.
BLANK, CLOSING, STATEMENT, INSIDE, BROKEN = 0.0, 0.15, 0.5, 1.0, 3.0
#: Weight of the squared unused share of a piece, and of every line of overlap that has no room.
IMBALANCE, LOST_OVERLAP = 1.0, 1.5

_BREAK = re.compile(r"[\s,;)}\]]")
_CLOSER = re.compile(r"\s*(?:[)}\]]+[;,]?|end|return\b.*)\s*$")
_ENDS = re.compile(r"[;{}]\s*$|^\s*$")


def units_of(lines: list[str], limit: int) -> list[tuple[str, int, bool]]:
    """Lines as units (text, line number, whether it continues its line); lines over the limit are broken into parts of about
    half of it, at blanks and separators where there are any."""
    half, out = max(1, limit // 2), []
    for number, line in enumerate(lines):
        if len(line) <= limit:
            out.append((line, number, False))
            continue
        at = 0
        while at < len(line):
            end = min(len(line), at + half)
            if end < len(line):
                breaks = [m.end() for m in _BREAK.finditer(line, at + half // 2, end)]
                end = breaks[-1] if breaks else end
            out.append((line[at:end], number, at > 0))
            at = end
    return out


def penalties(units: list[tuple[str, int, bool]]) -> list[float]:
    """Penalty of a cut before unit i (0 for none, at the start and the end)."""
    out = [0.0]
    indents = [len(t) - len(t.lstrip()) for t, _, _ in units]
    shallow = min((d for d, (t, _, _) in zip(indents, units) if t.strip()), default=0)
    for i in range(1, len(units)):
        before, (after, _, goes_on) = units[i - 1][0], units[i]
        if goes_on:
            out.append(BROKEN)
        elif not before.strip() or not after.strip():
            out.append(BLANK)
        elif _CLOSER.match(before) and not _CLOSER.match(after):
            out.append(CLOSING + 0.05 * min(6, max(0, indents[i] - shallow) // 2))
        elif indents[i] < indents[i - 1] or _ENDS.search(before) or (indents[i] == indents[i - 1] and not _CLOSER.match(after)):
            out.append(STATEMENT + 0.05 * min(6, max(0, indents[i] - shallow) // 2))
        else:
            out.append(INSIDE)
    return [*out, 0.0]


def cut_points(units: list[tuple[str, int, bool]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as (first unit with overlap, first new unit, end), by dynamic programming over the ends of pieces.

    A piece repeats the ``overlap`` units before its first new one; fewer only where those and the next unit pass the
    limit together.
    """
    n = len(units)
    place = [0]
    for text, _, goes_on in units:
        place.append(place[-1] + len(text) + (0 if goes_on else 1))

    def length(a: int, b: int) -> int:
        return place[b] - place[a] - (0 if units[a][2] else 1)

    cost, back, heads = [float("inf")] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    cost[0] = 0.0
    fine = penalties(units)
    for a in range(n):
        if cost[a] == float("inf"):
            continue
        first = max(0, a - overlap)
        while first < a and length(first, a + 1) > limit:
            first += 1
        lost = LOST_OVERLAP * (min(a, overlap) - (a - first))
        for b in range(a + 1, n + 1):
            size = length(first, b)
            if size > limit:
                break
            unused = (limit - size) / limit
            # The last piece may be short, but a balanced cut is still preferred.
            total = cost[a] + lost + fine[b] + IMBALANCE * unused * unused + 0.25
            if total < cost[b]:
                cost[b], back[b], heads[b] = total, a, first
    out, b = [], n
    while b > 0:
        out.append((heads[b], back[b], b))
        b = back[b]
    return out[::-1]


def join_units(units: list[tuple[str, int, bool]], a: int, b: int) -> str:
    """The text of units a to b."""
    return "".join(t if goes_on or i == a else "\n" + t for i, (t, _, goes_on) in enumerate(units[a:b], a))


PIECES = "item_id string, piece_no int, first_line int, new_from_line int, last_line int, n_chars int, signature string, text string"


def cut_items(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of ``items (item_id, first_line, signature, lines array<string>)`` of more than ``limit`` characters.

    Each item is cut on its own, whatever its length; every piece keeps the signature, has at most ``limit``
    characters, and repeats the ``overlap`` lines before its first new one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, first, signature, lines in zip(batch["item_id"], batch["first_line"], batch["signature"], batch["lines"]):
                units = units_of(list(lines), limit)
                rows = []
                for k, (head, new, end) in enumerate(cut_points(units, limit, overlap)):
                    text = join_units(units, head, end)
                    rows.append((item, k, first + units[head][1], first + units[new][1], first + units[end - 1][1], len(text), signature, text))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return items.select("item_id", "first_line", "signature", "lines").mapInPandas(run, PIECES)


def oversized_symbols(symbols: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """``item_id, first_line, signature, lines`` of the symbols whose lines have more than ``limit`` characters.

    ``symbols``: current rows ``id, path, range_start_line, range_end_line, signature``; ``files``: current rows
    ``file_path, text``. Lines run from the smaller to the larger number, within the file; symbols with a null number,
    outside the file, or without a file have no text.

    Plan: symbols first meet only the line lengths of their file; texts are joined to those that are too long.
    """
    lines = F.split(F.regexp_replace("text", "^\\ufeff", ""), "\r\n|\n")
    lengths = files.filter("text is not null").select(F.col("file_path").alias("fp"), F.transform(lines, lambda x: F.length(x)).alias("lens"))
    low = F.greatest(F.least("range_start_line", "range_end_line"), F.lit(1))
    high = F.greatest("range_start_line", "range_end_line")
    ranged = symbols.filter("range_start_line is not null and range_end_line is not null").select(
        F.col("id").alias("item_id"), F.col("path").alias("fp"), low.alias("low"), high.alias("high"), "signature"
    )
    measured = ranged.join(lengths, "fp").filter(F.col("low") <= F.least(F.col("high"), F.size("lens")))
    own = F.slice("lens", F.col("low"), F.least(F.col("high"), F.size("lens")) - F.col("low") + 1)
    chars = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")) + F.size(own) - 1
    long = measured.select("item_id", "fp", "low", "high", "signature", chars.alias("chars")).filter(F.col("chars") > limit)
    # Each file is split once, before its symbols meet it.
    texts = files.filter("text is not null").select(F.col("file_path").alias("fp"), lines.alias("lines"))
    whole = long.join(texts, "fp").select("item_id", "low", "high", "signature", "lines")
    return whole.select("item_id", F.col("low").cast("int").alias("first_line"), "signature", F.slice("lines", F.col("low"), F.least(F.col("high"), F.size("lines")) - F.col("low") + 1).alias("lines"))
