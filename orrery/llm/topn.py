"""Top N of every group by simultaneous bisection of per-group cutoffs (problem 5).

Scores become 64-bit integers of the same order. Every group keeps an interval that holds its cutoff; a pass counts,
for all groups at once, the rows in each of 2**BITS equal cells of the interval (BITS bisections in one pass), takes
the cell in which the count from above passes N, keeps the rows above it for good and carries only the cell's rows
on. When an interval is one score wide, the rows left are ties: they go on with an identifier code (the position of
the id in the order of the tied ids), smaller ids first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.lineage import Cuts

#: Bisections made by one pass.
BITS = 8
#: Every group's cutoff row is repeated so often, so that the rows of one hot group spread over as many tasks.
SALTS = 8


def order_code(x: Column) -> Column:
    """A bigint with the order of a double, null and NaN left out: the IEEE bits of its absolute value with its sign.

    The bits are put together from exponent and mantissa, exactly and JVM-side.
    """
    a = F.abs(x)
    least = F.lit(2.0**-1022)
    # floor(log2) can be one off near powers of two; both sides are corrected by comparison.
    e0 = F.when(a < least, F.lit(-1022)).otherwise(F.greatest(F.floor(F.log2(a)), F.lit(-1022)).cast("int"))
    p0 = pow2(e0)
    e = F.when(a < least, F.lit(-1022)).when(a < p0, e0 - 1).when(a / p0 >= 2, e0 + 1).otherwise(e0)
    # Scaled in two steps, as 2**(52 - e) itself can pass the largest double.
    half = F.floor((F.lit(52) - e) / 2).cast("int")
    mantissa = (a * pow2(half) * pow2(F.lit(52) - e - half)).cast("bigint")
    bits = F.when(a < least, mantissa).otherwise((e + 1023).cast("bigint") * F.lit(1 << 52) + (mantissa - F.lit(1 << 52)))
    bits = F.when(a == float("inf"), F.lit(0x7FF << 52)).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def pow2(e: Column) -> Column:
    """2.0 ** e."""
    return F.pow(F.lit(2.0), e.cast("double"))


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _bisect(cuts: Cuts, live: DataFrame, need: DataFrame, bits: int, salts: int) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """Passes over ``live (g, i, c, salt)`` until no group is open.

    ``need (g, need)``: how many rows each group still takes. Returns the rows taken, and of the groups whose cutoff
    falls among equal codes, those rows and how many of them are needed.
    """
    taken: list[DataFrame] = []
    tied: list[DataFrame] = []
    tied_need: list[DataFrame] = []
    bounds = cuts.cut(live.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).join(need, "g"))
    while True:
        # Differences of codes can pass a bigint, so they are taken as decimals.
        span = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1
        width = F.greatest(F.ceil(span / F.lit(1 << bits)).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)"))
        cells = bounds.select("g", "lo", "need", width.alias("width"))
        cell = F.floor((F.col("c").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) / F.col("width")).cast("int")
        placed = live.join(_salted(cells, salts), ["g", "salt"]).select("g", "i", "c", "salt", cell.alias("cell"))
        counts = placed.groupBy("g", "cell").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        # A group has at most 2**bits cells, so this window is small whatever the size of the group.
        down = Window.partitionBy("g").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = counts.withColumn("total", F.sum("k").over(down)).join(cells.select("g", "need"), "g")
        at = at.filter((F.col("total") >= F.col("need")) & (F.col("total") - F.col("k") < F.col("need")))
        verdict = F.when(F.col("total") == F.col("need"), "take").when(F.col("lo") == F.col("hi"), "tie").otherwise("open")
        at = cuts.cut(at.select("g", F.col("cell").alias("at"), "lo", "hi", (F.col("need") - F.col("total") + F.col("k")).alias("need"), verdict.alias("verdict")))
        judged = placed.join(_salted(at.select("g", "at", "verdict"), salts), ["g", "salt"], "left")
        # A group with fewer rows than it may take has no cutoff cell: all its rows stay.
        state = F.when(F.col("at").isNull() | (F.col("cell") > F.col("at")), "take").when(F.col("cell") == F.col("at"), F.col("verdict"))
        judged = cuts.cut(judged.select("g", "i", "c", "salt", state.alias("state")).filter(F.col("state").isNotNull()))
        taken.append(judged.filter("state = 'take'").select("g", "i"))
        left = {r["verdict"] for r in at.select("verdict").distinct().collect()}
        if "tie" in left:
            tied.append(judged.filter("state = 'tie'").select("g", "i"))
            tied_need.append(at.filter("verdict = 'tie'").select("g", "need"))
        if "open" not in left:
            return taken, union_all(tied), union_all(tied_need)
        live = judged.filter("state = 'open'").select("g", "i", "c", "salt")
        bounds = at.filter("verdict = 'open'").select("g", "lo", "hi", "need")


def union_all(parts: list[DataFrame]) -> DataFrame | None:
    """All rows of the parts; None for no part."""
    return reduce(DataFrame.unionByName, parts) if parts else None


def top_n(rows: DataFrame, group: str, score: str, ident: str, n: int, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """``group_id, item_id`` of the ``n`` rows of each group with the highest score, equal scores by smaller ``ident``.

    ``ident`` must be unique within a group. Rows with a null group, a null or NaN score or a null ident take no
    part; infinite scores do. Groups with fewer than ``n`` rows are returned whole; an empty table or ``n <= 0``
    gives an empty result. Extra columns do not matter.

    Scale: no group is gathered. A pass is a salted join with one row per open group, a partial count per
    (group, cell) before the shuffle, and a filter; the rows that go on shrink with every pass, and an interval is
    drawn in to the least and greatest code left in it, so heavily skewed scores do not add passes.
    """
    cuts = Cuts(rows.sparkSession, "topn")
    base = rows.select(F.col(group).cast("string").alias("g"), F.col(score).cast("double").alias("s"), F.col(ident).cast("string").alias("i"))
    base = base.filter(F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & F.col("i").isNotNull())
    salt = F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int").alias("salt")
    live = cuts.cut(base.select("g", "i", order_code(F.col("s")).alias("c"), salt).filter(F.lit(n > 0)))
    need = live.select("g").distinct().select("g", F.lit(n).cast("bigint").alias("need"))
    taken, tied, tied_need = _bisect(cuts, live, need, bits, salts)
    if tied is not None:
        # A global sort gives every tied id a code of its order; codes count downwards, as smaller ids go first.
        ranked = cuts.cut(tied.orderBy("i").select("g", "i", (-F.monotonically_increasing_id()).alias("c"), salt))
        more, _, _ = _bisect(cuts, ranked, tied_need, bits, salts)
        taken += more
    return union_all(taken).select(F.col("g").alias("group_id"), F.col("i").alias("item_id"))
