"""Cards of recurring conventions: confidence, gate, maturity, names, ids and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import hyphenated

#: Bounds of the gate: members, and days since first seen; days from which a card is observed; days after which it goes.
LEAST, MOST, LEAST_DAYS, OBSERVED_DAYS, EXPIRE_DAYS = 3, 50, 2, 30, 60


def observed_days(first: str, last: str) -> Column:
    """Whole days between two times, never negative; 0 if one is missing."""
    micros = F.unix_micros(F.col(last).cast("timestamp")) - F.unix_micros(F.col(first).cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0), F.floor(micros / F.lit(86_400_000_000))), F.lit(0)).cast("int")


def confidence(size: str, days: str, modularity: str, bridges: str) -> Column:
    """Evidence from size, age and modularity, less the share of bridges, within 0 and 1."""
    part = F.least(F.col(size) / 10, F.lit(1.0)) * 0.3 + F.least(F.col(days) / 30, F.lit(1.0)) * 0.3
    mod = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(modularity), F.lit(0.0)))) * 0.25
    loss = F.least(F.when(F.col(size) > 0, F.col(bridges) / F.col(size)).otherwise(0.0), F.lit(1.0)) * 0.15
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.2) + part + mod - loss))


def gate(size: str, days: str, bridges: str, least_days: int = LEAST_DAYS) -> Column:
    """Why a cluster gives no card, in order: too small, too large, too young, orphan; null if it does."""
    return (
        F.when(F.col(size) < LEAST, "too_small").when(F.col(size) > MOST, "too_large").when(F.col(days) < least_days, "too_young").when(F.col(bridges) >= F.col(size), "orphan")
    )


def maturity(days: str, seed: Column | None = None) -> Column:
    """``deterministic_seed`` for seeds, ``observed`` from thirty days on, else ``emerging``."""
    grown = F.when(F.col(days) >= OBSERVED_DAYS, "observed").otherwise("emerging")
    return grown if seed is None else F.when(seed, "deterministic_seed").otherwise(grown)


def skill_id(source: str, cluster: Column, slug: Column) -> Column:
    """A stable id of source, cluster and slug, in five groups of hex signs."""
    return hyphenated(F.sha2(F.concat_ws("|", F.lit("skill"), F.lit(source), cluster, slug), 256))


def body(name: str, description: str, members: str) -> Column:
    """The card's text: a heading, its description and its members, one a line. ``members`` is an ordered array."""
    lines = F.transform(F.col(members), lambda m: F.concat(F.lit("- `"), m, F.lit("`")))
    return F.concat(F.lit("# "), F.col(name), F.lit("\n\n"), F.coalesce(F.col(description), F.lit("")), F.lit("\n\n## Members\n\n"), F.array_join(lines, "\n"), F.lit("\n"))


def front_matter(fields: dict[str, Column]) -> Column:
    """A fenced head of ``key: value`` lines; values are JSON strings, so that any text can be read back."""
    rows = [F.concat(F.lit(f"{k}: "), F.get_json_object(F.to_json(F.struct(v.cast("string").alias("v"))), "$")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n"))


def expired(skills: DataFrame, now, days: int = EXPIRE_DAYS) -> DataFrame:
    """Cards that were emitted at least ``days`` before ``now``, with a free archive name: a suffix counts repeats of a slug."""
    from pyspark.sql import Window

    old = skills.filter(F.col("emitted_at") <= F.lit(now) - F.expr(f"interval {days} days"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("emitted_at", "id"))
    return old.withColumn("archive_name", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n)))


def changed_cards(new: DataFrame, old: DataFrame) -> DataFrame:
    """New cards that must be written: unknown ids, another body hash, or an old card that lacks its vector."""
    known = old.select("id", F.col("body_sha256").alias("__h"), F.col("has_vector").alias("__v"))
    return new.join(known, "id", "left").filter(F.col("__h").isNull() | (F.col("__h") != F.col("body_sha256")) | ~F.col("__v")).drop("__h", "__v")


def write_skills(old: DataFrame, new: DataFrame, embed=None, dim: int = 64) -> DataFrame:
    """The table of cards after a run: changed ones with fresh vectors of name and description, the others as they were.

    ``old`` has ``body_sha256`` and ``embedding``; ``new`` the same columns but these two. A card whose body has the hash of
    the stored one is not embedded again, unless that has no vector. Texts are embedded in Arrow batches.
    """
    from orrery.operators import retrieval as R

    hashed = new.withColumn("body_sha256", F.sha2(F.coalesce("body", F.lit("")), 256))
    fresh = changed_cards(hashed, old.withColumn("has_vector", F.col("embedding").isNotNull()))
    text = F.concat_ws("\n", "name", "description")
    fresh = R.embed_column(fresh.withColumn("__text", text), "__text", dim, embed=embed or R.hash_embeddings).drop("__text")
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*old.columns))
