"""Column functions on names, paths and vectors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.globs import glob_to_regex


def query_terms(question: str, most: int = 8) -> list[str]:
    """Lower-case terms of at least two signs, the first ``most``."""
    return [t for t in re.split(r"[^a-z0-9_]+", question.lower()) if len(t) >= 2][:most]


def matches_any_term(terms: list[str], columns: list[str]) -> Column:
    """Whether any term stands literally in any column, nulls counting as empty; no term matches nothing."""
    tests = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t) for t in terms for c in columns]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def matches_any_glob(column: str, patterns: list[str]) -> Column:
    """Whether a path matches any glob; no pattern matches all."""
    if not patterns:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col(column).rlike(glob_to_regex(p)) for p in patterns])


def language_of(column: str) -> Column:
    """Language by extension; null for others."""
    ext = F.regexp_extract(F.lower(F.col(column)), r"\.([a-z]+)$", 1)
    return (
        F.when(ext.isin("ts", "tsx", "mts", "cts"), "typescript").when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript")
        .when(ext.isin("py", "pyi"), "python").when(ext == "go", "go").when(ext == "rs", "rust")
    )


def split_identifier(column: str) -> Column:
    """Lower-case words of a camel, snake or kebab name."""
    spaced = F.regexp_replace(F.col(column), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\-.\s]+", " ")), " "), lambda x: x != "")


def short_name(column: str) -> Column:
    """The part of an id behind its last ``::``, or the base name of a path without extension."""
    base = F.regexp_replace(F.element_at(F.split(F.col(column), "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.when(F.col(column).contains("::"), F.element_at(F.split(F.col(column), "::"), -1)).otherwise(base)


def slug(column: str, ident: str, most: int = 60) -> Column:
    """A lower-case name of letters, digits and single hyphens, at most ``most`` long; ``cluster-`` and eight signs of the id if nothing is left."""
    s = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[\s_]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\-]", ""), r"-+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"^-|-$", ""), 1, most), r"-$", "")
    return F.when(s == "", F.concat(F.lit("cluster-"), F.substring(ident, 1, 8))).otherwise(s)


def dot(a: str, b: str) -> Column:
    """Dot product of two arrays of equal length, in doubles; null on a null or another length."""
    product = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def cosine(a: str, b: str) -> Column:
    """Cosine; 0 on a null, another length or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def path_affinity(a: str, b: str) -> Column:
    """Common leading segments of two paths over the larger number of segments."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    lead = F.coalesce(F.array_position(same, False) - 1, F.lit(0))
    lead = F.when(lead < 0, F.size(same)).otherwise(lead)
    return lead / F.greatest(F.size(F.split(a, "/")), F.size(F.split(b, "/")))


def hyphenated(digest: Column) -> Column:
    """The first 32 hex signs in groups of 8-4-4-4-12."""
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
