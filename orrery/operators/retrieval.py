"""Lexical and vector retrieval, rank fusion, and hybrid search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import cosine, dot, matches_any_glob, matches_any_term, query_terms

#: Fields a lexical search looks at; the constant of rank fusion.
FIELDS, FUSION = ["id", "path", "signature", "docstring"], 60


def lexical(symbols: DataFrame, question: str, languages: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Symbols in which any term of the question stands, of the given languages and paths. No term finds nothing."""
    out = symbols.filter(matches_any_term(query_terms(question), FIELDS))
    if languages:
        out = out.filter(F.col("language").isin(languages))
    return out.filter(matches_any_glob("path", paths or []))


def top(df: DataFrame, limit: int) -> DataFrame:
    """The first rows by pagerank (nulls last), then id."""
    return df.orderBy(F.col("pagerank").desc_nulls_last(), "id").limit(limit)


def since_filter(symbols: DataFrame, commits: DataFrame, cutoff) -> DataFrame:
    """Symbols whose commit is known and not older than ``cutoff``. Commit hashes of several lengths match by their first seven signs."""
    known = commits.groupBy(F.substring("hash", 1, 7).alias("__h")).agg(F.max("ts").alias("__ts"))
    return symbols.join(known, F.substring("updated_at_commit", 1, 7) == F.col("__h")).filter(F.col("__ts") >= F.lit(cutoff)).drop("__h", "__ts")


def nearest_l2(vectors: DataFrame, query: list[float], k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``ident, distance`` of the ``k`` nearest by Euclidean distance, ties by id; vectors that are null or of another length take no part.

    An exact scan: each partition keeps its own first ``k`` before anything is gathered (TakeOrderedAndProject).
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query))).withColumn("__q", q)
    squares = F.zip_with(F.col(vector), F.col("__q"), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return rows.select(ident, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("distance")).orderBy("distance", ident).limit(k)


def nearest_cosine(vectors: DataFrame, query: list[float], k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``ident, similarity`` of the ``k`` nearest by cosine, ties by id."""
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query))).withColumn("__q", F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(ident, cosine(vector, "__q").alias("similarity")).orderBy(F.col("similarity").desc(), ident).limit(k)


def fuse(lanes: dict[str, DataFrame], ident: str, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion: ``ident, score, reasons`` of lanes ``ident, rank`` (ranks from 1); the score is relative to the best.

    ``reasons`` are the lanes' names in order, joined by a plus sign. Bounded by the lanes' limits.
    """
    parts = [df.select(ident, (1.0 / (constant + F.col("rank"))).alias("part"), F.lit(name).alias("lane")) for name, df in lanes.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    out = union.groupBy(ident).agg(F.sum("part").alias("raw"), F.array_join(F.array_sort(F.collect_set("lane")), "+").alias("reasons"))
    return out.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy())).drop("raw")


def ranked(df: DataFrame, *order) -> DataFrame:
    """Adds ``rank`` from 1 in the given order; for results that a limit has bounded."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(symbols: DataFrame, vectors: DataFrame, question: str, query: list[float], top_k: int = 10) -> DataFrame:
    """Lexical and vector lanes of 4 * ``top_k`` each, fused: ``id, score, reasons``. ``top_k`` is clamped to 1..50."""
    top_k = max(1, min(50, top_k))
    lex = ranked(top(lexical(symbols, question), 4 * top_k).select("id", "pagerank"), F.col("pagerank").desc_nulls_last(), "id")
    vec = ranked(nearest_l2(vectors, query, 4 * top_k, ident="id"), "distance", "id")
    return fuse({"lexical": lex, "vector": vec}, "id").orderBy(F.col("score").desc(), "id").limit(top_k)


def mixed_similarity(rows: DataFrame, query: list[float], text: str, vector: str = "embedding") -> DataFrame:
    """Adds ``score``: (dot + 1) / 2 where a vector of the right length is there, else the share of the text's tokens found
    in ``name`` and ``description``; rows without any hit have 0."""
    tokens = [t for t in text.lower().split() if t]
    hay = F.lower(F.concat_ws(" ", "name", "description"))
    lexical_score = (sum((hay.contains(t).cast("int") for t in tokens), F.lit(0)) / len(tokens)) if tokens else F.lit(0.0)
    rows = rows.withColumn("__q", F.array(*[F.lit(float(x)) for x in query]))
    # Vectors that are not finite count as missing.
    near = F.when(F.abs(dot(vector, "__q")) < float("inf"), (dot(vector, "__q") + 1) / 2)
    return rows.withColumn("score", F.coalesce(near, lexical_score)).drop("__q")


def hash_embeddings(texts: list[str], dim: int) -> np.ndarray:
    """Deterministic unit vectors, one row a text: the hash of a text seeds a generator of numbers.

    Fixed values: the hash multiplies by 31 and adds each UTF-16 unit, in 32 bits; the generator shifts by 13, 17 and 5;
    a number is its state modulo 10,000 as a share, less a half. All texts go through the generator together.
    """
    state = np.zeros(len(texts), np.uint32)
    for i, text in enumerate(texts):
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
        if len(units):
            powers = np.multiply.accumulate(np.r_[np.uint32(1), np.full(len(units) - 1, 31, np.uint32)], dtype=np.uint32)[::-1]
            state[i] = np.add.reduce(units * powers, dtype=np.uint32)
    out = np.zeros((len(texts), dim))
    for k in range(dim):
        state ^= state << np.uint32(13)
        state ^= state >> np.uint32(17)
        state ^= state << np.uint32(5)
        out[:, k] = (state % np.uint32(10_000)) / 10_000 - 0.5
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def hash_embedding(text: str, dim: int) -> list[float]:
    """The vector of one text."""
    return hash_embeddings([text], dim)[0].tolist()


def embed_column(df: DataFrame, text: str, dim: int, out: str = "embedding", embed=hash_embeddings) -> DataFrame:
    """Adds a vector for every text by an Arrow-batched function; null texts have null vectors.

    ``embed`` may be any function of a list of texts and a dimension that gives one row for each; it gets a whole batch.
    """

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        known = batch.notna().to_numpy()
        rows = iter(np.asarray(embed(batch[known].tolist(), dim), np.float32)) if known.any() else iter(())
        return pd.Series([next(rows) if k else None for k in known], index=batch.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))
