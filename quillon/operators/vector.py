"""Vector columns: hash embeddings, similarities, normalisation, reranking. Vectors are arrays of double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import ascii_lower, text
from quillon.operators.ranking import top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when a norm is 0 or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def hash_slots(tokens: DataFrame, key: str, token: str, dimension: int) -> DataFrame:
    """Signed feature hashing in long form: key, slot, value, of unit length per key. The first four bytes of sha256 give
    the slot, the fifth the sign; tokens of eight letters or more weigh 1.25."""
    digest = F.sha2(F.col(token), 256)
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dimension
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    weight = F.when(F.length(token) >= 8, F.lit(1.25)).otherwise(F.lit(1.0))
    sums = tokens.select(key, slot.alias("slot"), (sign * weight).alias("w")).groupBy(key, "slot").agg(F.sum("w").alias("w"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, key).where(F.col("norm") > 0).select(key, "slot", (F.col("w") / F.col("norm")).alias("value"))


def hash_cross_score(query: str, texts: Column, tokens: Column, query_tokens: list[str]) -> Column:
    """.85 of the share of query tokens found plus .15 of a number from 0 to 1 hashed from both texts."""
    share = F.size(F.array_intersect(F.array(*[F.lit(t) for t in query_tokens]), tokens)) / len(query_tokens)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(query + "\n"), text(texts)), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share * 0.85 + noise * 0.15))


def late_interaction(tokens: Column, weights: dict[str, float]) -> Column:
    """The summed weight of the query's tokens that a text has."""
    out = F.lit(0.0)
    for token, w in weights.items():
        out = out + F.when(F.array_contains(tokens, token), F.lit(w)).otherwise(F.lit(0.0))
    return out


def minmax(c: str, over: W | None = None) -> Column:
    """(x - min) / (max - min); constant columns give 1 where positive, else 0."""
    over = over or W.partitionBy()
    low, high = F.min(c).over(over), F.max(c).over(over)
    same = F.abs(high - low) <= F.greatest(F.abs(high), F.abs(low)) * 1e-9
    return F.when(same, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - low) / (high - low))


def unit_weights(a: float, b: float) -> tuple[float, float]:
    a, b = max(0.0, a), max(0.0, b)
    return (a / (a + b), b / (a + b)) if a + b > 0 else (1.0, 0.0)


def rerank(df: DataFrame, key: str, similarity: str, pool: int, lexical: float = 0.7, semantic: float = 0.3, floor: float = 0.0) -> DataFrame:
    """The head of ``pool`` rows by score re-ordered by the weighted min-max of score and similarity; similarities under
    ``floor`` count as 0 before that. The tail keeps its order. key, score, in_pool, place."""
    lw, sw = unit_weights(lexical, semantic)
    head = top(df, key, pool).withColumn("_sim", F.when(F.col(similarity) < floor, 0.0).otherwise(F.coalesce(similarity, F.lit(0.0))))
    fused = F.round(minmax("score") * lw + minmax("_sim") * sw, 8)
    head = head.select(key, fused.alias("fused"), "score", F.lit(1).alias("in_pool"))
    tail = df.join(head.select(key), key, "left_anti").select(key, F.lit(None).cast("double").alias("fused"), "score", F.lit(0).alias("in_pool"))
    return head.unionByName(tail).select(key, F.coalesce("fused", "score").alias("score"), "in_pool", F.col("score").alias("lexical"))


def rerank_with_vectors(df: DataFrame, key: str, vectors: DataFrame, query: list[float], pool: int, **weights: float) -> DataFrame:
    """``rerank`` by the cosine of (key, vector) rows with a query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sims = vectors.select(key, cosine(F.col("vector"), q).alias("similarity"))
    return rerank(df.join(sims, key, "left"), key, "similarity", pool, **weights)


def rerank_with_scorer(df: DataFrame, key: str, score: Callable[[Column], Column], column: str, pool: int, **weights: float) -> DataFrame:
    """``rerank`` by a scorer of texts: a column expression or a vectorised function."""
    return rerank(df.withColumn("similarity", score(F.col(column))), key, "similarity", pool, **weights)


def refresh_vectors(rows: DataFrame, stored: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors (path, sha256, vector) brought up to date: unchanged ones kept, changed or new ones encoded, others gone."""
    now = rows.select("path", "sha256", "text")
    keep = stored.join(now.select("path", "sha256"), ["path", "sha256"], "left_semi")
    fresh = now.join(keep.select("path"), "path", "left_anti")
    return keep.select("path", "sha256", "vector").unionByName(encode(fresh).select("path", "sha256", "vector"))


def query_tokens(query: str, min_len: int = 2, limit: int = 32) -> Column:
    """The first ``limit`` distinct tokens of a text."""
    found = F.regexp_extract_all(ascii_lower(F.lit(query)), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: F.length(t) >= min_len)), 1, limit)
