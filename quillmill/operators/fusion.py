"""Fusion of ranked lists: reciprocal ranks, linear combination, weights by the query's kind, explanations.

Lists are long: (query_id, list, item_id, score). One shuffle by query and item adds up what the lists give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T

RRF_K = 60
VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.7, 0.3


def ranked(lists: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "item_id")
    return lists.withColumn("rank", F.row_number().over(order))


def reciprocal_rank(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    return ranked(lists).groupBy("query_id", "item_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def normalised(lists: DataFrame) -> DataFrame:
    """Scores moved to 0..1 in each list; equal ones are 1."""
    w = Window.partitionBy("query_id", "list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return lists.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))))


def linear(lists: DataFrame, weights: dict[str, Column | float]) -> DataFrame:
    """A list that lacks an item adds nothing."""
    weight = F.coalesce(*[F.when(F.col("list") == k, w if isinstance(w, Column) else F.lit(w)) for k, w in weights.items()])
    return normalised(lists).groupBy("query_id", "item_id").agg(F.sum(F.col("score") * weight).alias("score"))


def adaptive_weights(query: Column) -> Column:
    """The vector side's weight by a query's words; the lexical side has the rest. Words are looked for inside others."""
    low = F.lower(query)
    has = lambda names: F.greatest(*[F.contains(low, F.lit(n)) for n in names])
    n = F.size(T.words(query))
    return (
        F.when(has(["name", "title", "called", "specific"]), 0.5)
        .when(has(["similar", "related", "concept", "meaning", "like"]), 0.8)
        .when(has(["error", "code", "function", "method", "api"]), 0.4)
        .when(n > 10, 0.8)
        .when(n <= 3, 0.4)
        .otherwise(0.7)
    )


def explain(lists: DataFrame) -> DataFrame:
    """query_id, item_id, each list's rank and score, the fused score."""
    of = lambda name, c: F.max(F.when(F.col("list") == name, F.col(c)))
    return ranked(lists).groupBy("query_id", "item_id").agg(
        of("vector", "rank").alias("vector_rank"), of("lexical", "rank").alias("lexical_rank"), of("vector", "score").alias("vector_score"), of("lexical", "score").alias("lexical_score"), F.sum(1 / (RRF_K + F.col("rank"))).alias("score")
    )


def finished(fused: DataFrame, limit: int, min_score: float = 0.0) -> DataFrame:
    """Each query's `limit` best items at or above a threshold that only counts if positive."""
    kept = fused.where(F.col("score") >= min_score) if min_score > 0 else fused
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "item_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
