"""Retrieval quality: recall, hit rate, reciprocal rank, normalised discounted gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_metrics(results: DataFrame, ks: tuple[int, ...] = (1, 5, 10), rank: str = "rank") -> DataFrame:
    """One row: recall_at_k for each k, mrr, n_found, n_missing, over results with a rank from 1 or null."""
    at = [F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    found = F.count(rank)
    return results.agg(*at, F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"), found.alias("n_found"), (F.count(F.lit(1)) - found).alias("n_missing"))


def ndcg(judged: DataFrame, k: int, query: str = "query_id", score: str = "score", relevance: str = "relevance", *tie: str) -> DataFrame:
    """query, ndcg at k: gain 2^relevance - 1, discount log2(place + 1), against the best order; 0 where nothing is relevant."""
    gain = lambda place: (F.pow(F.lit(2.0), F.col(relevance)) - 1) / F.log2(F.col(place) + 1)
    rows = judged.withColumns(
        {
            "__place": F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), *tie)),
            "__best": F.row_number().over(Window.partitionBy(query).orderBy(F.desc(relevance), *tie)),
        }
    )
    sums = rows.groupBy(query).agg(*[F.sum(F.when(F.col(p) <= k, gain(p)).otherwise(0.0)).alias(n) for p, n in (("__place", "dcg"), ("__best", "ideal"))])
    return sums.select(query, F.coalesce(F.try_divide(F.col("dcg"), F.col("ideal")), F.lit(0.0)).alias("ndcg"))


def summary(df: DataFrame, value: str = "ndcg") -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
