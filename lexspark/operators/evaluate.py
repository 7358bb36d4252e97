"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row per query of `relevant`: n_relevant, mrr over the full list, recall at each cutoff.

    ranked: query_id, item, place; relevant: query_id, item. An item found twice counts at its best place.
    """
    best = ranked.groupBy("query_id", "item").agg(F.min("place").alias("place"))
    judged = relevant.select("query_id", "item").distinct().join(best, ["query_id", "item"], "left")
    hit = lambda k: F.sum(F.coalesce((F.col("place") <= k).cast("long"), F.lit(0)))
    return judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_relevant"),
        F.round(F.coalesce(F.lit(1.0) / F.min("place"), F.lit(0.0)), 6).alias("mrr"),
        *[F.round(hit(k) / F.count(F.lit(1)), 6).alias(f"recall_{k}") for k in cutoffs],
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Averages over queries, and how many there are."""
    names = [c for c in per_query.columns if c == "mrr" or c.startswith("recall_")]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def any_in_top(ranked: DataFrame, relevant: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, hit): whether any relevant item of a query is among its first n."""
    judged = relevant.select("query_id", "item").distinct().join(ranked.where(F.col("place") <= n).select("query_id", "item", "place"), ["query_id", "item"], "left")
    return judged.groupBy("query_id").agg((F.count("place") > 0).alias("hit"))
