"""Joins whose left side may have a key with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: int = 1000, at_least: int = 50_000) -> DataFrame:
    """Keys with more than 1/`share` of the rows and more than `at_least` rows: fewer than `share` keys at any size."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    return counts.where((F.col("rows") > at_least) & (F.col("rows") > total / share)).select(key)


def skew_left_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """`left` left-joined with `right` on `key`; `right` has each key at most once.

    Rows of hot keys are spread over `salts` partitions by the hash of the column `spread`, and only the
    right rows of these keys are repeated. The broadcast holds hot keys alone, fewer than 1000 of them.
    Null keys match nothing and are spread by the same hash, so that they do not meet in one task.
    """
    hot = F.broadcast(hot_keys(left, key).withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.drop("_hot").join(repeated, [key, "_salt"], "left").drop("_salt")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """As `skew_left_join`, for a right side that is small beside the left one: it is repeated `salts` times as a whole, so that
    nothing has to be counted first."""
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(repeated, [key, "_salt"], "left").drop("_salt")
