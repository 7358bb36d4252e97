"""Diagnostics of a corpus and of its vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.vectors import cosine, doubles, magnitude


def is_empty(c: Column) -> Column:
    """Null, blank or a lone hyphen."""
    return F.trim(F.coalesce(c, F.lit(""))).isin("-", "")


def empty_share(df: DataFrame, group: str, text: str, n: int = 20) -> DataFrame:
    """The n groups with the largest share of empty texts."""
    empty = F.sum(is_empty(F.col(text)).cast("long"))
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), empty.alias("empty"))
    return counted.withColumn("share", F.round(F.col("empty") / F.col("total"), 6)).orderBy(
        F.col("share").desc(), F.col("total").desc(), group
    ).limit(n)


def length_histogram(df: DataFrame, text: str, edges: tuple[int, ...] = (100, 500, 2000)) -> DataFrame:
    """(bucket, rows): texts by number of characters, up to each edge and beyond the last; null counts as 0."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    bucket = F.lit(f">{edges[-1]}")
    for low, high in reversed(list(zip((-1, *edges), edges))):  # noqa: B905
        bucket = F.when(size <= high, f"{low + 1}-{high}").otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def shares(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and their share of all."""
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("share", F.round(F.col("rows") / total, 6))


def sampled_cosines(vectors: DataFrame, group: str, sample: int = 50, by_hash: bool = False) -> DataFrame:
    """Cosines of all pairs among the `sample` lowest ids of each group: pairs, mean, least, greatest.

    vectors: id, the group, vec. A bounded sample is the definition of this figure; see `mean_cosines` for all pairs.
    `by_hash`: those with the lowest hashes of the id instead, which prefer no ids.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*([F.xxhash64("id", F.lit("sample"))] if by_hash else []), "id"))
    some = vectors.withColumn("n", rank).where(F.col("n") <= sample).select(group, "id", doubles(F.col("vec")).alias("v"))
    a, b = some.select(group, F.col("id").alias("a"), F.col("v").alias("va")), some.select(group, F.col("id").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, group).where(F.col("a") < F.col("b")).withColumn("c", cosine(F.col("va"), F.col("vb")))
    return pairs.groupBy(group).agg(
        F.count(F.lit(1)).alias("pairs"), *[F.round(f("c"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "greatest"))]
    )


def unit_sums(vectors: DataFrame, group: str) -> DataFrame:
    """(group, pos, n, s): sums of the unit vectors of each group by position; combined before the shuffle."""
    v = doubles(F.col("vec"))
    unit = vectors.select(group, F.posexplode(F.transform(v, lambda x: x / magnitude(v))).alias("pos", "x"))
    return unit.groupBy(group, "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))


def mean_cosines(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, centroid, mean): length of the mean unit vector, and the mean cosine over all pairs of a group.

    The mean over pairs follows from the sum of the unit vectors, (|sum|^2 - n) / (n (n - 1)): no pair is formed.
    """
    sums = unit_sums(vectors, group).groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return sums.select(
        group, "n", F.round(F.sqrt("q") / F.col("n"), 6).alias("centroid"),
        F.round(F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1)), 6).alias("mean"),
    )


def label_cosines(vectors: DataFrame, group: str, sample: int = 50) -> DataFrame:
    """(group, n, mean, pairs, least, greatest): mean cosine over all pairs of all n, and least and greatest among the pairs of
    a sample by hash. A group of one has no pairs."""
    drawn = sampled_cosines(vectors, group, sample, by_hash=True).select(group, "pairs", "least", "greatest")
    whole = mean_cosines(vectors, group).select(group, "n", "mean").join(drawn, group, "left")
    return whole.withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def cross_cosines(vectors: DataFrame, group: str) -> DataFrame:
    """(a, b, mean): mean cosine over all pairs between two groups, from their sums; as many rows as pairs of groups."""
    s = unit_sums(vectors, group)
    a, b = s.select(F.col(group).alias("a"), "pos", F.col("n").alias("na"), F.col("s").alias("sa")), s.select(F.col(group).alias("b"), "pos", F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = a.join(b, "pos").where(F.col("a") < F.col("b"))
    return both.groupBy("a", "b").agg(F.round(F.sum(F.col("sa") * F.col("sb")) / (F.max("na") * F.max("nb")), 6).alias("mean"))


def centred_cosines(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, mean): mean cosine of a group's vectors with each other after the mean of all vectors is taken off."""
    v = vectors.select(group, "id", doubles(F.col("vec")).alias("v"))
    centre = v.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    whole = centre.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])).scalar()
    moved = v.withColumn("c", whole).select(group, "id", F.zip_with("v", "c", lambda x, y: x - y).alias("vec"))
    return mean_cosines(moved.where(magnitude(F.col("vec")) > 0), group).select(group, "n", "mean")


def worst_status(checks: DataFrame, order: tuple[str, ...] = ("error", "warn", "ok")) -> DataFrame:
    """(worst, failed): the most serious status of all checks, and how many are not ok."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status"))
    return checks.agg(F.min_by("status", rank).alias("worst"), F.sum((F.col("status") != "ok").cast("long")).alias("failed"))
