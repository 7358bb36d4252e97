"""What changed between consecutive full snapshots of a table.

Every key has a persistent ordinal inside one of a fixed number of hash buckets. A snapshot is then a bitmap over
ordinals, kept as rows of 64-bit words; words without a set bit are not stored, which is the compression. Additions are
`now AND NOT before`, removals `before AND NOT now`. Beside each word lies a vector of the compared values, aligned with
the set bits, and the keys in both words are compared through it. All of it runs on built-in expressions; no task holds
more than the 64 keys of a word times the number of snapshots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.store import commit, current

BUCKETS = 256


def assign_ordinals(keys: DataFrame, key: str, registry: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, bucket, ordinal) for the distinct non-null `keys`, after the keys that `registry` (an earlier result) has.

    Keys of the registry keep their ordinals for ever, whether or not they occur; new ones go behind the last of their
    bucket in key order. Extra columns of `keys` are kept. `buckets` must not change over a registry's life.
    """
    found = keys.where(F.col(key).isNotNull()).withColumn(
        "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    )
    by_bucket = Window.partitionBy("bucket")
    if registry is None:
        return found.withColumn("ordinal", F.row_number().over(by_bucket.orderBy(key)).cast("long") - 1)
    known = registry.select(key, F.col("ordinal").alias("_known"))
    both = found.withColumn("_seen", F.lit(True)).join(known, key, "full_outer").withColumn(
        "bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    )
    rank = F.row_number().over(Window.partitionBy("bucket", F.col("_known").isNull()).orderBy(key))
    last = F.coalesce(F.max("_known").over(by_bucket), F.lit(-1))
    ordinal = F.coalesce(F.col("_known"), last + rank).cast("long")
    return both.withColumn("ordinal", ordinal).drop("_known", "_seen")


def extend_registry(keys: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored registry at `path` after new keys of a delivery were added, as its next version; made where there is none.

    Keys keep bucket and ordinal for ever. Repeated keys count once, null ones not at all.
    """
    spark, found = keys.sparkSession, keys.select(key).where(F.col(key).isNotNull()).distinct()
    known = current(spark, path)
    if known is not None:
        found = found.join(known.select(key), key, "left_anti").unionByName(known.select(key))
    commit(assign_ordinals(found, key, known, buckets).select(key, "bucket", "ordinal"), path)
    return current(spark, path)


def latest_rows(df: DataFrame, seq: str, key: str, values: list[str], order: str) -> DataFrame:
    """One row per (seq, key): the one with the greatest `order`, nulls last; of equals the one with greater values.

    The aggregate combines before the shuffle, so that a row delivered a million times costs no more than one.
    """
    packed = F.struct(*[F.col(v) for v in values])
    rank = F.struct(F.col(order).isNotNull(), F.col(order), packed)
    return (
        df.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
        .groupBy(seq, key)
        .agg(F.max(rank).alias("_top"))
        .select(seq, key, F.col("_top.col3").alias("vals"))
    )


def _differs(now: Column, before: Column, values: list[str]) -> Column:
    """Whether any value is present on both sides and differs."""
    each = [F.coalesce(now[v] != before[v], F.lit(False)) for v in values]
    return reduce(lambda a, b: a | b, each)


def snapshot_changes(
    deliveries: DataFrame,
    seq: str,
    key: str,
    values: list[str],
    order: str,
    registry: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(seq, key, change_kind) with `added`, `removed` or `changed`, each delivery against the next lower existing one.

    deliveries: rows of all deliveries, one `seq` per delivery, values already in comparable form. Rows without key or
    seq are ignored. Null values never differ. The first delivery has no changes; an empty input has none either.
    Other columns are ignored, whatever their names.
    """
    # names of our own, so that columns of any name can be compared
    names = [f"v{i}" for i in range(len(values))]
    mine = deliveries.select(
        F.col(seq).alias("q"), F.col(key).alias("k"), F.col(order).alias("o"), *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)]
    )
    if registry is not None:
        registry = registry.withColumnRenamed(key, "k")
    changes = _changes(mine, names, registry, buckets)
    return changes.select(F.col("q").alias(seq), F.col("k").alias(key), "change_kind")


def _changes(deliveries: DataFrame, values: list[str], registry: DataFrame | None, buckets: int) -> DataFrame:
    seq, key = "q", "k"
    rows = latest_rows(deliveries, seq, key, values, "o")
    # one row per key: its states in all deliveries, at most as many as there are deliveries
    states = rows.groupBy(key).agg(F.collect_list(F.struct("q", "vals")).alias("_states"))
    placed = assign_ordinals(states, key, registry, buckets)
    word = F.shiftright("ordinal", 6)
    bit = F.col("ordinal").bitwiseAND(F.lit(63)).cast("int")
    words = (
        placed.where(F.col("_states").isNotNull())
        .select("bucket", word.alias("word"), bit.alias("bit"), key, F.inline("_states"))
        .groupBy("bucket", "word", "q")
        .agg(
            F.expr("bit_or(shiftleft(1L, bit))").alias("bits"),
            # the aligned vector: sorted by bit, one entry per set bit
            F.sort_array(F.collect_list(F.struct("bit", "k", "vals"))).alias("vec"),
        )
    )
    # the deliveries that exist: one array, as long as their number, which every task sees as a literal
    series = deliveries.where(F.col(seq).isNotNull()).agg(F.sort_array(F.collect_set(seq)))
    chunks = words.groupBy("bucket", "word").agg(
        F.map_from_entries(F.collect_list(F.struct("q", F.struct("bits", "vec")))).alias("by_q")
    )
    grid = chunks.withColumn("all_q", series.scalar())
    empty_vec = F.filter(F.map_values("by_q")[0]["vec"], lambda _: F.lit(False))
    pairs = grid.select(
        "by_q",
        empty_vec.alias("none"),
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.size("all_q"), F.lit(2))),
                lambda i: F.struct(
                    F.element_at("all_q", i - 1).alias("before_q"), F.try_element_at("all_q", i).alias("now_q")
                ),
            )
        ).alias("p"),
    ).where(F.col("p.now_q").isNotNull())
    now = F.try_element_at(F.col("by_q"), F.col("p.now_q"))
    before = F.try_element_at(F.col("by_q"), F.col("p.before_q"))
    sides = pairs.select(
        F.col("p.now_q").alias(seq),
        F.coalesce(now["bits"], F.lit(0).cast("long")).alias("b1"),
        F.coalesce(before["bits"], F.lit(0).cast("long")).alias("b0"),
        F.coalesce(now["vec"], F.col("none")).alias("v1"),
        F.coalesce(before["vec"], F.col("none")).alias("v0"),
    ).select(
        seq, "b0", "b1", "v0", "v1",
        F.expr("b1 & ~b0").alias("plus"), F.expr("b0 & ~b1").alias("minus"), F.expr("b1 & b0").alias("both"),
    )

    def has(mask: str, x: Column) -> Column:
        return F.getbit(F.col(mask), x["bit"]) == 1

    def at(bits: str, vec: str, x: Column) -> Column:
        """The entry of the other vector for the same ordinal: its place is the number of set bits below."""
        below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), x["bit"]))
        return F.element_at(F.col(vec), F.bit_count(F.col(bits).bitwiseAND(below)) + 1)

    added = F.transform(
        F.filter("v1", lambda x: has("plus", x)), lambda x: F.struct(x["k"].alias("k"), F.lit("added").alias("change_kind"))
    )
    removed = F.transform(
        F.filter("v0", lambda x: has("minus", x)),
        lambda x: F.struct(x["k"].alias("k"), F.lit("removed").alias("change_kind")),
    )
    changed = F.transform(
        F.filter("v1", lambda x: F.when(has("both", x), _differs(x["vals"], at("b0", "v0", x)["vals"], values)).otherwise(False)),
        lambda x: F.struct(x["k"].alias("k"), F.lit("changed").alias("change_kind")),
    )
    return sides.select(seq, F.inline(F.concat(added, removed, changed)))
