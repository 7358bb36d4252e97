"""Keyed state as plain tables: merges, patches, deletions, views by owner, pages.

A merge is an anti-join and a union, which any file format can hold. A stored table is a folder of versions: `commit` writes
a new one beside those that are there and completes it with a mark, `current` reads the newest complete one. Nothing is
renamed, so that at every moment, also after a crash at any point, a complete version can be read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null."""
    right = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return a.join(right, on, how)


def unique(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") == 1).drop("_n")


def upsert(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """`fresh`, and the rows of `old` whose key it does not have. Each side has a key at most once; null keys are keys."""
    return _null_safe(old, fresh, keys, "left_anti").unionByName(fresh)


def insert_ignore(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """`old`, and the rows of `fresh` whose key it does not have."""
    return old.unionByName(_null_safe(fresh, old, keys, "left_anti"))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """`old` without the keys of `gone`."""
    return _null_safe(old, gone, keys, "left_anti")


def patch(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`old` with the columns that a change names. changes: key, fields array<string>, and the columns; a field that is
    named is set even to null, one that is not named stays."""
    new = changes.select(key, "fields", *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(new, key, "left")
    named = lambda c: F.coalesce(F.array_contains("fields", c), F.lit(False))
    return joined.withColumns({c: F.when(named(c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop(
        "fields", *[f"_new_{c}" for c in columns]
    )


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children after the deletion of the parents in `gone`; children without a parent key stay."""
    left = parents.join(gone.select(key).distinct(), key, "left_anti")
    dead = gone.select(F.col(key).alias(foreign)).distinct()
    return left, children.join(dead, foreign, "left_anti")


def owned(df: DataFrame, owner: str, who: str) -> DataFrame:
    """The rows of one owner."""
    return df.where(F.col(owner) == who)


def owned_children(children: DataFrame, parents: DataFrame, foreign: str, key: str, owner: str, who: str) -> DataFrame:
    """Children of the parents of one owner."""
    mine = owned(parents, owner, who).select(F.col(key).alias(foreign)).distinct()
    return children.join(mine, foreign, "left_semi")


def nested(parents: DataFrame, children: DataFrame, key: str, foreign: str, order: Column, fields: list[str], name: str) -> DataFrame:
    """Parents with an array of their children in order; an empty one where there are none.

    Children are gathered per parent, in an array as long as the parent has children.
    """
    packed = F.sort_array(F.collect_list(F.struct(order.alias("_o"), *fields)))
    slim = F.transform(packed, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    grouped = children.groupBy(F.col(foreign).alias(key)).agg(slim.alias(name))
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array()))


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page `number` from 1; numbers outside 1..500 are the first page, sizes are kept within 1..1000."""
    number = number if 1 <= number <= 500 else 1
    size = min(max(size, 1), 1000)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


_MARK = "_COMPLETE"


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int], list[int]]:
    """(file system, complete versions, others) of the stored table at `path`, ascending."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done, rest = [], []
    if fs.exists(root):
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("v") and name[1:].isdigit():
                (done if fs.exists(hadoop(f"{path}/{name}/{_MARK}")) else rest).append(int(name[1:]))
    return fs, sorted(done), sorted(rest)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of the stored table at `path`; None where there is none."""
    done = _versions(spark, path)[1]
    return spark.read.parquet(f"{path}/v{done[-1]}") if done else None


def commit(df: DataFrame, path: str, keys: list[str] | None = None, kept: int = 2) -> int:
    """Write `df`, which may read from the stored table at `path`, as its next version; the number of rows.

    With `keys` a table in which rows share their keys (nulls are equal) is refused before anything is written. The rows
    that can be read back are counted before the version is completed. A reader sees the old version or the new one; the
    last `kept` complete ones stay for readers that have begun, older ones and those a crash has left are deleted. Of two
    writers at a time one fails, as both write the same version.
    """
    spark: SparkSession = df.sparkSession
    if keys and not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows share their keys {keys}")
    fs, done, rest = _versions(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here = f"{path}/v{max([0, *done, *rest]) + 1}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(here)
    n = spark.read.schema(df.schema).parquet(here).count()
    if seen.get["n"] != n:
        raise RuntimeError(f"{seen.get['n']} rows were written to {here}, {n} can be read")
    fs.create(hadoop(f"{here}/{_MARK}"), False).close()
    for v in [*done[: len(done) + 1 - kept], *rest]:
        fs.delete(hadoop(f"{path}/v{v}"), True)
    return n


def deleted(df: DataFrame, path: str, gone: Column) -> int:
    """Delete the rows of the stored table for which `gone` is true; how many they were. Rows for which it is null stay."""
    before = df.count()
    return before - commit(df.where(~F.coalesce(gone, F.lit(False))), path)


def write_points(df: DataFrame, path: str, id_: str, parts: int = 64) -> list[int]:
    """Write `df` in `parts` parts by the hash of the id, each a stored table of its own; the numbers of those written.

    A part that is there with at least as many rows as it needs is left as it is, so that a run that broke off goes on
    where it was, and a second run writes nothing.
    """
    part = F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int")
    one = df.dropDuplicates([id_]).withColumn("_part", part)
    needed = {r["_part"]: r["count"] for r in one.groupBy("_part").count().collect()}  # at most `parts` rows
    done = []
    for k, n in sorted(needed.items()):
        there = current(df.sparkSession, f"{path}/part{k}")
        if there is None or there.count() < n:
            commit(one.where(F.col("_part") == k).drop("_part"), f"{path}/part{k}")
            done.append(k)
    return done


def points(spark: SparkSession, path: str, parts: int = 64) -> DataFrame | None:
    """All parts that `write_points` has completed."""
    found = [t for k in range(parts) if (t := current(spark, f"{path}/part{k}")) is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def touched(fresh: DataFrame, at: Column, column: str = "updated_at") -> DataFrame:
    """`fresh` with the time of its merge."""
    return fresh.withColumn(column, at)


def append_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, foreign: str, key: str, order: list[Column], number: str) -> DataFrame:
    """`children` and those of `fresh` whose parent exists, numbered after the ones that their parent has."""
    have = children.groupBy(foreign).agg(F.max(number).alias("_last"))
    known = fresh.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi").join(have, foreign, "left")
    place = F.row_number().over(Window.partitionBy(foreign).orderBy(*order)) + F.coalesce("_last", F.lit(0))
    return children.unionByName(known.withColumn(number, place.cast("long")).drop("_last"))


def only(df: DataFrame) -> Row | None:
    """The row of a table of one row, None for none; more than one is an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0] if rows else None


def page_count(df: DataFrame, size: int = 50) -> DataFrame:
    """(total, pages): the exact number of rows and how many pages of `size` they fill."""
    size = min(max(size, 1), 1000)
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def visible(df: DataFrame, policy: str, owner: str | None = None, who: str | None = None) -> DataFrame:
    """Rows that a reader may see: all of a `public` table, none of a `denied` one, those of `who` in an `owner` one."""
    if policy == "public":
        return df
    if policy == "denied":
        return df.where(F.lit(False))
    if policy == "owner" and owner is not None:
        return owned(df, owner, who)
    raise ValueError(f"unknown policy {policy}")


def lookup(requests: DataFrame, cache: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`requests` with `column` of the cache and `hit`; a null key is a miss. The cache has each key at most once."""
    found = cache.select(*keys, column, F.lit(True).alias("hit"))
    return requests.join(found, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def validated_cache(rows: DataFrame, cache: DataFrame, keys: list[str], digest: str, column: str) -> DataFrame:
    """`rows` with `column` and `state`: `hit` where the cache has the keys with the same digest, `stale` with another one, else
    `miss`. Only hits have a value. The cache has each key at most once."""
    found = cache.select(*keys, F.col(digest).alias("_digest"), F.col(column).alias("_value"), F.lit(True).alias("_there"))
    same = F.coalesce(F.col("_digest") == F.col(digest), F.lit(False))
    state = F.when(F.col("_there").isNull(), "miss").when(same, "hit").otherwise("stale")
    joined = rows.join(found, keys, "left").withColumns({"state": state, column: F.when(same, F.col("_value"))})
    return joined.drop("_digest", "_value", "_there")


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """`df` with the given values where a column is null or blank, or not there at all."""
    blank = lambda c: F.trim(F.col(c).cast("string")) == ""
    return df.withColumns({c: F.when(F.col(c).isNull() | blank(c), v).otherwise(F.col(c)) if c in df.columns else v for c, v in defaults.items()})
