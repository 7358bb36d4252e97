"""References to records that do not exist, as keyed state that is carried from batch to batch.

The state is two logs. The parent log has a row for each key that a batch brought events of: first and last arrival,
deletion; its rows are merged by least and greatest values, so that they need no order. The reference log has a row for
each reference that a batch brought or changed, and the last one of a reference is its state. A batch brings new
references, which probe the parents, and parent events: an arrival resolves the references that wait for it, also a second
arrival after a deletion, a deletion opens them again, and an earlier arrival than known may end that a reference was
late.

A batch looks at the log by the keys of its events, in one pass over these columns, and shuffles and writes only what it
brings and what that changes. How many references are open is summed up from the changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.notation import month_of_micros
from lexspark.operators.skew import salted_left_join

REFERENCE = ("src_table", "src_id", "ref_field", "target", "key")
PARENTS = "target string, key string, first_at long, last_at long, deleted_at long"
REFERENCES = (
    "src_table string, src_id string, ref_field string, target string, key string, ref_at long, first_at long, "
    "was_deleted boolean, open boolean, resolved_at long, batch int"
)
FEW = 200_000  # most keys of a batch that are sent to all tasks; more of them are shuffled with the log
_EVER = -(2**62)  # before everything


def empty_state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(parent log, reference log) before the first batch."""
    # the limit tells the optimizer, which then plans no join with it
    return spark.createDataFrame([], PARENTS).limit(0), spark.createDataFrame([], REFERENCES).limit(0)


def parent_events(events: DataFrame) -> DataFrame:
    """Rows of the parent log from events (target, key, first_at, deleted_at), each key once.

    An arrival time that is null counts as before everything, so that a parent of unknown age makes nothing late. A row
    with a deletion says that its arrival was deleted, whatever the order of the two times.
    """
    at = F.coalesce("first_at", F.lit(_EVER))
    gone = F.when(F.col("deleted_at").isNotNull(), F.greatest(at, "deleted_at"))
    each = events.where(F.col("key").isNotNull()).select("target", "key", at.alias("first_at"), at.alias("last_at"), gone.alias("deleted_at"))
    return merged_parents(each)


def merged_parents(log: DataFrame) -> DataFrame:
    """The parents as they are: first and last arrival, last deletion."""
    return log.groupBy("target", "key").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("deleted_at").alias("deleted_at"))


def current_references(log: DataFrame) -> DataFrame:
    """The state of every reference: the earliest time of its row, and what the last batch says that the log has of it."""
    last = F.max_by(F.struct("first_at", "was_deleted", "open", "resolved_at"), "batch").alias("_last")
    each = log.groupBy(*REFERENCE).agg(F.min("ref_at").alias("ref_at"), last)
    late = F.coalesce(F.col("_last.first_at") > F.col("ref_at"), F.lit(False))
    return each.select(*REFERENCE, "ref_at", late.alias("was_late"), "_last.was_deleted", "_last.open", "_last.resolved_at")


def changes(parents: DataFrame, log: DataFrame, references: DataFrame, brought: DataFrame, batch: int, salts: int = 8, few: bool = False) -> DataFrame:
    """What a batch appends to the reference log: the references that it brings and those of the keys of `brought`, the rows
    that it appends to the parent log (`parent_events`). `few` says that these are few enough for all tasks.

    references: src_table, src_id, ref_field, target, key, ref_at (microseconds or null). Those with a null key are no
    references. Rows that are delivered again (same table, id, field and key), in one batch or in later ones, count once, the
    earliest `ref_at` holds. Extra columns are ignored. `batch` is greater than those before.
    """
    touched = brought.select("target", "key")
    waiting = log.join(F.broadcast(touched) if few else touched, ["target", "key"], "left_semi").select(*REFERENCE, "ref_at")
    fresh = references.where(F.col("key").isNotNull()).select(*REFERENCE, "ref_at")
    probing = waiting.unionByName(fresh).groupBy(*REFERENCE).agg(F.min("ref_at").alias("ref_at"))
    probing = probing.withColumn("probe", F.concat_ws("\x01", "target", "key"))
    # the parents of these references alone
    asked = probing.select("target", "key").distinct()
    found = merged_parents(parents.join(asked, ["target", "key"], "left_semi").unionByName(brought))
    looked = salted_left_join(
        probing, found.select(F.concat_ws("\x01", "target", "key").alias("probe"), "first_at", "last_at", "deleted_at"), "probe", "src_id", salts
    )
    missing = F.col("first_at").isNull()
    gone = F.col("deleted_at").isNotNull() & ~(F.col("last_at") > F.col("deleted_at"))
    back = F.when(F.col("deleted_at").isNotNull(), F.col("last_at")).otherwise(F.col("first_at"))
    return looked.select(
        *REFERENCE, "ref_at", "first_at",
        F.col("deleted_at").isNotNull().alias("was_deleted"),
        (missing | gone).alias("open"),
        F.when(~missing & ~gone, back).alias("resolved_at"),
        F.lit(batch).alias("batch"),
    )


def replay(references: DataFrame, events: DataFrame, period: Column, event_period: Column, path: str) -> DataFrame:
    """The reference log after all batches, one for each value of `period` that references have, in order; each batch is
    written to `path` before the next one reads it.

    Periods are numbers. An event comes with the batch of its own period, or the next one that there is; those after the last
    batch come as a batch of their own. References and events whose period is null come with the first batch. The history is
    read once and parted by period first.
    """
    spark = references.sparkSession
    sides = {"references": references.withColumn("_p", period.cast("long")), "events": events.withColumn("_p", event_period.cast("long"))}
    for name, rows in sides.items():
        rows.hint("rebalance", "_p").write.partitionBy("_p").parquet(f"{path}/{name}")
    parts = {name: spark.read.schema(rows.schema).parquet(f"{path}/{name}") for name, rows in sides.items()}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop(f"{path}/references"))
    values = [f.getPath().getName().removeprefix("_p=") for f in folders if f.getPath().getName().startswith("_p=")]
    edges = sorted(int(v) for v in values if v.lstrip("-").isdigit())

    def part(name: str, b: int) -> DataFrame:
        p = F.col("_p")
        here = F.lit(True) if b == 0 else p > edges[b - 1]
        if b < len(edges):
            here = here & (p <= edges[b])
        return parts[name].where(p.isNull() | here if b == 0 else here).drop("_p")

    parents, log = empty_state(spark)
    for b in range(len(edges) + 1):
        parent_events(part("events", b)).write.parquet(f"{path}/parents/{b}")
        brought = spark.read.schema(PARENTS).parquet(f"{path}/parents/{b}")
        changes(parents, log, part("references", b), brought, b, few=brought.count() <= FEW).write.parquet(f"{path}/log/{b}")
        parents = spark.read.schema(PARENTS).parquet(*[f"{path}/parents/{i}" for i in range(b + 1)])
        log = spark.read.schema(REFERENCES).parquet(*[f"{path}/log/{i}" for i in range(b + 1)])
    return log


def advance(parents: DataFrame, log: DataFrame, references: DataFrame, events: DataFrame, batch: int = 0) -> tuple[DataFrame, DataFrame]:
    """The (parent log, reference log) after a batch; write both between batches (tables, or session.durable)."""
    brought = parent_events(events)
    return parents.unionByName(brought), log.unionByName(changes(parents, log, references, brought, batch))


def orphan_cases(state: DataFrame) -> DataFrame:
    """References whose target is missing, deleted, or first arrived after them."""
    return state.where(F.col("was_late") | F.col("open"))


def orphan_counts(state: DataFrame) -> DataFrame:
    """Cases per table, field and month of the referring row, with those still open; null month: time unknown."""
    return (
        orphan_cases(state)
        .groupBy("src_table", "ref_field", month_of_micros(F.col("ref_at")).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("cases"),
            F.sum(F.col("open").cast("long")).alias("still_open"),
        )
    )


def open_by_batch(log: DataFrame) -> DataFrame:
    """(batch, src_table, ref_field, opened, closed, open): how many references each batch has opened and closed, and how many
    are open after it, summed up from the changes; only batches with rows in the log have any."""
    before = F.coalesce(F.lag("open").over(Window.partitionBy(*REFERENCE).orderBy("batch")), F.lit(False))
    each = log.withColumn("_before", before).groupBy("batch", "src_table", "ref_field").agg(
        F.count_if(F.col("open") & ~F.col("_before")).alias("opened"), F.count_if(~F.col("open") & F.col("_before")).alias("closed")
    )
    so_far = Window.partitionBy("src_table", "ref_field").orderBy("batch")
    return each.withColumn("open", F.sum(F.col("opened") - F.col("closed")).over(so_far))
