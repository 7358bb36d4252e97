"""Snapshot changes (problem 1) and orphan references (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.notation import (
    checksum_value, date_value, instant_micros, ntz_micros, stripped, uuid_key,
)
from lexspark.operators.orphans import current_references, open_by_batch, orphan_cases, orphan_counts, replay
from lexspark.operators.snapshots import extend_registry, snapshot_changes
from lexspark.session import workspace
from lexspark.sources.tables import table

#: The number of the current list as one more delivery.
CURRENT = 13


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "law_versions").select(
        F.col("snap_no").cast("long").alias("snap_no"),
        stripped(F.col("law_key")).alias("law_key"),
        checksum_value(F.col("checksum")).alias("checksum"),
        date_value(F.col("last_changed")).alias("last_changed"),
        ntz_micros(F.col("checked_at")).alias("seen_at"),
    )
    current = table(spark, d, "laws").select(
        F.lit(CURRENT).cast("long").alias("snap_no"),
        stripped(F.col("law_key")).alias("law_key"),
        F.lit(None).cast("string").alias("checksum"),
        date_value(F.col("last_changed")).alias("last_changed"),
        ntz_micros(F.col("loaded_at")).alias("seen_at"),
    )
    return versions.unionByName(current)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes from each delivery to the next. The registry of ordinals is a stored table: the full deliveries make it, and the
    current list, which comes later, finds its keys there and adds new ones."""
    all_of = _deliveries(spark, d)
    path = workspace(spark, "law-ordinals")
    for part in (F.col("snap_no") != CURRENT, F.col("snap_no") == CURRENT):
        registry = extend_registry(all_of.where(part).select("law_key"), "law_key", path)
    return snapshot_changes(all_of, "snap_no", "law_key", ["checksum", "last_changed"], "seen_at", registry)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Additions, removals and changes per delivery."""
    return p1_found(spark, d).groupBy("snap_no", "change_kind").agg(F.count(F.lit(1)).alias("laws"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    norms, marks = table(spark, d, "norms"), table(spark, d, "bookmarks")
    at = instant_micros(F.col("added_at"))

    def refs(df: DataFrame, name: str, field: str, target: str, src_id, key, when) -> DataFrame:
        return df.select(
            F.lit(name).alias("src_table"), src_id.alias("src_id"), F.lit(field).alias("ref_field"),
            F.lit(target).alias("target"), key.alias("key"), when.alias("ref_at"),
        )

    mark_id = uuid_key(F.col("id"))
    return (
        refs(norms, "norms", "law_id", "law_id", F.col("id").cast("string"), F.col("law_id").cast("string"), ntz_micros(F.col("loaded_at")))
        .unionByName(refs(marks, "bookmarks", "law_key", "law_key", mark_id, stripped(F.col("law_key")), at))
        .unionByName(refs(marks, "bookmarks", "folder_id", "folder_id", mark_id, uuid_key(F.col("folder_id")), at))
    )


def _parent_events(spark: SparkSession, d: str) -> DataFrame:
    laws, folders = table(spark, d, "laws"), table(spark, d, "folders")
    none = F.lit(None).cast("long")

    def events(df: DataFrame, target: str, key, first, gone) -> DataFrame:
        return df.select(F.lit(target).alias("target"), key.alias("key"), first.alias("first_at"), gone.alias("deleted_at"))

    loaded = ntz_micros(F.col("loaded_at"))
    return (
        events(laws, "law_id", F.col("id").cast("string"), loaded, none)
        .unionByName(events(laws, "law_key", stripped(F.col("law_key")), loaded, none))
        .unionByName(events(folders, "folder_id", uuid_key(F.col("id")), ntz_micros(F.col("created_at")), ntz_micros(F.col("deleted_at"))))
    )


def _quarter(at: str):
    """The quarter of a time in microseconds as a number."""
    day = F.timestamp_micros(F.col(at))
    return F.year(day) * 4 + F.quarter(day) - 1


def _orphan_log(spark: SparkSession, d: str) -> DataFrame:
    """The history in batches by quarter of the referring rows, with the logs written between them. A row of a folder that is
    deleted comes twice: when the folder arrived, and when it was deleted."""
    events = _parent_events(spark, d)
    arrived = events.withColumn("deleted_at", F.lit(None).cast("long")).withColumn("at", F.col("first_at"))
    gone = events.where(F.col("deleted_at").isNotNull()).withColumn("at", F.greatest("first_at", "deleted_at"))
    return replay(_references(spark, d), arrived.unionByName(gone), _quarter("ref_at"), _quarter("at"), workspace(spark, "orphans"))


def _orphan_state(spark: SparkSession, d: str) -> DataFrame:
    return current_references(_orphan_log(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_cases(_orphan_state(spark, d)).select("src_table", "src_id", "ref_field")


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Cases per table, field and month of the referring row; null month: time unknown."""
    return orphan_counts(_orphan_state(spark, d))


def p5_open(spark: SparkSession, d: str) -> DataFrame:
    """References that are orphans at the end of each batch in which any was opened or closed, by table and field."""
    return open_by_batch(_orphan_log(spark, d)).where((F.col("opened") > 0) | (F.col("closed") > 0)).select(
        F.col("batch").cast("long").alias("batch"), "src_table", "ref_field", "open"
    )


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p5_found": p5_found, "p5_by_month": p5_by_month, "p5_open": p5_open}

_TRIM = r"regexp_replace({}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return f"nullif({_TRIM.format(c)}, '')"


def _date(c: str) -> str:
    t = _trim(c)
    return (
        f"coalesce(try_strptime(regexp_extract({t}, '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})($|[T ])', 1), '%Y-%m-%d'), "
        f"try_strptime(regexp_extract({t}, '^(\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}})($|\\s)', 1), '%d.%m.%Y'), "
        f"try_strptime(regexp_extract({t}, '^(\\d{{8}})$', 1), '%Y%m%d'))"
    )


_CHANGES = f"""
WITH v AS (
  SELECT snap_no::BIGINT AS q, {_trim('law_key')} AS k,
         nullif(regexp_replace(lower({_trim('checksum')}), '^[a-z0-9_-]+:\\s*', ''), '') AS c,
         {_date('last_changed')} AS l, checked_at AS t FROM law_versions
  UNION ALL
  SELECT {CURRENT}, {_trim('law_key')}, NULL, {_date('last_changed')}, loaded_at FROM laws),
r AS (SELECT * FROM v WHERE k IS NOT NULL AND q IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY q, k ORDER BY t DESC NULLS LAST, c DESC NULLS LAST, l DESC NULLS LAST) = 1),
s AS (SELECT q, lag(q) OVER (ORDER BY q) AS p FROM (SELECT DISTINCT q FROM r)),
f AS (
  SELECT n.q AS snap_no, n.k AS law_key, CASE WHEN o.k IS NULL THEN 'added' ELSE 'changed' END AS change_kind
  FROM r n JOIN s ON s.q = n.q AND s.p IS NOT NULL LEFT JOIN r o ON o.q = s.p AND o.k = n.k
  WHERE o.k IS NULL OR n.c <> o.c OR n.l <> o.l
  UNION ALL
  SELECT s.q, o.k, 'removed' FROM r o JOIN s ON s.p = o.q LEFT JOIN r n ON n.q = s.q AND n.k = o.k WHERE n.k IS NULL)
"""

_AT = f"""CASE WHEN regexp_full_match({_trim('added_at')}, '\\d+') THEN make_timestamp(try_cast({_trim('added_at')} AS BIGINT) * 1000)
  ELSE timezone('UTC', try_cast(CASE WHEN regexp_matches({_trim('added_at')}, '(Z|[+-]\\d\\d(:?\\d\\d)?)$') AND length({_trim('added_at')}) > 10
    THEN {_trim('added_at')} ELSE {_trim('added_at')} || 'Z' END AS TIMESTAMPTZ)) END"""

_ORPHANS = f"""
WITH l AS (SELECT id::VARCHAR AS i, {_trim('law_key')} AS k, loaded_at AS t FROM laws),
p AS (
  SELECT 'law_id' AS f, i AS k, min(t) AS t, false AS gone FROM l GROUP BY i
  UNION ALL SELECT 'law_key', k, min(t), false FROM l WHERE k IS NOT NULL GROUP BY k
  UNION ALL SELECT 'folder_id', lower({_trim('id')}), min(created_at), max(deleted_at) IS NOT NULL FROM folders GROUP BY 2),
b AS (SELECT lower({_trim('id')}) AS i, {_trim('law_key')} AS lk, lower({_trim('folder_id')}) AS fo, {_AT} AS t FROM bookmarks),
r AS (
  SELECT 'norms' AS src_table, id::VARCHAR AS src_id, 'law_id' AS ref_field, law_id::VARCHAR AS k, loaded_at AS t FROM norms
  UNION ALL SELECT 'bookmarks', i, 'law_key', lk, t FROM b
  UNION ALL SELECT 'bookmarks', i, 'folder_id', fo, t FROM b),
d AS (SELECT src_table, src_id, ref_field, k, min(t) AS t FROM r WHERE k IS NOT NULL GROUP BY ALL),
f AS (SELECT d.*, p.k IS NULL OR p.gone AS still_open FROM d LEFT JOIN p ON p.f = d.ref_field AND p.k = d.k
      WHERE p.k IS NULL OR p.gone OR p.t > d.t)
"""

_Q = "(year({0}) * 4 + quarter({0}) - 1)"
_OPEN = _ORPHANS + f""", x AS (SELECT *, {_Q.format('t')} AS q FROM r WHERE k IS NOT NULL),
g AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS n FROM (SELECT DISTINCT q FROM x WHERE q IS NOT NULL)),
y AS (SELECT src_table, src_id, ref_field, k, min(coalesce((SELECT count(*) FROM g WHERE g.q < x.q), 0)) AS rb FROM x GROUP BY ALL),
e AS (SELECT f, k, min(ab) AS ab, min(db) AS db FROM (
  SELECT f, k, (SELECT count(*) FROM g WHERE g.q < {_Q.format('t')}) AS ab, NULL AS db FROM p
  UNION ALL SELECT 'folder_id', lower({_trim('id')}), NULL, (SELECT count(*) FROM g WHERE g.q < {_Q.format('greatest(created_at, deleted_at)')}) FROM folders WHERE deleted_at IS NOT NULL) GROUP BY ALL),
z AS (SELECT y.*, b.n, ab IS NULL OR ab > b.n OR coalesce(db <= b.n, false) AS open FROM y JOIN (SELECT unnest(range((SELECT count(*) + 1 FROM g))) AS n) b ON b.n >= rb
  LEFT JOIN e ON e.f = y.ref_field AND e.k = y.k),
c AS (SELECT *, coalesce(lag(open) OVER (PARTITION BY src_table, src_id, ref_field, k ORDER BY n), false) AS before FROM z),
h AS (SELECT n, src_table, ref_field, count(*) FILTER (open AND NOT before) AS o, count(*) FILTER (before AND NOT open) AS s FROM c GROUP BY ALL)
SELECT n AS batch, src_table, ref_field, open::BIGINT AS open FROM (SELECT *, sum(o - s) OVER (PARTITION BY src_table, ref_field ORDER BY n) AS open FROM h) WHERE o > 0 OR s > 0"""

SQL = {
    "p5_open": _OPEN,
    "p1_found": _CHANGES + "SELECT snap_no, law_key, change_kind FROM f",
    "p1_counts": _CHANGES + "SELECT snap_no, change_kind, count(*) AS laws FROM f GROUP BY ALL",
    "p5_found": _ORPHANS + "SELECT src_table, src_id, ref_field FROM f",
    "p5_by_month": _ORPHANS + "SELECT src_table, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS cases, "
    "sum(still_open::INT)::BIGINT AS still_open FROM f GROUP BY ALL",
}
