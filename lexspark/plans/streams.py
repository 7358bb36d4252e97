"""Windows over the log of events, as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.notation import ntz_micros
from lexspark.sources.tables import table
from lexspark.streaming.windows import anchored_windows, debounced, fifo_hits, fixed_windows

HOUR, DAY = 3_600_000_000, 86_400_000_000


def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Requests per user and day, and those over a limit of 3."""
    return fixed_windows(table(spark, d, "events"), "user_id", "ts", "1 day", 3)


def rate_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that open with a user's first request: requests in each and those over the limit of 3."""
    w = anchored_windows(table(spark, d, "events"), "user_id", ntz_micros(F.col("ts")), "event_id", DAY)
    return w.groupBy(F.col("client").alias("user_id"), "opened").agg(
        F.count(F.lit(1)).alias("requests"), F.sum((F.col("number") > 3).cast("long")).alias("refused")
    )


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Events by type that an answer kept for an hour would serve: all but the first of each window."""
    w = anchored_windows(table(spark, d, "events"), "event_type", ntz_micros(F.col("ts")), "event_id", HOUR)
    return w.groupBy(F.col("client").alias("event_type")).agg(
        F.count(F.lit(1)).alias("events"), F.sum((F.col("number") > 1).cast("long")).alias("hits")
    )


def debounce(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each burst of a user, with a gap of 6 hours."""
    return debounced(table(spark, d, "events"), "user_id", "ts", 6 * HOUR)


def answer_cache(spark: SparkSession, d: str) -> DataFrame:
    """Events by type that a cache of 500 answers, kept for an hour, would serve; each user has a cache and asks for the types."""
    hits = fifo_hits(table(spark, d, "events"), "user_id", ntz_micros(F.col("ts")), "event_id", "event_type", HOUR, 500)
    types = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return hits.join(types, "id").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if("hit").alias("hits"))


QUERIES = {"answer_cache": answer_cache, "rate_windows": rate_windows, "rate_anchor": rate_anchor, "cache_hits": cache_hits, "debounce": debounce}


def _anchored(key: str, width: int) -> str:
    """Chains of windows: from each window's first event to the first one after its end."""
    return f"""e AS (SELECT {key} AS k, epoch_us(ts) AS t FROM events),
t AS (SELECT DISTINCT k, t FROM e), nx AS MATERIALIZED (SELECT a.k, a.t, b.t AS n FROM (SELECT k, t, t + {width} AS u FROM t) a ASOF LEFT JOIN t b ON a.k = b.k AND a.u <= b.t),
r AS (SELECT k, min(t) AS t FROM t GROUP BY 1 UNION ALL SELECT nx.k, nx.n FROM r JOIN nx ON r.k = nx.k AND r.t = nx.t WHERE nx.n IS NOT NULL),
o AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS u FROM r),
w AS (SELECT e.k, o.t AS opened, count(*) AS n FROM e JOIN o ON e.k = o.k AND e.t >= o.t AND (o.u IS NULL OR e.t < o.u) GROUP BY ALL)"""


SQL = {
    # with fewer keys than places nothing is pushed out: windows of an hour by user and type, whose border still counts
    "answer_cache": f"""WITH RECURSIVE {_anchored("user_id || '-' || event_type", HOUR + 1)} SELECT string_split(k, '-')[2] AS event_type, sum(n)::BIGINT AS events, sum(n - 1)::BIGINT AS hits FROM w GROUP BY 1""",
    "rate_windows": """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS requests, least(count(*), 3) AS allowed,
  greatest(count(*) - 3, 0) AS refused FROM events GROUP BY ALL""",
    "rate_anchor": f"WITH RECURSIVE {_anchored('user_id', DAY)} SELECT k AS user_id, opened, n AS requests, greatest(n - 3, 0) AS refused FROM w",
    "cache_hits": f"WITH RECURSIVE {_anchored('event_type', HOUR)} SELECT k AS event_type, sum(n)::BIGINT AS events, sum(n - 1)::BIGINT AS hits FROM w GROUP BY 1",
    "debounce": """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, max(ts) AS at, count(*) AS events FROM s GROUP BY user_id, s""",
}
