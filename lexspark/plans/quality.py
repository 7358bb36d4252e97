"""Corpus and vector diagnostics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.notation import date_value, instant_micros, stripped
from lexspark.functions.text import word_count
from lexspark.functions.vectors import is_vector
from lexspark.operators import quality as Q
from lexspark.plans.common import CORPUS, DIM, LAWS, corpus, current_laws, trim, usable
from lexspark.plans.upkeep import _AT, _date
from lexspark.sources.tables import table


def empty_by_law(spark: SparkSession, d: str) -> DataFrame:
    """The 20 laws with the largest share of empty norms."""
    return Q.empty_share(corpus(spark, d).where(F.col("law_key").isNotNull()), "law_key", "content")


def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Q.length_histogram(table(spark, d, "norms"), "content")


def category_share(spark: SparkSession, d: str) -> DataFrame:
    """Norms by category of their law."""
    c = corpus(spark, d).withColumn("category", F.coalesce(F.lower(stripped(F.col("category"))), F.lit("other")))
    return Q.shares(c, "category")


def other_average(spark: SparkSession, d: str) -> DataFrame:
    """Laws without category: how many, and norms for each on average."""
    other = corpus(spark, d).where(stripped(F.col("category")).isNull() & F.col("law_id").isNotNull())
    return other.agg(
        F.count_distinct("law_id").alias("laws"), F.count(F.lit(1)).alias("norms"),
        F.round(F.try_divide(F.count(F.lit(1)), F.count_distinct("law_id")), 6).alias("norms_per_law"),
    )


def short_content_top(spark: SparkSession, d: str) -> DataFrame:
    """The 20 laws with the most norms of at most 80 characters."""
    short = corpus(spark, d).where((F.length(F.coalesce("content", F.lit(""))) <= 80) & F.col("law_key").isNotNull())
    return short.groupBy("law_key").agg(F.count(F.lit(1)).alias("norms")).orderBy(F.col("norms").desc(), "law_key").limit(20)


def category_listing(spark: SparkSession, d: str) -> DataFrame:
    """Laws per category, with the first key and the last."""
    laws = current_laws(spark, d).where(F.col("law_key").isNotNull())
    return laws.groupBy(F.coalesce(F.lower(stripped(F.col("category"))), F.lit("other")).alias("category")).agg(
        F.count_distinct("law_key").alias("laws"), F.min("law_key").alias("first"), F.max("law_key").alias("last")
    )


def coverage_missing(spark: SparkSession, d: str) -> DataFrame:
    """Laws that bookmarks name or the list has, but that have no norm."""
    laws = current_laws(spark, d).where(F.col("law_key").isNotNull())
    named = table(spark, d, "bookmarks").select(stripped(F.col("law_key")).alias("law_key")).where(F.col("law_key").isNotNull())
    wanted = named.union(laws.select("law_key")).distinct()
    there = laws.join(table(spark, d, "norms").select("law_id"), "law_id", "left_semi").select("law_key")
    return wanted.join(there, "law_key", "left_anti")


def stale_counts(spark: SparkSession, d: str) -> DataFrame:
    """Laws whose stated number of norms is not the actual one."""
    actual = table(spark, d, "norms").where(F.col("law_id").isNotNull()).groupBy("law_id").agg(F.count(F.lit(1)).alias("actual"))
    both = current_laws(spark, d).join(actual, "law_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where(~F.col("total_norms").eqNullSafe(F.col("actual"))).select("law_id", F.col("total_norms").cast("long").alias("stated"), "actual")


def token_drift(spark: SparkSession, d: str) -> DataFrame:
    """Norms by how their stated token count compares with their words."""
    words, stated = word_count(F.col("content")), F.col("token_count")
    kind = F.when(stated.isNull(), "absent").when(stated == 0, "zero").when(stated == words, "equal").when(stated < words, "low").otherwise("high")
    return table(spark, d, "norms").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("norms"), F.sum(words).alias("words"))


def folder_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each folder's fields, in order, comma-separated; only folders with faults."""
    bad_date = lambda c: stripped(F.col(c)).isNotNull() & date_value(F.col(c)).isNull()
    rules = {
        "id": ~F.coalesce(F.col("id").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False)),
        "incident_date": bad_date("incident_date"), "deadline_date": bad_date("deadline_date"),
        "dispute_value": F.coalesce(F.isnan("dispute_value") | (F.col("dispute_value") < 0), F.lit(False)),
        "name": stripped(F.col("name")).isNull() | (F.length("name") > 200),
        "deleted_at": F.coalesce(F.col("deleted_at") < F.col("created_at"), F.lit(False)),
    }
    faults = F.concat_ws(",", *[F.when(rule, name) for name, rule in rules.items()])
    return table(spark, d, "folders").select("id", faults.alias("faults")).where(F.col("faults") != "").distinct()


def added_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks per day in UTC, however the time is written."""
    micros = instant_micros(F.col("added_at"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int"))
    return table(spark, d, "bookmarks").distinct().groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("bookmarks"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


def intra_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Of the 50 lowest ids of each label; `label_cosines` has all pairs and a sample by hash."""
    return Q.sampled_cosines(_vectors(spark, d), "label")


def label_cosines(spark: SparkSession, d: str) -> DataFrame:
    return Q.label_cosines(_vectors(spark, d), "label")


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return Q.mean_cosines(_vectors(spark, d), "label")


def inter_cosine(spark: SparkSession, d: str) -> DataFrame:
    return Q.cross_cosines(_vectors(spark, d), "label")


def centred_cosine(spark: SparkSession, d: str) -> DataFrame:
    return Q.centred_cosines(_vectors(spark, d), "label")


def vector_faults(spark: SparkSession, d: str) -> DataFrame:
    """Norms by state of their vector."""
    v = F.col("embedding")
    state = F.when(v.isNull(), "absent").when(F.size(v) != DIM, "size").when(is_vector(v, DIM), "usable").otherwise("values")
    return table(spark, d, "norms").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("norms"))


def health(spark: SparkSession, d: str) -> DataFrame:
    """The worst status over checks of the tables."""
    def check(name: str, ok, bad: str) -> DataFrame:
        return table(spark, d, name).agg(F.when(ok, "ok").otherwise(bad).alias("status")).select(F.lit(name).alias("table"), "status")

    some = F.count(F.lit(1)) > 0
    checks = (
        check("laws", some & (F.count("id") == F.count(F.lit(1))), "error")
        .unionByName(check("norms", F.count("law_id") == F.count(F.lit(1)), "warn"))
        .unionByName(check("messages", F.count("conversation_id") == F.count(F.lit(1)), "warn"))
        .unionByName(check("folders", some, "error"))
    )
    return Q.worst_status(checks)


QUERIES = {
    f.__name__: f
    for f in (
        empty_by_law, length_histogram, category_share, other_average, short_content_top, category_listing, coverage_missing,
        stale_counts, token_drift, folder_faults, added_by_day, intra_cosine, label_cosines, centroids, inter_cosine, centred_cosine,
        vector_faults, health,
    )
}

_EMPTY = "trim(coalesce(content, ''), ' ') IN ('-', '')"
_CATEGORY = f"coalesce(lower({trim('category')}), 'other')"
_UNIT = """u AS (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
s AS (SELECT label, pos, count(*) AS n, sum(x) AS s FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u) GROUP BY ALL)"""

SQL = {
    "empty_by_law": f"WITH {CORPUS} SELECT law_key, count(*) AS total, sum(({_EMPTY})::INT)::BIGINT AS empty, round(sum(({_EMPTY})::INT) / count(*), 6) AS share FROM c WHERE law_key IS NOT NULL GROUP BY 1 ORDER BY share DESC, total DESC, law_key LIMIT 20",
    "length_histogram": "SELECT CASE WHEN n <= 100 THEN '0-100' WHEN n <= 500 THEN '101-500' WHEN n <= 2000 THEN '501-2000' ELSE '>2000' END AS bucket, count(*) AS rows FROM (SELECT length(coalesce(content, '')) AS n FROM norms) GROUP BY 1",
    "category_share": f"WITH {CORPUS} SELECT {_CATEGORY} AS category, count(*) AS rows, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1",
    "other_average": f"WITH {CORPUS} SELECT count(DISTINCT law_id) AS laws, count(*) AS norms, round(count(*) / nullif(count(DISTINCT law_id), 0), 6) AS norms_per_law FROM c WHERE {trim('category')} IS NULL AND law_id IS NOT NULL",
    "short_content_top": f"WITH {CORPUS} SELECT law_key, count(*) AS norms FROM c WHERE length(coalesce(content, '')) <= 80 AND law_key IS NOT NULL GROUP BY 1 ORDER BY norms DESC, law_key LIMIT 20",
    "category_listing": f"WITH {LAWS} SELECT {_CATEGORY} AS category, count(DISTINCT law_key) AS laws, min(law_key) AS first, max(law_key) AS last FROM l WHERE law_key IS NOT NULL GROUP BY 1",
    "coverage_missing": f"WITH {LAWS} SELECT k AS law_key FROM (SELECT {trim('law_key')} AS k FROM bookmarks UNION SELECT law_key FROM l) WHERE k IS NOT NULL AND k NOT IN (SELECT law_key FROM l WHERE law_key IS NOT NULL AND law_id IN (SELECT law_id FROM norms))",
    "stale_counts": f"WITH {LAWS}, a AS (SELECT law_id, count(*) AS n FROM norms GROUP BY 1) SELECT law_id, total_norms::BIGINT AS stated, coalesce(n, 0) AS actual FROM l LEFT JOIN a USING (law_id) WHERE total_norms IS DISTINCT FROM coalesce(n, 0)",
    "token_drift": "SELECT CASE WHEN token_count IS NULL THEN 'absent' WHEN token_count = 0 THEN 'zero' WHEN token_count = w THEN 'equal' WHEN token_count < w THEN 'low' ELSE 'high' END AS kind, count(*) AS norms, sum(w)::BIGINT AS words FROM (SELECT token_count, len(regexp_extract_all(coalesce(content, ''), '\\S+')) AS w FROM norms) GROUP BY 1",
    "folder_faults": f"""SELECT DISTINCT id, f AS faults FROM (SELECT id, concat_ws(',', CASE WHEN NOT regexp_full_match(id, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN 'id' END,
  CASE WHEN {trim('incident_date')} IS NOT NULL AND {_date('incident_date')} IS NULL THEN 'incident_date' END, CASE WHEN {trim('deadline_date')} IS NOT NULL AND {_date('deadline_date')} IS NULL THEN 'deadline_date' END,
  CASE WHEN isnan(dispute_value) OR dispute_value < 0 THEN 'dispute_value' END, CASE WHEN {trim('name')} IS NULL OR length(name) > 200 THEN 'name' END, CASE WHEN deleted_at < created_at THEN 'deleted_at' END) AS f FROM folders) WHERE f <> ''""",
    "added_by_day": f"SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS bookmarks FROM (SELECT {_AT} AS t FROM (SELECT DISTINCT * FROM bookmarks)) GROUP BY 1",
    "intra_cosine": """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 50)
SELECT a.label, count(*) AS pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean, round(min(list_cosine_similarity(a.v, b.v)), 6) AS least, round(max(list_cosine_similarity(a.v, b.v)), 6) AS greatest
FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""",
    "centroids": f"WITH {_UNIT} SELECT label, max(n) AS n, round(sqrt(sum(s * s)) / max(n), 6) AS centroid, round((sum(s * s) - max(n)) / nullif(max(n) * (max(n) - 1), 0), 6) AS mean FROM s GROUP BY 1",
    "inter_cosine": "SELECT a.label AS a, b.label AS b, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY ALL",
    "centred_cosine": """WITH c AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1)),
e AS (SELECT label, vec_id, list_transform(list_zip(embedding::DOUBLE[], c), lambda p: p[1] - p[2]) AS v FROM embeddings, c)
SELECT a.label, (SELECT count(*) FROM e x WHERE x.label = a.label) AS n, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS mean FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""",
    "vector_faults": f"SELECT CASE WHEN embedding IS NULL THEN 'absent' WHEN len(embedding) <> 64 THEN 'size' WHEN {usable('embedding')} THEN 'usable' ELSE 'values' END AS state, count(*) AS norms FROM norms GROUP BY 1",
    "health": """WITH k AS (SELECT CASE WHEN count(*) > 0 AND count(id) = count(*) THEN 'ok' ELSE 'error' END AS s FROM laws UNION ALL SELECT CASE WHEN count(law_id) = count(*) THEN 'ok' ELSE 'warn' END FROM norms
UNION ALL SELECT CASE WHEN count(conversation_id) = count(*) THEN 'ok' ELSE 'warn' END FROM messages UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'error' END FROM folders)
SELECT arg_min(s, list_position(['error', 'warn', 'ok'], s)) AS worst, sum((s <> 'ok')::INT)::BIGINT AS failed FROM k""",
}
