"""Views that several queries share, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.notation import ntz_micros, stripped
from lexspark.functions.vectors import is_vector
from lexspark.operators.skew import salted_left_join
from lexspark.sources.tables import table

DIM = 64


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that with the greatest `order`; nulls last. Of equals the one with the lowest hash of the whole row, so
    that the choice is the same in every run."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*df.columns)))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def current_laws(spark: SparkSession, d: str) -> DataFrame:
    """law_id, law_key, law_title, category, loaded: the newest row of each law."""
    rows = table(spark, d, "laws").where(F.col("id").isNotNull())
    return newest(rows, ["id"], "loaded_at").select(
        F.col("id").alias("law_id"), stripped(F.col("law_key")).alias("law_key"), F.col("title").alias("law_title"),
        "alt_title", "category", "total_norms", ntz_micros(F.col("loaded_at")).alias("loaded"),
    )


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Norms with their law: id, law_key, law_title, category, norm_id, norm_title, content, vec (null if unusable)."""
    norms = table(spark, d, "norms").select(
        "id", "law_id", stripped(F.col("norm_id")).alias("norm_id"), F.col("title").alias("norm_title"), "content",
        F.when(is_vector(F.col("embedding"), DIM), F.col("embedding")).alias("vec"),
    )
    laws = current_laws(spark, d).select("law_id", "law_key", "law_title", "category")
    return salted_left_join(norms, laws, "law_id", "id", 8)  # one law has a tenth of the norms


TRIM = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{feff}}]+|[\s\x{{00a0}}\x{{feff}}]+$', '', 'g')"


def trim(c: str) -> str:
    return f"nullif({TRIM.format(c)}, '')"


def usable(c: str) -> str:
    return (
        f"len({c}) = {DIM} AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 "
        f"AND len(list_filter({c}, lambda x: x <> 0)) > 0"
    )


LAWS = f"""l AS (SELECT id AS law_id, {trim('law_key')} AS law_key, title AS law_title, alt_title, category, total_norms, loaded_at FROM laws
  WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
CORPUS = f"""{LAWS},
c AS (SELECT n.id, n.law_id, l.law_key, l.law_title, l.category, {trim('n.norm_id')} AS norm_id, n.title AS norm_title, n.content,
  CASE WHEN {usable('n.embedding')} THEN n.embedding::DOUBLE[] END AS vec FROM norms n LEFT JOIN l ON l.law_id = n.law_id)"""
