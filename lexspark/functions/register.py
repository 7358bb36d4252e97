"""Scalar functions for SQL texts. They are SQL functions over built-in expressions, so that the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and definition; `CREATE OR REPLACE TEMPORARY FUNCTION` is put before.
FUNCTIONS = (
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN coalesce(try_divide("
    "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
    "bm25_score(tf DOUBLE, length DOUBLE, texts DOUBLE, having DOUBLE) RETURNS DOUBLE RETURN "
    "ln(1 + (texts - having + 0.5D) / (having + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * length / 600D))",
    "text_trigrams(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(flatten(transform("
    "filter(split(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9äöüß]+', ' '), ' '), w -> w <> ''), "
    "w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    "trigram_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce(try_divide("
    "size(array_intersect(text_trigrams(a), text_trigrams(b))), size(array_union(text_trigrams(a), text_trigrams(b)))), 0D)",
    "request_allowed(requests BIGINT, most BIGINT) RETURNS STRUCT<allowed: BOOLEAN, remaining: BIGINT> RETURN "
    "named_struct('allowed', requests <= most, 'remaining', greatest(most - requests, 0L))",
)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session; calling it again changes nothing."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
