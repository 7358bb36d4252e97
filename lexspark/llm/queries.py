"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.notation import stripped
from lexspark.llm.conversations import judge_conversations, rebuild_conversations
from lexspark.llm.leakage import find_leaks
from lexspark.llm.packing import divided, pack
from lexspark.llm.pieces import split_oversized
from lexspark.llm.reading import fit_reading_model, reading_levels
from lexspark.llm.similar import near_pairs, nearest
from lexspark.session import durable
from lexspark.sources.tables import table


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Norms with a cosine of at least 0.9, each among the 10 most similar of the other."""
    return near_pairs(table(spark, d, "norms"), "id", "embedding", 64, 10, 0.9)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("id_a", "id_b")


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar of all norms for each norm whose id is divisible by 100, with both norm_ids."""
    norms = table(spark, d, "norms")
    found = nearest(norms, "id", "embedding", norms.where(F.col("id") % 100 == 0), 64, 10)
    name = norms.select("id", stripped(F.col("norm_id")).alias("norm_id"))
    return found.join(name, "id").join(
        name.select(F.col("id").alias("neighbour"), F.col("norm_id").alias("neighbour_norm_id")), "neighbour"
    )


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 256 tokens with 32 of overlap of every larger norm."""
    return split_oversized(table(spark, d, "norms"), "id", "content", 256, 32)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where(F.col("piece_no") == 1).select("id", "unbroken")


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from what is new in each piece, by length and digest, and pieces that are too large."""
    new = F.expr("substring(content, fresh_at + 1)")
    parts = F.sort_array(F.collect_list(F.struct("piece_no", new.alias("t"))))
    text = F.array_join(F.transform(parts, lambda p: p["t"]), "")
    return p3_pieces(spark, d).groupBy("id").agg(
        F.length(text).cast("long").alias("chars"), F.md5(text).alias("digest"), F.count_if(F.col("tokens") > 256).alias("too_large"),
        F.count_if((F.col("piece_no") > 1) & (F.col("overlap") != 32)).alias("not_overlapping"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return judge_conversations(table(spark, d, "messages")).where(~F.col("whole")).select("conversation_id")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the whole conversations."""
    return rebuild_conversations(table(spark, d, "messages"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, one token per UTF-8 byte, in containers of 4,096 tokens."""
    return pack(table(spark, d, "documents"), "doc_id", F.octet_length("text"), 4096)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pieces lie in several containers."""
    return divided(p6_containers(spark, d), "doc_id").select("doc_id")


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold: documents, pieces, tokens, containers over 4,096 tokens, documents that are not held whole."""
    packed = durable(p6_containers(spark, d))
    size = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n")).where(F.col("n") > 0)
    held = packed.groupBy("doc_id").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("found"), F.max("pieces").alias("pieces"))
    whole = size.join(held, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("found").alias("pieces"), F.sum("held").alias("tokens"),
        F.count_if(~F.coalesce((F.col("held") == F.col("n")) & (F.col("found") == F.col("pieces")), F.lit(False))).alias("broken"),
    )
    full = packed.groupBy("container_id").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > 4096).alias("overfull"))
    return whole.crossJoin(full)  # one row beside one row


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    used = p6_containers(spark, d).groupBy("container_id").agg(F.sum("size").alias("tokens"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.round(F.avg("tokens") / 4096, 4).alias("fill"),
    )


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items whose question or answer they contain, with the length of the passage."""
    return find_leaks(
        table(spark, d, "documents"), "doc_id", "text",
        table(spark, d, "eval_items"), "item_id", ["question_text", "answer_text"],
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items and how many documents have them."""
    return p7_leaks(spark, d).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.max("run_words").alias("longest_run")
    )


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level and difficulty of every document of at least 50 words, with source and language."""
    docs = table(spark, d, "documents")
    model = fit_reading_model(table(spark, d, "reading_labels"), docs, "doc_id", "text")
    return reading_levels(docs, "doc_id", "text", model, ("source", "lang"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean difficulty per source, language (as written, two letters) and level."""
    lang = F.substring(F.lower(stripped(F.col("lang"))), 1, 2)
    return p8_levels(spark, d).groupBy("source", lang.alias("language"), "reading_level").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("difficulty"), 3).alias("difficulty")
    )


QUERIES = {
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p2_nearest": p2_nearest,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined, "p4_found": p4_found, "p4_turns": p4_turns,
    "p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_audit": p6_audit,
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_items": p7_items,
    "p8_found": p8_found, "p8_levels": p8_levels, "p8_profile": p8_profile,
}

_TRIM = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{feff}}]+|[\s\x{{00a0}}\x{{feff}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return f"nullif({_TRIM.format(c)}, '')"


_TALK = f"""
WITH m AS (
  SELECT lower({_trim('id')}) AS mid, lower({_trim('conversation_id')}) AS c, lower({_trim('role')}) AS role,
         content, {_trim('content')} IS NULL AS blank, created_at, ingested_at FROM messages),
o AS (SELECT * FROM m WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mid ORDER BY ingested_at, created_at) = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY created_at, CASE role WHEN 'user' THEN 0 ELSE 1 END, mid) AS n
      FROM o WHERE NOT blank AND role IN ('user', 'assistant')),
g AS (SELECT c FROM w GROUP BY c HAVING count(*) % 2 = 0 AND bool_and((n % 2 = 1) = (role = 'user'))
      EXCEPT SELECT c FROM o WHERE coalesce(role, '') NOT IN ('user', 'assistant', 'system'))
"""

# all pairs, at the size of the comparison; the index is compared with brute force at larger ones
_PAIRS = """
WITH u AS (SELECT id, embedding::DOUBLE[] AS v FROM norms WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
c AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.id < b.id),
n AS (SELECT x, y FROM (SELECT x, y, c FROM c WHERE c >= 0.9 UNION ALL SELECT y, x, c FROM c WHERE c >= 0.9)
  QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 10)
SELECT a.x AS id_a, a.y AS id_b FROM n a JOIN n b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y"""

SQL = {
    "p2_found": _PAIRS,
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
    "p6_audit": """SELECT count(*) AS documents, sum(ceil(strlen(text) / 4096))::BIGINT AS pieces, sum(strlen(text))::BIGINT AS tokens, 0::BIGINT AS broken,
  0::BIGINT AS overfull FROM documents WHERE strlen(text) > 0""",
    "p3_rejoined": r"""SELECT id, length(content) AS chars, md5(content) AS digest, 0::BIGINT AS too_large, 0::BIGINT AS not_overlapping
FROM norms WHERE len(regexp_extract_all(content, '\S+')) > 256""",
    "p3_found": r"""
SELECT id, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[\n\r.;:!?]'),
    lambda x: len(regexp_extract_all(x, '\S+')))) > 256 THEN 1 ELSE 0 END::BIGINT AS unbroken
FROM norms WHERE len(regexp_extract_all(content, '\S+')) > 256""",
    "p4_found": _TALK + "SELECT DISTINCT c AS conversation_id FROM o WHERE c NOT IN (SELECT c FROM g)",
    "p4_turns": _TALK + "SELECT c AS conversation_id, n AS turn_no, role, content, created_at FROM w WHERE c IN (SELECT c FROM g)",
}
