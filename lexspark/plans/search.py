"""Retrieval: dense, BM25, hybrid, tiers, and how good they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.notation import stripped
from lexspark.functions.text import query_keywords, query_terms, STOP_WORDS, trigram_similarity, trigrams
from lexspark.operators.evaluate import mean_metrics, ranking_metrics
from lexspark.operators.retrieval import (
    bm25_pool, bm25_topn, cascade, dense_topn, diversify, fuse, gated, group_hits, homogeneity, keyword_boost, occurring, similar_grams,
)
from lexspark.plans.common import CORPUS, LAWS, corpus, current_laws, trim
from lexspark.session import durable
from lexspark.sources.tables import table

TOP = 10


def _dense(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vec")
    return dense_topn(queries, rows, n)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    return _dense(spark, d, TOP).select("query_id", "id", "dense", F.col("place").cast("long").alias("place"))


def dense_diversified(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best of 100, with boosts for labels with many hits and a cap on each."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    pool = _dense(spark, d, TOP * 10).drop("place").join(labels, "id").withColumn("boosted", F.col("dense"))
    return diversify(pool, "label", TOP).select("query_id", "id", "label", "score", F.col("place").cast("long").alias("place"))


def vector_label_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the 10 nearest others that have the query's label."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    mine = labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted"))
    near = _dense(spark, d, TOP + 1).where(F.col("id") != F.col("query_id")).join(labels, "id").join(mine, "query_id")
    return near.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("wanted")).cast("double")), 6).alias("precision"))


def _alive(rows: DataFrame) -> DataFrame:
    """Without repealed and empty norms."""
    gone = F.col("content").isNull() | (F.trim("content") == "") | (F.col("content") == "(weggefallen)")
    return rows.where(~gone & ~F.coalesce(F.col("norm_title").contains("(weggefallen)"), F.lit(False)))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    vectors = rows.where(F.col("vec").isNotNull()).select("id", "vec")
    asked = rows.where((F.col("id") % 100 == 0) & F.col("vec").isNotNull())
    queries = asked.select(F.col("id").alias("query_id"), "vec")
    text = asked.select(
        F.col("id").alias("query_id"), query_terms(F.col("norm_title")).alias("terms"), query_keywords(F.col("norm_title")).alias("keywords")
    )
    pool = dense_topn(queries, vectors, TOP * 10).drop("place").join(_alive(rows.drop("vec")), "id").join(text, "query_id")
    title = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("law_title", "norm_title")])
    pool = pool.withColumn("_text", F.concat(title, F.lit(" "), F.col("content")))
    searched = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("law_title", "norm_title", "law_key", "norm_id")])
    ranked = keyword_boost(fuse(bm25_pool(pool, "_text", "terms")), "keywords", searched)
    return diversify(ranked.withColumn("law_key", F.coalesce("law_key", F.lit(""))), "law_key", TOP)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Dense pool over all categories, dead norms out, BM25, fusion, keyword boost, diversity. Queries: the titles and vectors
    of the norms whose id is divisible by 100. Category filter and expansion of the query are left out (README)."""
    return _hybrid(spark, d).select("query_id", "id", "law_key", "dense", "bm25", "score", F.col("place").cast("long").alias("place"))


def law_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the hybrid search by law, with the best score in per cent and the first three norms."""
    return group_hits(_hybrid(spark, d), "law_key", [F.col("place")])


def homogeneous(spark: SparkSession, d: str) -> DataFrame:
    """How much one law dominates each answer, and whether the search should be widened for that; it is not widened (README)."""
    return homogeneity(_hybrid(spark, d), "law_key").withColumn("widen", (F.col("share") > 0.6) & (F.col("top") < 0.6))


def context_top10(spark: SparkSession, d: str) -> DataFrame:
    """The text of an answer: its norms in order, at most 1200 characters of each."""
    part = F.concat(
        F.lit("["), F.concat_ws(" ", F.coalesce("law_key", F.lit("")), F.coalesce("norm_id", F.lit(""))), F.lit("] "),
        F.substring("content", 1, 1200),
    )
    parts = F.sort_array(F.collect_list(F.struct("place", part.alias("t"))))
    return _hybrid(spark, d).groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda s: s["t"]), "\n\n").alias("context")
    )


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), query_terms(F.col("question_text")).alias("terms"))


def _bm25(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = _alive(table(spark, d, "norms").withColumnRenamed("title", "norm_title"))
    return bm25_topn(rows.select("id", F.col("content").alias("text")), _asked(spark, d), n)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best norms by BM25 over the whole corpus for each question."""
    return _bm25(spark, d, TOP).select("query_id", "id", "bm25", F.col("place").cast("long").alias("place"))


def _ranked_and_relevant(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = _bm25(spark, d, 50).join(corpus(spark, d).select("id", "law_key", "norm_id"), "id")
    ranked = found.where(F.col("law_key").isNotNull() & F.col("norm_id").isNotNull()).select(
        "query_id", F.concat_ws(" ", "norm_id", "law_key").alias("item"), "place"
    )
    relevant = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode("paragraphs").alias("item"))
    return ranked, relevant.withColumn("item", stripped(F.col("item")))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return ranking_metrics(*_ranked_and_relevant(spark, d))


def eval_by_query(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank of each question against the norms that answer it."""
    return _judged(spark, d)


def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return mean_metrics(_judged(spark, d))


def query_words(spark: SparkSession, d: str) -> DataFrame:
    """Terms and keywords of every question."""
    q = F.col("question_text")
    return table(spark, d, "eval_items").select(
        "item_id", F.array_join(query_terms(q), " ").alias("terms"), F.array_join(query_keywords(q), " ").alias("keywords")
    )


def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Law keys that occur as capitalised words in what answers a question."""
    text = F.array_join("paragraphs", " ")
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+"), 0))
    keys = current_laws(spark, d).select("law_key").where(F.col("law_key").isNotNull()).distinct()
    named = table(spark, d, "eval_items").select("item_id", F.explode(words).alias("law_key"))
    return named.join(keys, "law_key", "left_semi").select("item_id", "law_key")


def tiered_union(spark: SparkSession, d: str) -> DataFrame:
    """Laws alone for each question (all tiers of the search: `tiered_search`): words of a title (0.9), then, for questions with fewer than 3, parts of words
    in title, alternative title or key (0.65), then, for those with none, any law by trigrams (0.5). Words, parts and trigrams meet
    as keys of joins; a part is found by an automaton over all keywords."""
    asked = table(spark, d, "eval_items").select(
        F.col("item_id").alias("query_id"), query_keywords(F.col("question_text")).alias("keywords"),
        trigrams(F.col("question_text")).alias("grams"),
    )
    laws = current_laws(spark, d)
    titles = laws.select("law_id", F.explode(query_keywords(F.col("law_title"), ())).alias("word"))
    words = asked.select("query_id", F.explode("keywords").alias("word"))
    tier = lambda df, name, score: df.select("query_id", "law_id", F.lit(name).alias("tier"), F.lit(score).alias("score"))
    full = durable(titles.join(words, "word").select("query_id", "law_id").distinct())
    few = gated(words, full, 3)
    parts = occurring(laws, "law_id", ["law_title", "alt_title", "law_key"], few, "word")
    so_far = durable(tier(full, "title", 0.9).unionByName(tier(parts.join(few, "word").select("query_id", "law_id").distinct(), "part", 0.65)))
    none = gated(asked, so_far, 1)
    near = similar_grams(none.select("query_id", "grams"), laws.select("law_id", trigrams(F.col("law_title")).alias("grams")), 0.3)
    return so_far.unionByName(tier(near, "trigram", 0.5))


def tiered_search(spark: SparkSession, d: str) -> DataFrame:
    """All tiers of the search, over all norms and laws. Queries: the titles of the norms whose id is divisible by 100, also
    of those without vector, which the hybrid search cannot answer."""
    rows = corpus(spark, d)
    asked = rows.where((F.col("id") % 100 == 0) & F.col("norm_title").isNotNull())
    search = durable(_hybrid(spark, d).select("query_id", "id", "law_key", "score"))
    queries = asked.select(F.col("id").alias("query_id"), F.col("norm_title").alias("text"))
    return cascade(queries, search, rows.drop("vec"), current_laws(spark, d))


def trigram_match(spark: SparkSession, d: str) -> DataFrame:
    """Trigram similarity of title and alternative title of each law."""
    return current_laws(spark, d).select(
        "law_id", F.round(trigram_similarity(trigrams(F.col("law_title")), trigrams(F.col("alt_title"))), 6).alias("similarity")
    )


QUERIES = {
    "dense_topk": dense_topk, "dense_diversified": dense_diversified, "vector_label_recall": vector_label_recall,
    "hybrid_search": hybrid_search, "law_grouping": law_grouping, "homogeneous": homogeneous, "context_top10": context_top10,
    "bm25_topk": bm25_topk, "eval_by_query": eval_by_query, "eval_recall_mrr": eval_recall_mrr, "query_words": query_words,
    "abbreviations": abbreviations, "tiered_union": tiered_union, "tiered_search": tiered_search, "trigram_match": trigram_match,
}

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _parts(c: str, kind: str, least: int) -> str:
    """Distinct bare words in order of first occurrence."""
    bare = f"list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '\\s+'), lambda w: regexp_replace(w, '^[^{kind}]+|[^{kind}]+$', '', 'g')), lambda w: length(w) >= {least})"
    return f"(SELECT coalesce(list(w ORDER BY p), []) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(b) AS w, generate_subscripts(b, 1) AS p FROM (SELECT {bare} AS b)) GROUP BY w))"


def _terms(c: str) -> str:
    return _parts(c, "a-zäöüß0-9", 2)


def _keywords(c: str, stop: bool = True) -> str:
    parts = _parts(c, "a-zäöüß", 3)
    return f"list_filter({parts}, lambda w: NOT list_contains({_STOP}, w))" if stop else parts


_DENSE = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
p AS (SELECT q.id AS query_id, e.id, e.label, q.label AS wanted, round(list_cosine_similarity(q.vec, e.vec), 6) AS dense,
      row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vec, e.vec), 6) DESC, e.id) AS place
      FROM e q, e WHERE q.id % 100 = 0)"""

_DIVERSE = """g AS (SELECT *, row_number() OVER (PARTITION BY query_id, {g} ORDER BY boosted DESC, id) AS r,
      round(boosted * (1 + least(0.2, 0.02 * (count(*) OVER (PARTITION BY query_id, {g}) - 1))), 6) AS score FROM {src}),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place2 FROM g WHERE r <= 3),
f AS (SELECT * FROM h WHERE place2 <= 10)"""

_TOKENS = "regexp_extract_all(lower({}), '[\\wäöüß]+')"

_HYBRID = f"""WITH {CORPUS},
q AS (SELECT id AS query_id, vec, {_terms('norm_title')} AS terms, {_keywords('norm_title')} AS keywords FROM c WHERE id % 100 = 0 AND vec IS NOT NULL),
p0 AS (SELECT q.query_id, c.id, round(list_cosine_similarity(q.vec, c.vec), 6) AS dense FROM q, c WHERE c.vec IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.vec, c.vec), 6) DESC, c.id) <= 100),
p AS (SELECT p0.*, coalesce(c.law_key, '') AS law_key, c.law_title, c.norm_title, c.norm_id, c.content, q.terms, q.keywords,
      {_TOKENS.format("coalesce(c.law_title, '') || ' ' || coalesce(c.norm_title, '') || ' ' || c.content")} AS w
      FROM p0 JOIN c USING (id) JOIN q USING (query_id)
      WHERE c.content IS NOT NULL AND trim(c.content, ' ') <> '' AND c.content <> '(weggefallen)' AND NOT coalesce(contains(c.norm_title, '(weggefallen)'), false)),
t AS (SELECT query_id, id, unnest(terms) AS term, w FROM p),
tf AS (SELECT query_id, id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS len FROM t),
n AS (SELECT query_id, count(*) AS n FROM p GROUP BY 1),
df AS (SELECT query_id, term, sum((tf > 0)::INT) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 600.0))) AS bm25
      FROM tf JOIN n USING (query_id) JOIN df USING (query_id, term) WHERE tf > 0 GROUP BY ALL),
u AS (SELECT p.*, round(coalesce(s.bm25, 0), 6) AS bm25 FROM p LEFT JOIN s USING (query_id, id)),
v AS (SELECT *, CASE WHEN len(terms) > 0 THEN 0.85 * dense / greatest(max(dense) OVER w1, 0.001) + 0.15 * bm25 / greatest(max(bm25) OVER w1, 0.001) ELSE dense END AS fused
      FROM u WINDOW w1 AS (PARTITION BY query_id)),
x AS (SELECT *, fused * (1 + least(0.1 * len(list_filter(keywords, lambda k: contains(lower(coalesce(law_title, '') || ' ' || coalesce(norm_title, '') || ' ' || law_key || ' ' || coalesce(norm_id, '')), k))), 0.5)) AS boosted FROM v),
{_DIVERSE.format(g='law_key', src='x')}"""

_BM25 = f"""WITH a AS (SELECT id, content FROM norms WHERE content IS NOT NULL AND trim(content, ' ') <> '' AND content <> '(weggefallen)' AND NOT coalesce(contains(title, '(weggefallen)'), false)),
w AS (SELECT id, {_TOKENS.format('content')} AS w FROM a),
tf AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT query_id, unnest(terms) AS term FROM (SELECT item_id AS query_id, {_terms('question_text')} AS terms FROM eval_items)),
s AS (SELECT query_id, id, round(sum(ln(1 + ((SELECT count(*) FROM a) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / 600.0))), 6) AS bm25
      FROM q JOIN df USING (term) JOIN tf USING (term) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS place FROM s)"""

_JUDGED = _BM25 + f""", {CORPUS},
r AS (SELECT query_id, c.norm_id || ' ' || c.law_key AS item, min(place) AS place FROM b JOIN c USING (id)
      WHERE place <= 50 AND c.norm_id IS NOT NULL AND c.law_key IS NOT NULL GROUP BY ALL),
j AS (SELECT DISTINCT item_id AS query_id, {trim('item')} AS item FROM (SELECT item_id, unnest(paragraphs) AS item FROM eval_items)),
m AS (SELECT query_id, count(*) AS n_relevant, round(coalesce(1.0 / min(place), 0), 6) AS mrr,
      {', '.join(f"round(sum(coalesce((place <= {k})::INT, 0)) / count(*), 6) AS recall_{k}" for k in (1, 3, 5, 10))}
      FROM j LEFT JOIN r USING (query_id, item) GROUP BY 1)"""

_GRAMS = ("list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9äöüß]+', ' ', 'g'), ' '), lambda w: w <> ''), "
          "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))")  # fmt: skip


def _similar(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


SQL = {
    "dense_topk": f"WITH {_DENSE} SELECT query_id, id, dense, place FROM p WHERE place <= 10",
    "dense_diversified": f"WITH {_DENSE}, d AS (SELECT *, dense AS boosted FROM p WHERE place <= 100), {_DIVERSE.format(g='label', src='d')} SELECT query_id, id, label, score, place2 AS place FROM f",
    "vector_label_recall": f"WITH {_DENSE} SELECT query_id, round(avg((label = wanted)::INT), 6) AS precision FROM p WHERE place <= 11 AND id <> query_id GROUP BY 1",
    "hybrid_search": _HYBRID + " SELECT query_id, id, law_key, dense, bm25, score, place2 AS place FROM f",
    "law_grouping": _HYBRID + """ SELECT query_id, law_key, count(*) AS hits, floor(greatest(max(score), 0) * 100 + 0.5)::BIGINT AS relevance,
        array_to_string(list(id ORDER BY place2)[1:3], ',') AS norms FROM f GROUP BY ALL""",
    "homogeneous": _HYBRID + """ SELECT query_id, round(max(n) / sum(n), 6) AS share, max(t) AS top, round(max(n) / sum(n), 6) > 0.6 AND max(t) < 0.6 AS widen
        FROM (SELECT query_id, law_key, count(*) AS n, max(score) AS t FROM f GROUP BY ALL) GROUP BY 1""",
    "context_top10": _HYBRID + " SELECT query_id, string_agg('[' || law_key || ' ' || coalesce(norm_id, '') || '] ' || substring(content, 1, 1200), chr(10) || chr(10) ORDER BY place2) AS context FROM f GROUP BY 1",
    "bm25_topk": _BM25 + " SELECT query_id, id, bm25, place FROM b WHERE place <= 10",
    "eval_by_query": _JUDGED + " SELECT * FROM m",
    "eval_recall_mrr": _JUDGED + " SELECT count(*) AS queries, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("mrr", "recall_1", "recall_3", "recall_5", "recall_10")) + " FROM m",
    "query_words": f"SELECT item_id, array_to_string({_terms('question_text')}, ' ') AS terms, array_to_string({_keywords('question_text')}, ' ') AS keywords FROM eval_items",
    "abbreviations": f"WITH {LAWS} SELECT DISTINCT item_id, w AS law_key FROM (SELECT item_id, unnest(regexp_extract_all(array_to_string(paragraphs, ' '), '[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+')) AS w FROM eval_items) WHERE w IN (SELECT law_key FROM l)",
    "tiered_union": f"""WITH {LAWS},
q AS (SELECT item_id AS query_id, {_keywords('question_text')} AS keywords, {_GRAMS.format('question_text')} AS grams FROM eval_items),
a AS (SELECT DISTINCT query_id, law_id, 'title' AS tier, 0.9::DOUBLE AS score FROM (SELECT query_id, unnest(keywords) AS w FROM q)
      JOIN (SELECT law_id, unnest({_keywords('law_title', False)}) AS w FROM l) USING (w)),
b AS (SELECT query_id, law_id, 'part', 0.65::DOUBLE FROM q, l WHERE query_id NOT IN (SELECT query_id FROM a GROUP BY 1 HAVING count(*) >= 3)
      AND len(list_filter(keywords, lambda k: contains(lower(coalesce(law_title, '')), k) OR contains(lower(coalesce(alt_title, '')), k) OR contains(lower(coalesce(law_key, '')), k))) > 0),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT * FROM ab UNION ALL SELECT query_id, law_id, 'trigram', 0.5::DOUBLE FROM q, l WHERE query_id NOT IN (SELECT query_id FROM ab)
 AND {_similar(_GRAMS.format('law_title'), 'grams')} >= 0.3""",
    "trigram_match": f"WITH {LAWS} SELECT law_id, round({_similar(_GRAMS.format('law_title'), _GRAMS.format('alt_title'))}, 6) AS similarity FROM l",
}
