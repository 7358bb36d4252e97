"""What serves readers: expanded queries, tiers, pages, caches, imports, prompts, policies, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import register
from lexspark.functions import text as T
from lexspark.functions.lookup import reverse_term
from lexspark.functions.notation import date_value, stripped, uuid_key
from lexspark.functions.vectors import is_vector
from lexspark.operators import store
from lexspark.operators.corpus import carry_over
from lexspark.operators.evaluate import any_in_top
from lexspark.operators.retrieval import containing, dense_topn, homogeneity, occurring, widened
from lexspark.plans.common import CORPUS, DIM, LAWS, corpus, current_laws, newest, trim, usable
from lexspark.plans.search import _DENSE, _GRAMS, _JUDGED, _STOP, TOP, _ranked_and_relevant, _similar
from lexspark.plans.state import _MARKS, _marks, _old_and_new
from lexspark.plans.upkeep import _date
from lexspark.plans.wording import SQL as WORDING
from lexspark.plans.wording import TERMS, _DICTIONARY, _dictionary, detect_categories
from lexspark.sources.tables import table


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text: titles of the norms whose id is divisible by 100."""
    norms = table(spark, d, "norms").where((F.col("id") % 100 == 0) & (F.trim("title") != ""))
    return norms.select(F.col("id").alias("query_id"), F.col("title").alias("text"))


def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each question as it is embedded: with the terms of its category, where it has one, and the prefix of queries."""
    terms = _dictionary(spark, d).groupBy("category").agg(F.slice(F.sort_array(F.collect_list("keyword")), 1, 3).alias("terms"))
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "question_text")
    found = asked.join(detect_categories(spark, d).select("query_id", "category"), "query_id", "left").join(F.broadcast(terms), "category", "left")
    text = T.query_text(T.expanded(F.col("question_text"), F.coalesce("terms", F.array().cast("array<string>"))))
    return found.select("query_id", "category", text.alias("text"))


def norm_text_tier(spark: SparkSession, d: str) -> DataFrame:
    """Norms with the text of a query in content, title or number (0.65), the 20 with the lowest ids of each query."""
    norms = table(spark, d, "norms").select("id", "content", "title", "norm_id")
    return containing(norms, "id", ["content", "title", "norm_id"], _titles(spark, d), 20).select("query_id", "id", F.lit(0.65).alias("score"))


def law_text_tier(spark: SparkSession, d: str) -> DataFrame:
    """Laws with the text of a query in title, other title or key (0.5), the 20 with the lowest ids of each query."""
    found = containing(current_laws(spark, d), "law_id", ["law_title", "alt_title", "law_key"], _titles(spark, d), 20)
    return found.select("query_id", "law_id", F.lit(0.5).alias("score"))


def abbreviation_tier(spark: SparkSession, d: str) -> DataFrame:
    """Laws whose key stands as a word in what answers a question, 0.95 in a search and 0.99 in a chat."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.array_join("paragraphs", " "), F.lit("[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+"), 0)))
    named = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), words.alias("law_key"))
    laws = current_laws(spark, d).select("law_id", "law_key")
    return named.join(laws, "law_key").select("query_id", "law_id", F.lit(0.95).alias("search"), F.lit(0.99).alias("chat"))


def category_browse(spark: SparkSession, d: str) -> DataFrame:
    """The laws of each category (1.0), the first 200 by key."""
    laws = current_laws(spark, d).select(F.lower(stripped(F.col("category"))).alias("category"), "law_key", "law_id").where(F.col("category").isNotNull())
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.col("law_key").asc_nulls_first(), "law_id"))
    return laws.withColumn("n", rank).where(F.col("n") <= 200).select("category", "law_id", F.lit(1.0).alias("score"))


def ilike_laws(spark: SparkSession, d: str) -> DataFrame:
    """Laws by patterns in which % and _ stand for anything."""
    patterns = F.explode(F.array(*[F.lit(p) for p in ILIKE])).alias("pattern")
    laws = current_laws(spark, d).select("law_id", "law_title", "alt_title", "law_key", patterns)
    hit = F.lit(False)
    for c in ("law_title", "alt_title", "law_key"):
        hit = hit | F.coalesce(F.expr(f"{c} ILIKE concat('%', trim(pattern), '%')"), F.lit(False))
    return laws.where(hit).select("pattern", "law_id")


#: Patterns as readers type them.
ILIKE = ("archiv", " verordnung ", "ge_etz", "recht%2")


def widened_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest vectors of the query's own label; where they are all of one label and none is near, the best of each
    other label from a search over all is added."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    queries = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vec", "label")
    labels = rows.select("id", "label")
    search = lambda n, within: dense_topn(queries, rows, n, within=within).join(labels, "id").select(
        "query_id", "id", "label", F.col("dense").alias("score")
    )
    first = search(TOP, "label")
    others = first.where(F.col("id") != F.col("query_id"))
    share = homogeneity(others, "label")
    flagged = share.where((F.col("share") > 0.6) & (F.col("top") < 0.6))
    return widened(first, search(TOP * 10, None), flagged, "label")


def top3_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether any norm that answers a question is among the first three."""
    return any_in_top(*_ranked_and_relevant(spark, d), 3)


def tagged_passages(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded with the law's key in front, as length and digest."""
    p = T.tagged_passage(F.col("law_key"), F.col("norm_title"), F.col("content"))
    return corpus(spark, d).select("id", F.length(p).cast("long").alias("chars"), T.client_hash(p).alias("digest"))


PROMPT = ("name", "category", "court_name", "case_number", "opposing_party", "notes")


def folder_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a folder says about its case, a line for each field that has a value."""
    return table(spark, d, "folders").select("id", T.assembled_prompt([(c, F.col(c)) for c in PROMPT]).alias("prompt")).distinct()


def reverse_terms(spark: SparkSession, d: str) -> DataFrame:
    """The English term for a law's title, by the dictionary the other way round."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TERMS])
    return current_laws(spark, d).select("law_id", reverse_term(F.col("law_title"), pairs).alias("term"))


def fallback_queries(spark: SparkSession, d: str) -> DataFrame:
    """What is searched for where nothing can be translated: the first six words that mean something."""
    return table(spark, d, "eval_items").select("item_id", T.fallback_words(F.col("question_text")).alias("words"))


def encoded_titles(spark: SparkSession, d: str) -> DataFrame:
    return current_laws(spark, d).where(F.col("law_key").isNotNull()).select("law_id", T.url_encoded(F.col("law_key")).alias("encoded"))


def inferred_fields(spark: SparkSession, d: str) -> DataFrame:
    """Authority, status and jurisdiction of each law, from title and key."""
    t, k = F.col("law_title"), F.col("law_key")
    return current_laws(spark, d).select("law_id", T.authority(t, k).alias("authority"), T.in_force(t).alias("status"), T.jurisdiction(t, k).alias("jurisdiction"))


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    """Laws of each category: how many, and how many pages of 50."""
    laws = current_laws(spark, d).select(F.coalesce(F.lower(stripped(F.col("category"))), F.lit("other")).alias("category"))
    all_of = store.page_count(laws).select(F.lit("all").alias("category"), "total", "pages")
    each = laws.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    return all_of.unionByName(each.withColumn("pages", F.ceil(F.col("total") / 50).cast("long")))


def recent_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The 50 conversations with the newest messages."""
    m = table(spark, d, "messages").select(uuid_key(F.col("conversation_id")).alias("conversation_id"), "created_at")
    last = m.where(F.col("conversation_id").isNotNull()).groupBy("conversation_id").agg(F.max("created_at").alias("last_at"))
    return last.orderBy(F.col("last_at").desc_nulls_last(), "conversation_id").limit(50)


def first_law(spark: SparkSession, d: str) -> DataFrame:
    """The law with the least key; no row where there is none."""
    laws = current_laws(spark, d).where(F.col("law_key").isNotNull()).select("law_id", "law_key")
    return laws.orderBy("law_key", "law_id").limit(1)


def policy_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the owner of the first folder may see under each policy."""
    folders = table(spark, d, "folders")
    who = folders.agg(F.min("user_id")).scalar()
    parts = [store.visible(folders, p, "user_id", who).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(p).alias("policy"), "rows") for p in ("public", "owner", "denied")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def key_queries(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarked titles and keys that are nothing but names of laws, which need no search."""
    keys = current_laws(spark, d).where(F.col("law_key").isNotNull()).agg(F.collect_set("law_key")).scalar()  # the list of laws
    texts = _marks(spark, d).select(F.explode(F.array("law_key", "law_title", F.concat_ws(" ", "law_key", "law_key"))).alias("text"))
    return texts.where(F.col("text").isNotNull()).distinct().withColumn("keys", keys).select("text", T.only_keys(F.col("text"), F.col("keys")).alias("only_keys"))


def spot_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Of the first 100 norms of each law those with the number 1."""
    norms = table(spark, d, "norms").where(F.col("law_id").isNotNull()).select("id", "law_id", stripped(F.col("norm_id")).alias("norm_id"))
    first = norms.withColumn("n", F.row_number().over(Window.partitionBy("law_id").orderBy("id"))).where(F.col("n") <= 100)
    return first.where(T.bare_norm_id(F.col("norm_id")) == "1").select("law_id", "id")


def landmark_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents that are no part of their text."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.is_landmark(F.col("line"), 5).alias("landmark")).agg(F.count(F.lit(1)).alias("lines"))


def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks with folders, and those of the older kind without, completed by defaults, where the first have none of the same
    user, law and norm."""
    keys = ["user_id", "law_key", "norm_id"]
    marks = _marks(spark, d)
    one = lambda df: store.unique(df, keys, [F.col("id")])
    old = store.with_defaults(one(marks.where(F.col("folder_id").isNull())), {"category": F.lit("other"), "law_title": F.col("law_key"), "folder_id": F.lit("ungrouped")})
    new = one(marks.where(F.col("folder_id").isNotNull()))
    return store.insert_ignore(new, old, keys).select("id", "law_title", "category", "folder_id")


#: The kinds of folders that each category of laws belongs to.
KINDS = {"housing": ("housing", "consumer"), "labor": ("labor",), "finance": ("finance", "consumer"), "social": ("social", "family")}


def category_folders(spark: SparkSession, d: str) -> DataFrame:
    """Laws and the folders that they may matter to, counted by category of the law and kind of folder."""
    kinds = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    laws = current_laws(spark, d).select(F.lower(stripped(F.col("category"))).alias("law_category"))
    laws = laws.groupBy("law_category").agg(F.count(F.lit(1)).alias("laws"))
    wanted = laws.select("law_category", "laws", F.explode(F.try_element_at(kinds, "law_category")).alias("kind"))
    folders = table(spark, d, "folders").dropDuplicates(["id"]).groupBy(F.lower(stripped(F.col("category"))).alias("kind")).agg(F.count(F.lit(1)).alias("folders"))
    return wanted.join(folders, "kind").select("law_category", "kind", "laws", "folders")


def explanation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Whether there is an explanation of what a bookmark names, looked up by law, norm and language; norms with a title have one in
    German."""
    c = corpus(spark, d).where(F.col("norm_title").isNotNull() & F.col("law_key").isNotNull() & F.col("norm_id").isNotNull())
    name = F.concat_ws("-", "law_key", "norm_id").alias("name")
    cache = c.select(name, F.lit("de").alias("lang"), "id").groupBy("name", "lang").agg(F.min("id").alias("explanation"))
    asked = _marks(spark, d).select("id", name, F.when(F.col("synced"), "de").otherwise("en").alias("lang")).distinct()
    return store.lookup(asked, cache, ["name", "lang"], "explanation").select("id", "hit", F.coalesce("explanation", F.lit(0)).alias("explanation"))


def vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """Whether the vector that an earlier norm of the same law and number has can be used: only if the text is the same."""
    n = table(spark, d, "norms").select("id", "law_id", stripped(F.col("norm_id")).alias("norm_id"), F.md5(F.coalesce("content", F.lit(""))).alias("digest"), F.col("embedding").alias("vec"))
    keys = ["law_id", "norm_id"]
    known = n.where(F.col("law_id").isNotNull() & F.col("norm_id").isNotNull() & is_vector(F.col("vec"), DIM))
    cache = store.unique(known, keys, [F.col("id")]).select(*keys, "digest", "vec")
    return store.validated_cache(n.drop("vec"), cache, keys, "digest", "vec").select("id", "state", F.col("vec").isNotNull().alias("has_vector"))


def points_pending(spark: SparkSession, d: str) -> DataFrame:
    """Laws whose norms do not all have a usable vector: how many are needed, there, and to be written."""
    n = table(spark, d, "norms").where(F.col("law_id").isNotNull())
    each = n.groupBy("law_id").agg(F.count(F.lit(1)).alias("needed"), F.count_if(is_vector(F.col("embedding"), DIM)).alias("there"))
    return each.where(F.col("there") < F.col("needed")).withColumn("to_write", F.col("needed") - F.col("there"))


def appended_turns(spark: SparkSession, d: str) -> DataFrame:
    """Messages that are ingested from July 2024 on, numbered after the ones that their conversation has."""
    m = newest(table(spark, d, "messages"), ["id"], "ingested_at").select(uuid_key(F.col("id")).alias("id"), uuid_key(F.col("conversation_id")).alias("c"), "created_at", "ingested_at")
    m = m.where(F.col("c").isNotNull())
    new = F.coalesce(F.col("ingested_at") >= F.lit("2024-07-01").cast("timestamp_ntz"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("c").orderBy("created_at", "id"))
    old = m.where(~new).withColumn("number", rank.cast("long"))
    return store.append_children(old, m.where(new), old.select("c"), "c", "c", [F.col("created_at"), F.col("id")], "number").select("id", "c", "number")


def objection_dates(spark: SparkSession, d: str) -> DataFrame:
    """A month of 30 days from the date of each folder's incident."""
    day = date_value(F.col("incident_date"))
    return table(spark, d, "folders").select("id", F.date_add(day.cast("date"), 30).cast("string").alias("until")).distinct()


def touched_merge(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery overwritten by the current list; rows that are merged carry the time of the merge."""
    old, new = _old_and_new(spark, d)
    at = F.lit("2025-03-01 00:00:00")
    return store.upsert(old.withColumn("updated_at", F.lit(None).cast("string")), store.touched(new, at), ["law_key"]).select("law_key", "origin", "updated_at")


def retained_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by type that remain, and those that go, when only the last week before the newest one is kept."""
    e = table(spark, d, "events")
    edge = e.agg(F.max("ts") - F.expr("INTERVAL 7 DAYS")).scalar()
    return e.groupBy("event_type").agg(F.count_if(F.col("ts") >= edge).alias("kept"), F.count_if(F.col("ts") < edge).alias("gone"))


def nested_json(spark: SparkSession, d: str) -> DataFrame:
    """The norms of each law as JSON, the first five by id."""
    n = table(spark, d, "norms").where(F.col("law_id").isNotNull()).select("law_id", "id", F.length(F.coalesce("content", F.lit(""))).alias("chars"))
    first = n.withColumn("n", F.row_number().over(Window.partitionBy("law_id").orderBy("id"))).where(F.col("n") <= 5)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", "chars"))), lambda s: F.struct(s["id"].alias("id"), s["chars"].alias("chars")))
    return first.groupBy("law_id").agg(F.to_json(listed).alias("norms"))


def category_map(spark: SparkSession, d: str) -> DataFrame:
    """Laws per category, gathered into a map and laid out again, with their share."""
    laws = current_laws(spark, d).groupBy(F.coalesce(F.lower(stripped(F.col("category"))), F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    one = laws.agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))  # as many entries as categories
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return one.withColumn("total", total).select("total", F.explode("m").alias("category", "laws")).select("category", "laws", F.round(F.col("laws") / F.col("total"), 6).alias("share"))


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of titles, a score and a limit by the functions for SQL texts."""
    register.register(spark)
    laws = current_laws(spark, d)
    return laws.select(
        "law_id", F.round(F.expr("trigram_similarity(law_title, alt_title)"), 6).alias("similarity"),
        F.round(F.expr("bm25_score(2D, cast(length(law_title) AS DOUBLE), 100D, 7D)"), 6).alias("score"),
        F.round(F.expr("vector_cosine(array(1D, cast(law_id AS DOUBLE)), array(2D, 1D))"), 6).alias("cosine"),
        F.expr("request_allowed(law_id % 20, 10).remaining").alias("remaining"),
    )


def projected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Norms as they are shown: titles fall back to the law's key, categories to `other`."""
    return corpus(spark, d).select(
        "id", F.coalesce(stripped(F.col("law_title")), "law_key", F.lit("")).alias("title"),
        F.coalesce(F.lower(stripped(F.col("category"))), F.lit("other")).alias("category"),
        F.coalesce("norm_id", F.lit("")).alias("norm_id"), F.substring(F.coalesce("content", F.lit("")), 1, 300).alias("snippet"),
    )


def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    """Norms after the laws that were delivered in 2025 are replaced by what came then; vectors of norms that stay are taken over."""
    n = table(spark, d, "norms").where(F.col("law_id").isNotNull()).select("id", "law_id", stripped(F.col("norm_id")).alias("norm_id"), F.when(is_vector(F.col("embedding"), DIM), F.col("embedding")).alias("vec"), "loaded_at")
    new = F.coalesce(F.col("loaded_at") >= F.lit("2025-01-01").cast("timestamp_ntz"), F.lit(False))
    fresh, old = n.where(new), n.where(~new)
    keys = ["law_id", "norm_id"]
    donors = store.unique(old.where(F.col("vec").isNotNull() & F.col("norm_id").isNotNull()), keys, [F.col("id")])
    return store.delete_keys(old, fresh, ["law_id"]).unionByName(carry_over(fresh, donors, keys, "vec")).select("id", F.col("vec").isNotNull().alias("has_vector"))


def pushed_marks(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks of each user after those not yet synced were pushed: all are flagged, and how many were."""
    m = _marks(spark, d).dropDuplicates(["id"])
    flagged = m.withColumns({"pushed": ~F.coalesce("synced", F.lit(False)), "synced": F.lit(True)})
    return flagged.groupBy("user_id").agg(F.count_if("synced").alias("synced"), F.count_if("pushed").alias("pushed"))


def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """Requests per user, kind and day: 1 is allowed of purchases, 3 of anything else."""
    e = table(spark, d, "events").withColumn("most", F.when(F.col("event_type") == "purchase", 1).otherwise(3))
    return e.groupBy("user_id", "event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.max("most").alias("most")).select(
        "user_id", "event_type", F.col("w.start").alias("start"), "requests", F.greatest(F.col("requests") - F.col("most"), F.lit(0)).cast("long").alias("refused")
    )


def keyword_norms(spark: SparkSession, d: str) -> DataFrame:
    """How many norms have each translated term anywhere in their text."""
    terms = spark.createDataFrame([(b,) for _, b in TERMS], "term string")
    return occurring(table(spark, d, "norms"), "id", ["content", "title"], terms, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("norms"))


QUERIES = {
    f.__name__: f
    for f in (
        expanded_queries, norm_text_tier, law_text_tier, abbreviation_tier, category_browse, ilike_laws, widened_search, top3_hits,
        tagged_passages, folder_prompts, reverse_terms, fallback_queries, encoded_titles, inferred_fields, page_totals,
        recent_conversations, first_law, policy_rows, key_queries, spot_lookup, landmark_lines, legacy_import, category_folders,
        explanation_cache, vector_cache, points_pending, appended_turns, objection_dates, touched_merge, retained_events, nested_json,
        category_map, sql_functions, projected_rows, replaced_children, pushed_marks, rate_limits, keyword_norms,
    )
}

_Q = "q AS (SELECT id AS query_id, title AS text FROM norms WHERE id % 100 = 0 AND trim(title, ' ') <> '')"
_CATEGORY = f"lower({trim('category')})"
_PAIRS = f"p AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TERMS))}) t(i, a, b))"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY user_id, law_key, norm_id ORDER BY id) = 1"


def _some(c: str, before: str = "", after: str = "") -> str:
    return f"CASE WHEN coalesce({c}, '') <> '' THEN '{before}' || {c} || '{after}' ELSE '' END"


SQL = {
    "top3_hits": _JUDGED + " SELECT query_id, bool_or(coalesce(place <= 3, false)) AS hit FROM j LEFT JOIN r USING (query_id, item) GROUP BY 1",
    "sql_functions": f"""WITH {LAWS} SELECT law_id, round({_similar(_GRAMS.format('law_title'), _GRAMS.format('alt_title'))}, 6) AS similarity,
  round(ln(1 + (100 - 7 + 0.5) / (7 + 0.5)) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length(law_title) / 600.0)), 6) AS score,
  round((2 + law_id) / (sqrt(1 + law_id::DOUBLE * law_id) * sqrt(5)), 6) AS cosine, greatest(10 - law_id % 20, 0) AS remaining FROM l""",
    "expanded_queries": f"""WITH {_DICTIONARY}, x AS ({WORDING['detect_categories']}),
t AS (SELECT category, array_to_string(list(keyword ORDER BY keyword)[1:3], ' ') AS terms FROM dt GROUP BY 1)
SELECT x.query_id, x.category, 'query: ' || coalesce(terms || ' ', '') || question_text AS text FROM x JOIN eval_items i ON i.item_id = x.query_id LEFT JOIN t USING (category)""",
    "norm_text_tier": f"""WITH {_Q}, t AS (SELECT DISTINCT lower(text) AS t FROM q),
h AS (SELECT t, n.id FROM t JOIN norms n ON contains(lower(coalesce(content, '')), t) OR contains(lower(coalesce(title, '')), t) OR contains(lower(coalesce(norm_id, '')), t)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY n.id) <= 20) SELECT query_id, id, 0.65::DOUBLE AS score FROM q JOIN h ON lower(q.text) = h.t""",
    "law_text_tier": f"""WITH {_Q}, {LAWS}, h AS (SELECT query_id, law_id FROM q JOIN l ON contains(lower(coalesce(law_title, '')), lower(text)) OR contains(lower(coalesce(alt_title, '')), lower(text))
  OR contains(lower(coalesce(law_key, '')), lower(text)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY law_id) <= 20) SELECT *, 0.5::DOUBLE AS score FROM h""",
    "abbreviation_tier": f"""WITH {LAWS}, w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(array_to_string(paragraphs, ' '), '[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+')) AS w FROM eval_items)
SELECT item_id AS query_id, law_id, 0.95::DOUBLE AS search, 0.99::DOUBLE AS chat FROM w JOIN l ON law_key = w""",
    "category_browse": f"""WITH {LAWS} SELECT {_CATEGORY} AS category, law_id, 1.0::DOUBLE AS score FROM l WHERE {_CATEGORY} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {_CATEGORY} ORDER BY law_key NULLS FIRST, law_id) <= 200""",
    "ilike_laws": f"""WITH {LAWS}, p AS (SELECT unnest([{', '.join(f"'{p}'" for p in ILIKE)}]) AS pattern)
SELECT pattern, law_id FROM l, p WHERE coalesce(law_title ILIKE '%' || trim(pattern) || '%', false) OR coalesce(alt_title ILIKE '%' || trim(pattern) || '%', false)
  OR coalesce(law_key ILIKE '%' || trim(pattern) || '%', false)""",
    "widened_search": f"""WITH {_DENSE.replace('AS place', 'AS place, row_number() OVER (PARTITION BY q.id, e.label = q.label ORDER BY round(list_cosine_similarity(q.vec, e.vec), 6) DESC, e.id) AS own')},
f AS (SELECT query_id, id, label, dense AS score FROM p WHERE label = wanted AND own <= 10),
g AS (SELECT query_id FROM f WHERE id <> query_id GROUP BY 1 HAVING max(score) < 0.6),
s AS (SELECT p.query_id, p.id, p.label, p.dense AS score FROM p JOIN g USING (query_id) WHERE place <= 100 AND label <> wanted
  QUALIFY row_number() OVER (PARTITION BY p.query_id, p.label ORDER BY p.dense DESC, p.id) = 1)
SELECT *, false AS added FROM f UNION ALL SELECT *, true FROM s""",
    "tagged_passages": f"""WITH {CORPUS}, p AS (SELECT id, 'passage: ' || {_some('law_key', '[', '] ')} || {_some('norm_title', '', '. ')} || coalesce(substring(content, 1, 4096), '') AS p FROM c)
SELECT id, length(p) AS chars, substring(sha256(p), 1, 16) AS digest FROM p""",
    "folder_prompts": "SELECT DISTINCT id, concat_ws(chr(10), " + ", ".join(f"CASE WHEN trim({c}, ' ') <> '' THEN '{c}: ' || {c} END" for c in PROMPT) + ") AS prompt FROM folders",
    "reverse_terms": f"""WITH {LAWS}, {_PAIRS} SELECT law_id, coalesce((SELECT arg_min(a, i) FROM p WHERE b = trim(lower(coalesce(law_title, '')), ' ')),
  (SELECT arg_min(a, i) FROM p WHERE contains(trim(lower(coalesce(law_title, '')), ' '), b))) AS term FROM l""",
    "fallback_queries": f"""SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(question_text), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))[1:6], ' ') AS words FROM eval_items""",
    "encoded_titles": f"WITH {LAWS} SELECT law_id, url_encode(law_key) AS encoded FROM l WHERE law_key IS NOT NULL",
    "inferred_fields": f"""WITH {LAWS}, x AS (SELECT law_id, upper(coalesce(law_title, '')) AS t, upper(coalesce(law_key, '')) AS k, lower(coalesce(law_title, '')) AS s, lower(concat_ws(' ', law_key, law_title)) AS n FROM l)
SELECT law_id, CASE WHEN contains(t, 'GESETZ') OR k LIKE '%G' THEN 'Federal Law' WHEN contains(t, 'ORDNUNG') THEN 'Regulation'
  WHEN regexp_matches(k, 'BGH|BVERFG|BSG|BFH') THEN 'Court Decision' ELSE 'Regulation' END AS authority,
  CASE WHEN contains(s, 'außer kraft') OR contains(s, 'weggefallen') OR contains(s, '(a.f.)') THEN 'Invalid/Amended' ELSE 'Active' END AS status,
  CASE WHEN contains(n, 'berlin') THEN 'Berlin (State)' ELSE 'Germany (Federal)' END AS jurisdiction FROM x""",
    "page_totals": f"""WITH {LAWS}, t AS (SELECT coalesce({_CATEGORY}, 'other') AS category FROM l), g AS (SELECT category, count(*) AS total FROM t GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM t)
SELECT *, ceil(total / 50)::BIGINT AS pages FROM g""",
    "recent_conversations": f"""SELECT lower({trim('conversation_id')}) AS conversation_id, max(created_at) AS last_at FROM messages WHERE {trim('conversation_id')} IS NOT NULL GROUP BY 1
ORDER BY 2 DESC NULLS LAST, 1 LIMIT 50""",
    "first_law": f"WITH {LAWS} SELECT law_id, law_key FROM l WHERE law_key IS NOT NULL ORDER BY law_key, law_id LIMIT 1",
    "policy_rows": """SELECT 'public' AS policy, count(*) AS rows FROM folders UNION ALL SELECT 'denied', 0
UNION ALL SELECT 'owner', count(*) FROM folders WHERE user_id = (SELECT min(user_id) FROM folders)""",
    "key_queries": f"""WITH {LAWS}, {_MARKS}, k AS (SELECT list(DISTINCT law_key) AS k FROM l WHERE law_key IS NOT NULL),
t AS (SELECT law_key AS text FROM m UNION SELECT law_title FROM m UNION SELECT concat_ws(' ', law_key, law_key) FROM m),
w AS (SELECT text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM t WHERE text IS NOT NULL)
SELECT text, len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda x: NOT list_contains(k, x))) = 0 AS only_keys FROM w, k""",
    "spot_lookup": f"""WITH n AS (SELECT id, law_id, {trim('norm_id')} AS norm_id, row_number() OVER (PARTITION BY law_id ORDER BY id) AS n FROM norms WHERE law_id IS NOT NULL)
SELECT law_id, id FROM n WHERE n <= 100 AND trim(ltrim(trim(norm_id), '§')) = '1'""",
    "landmark_lines": """WITH x AS (SELECT trim(lower(unnest(string_split(text, chr(10)))), ' ') AS t FROM documents)
SELECT contains(t, 'table of contents') OR contains(t, 'back to top') OR length(t) < 5 AS landmark, count(*) AS lines FROM x GROUP BY 1""",
    "legacy_import": f"""WITH {_MARKS}, n AS (SELECT * FROM m WHERE folder_id IS NOT NULL {_FIRST}), o AS (SELECT * FROM m WHERE folder_id IS NULL {_FIRST}),
b AS (SELECT id, law_title, category, folder_id FROM n UNION ALL
  SELECT id, CASE WHEN trim(coalesce(law_title, ''), ' ') = '' THEN law_key ELSE law_title END, CASE WHEN trim(coalesce(category, ''), ' ') = '' THEN 'other' ELSE category END, 'ungrouped'
  FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id IS NOT DISTINCT FROM o.user_id AND n.law_key IS NOT DISTINCT FROM o.law_key AND n.norm_id = o.norm_id)) SELECT * FROM b""",
    "category_folders": f"""WITH {LAWS}, k(c, kind) AS (VALUES {', '.join(f"('{k}', '{s}')" for k, v in KINDS.items() for s in v)}),
a AS (SELECT {_CATEGORY} AS c, count(*) AS laws FROM l GROUP BY 1), f AS (SELECT {_CATEGORY} AS kind, count(DISTINCT id) AS folders FROM folders GROUP BY 1)
SELECT k.c AS law_category, k.kind, laws, folders FROM k JOIN a USING (c) JOIN f ON f.kind = k.kind""",
    "explanation_cache": f"""WITH {CORPUS}, {_MARKS}, e AS (SELECT law_key || '-' || norm_id AS name, min(id) AS explanation FROM c WHERE norm_title IS NOT NULL AND law_key IS NOT NULL AND norm_id IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT id, concat_ws('-', law_key, norm_id) AS name, synced FROM m) SELECT id, explanation IS NOT NULL AND coalesce(synced, false) AS hit, coalesce(CASE WHEN synced THEN explanation END, 0) AS explanation FROM a LEFT JOIN e USING (name)""",
    "vector_cache": f"""WITH n AS (SELECT id, law_id, {trim('norm_id')} AS norm_id, md5(coalesce(content, '')) AS h, embedding AS vec FROM norms),
c AS (SELECT law_id, norm_id, h AS ch FROM n WHERE law_id IS NOT NULL AND norm_id IS NOT NULL AND {usable('vec')} QUALIFY row_number() OVER (PARTITION BY law_id, norm_id ORDER BY id) = 1)
SELECT id, CASE WHEN ch IS NULL THEN 'miss' WHEN ch = h THEN 'hit' ELSE 'stale' END AS state, coalesce(ch = h, false) AS has_vector FROM n LEFT JOIN c USING (law_id, norm_id)""",
    "points_pending": f"""WITH g AS (SELECT law_id, count(*) AS needed, count(*) FILTER ({usable('embedding')}) AS there FROM norms WHERE law_id IS NOT NULL GROUP BY 1)
SELECT *, needed - there AS to_write FROM g WHERE there < needed""",
    "appended_turns": f"""WITH m AS (SELECT lower({trim('id')}) AS id, lower({trim('conversation_id')}) AS c, created_at, ingested_at FROM messages
  QUALIFY row_number() OVER (PARTITION BY lower({trim('id')}) ORDER BY ingested_at DESC NULLS LAST) = 1), x AS (SELECT *, coalesce(ingested_at >= TIMESTAMP '2024-07-01', false) AS new FROM m WHERE c IS NOT NULL)
SELECT id, c, row_number() OVER (PARTITION BY c ORDER BY new, created_at NULLS FIRST, id) AS number FROM x WHERE NOT new OR c IN (SELECT c FROM x WHERE NOT new)""",
    "objection_dates": f"SELECT DISTINCT id, strftime({_date('incident_date')} + INTERVAL 30 DAY, '%Y-%m-%d') AS until FROM folders",
    "touched_merge": f"""WITH o AS (SELECT DISTINCT {trim('law_key')} AS law_key FROM law_versions WHERE snap_no = (SELECT max(snap_no) FROM law_versions) AND {trim('law_key')} IS NOT NULL),
n AS (SELECT DISTINCT {trim('law_key')} AS law_key FROM laws WHERE {trim('law_key')} IS NOT NULL)
SELECT law_key, 'new' AS origin, '2025-03-01 00:00:00' AS updated_at FROM n UNION ALL SELECT law_key, 'old', NULL FROM o WHERE law_key NOT IN (SELECT law_key FROM n)""",
    "retained_events": """WITH x AS (SELECT event_type, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS kept FROM events)
SELECT event_type, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS gone FROM x GROUP BY 1""",
    "nested_json": """WITH n AS (SELECT law_id, id, length(coalesce(content, '')) AS chars FROM norms WHERE law_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY law_id ORDER BY id) <= 5)
SELECT law_id, '[' || string_agg('{"id":' || id || ',"chars":' || chars || '}', ',' ORDER BY id) || ']' AS norms FROM n GROUP BY 1""",
    "category_map": f"""WITH {LAWS}, g AS (SELECT coalesce({_CATEGORY}, 'other') AS category, count(*) AS laws FROM l GROUP BY 1)
SELECT category, laws, round(laws / sum(laws) OVER (), 6) AS share FROM g""",
    "projected_rows": f"""WITH {CORPUS} SELECT id, coalesce({trim('law_title')}, law_key, '') AS title, coalesce({_CATEGORY}, 'other') AS category, coalesce(norm_id, '') AS norm_id,
  substring(coalesce(content, ''), 1, 300) AS snippet FROM c""",
    "replaced_children": f"""WITH n AS (SELECT id, law_id, {trim('norm_id')} AS norm_id, coalesce({usable('embedding')}, false) AS ok, coalesce(loaded_at >= TIMESTAMP '2025-01-01', false) AS new FROM norms WHERE law_id IS NOT NULL),
g AS (SELECT DISTINCT law_id, norm_id FROM n WHERE NOT new AND ok AND norm_id IS NOT NULL)
SELECT id, ok AS has_vector FROM n WHERE NOT new AND law_id NOT IN (SELECT law_id FROM n WHERE new)
UNION ALL SELECT n.id, n.ok OR g.law_id IS NOT NULL FROM n LEFT JOIN g USING (law_id, norm_id) WHERE n.new""",
    "pushed_marks": f"WITH {_MARKS}, x AS (SELECT DISTINCT ON (id) * FROM m) SELECT user_id, count(*) AS synced, count(*) FILTER (NOT coalesce(synced, false)) AS pushed FROM x GROUP BY 1",
    "rate_limits": """SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS requests,
  greatest(count(*) - max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 3 END), 0) AS refused FROM events GROUP BY ALL""",
    "keyword_norms": f"""WITH {_PAIRS} SELECT b AS term, count(*) AS norms FROM (SELECT DISTINCT b FROM p) p JOIN norms n ON contains(lower(coalesce(content, '')), b) OR contains(lower(coalesce(title, '')), b) GROUP BY 1""",
}
