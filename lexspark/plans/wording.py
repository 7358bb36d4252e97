"""Text forms, dictionaries and classifiers over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions.dialog import chat_markup
from lexspark.functions.lookup import matches_search, translated_terms
from lexspark.functions.notation import stripped
from lexspark.functions.vectors import hash_slot
from lexspark.operators.classify import category_words, classify_records, detect_category, review_queue
from lexspark.operators.corpus import sections, stitch_paragraphs
from lexspark.plans.common import CORPUS, LAWS, corpus, current_laws, newest, trim
from lexspark.sources.tables import table

GERMAN = ("der", "die", "das", "und", "ist", "nicht", "sie", "den", "von", "mit", "dem", "für", "ein", "eine", "wenn", "oder", "auf", "zu", "im", "des")
GENERIC = ("gesetz", "verordnung", "regelung")
TEMPLATE = "An {{court}}, Aktenzeichen {{number}}: {{name}} gegen {{opponent}} ({{unknown}})"


def passages(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded for each norm, as length and digest, with its deterministic id."""
    p = T.passage(F.col("law_title"), F.col("norm_title"), F.col("content"))
    ident = T.point_id(F.lit("norm"), F.coalesce("law_key", F.lit("")), F.coalesce("norm_id", F.lit("")))
    return corpus(spark, d).select("id", ident.alias("point_id"), F.length(p).cast("long").alias("chars"), T.client_hash(p).alias("digest"))


def norm_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Norm ids without section signs, and official forms of English ones."""
    n = stripped(F.col("norm_id"))
    english = F.regexp_replace(n, "^§", "Section")
    return table(spark, d, "norms").select(
        "id", T.bare_norm_id(n).alias("bare"), T.official_section(english).alias("official"), T.word_count(F.col("content")).alias("words")
    )


def law_names(spark: SparkSession, d: str) -> DataFrame:
    """Slug, encoded title, key without year, folder name of the source."""
    return table(spark, d, "laws").join(current_laws(spark, d).select(F.col("law_id").alias("id"), "loaded"), "id").select(
        "id", T.slug(F.col("title")).alias("slug"), T.without_year(stripped(F.col("law_key"))).alias("short_key"),
        T.safe_name(F.col("source")).alias("folder"),
    ).distinct()


def language_share(spark: SparkSession, d: str) -> DataFrame:
    """Whether more than three tenths of a document's words are common German ones."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    share = F.round(T.share_of(words, GERMAN), 6)
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", share.alias("share"), (share > 0.3).alias("german"))


def secret_flags(spark: SparkSession, d: str) -> DataFrame:
    """Messages as they may be shown: a fixed text in place of those with an access key, without hidden thoughts."""
    shown = F.when(T.has_secret(F.col("content")), "[removed]").otherwise(T.hidden_thoughts_removed(F.col("content")))
    return table(spark, d, "messages").groupBy("id").agg(F.min(shown).alias("shown"))


def filled_templates(spark: SparkSession, d: str) -> DataFrame:
    """A letter for each folder; missing values are named as such, unknown places stay."""
    some = lambda c: F.coalesce(stripped(F.col(c)), F.lit(f"[{c}]"))
    values = F.create_map(
        F.lit("court"), some("court_name"), F.lit("number"), some("case_number"), F.lit("name"), some("name"),
        F.lit("opponent"), some("opposing_party"),
    )
    return table(spark, d, "folders").distinct().select("id", T.filled(F.lit(TEMPLATE), values).alias("letter"), T.title_case(F.col("status")).alias("status"))


def sparse_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hashed term counts of each norm. The slot is a hash, which SQL elsewhere does not have: rows only."""
    words = table(spark, d, "norms").select("id", F.explode(T.tokens(F.col("content"))).alias("w"))
    return words.groupBy("id", hash_slot(F.col("w")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def numbered_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each norm by number; lines without number belong to the one before."""
    p = table(spark, d, "norms").select("id", F.posexplode(stitch_paragraphs(F.col("content"))).alias("place", "p"))
    return p.select("id", F.col("place").cast("long").alias("place"), "p.number", "p.text")


def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of marked-up documents, cut where a paragraph begins a new matter."""
    docs = table(spark, d, "documents").where(F.col("text").contains("<p"))
    return sections(docs, "doc_id", "text", "^(Zwischen|Seit|Nachdem|Mein|Der|Die|Das)")


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    titles = current_laws(spark, d).select(F.lower(stripped(F.col("category"))).alias("category"), F.col("law_title").alias("title"))
    return category_words(titles, 12)


def detect_categories(spark: SparkSession, d: str) -> DataFrame:
    """The category of each question, by a dictionary out of the titles of the laws."""
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question_text").alias("text"))
    return detect_category(asked, _dictionary(spark, d)).select("query_id", "category", F.round("score", 6).alias("score"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    laws = current_laws(spark, d)
    records = laws.select(F.col("law_id").alias("id"), F.col("law_title").alias("title"), F.concat_ws(" ", "law_title", "law_key", "alt_title").alias("text"))
    return classify_records(records, _dictionary(spark, d), GENERIC)


def ingest_classify(spark: SparkSession, d: str) -> DataFrame:
    """Category and confidence of every law."""
    return _classified(spark, d)


def review_least_certain(spark: SparkSession, d: str) -> DataFrame:
    """The 50 laws whose category is least certain."""
    return review_queue(_classified(spark, d))


#: Terms of the questions with their German forms.
TERMS = (("housing", "wohnung"), ("assessment", "bescheid"), ("insurance", "versicherung"), ("pension", "rente"), ("pension concession", "rentenerlaubnis"),
         ("broadcasting", "rundfunk"), ("registration", "eintragung"), ("railway", "eisenbahn"), ("harbour", "hafen"), ("education", "schule"))
SEARCHES = ("Verordnung -Prüfung", '"Gesetz zur Regelung" Netz', "Archivordnung or Förderanspruch", "-Gesetz", "")


def term_translate(spark: SparkSession, d: str) -> DataFrame:
    """German forms of the terms of each question."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TERMS])
    return table(spark, d, "eval_items").select("item_id", translated_terms(F.col("question_text"), pairs).alias("german"))


def law_search(spark: SparkSession, d: str) -> DataFrame:
    """Laws that meet each of some searches with phrases, exclusions and choices."""
    asked = F.explode(F.array(*[F.lit(s) for s in SEARCHES])).alias("search")
    laws = current_laws(spark, d).select("law_id", F.concat_ws(" ", "law_key", "law_title", "alt_title").alias("t"), asked)
    return laws.where(matches_search(F.col("t"), F.col("search"))).select("search", "law_id")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events and the sum of their property `k`, by type; unreadable properties count as none."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(k), F.lit(0)).alias("k"))


def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every message once as ChatML, by length and digest."""
    m = newest(table(spark, d, "messages"), ["id"], "ingested_at")
    turn = chat_markup(F.coalesce(F.lower(stripped(F.col("role"))), F.lit("user")), F.col("content"))
    return m.select("id", F.length(turn).cast("long").alias("chars"), T.client_hash(turn).alias("digest"))


QUERIES = {
    "term_translate": term_translate, "law_search": law_search, "event_props": event_props, "chat_turns": chat_turns,
    "passages": passages, "norm_numbers": norm_numbers, "law_names": law_names, "language_share": language_share,
    "secret_flags": secret_flags, "filled_templates": filled_templates, "sparse_hash": sparse_hash,
    "numbered_paragraphs": numbered_paragraphs, "html_sections": html_sections, "detect_categories": detect_categories,
    "ingest_classify": ingest_classify, "review_least_certain": review_least_certain,
}

_PASSAGE = """'passage: ' || CASE WHEN coalesce(law_title, '') <> '' THEN law_title || '. ' ELSE '' END
  || CASE WHEN coalesce(norm_title, '') <> '' THEN norm_title || '. ' ELSE '' END || coalesce(substring(content, 1, 4000), '')"""
_SHA = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('norm:' || coalesce(law_key, '') || ':' || coalesce(norm_id, '')))"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
_LETTERS = "trim(regexp_replace(lower({}), '[^a-zäöüß]+', ' ', 'g'))"
_DICTIONARY = f"""{LAWS},
dw AS (SELECT category, w AS keyword, count(*) AS n FROM (SELECT law_id, lower({trim('category')}) AS category,
       unnest(list_distinct(string_split({_LETTERS.format("coalesce(law_title, '')")}, ' '))) AS w FROM l)
       WHERE category IS NOT NULL AND length(w) >= 5 GROUP BY ALL),
dt AS (SELECT * FROM dw QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, keyword) <= 12),
dc AS (SELECT category, list(keyword ORDER BY keyword) AS keywords, row_number() OVER (ORDER BY category) AS ord FROM dt GROUP BY 1)"""
_HITS = "list_filter(keywords, lambda k: contains(t, k))"
_COVER = ("len(list_distinct(flatten(list_transform(list_distinct(hits), lambda k: flatten(list_transform(list_filter(range(1, length(t) + 1), "
          "lambda i: substring(t, i, length(k)) = k), lambda i: range(i, i + length(k))))))))")  # fmt: skip
_CLASSIFIED = f"""WITH {_DICTIONARY},
r AS (SELECT law_id AS id, law_title AS title, {_LETTERS.format("concat_ws(' ', law_title, law_key, alt_title)")} AS t FROM l),
s AS (SELECT id, title, category, ord, 2 * len({_HITS}) - {' - '.join(f"contains(t, '{g}')::INT" for g in GENERIC)} AS s FROM r, dc),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, ord) AS n, lead(s, 1, 0) OVER (PARTITION BY id ORDER BY s DESC, ord) AS s2 FROM s WHERE s > 0),
f AS (SELECT r.id, r.title, CASE WHEN k.s >= 2 AND k.s - k.s2 >= 1 THEN k.category ELSE 'other' END AS category,
      round(CASE WHEN k.s IS NULL THEN 0 WHEN k.s >= 2 AND k.s - k.s2 >= 1 THEN least(0.98, 0.55 + k.s / 12.0::DOUBLE + (k.s - k.s2) / 10.0::DOUBLE)
        ELSE least(0.49, greatest(0.1, k.s / 10.0::DOUBLE)) END::DOUBLE, 6) AS confidence FROM r LEFT JOIN k ON k.id = r.id AND k.n = 1)"""

_TURN = f"'<|im_start|>' || coalesce(lower({trim('role')}), 'user') || chr(10) || coalesce(content, '') || '<|im_end|>' || chr(10)"
# greedy by (place, length): a recursive walk over the found terms
_TRANSLATE = f"""WITH RECURSIVE d(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in TERMS)}),
f AS (SELECT item_id, instr(lower(question_text), a) AS at, length(a) AS n, b, row_number() OVER (PARTITION BY item_id ORDER BY instr(lower(question_text), a), length(a) DESC, b) AS r
      FROM eval_items, d WHERE contains(lower(question_text), a)),
w AS (SELECT item_id, 0::BIGINT AS r, 0::BIGINT AS e, []::VARCHAR[] AS o FROM eval_items UNION ALL
      SELECT w.item_id, f.r, CASE WHEN f.at > w.e THEN f.at + f.n - 1 ELSE w.e END, CASE WHEN f.at > w.e AND NOT list_contains(w.o, f.b) THEN list_append(w.o, f.b) ELSE w.o END
      FROM w JOIN f ON f.item_id = w.item_id AND f.r = w.r + 1)
SELECT item_id, array_to_string(arg_max(o, r), ' ') AS german FROM w GROUP BY 1"""

_NUMBER = "concat(" + ", ".join(f"regexp_extract(x, '^\\s*(?:\\((\\d+[a-z]?)\\)|(\\d+[a-z]?)[.)]\\s|§\\s*(\\d+[a-z]?))', {g})" for g in (1, 2, 3)) + ")"
_STEM = "CASE WHEN length(w) > 5 THEN regexp_replace(w, '(?:ungen|ung|ern|en|em|er|es|e|n|s)$', '') ELSE w END"


def _stemmed(t: str) -> str:
    return f"' ' || array_to_string(list_transform(regexp_extract_all(lower({t}), '[\\wäöüß]+'), lambda w: {_STEM}), ' ') || ' '"


def _meets(search: str) -> str:
    """The condition that the padded stems `p` meet a search."""
    choices = []
    for choice in re.split(r"(?i)\s+or\s+", search):
        parts = [x for x in re.findall(r'-?"[^"]*"|\S+', choice) if re.search(r"\w", x)]
        if any(not x.startswith("-") for x in parts):
            choices.append(" AND ".join(f"{'NOT ' if x.startswith('-') else ''}contains(p, {_stemmed(repr(x))})" for x in parts))
    return " OR ".join(f"({c})" for c in choices) or "false"


SQL = {
    "law_search": f"WITH {LAWS}, x AS (SELECT law_id, {_stemmed("concat_ws(' ', law_key, law_title, alt_title)")} AS p FROM l) "
    + " UNION ALL ".join(f"SELECT '{s}' AS search, law_id FROM x WHERE {_meets(s)}" for s in SEARCHES),
    "numbered_paragraphs": f"""WITH s AS (SELECT id, list_filter(regexp_split_to_array(coalesce(content, ''), '\\r\\n|\\n|\\r'), lambda x: trim(x, ' ') <> '') AS v FROM norms),
l AS (SELECT id, trim(unnest(v), ' ') AS x, generate_subscripts(v, 1) AS i FROM s), n AS (SELECT *, {_NUMBER} AS n FROM l),
g AS (SELECT *, sum((n <> '')::INT) OVER w AS seen FROM n WINDOW w AS (PARTITION BY id ORDER BY i)),
p AS (SELECT *, sum((n <> '' OR seen = 0)::INT) OVER (PARTITION BY id ORDER BY i) AS p FROM g)
SELECT id, p::BIGINT - 1 AS place, arg_min(CASE WHEN n <> '' THEN n ELSE (i - 1)::VARCHAR END, i) AS number, string_agg(x, chr(10) ORDER BY i) AS text FROM p GROUP BY id, p""",
    "html_sections": """WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?is)<p\\b[^>]*>(.*?)(?:</p>|$)', 1),
    lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS v FROM documents WHERE contains(text, '<p')),
l AS (SELECT doc_id, unnest(v) AS p, generate_subscripts(v, 1) AS i FROM s),
h AS (SELECT *, regexp_matches(p, '^(Zwischen|Seit|Nachdem|Mein|Der|Die|Das)') AS head FROM l WHERE p <> ''),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS section_no FROM h)
SELECT doc_id, section_no, max(p) FILTER (head) AS heading, coalesce(string_agg(p, ' ' ORDER BY i) FILTER (NOT head), '') AS body FROM n GROUP BY ALL""",
    "term_translate": _TRANSLATE,
    "event_props": "SELECT event_type, count(*) AS events, coalesce(sum(try_cast(props::JSON->>'k' AS BIGINT)), 0)::BIGINT AS k FROM events GROUP BY 1",
    "chat_turns": f"SELECT id, length(t) AS chars, substring(sha256(t), 1, 16) AS digest FROM (SELECT id, {_TURN} AS t FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)",
    "passages": f"""WITH {CORPUS}, p AS (SELECT id, {_PASSAGE} AS p, {_SHA} AS h FROM c)
SELECT id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
  substring('89ab', (('0x' || substring(h, 17, 1))::INT % 4) + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id,
  length(p) AS chars, substring(sha256(p), 1, 16) AS digest FROM p""",
    "norm_numbers": f"""WITH n AS (SELECT id, {trim('norm_id')} AS n, content FROM norms)
SELECT id, trim(ltrim(trim(n), '§')) AS bare, CASE WHEN regexp_matches(regexp_replace(n, '^§', 'Section'), '(?i)^\\s*section\\s+\\d')
  THEN '§ ' || regexp_extract(regexp_replace(n, '^§', 'Section'), '(?i)^\\s*section\\s+(\\d+[a-z]?)', 1) ELSE regexp_replace(n, '^§', 'Section') END AS official,
  len(regexp_extract_all(coalesce(content, ''), '\\S+')) AS words FROM n""",
    "law_names": f"""SELECT DISTINCT id, substring(lower(regexp_replace(title, '\\s+', '-', 'g')), 1, 40) AS slug,
  trim(regexp_replace({trim('law_key')}, '\\d{{4}}$', '')) AS short_key, regexp_replace(string_split(source, '/')[-2], '[^\\w.-]', '_', 'g') AS folder FROM laws""",
    "language_share": f"""WITH s AS (SELECT doc_id, round(coalesce(len(list_filter({_WORDS}, lambda w: list_contains([{', '.join(f"'{w}'" for w in GERMAN)}], w)))
  / nullif(len({_WORDS}), 0), 0), 6) AS share FROM documents WHERE text IS NOT NULL) SELECT *, share > 0.3 AS german FROM s""",
    "secret_flags": "SELECT id, min(CASE WHEN " + " OR ".join(f"coalesce(regexp_matches(content, '{p}'), false)" for p in T.SECRETS)
    + " THEN '[removed]' ELSE trim(regexp_replace(content, '(?s)<think>.*?</think>\\s*', '', 'g'), ' ') END) AS shown FROM messages GROUP BY id",
    "filled_templates": f"""SELECT DISTINCT id, 'An ' || coalesce({trim('court_name')}, '[court_name]') || ', Aktenzeichen ' || coalesce({trim('case_number')}, '[case_number]') || ': '
  || coalesce({trim('name')}, '[name]') || ' gegen ' || coalesce({trim('opposing_party')}, '[opposing_party]') || ' ({{{{unknown}}}})' AS letter,
  array_to_string(list_transform(string_split(replace(status, '_', ' '), ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') AS status FROM folders""",
    "detect_categories": f"""WITH {_DICTIONARY},
q AS (SELECT item_id AS query_id, trim(lower(question_text)) AS t FROM eval_items),
h AS (SELECT query_id, t, category, ord, {_HITS} AS hits FROM q, dc),
s AS (SELECT query_id, category, ord, round(least(1.0, len(hits) / sqrt(greatest(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')), 1)))
      * (0.5 + 0.5 * least(1.0, {_COVER} / length(t) * 3)), 9) AS s FROM h WHERE len(hits) > 0 AND length(t) >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ord) AS n, lead(s, 1, 0) OVER (PARTITION BY query_id ORDER BY s DESC, ord) AS s2 FROM s),
m AS (SELECT *, (s - s2) / s AS margin FROM k WHERE n = 1)
SELECT q.query_id, CASE WHEN s >= CASE WHEN margin < 0.5 THEN 0.2 + 0.8 * (1 - margin * 2) ELSE 0.2 END THEN category END AS category, round(s, 6) AS score
FROM q LEFT JOIN m USING (query_id)""",
    "ingest_classify": _CLASSIFIED + " SELECT * FROM f",
    "review_least_certain": _CLASSIFIED + " SELECT * FROM f ORDER BY confidence, title, id LIMIT 50",
}
