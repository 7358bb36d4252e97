"""What comes in and goes out as text: law files, lists, answers of models, addresses; each from text made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions.dialog import answer_field, answer_paths, without_prompt, wrapped_prompt
from lexspark.functions.embed import HashedWords, embed
from lexspark.functions.notation import stripped
from lexspark.operators import store
from lexspark.operators.classify import first_match
from lexspark.plans.common import LAWS, current_laws, newest, trim
from lexspark.plans.wording import sparse_hash
from lexspark.sources.law_files import contents, dictionary_of, parse_laws, paragraphs_of, still_to_fetch
from lexspark.sources.tables import table
from lexspark.streaming.windows import assembled


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _norms(spark: SparkSession, d: str) -> DataFrame:
    """law_id, id, norm_id, title, content of norms with plain text."""
    n = table(spark, d, "norms").select("law_id", "id", stripped(F.col("norm_id")).alias("norm_id"), F.trim("title").alias("title"), "content")
    return n.where(F.col("law_id").isNotNull() & F.col("content").rlike(r"^[\p{L}\p{N} .,;§()-]+$"))


def law_files(spark: SparkSession, d: str) -> DataFrame:
    """Laws as they are read from files in XML: key, title, how many norms, and the letters of their paragraphs."""
    norm = F.concat(
        F.lit("<norm doknr='"), F.col("id").cast("string"), F.lit("'><metadaten>"), F.coalesce(F.concat(F.lit("<enbez>"), _escaped(F.col("norm_id")), F.lit("</enbez>")), F.lit("")),
        F.coalesce(F.concat(F.lit("<titel>"), _escaped(F.col("title")), F.lit("</titel>")), F.lit("")),
        F.lit("</metadaten><textdaten><text><Content><P>"), _escaped(F.col("content")), F.lit("</P></Content></text></textdaten></norm>"),
    )
    each = _norms(spark, d).groupBy("law_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", norm.alias("x")))), lambda s: s["x"]), "").alias("norms"))
    head = F.concat(F.lit("<norm><metadaten><jurabk>"), _escaped(F.col("law_key")), F.lit("</jurabk><langue>"), _escaped(F.coalesce("law_title", F.lit(""))), F.lit("</langue></metadaten></norm>"))
    files = current_laws(spark, d).where(F.col("law_key").isNotNull()).join(each, "law_id", "left").select(
        F.col("law_id").alias("path"), F.concat(F.lit("<dokumente>"), head, F.coalesce("norms", F.lit("")), F.lit("</dokumente>")).alias("content")
    )
    letters = F.aggregate("norms", F.lit(0), lambda s, n: s + F.aggregate(n["paragraphs"], F.lit(0), lambda t, p: t + F.length(F.regexp_replace(p, r"\s+", ""))))
    return parse_laws(files).select(F.col("path").alias("law_id"), F.col("raw_key").alias("law_key"), F.col("title"), F.size("norms").cast("long").alias("norms"), letters.cast("long").alias("letters"))


def still_to_load(spark: SparkSession, d: str) -> DataFrame:
    """Laws of a table of contents in XML that no delivery has yet; items without title are left out."""
    item = F.concat(F.lit("<item><title>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</title><link>"), _escaped(F.coalesce(stripped(F.col("law_key")), F.lit(""))), F.lit("</link></item>"))
    files = table(spark, d, "laws").groupBy("category").agg(F.concat(F.lit("<items>"), F.array_join(F.collect_list(item), ""), F.lit("</items>")).alias("content"))
    had = table(spark, d, "law_versions").select(stripped(F.col("law_key")).alias("link")).where(F.col("link").isNotNull())
    return still_to_fetch(contents(files), had, "link").select(F.col("link").alias("law_key")).distinct()


def question_lists(spark: SparkSession, d: str) -> DataFrame:
    """The norms that answer each question, read from a list, one text or nothing."""
    raw = F.when(F.col("item_id") % 3 == 0, F.to_json("paragraphs")).when(F.col("item_id") % 3 == 1, F.get("paragraphs", F.lit(0)))
    return table(spark, d, "eval_items").select("item_id", F.array_join(paragraphs_of(raw), "|").alias("paragraphs"))


def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    """Titles of laws read back from lines of a dictionary; other lines are left out."""
    laws = current_laws(spark, d).where(F.col("law_key").rlike(r"^\w+$") & F.col("law_title").isNotNull())
    lines = laws.select(F.explode(F.array(F.concat(F.lit('  "'), "law_key", F.lit('": "'), "law_title", F.lit('",')), F.lit("// a note"))).alias("value"))
    return dictionary_of(lines, "value").select("key", "value").distinct()


def _said(spark: SparkSession, d: str) -> DataFrame:
    """id, content of each message once, those that JSON holds without escapes."""
    m = newest(table(spark, d, "messages"), ["id"], "ingested_at").select("id", F.trim("content").alias("t"))
    return m.where(F.col("t").rlike(r"^[\p{L}\p{N}][\p{L}\p{N} .,;§()-]*$"))


def plain_answers(spark: SparkSession, d: str) -> DataFrame:
    """The text of answers that come as JSON, in a fence, inside prose, or bare, with hidden thoughts before."""
    form = F.pmod(F.length("t"), F.lit(4))
    obj = F.concat(F.lit('{"translation": "'), "t", F.lit('"}'))
    raw = F.concat(
        F.lit("<think>let me see</think>\n"),
        F.when(form == 0, obj).when(form == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(form == 2, F.concat(F.lit("Here: "), obj, F.lit(" That is all."))).otherwise(F.col("t")),
    )
    return _said(spark, d).select("id", answer_field(raw, "translation").alias("answer"))


def answer_ways(spark: SparkSession, d: str) -> DataFrame:
    """The ways out that an answer names, numbered, with probabilities within 0 and 1 and a half where there is none."""
    n = F.length("t")
    p = F.when(n % 3 == 0, F.lit("null")).otherwise(F.format_string("%.2f", n / 50.0))
    raw = F.concat(F.lit('{"paths": [{"title": "'), "t", F.lit('", "success_probability": '), p, F.lit('}, {"summary": "x"}]}'))
    ways = _said(spark, d).select("id", F.inline(answer_paths(raw)))
    return ways.select("id", F.col("number").cast("long").alias("number"), "title", F.round("probability", 6).alias("probability"))


def stored_ways(spark: SparkSession, d: str) -> DataFrame:
    """The titles of the ways out, as nested JSON for storage."""
    raw = F.concat(F.lit('{"paths": [{"title": "'), "t", F.lit('"}]}'))
    return _said(spark, d).select("id", F.to_json(F.transform(answer_paths(raw), lambda p: F.struct(p["number"].alias("number"), p["title"].alias("title")))).alias("ways"))


def streamed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers put together from lines of JSON, a word a line, with one that cannot be read and the last one saying that it ends."""
    words = _said(spark, d).select("id", F.posexplode(F.split("t", "(?<= )")).alias("n", "w"))
    line = F.concat(F.lit('{"message": {"content": "'), "w", F.lit('"}, "done": false}'))
    ends = _said(spark, d).select("id", F.explode(F.array(F.struct(F.lit(-1).alias("n"), F.lit("{broken").alias("line")), F.struct(F.lit(2**30).alias("n"), F.lit('{"done": true}').alias("line")))).alias("e"))
    lines = words.select("id", "n", line.alias("line")).unionByName(ends.select("id", "e.n", "e.line"))
    return assembled(lines, "id", "n", "line").select("id", "answer", "done", "unreadable")


def thought_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether the part of an answer that has come so far ends inside a hidden thought."""
    whole = F.concat(F.lit("<think>"), F.substring("t", 1, 20), F.lit("</think>"), F.col("t"))
    return _said(spark, d).select("id", T.inside_thought(F.substring(whole, F.lit(1), F.pmod(F.length("t"), F.lit(60)) + 1)).alias("inside"))


def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    """What models of three families have added to their prompts, as length and digest of prompt and answer."""
    model = F.when(F.length("t") % 3 == 0, "qwen-7b").when(F.length("t") % 3 == 1, "Gemma-2").otherwise("other")
    prompt = wrapped_prompt(model, F.lit("Be brief."), F.col("t"))
    added = without_prompt(F.concat(prompt, F.lit(" answer "), F.col("id")), prompt)
    return _said(spark, d).select("id", T.client_hash(prompt).alias("prompt"), added.alias("answer"))


def client_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The address a request comes from, as digest: first hop, else the real one, else this machine."""
    u = F.col("user_id").cast("string")
    hops = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 1.1.1.1"))).when(F.col("event_id") % 3 == 1, F.lit(""))
    real = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("8.8.8."), u))
    found = table(spark, d, "events").select(T.client_hash(T.first_hop(hops, real)).alias("client"))
    return found.groupBy("client").agg(F.count(F.lit(1)).alias("requests"))


def local_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that point to this machine or a private network."""
    n = F.col("user_id")
    url = F.concat(F.lit("http://"), F.concat_ws(".", (n % 256).cast("string"), F.lit("16"), F.lit("0"), F.lit("1")), F.lit(":80/x"))
    return table(spark, d, "events").select("user_id").distinct().select("user_id", T.is_local_url(url).alias("local"))


RULES = [("energy", ("energie", "netz")), ("water", ("gewässer", "hafen")), ("forest", ("wald",))]


def first_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first rule with a keyword in a law's title and key."""
    return current_laws(spark, d).select("law_id", first_match(F.concat_ws(" ", "law_title", "law_key"), RULES, "other").alias("rule"))


def embedded_words(spark: SparkSession, d: str) -> DataFrame:
    """Titles embedded by the stand-in for a model: equal titles have equal vectors, those with words unit length."""
    t = current_laws(spark, d).select("law_id", "law_title").repartition(4)
    v = t.withColumn("v", embed(F.col("law_title"), HashedWords(64)))
    length = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 3)
    return v.groupBy("law_title").agg(F.count_distinct(F.to_json("v")).alias("vectors"), F.max(length).alias("length"), F.max(F.size("v")).cast("long").alias("dim"))


def removed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks that remain when those of deleted folders are removed by their keys."""
    marks = table(spark, d, "bookmarks").select("id", "folder_id").distinct()
    gone = table(spark, d, "folders").where(F.col("deleted_at").isNotNull()).select(F.col("id").alias("folder_id"))
    return store.delete_keys(marks, gone, ["folder_id"])


def merged_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Explanations by norm and language, new ones over old ones, a null language being one of its own."""
    n = table(spark, d, "norms").where(F.col("law_id").isNotNull()).select("law_id", F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 2 == 0, "de").otherwise("en")).alias("lang"), "id", "loaded_at")
    new = F.coalesce(F.col("loaded_at") >= F.lit("2024-09-01").cast("timestamp_ntz"), F.lit(False))
    one = lambda df: store.unique(df, ["law_id", "lang"], [F.col("id")])
    return store.upsert(one(n.where(~new)), one(n.where(new)), ["law_id", "lang"]).select("law_id", F.coalesce("lang", F.lit("-")).alias("lang"), "id")


def sparse_totals(spark: SparkSession, d: str) -> DataFrame:
    """Words of each norm by its hashed vector: their number is the sum of all slots."""
    return sparse_hash(spark, d).groupBy("id").agg(F.sum("n").alias("words"), F.count_if((F.col("slot") < 0) | (F.col("slot") >= 1 << 20)).alias("outside"))


QUERIES = {
    f.__name__: f
    for f in (
        law_files, still_to_load, question_lists, dictionary_entries, plain_answers, answer_ways, stored_ways, streamed_answers, thought_states,
        model_outputs, client_addresses, local_urls, first_rules, embedded_words, removed_keys, merged_explanations, sparse_totals,
    )
}

_SAID = f"""s AS (SELECT id, trim(content, ' ') AS t FROM messages WHERE regexp_full_match(trim(content, ' '), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}} .,;§()-]*')
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"""

SQL = {
    "law_files": f"""WITH {LAWS}, n AS (SELECT law_id, count(*) AS n, sum(length(regexp_replace(content, '\\s+', '', 'g')))::BIGINT AS letters FROM norms
  WHERE law_id IS NOT NULL AND regexp_full_match(content, '[\\p{{L}}\\p{{N}} .,;§()-]+') GROUP BY 1)
SELECT law_id, law_key, regexp_replace(trim(coalesce(law_title, '')), '\\s+', ' ', 'g') AS title, coalesce(n, 0) AS norms, coalesce(letters, 0) AS letters
FROM l LEFT JOIN n USING (law_id) WHERE law_key IS NOT NULL""",
    "still_to_load": f"""SELECT DISTINCT {trim('law_key')} AS law_key FROM laws WHERE trim(coalesce(title, ''), ' ') <> '' AND {trim('law_key')} IS NOT NULL
  AND {trim('law_key')} NOT IN (SELECT {trim('law_key')} FROM law_versions WHERE {trim('law_key')} IS NOT NULL)""",
    "question_lists": """SELECT item_id, CASE item_id % 3 WHEN 0 THEN array_to_string(paragraphs, '|') WHEN 1 THEN trim(coalesce(paragraphs[1], ''), ' ') ELSE '' END AS paragraphs FROM eval_items""",
    "dictionary_entries": f"WITH {LAWS} SELECT DISTINCT law_key AS key, law_title AS value FROM l WHERE regexp_full_match(law_key, '[a-zA-Z0-9_]+') AND law_title IS NOT NULL",
    "plain_answers": f"WITH {_SAID} SELECT id, t AS answer FROM s",
    "answer_ways": f"""WITH {_SAID} SELECT id, 1::BIGINT AS number, t AS title, CASE WHEN length(t) % 3 = 0 THEN 0.5 ELSE least(1.0, round(length(t) / 50.0, 2)) END::DOUBLE AS probability FROM s
UNION ALL SELECT id, 2, '', 0.5 FROM s""",
    "stored_ways": f"""WITH {_SAID} SELECT id, '[{{"number":1,"title":"' || t || '"}}]' AS ways FROM s""",
    "streamed_answers": f"WITH {_SAID} SELECT id, t AS answer, true AS done, 1::BIGINT AS unreadable FROM s",
    "thought_states": f"WITH {_SAID} SELECT id, length(t) % 60 + 1 BETWEEN 7 AND 7 + least(20, length(t)) + 7 AS inside FROM s",
    "model_outputs": f"""WITH {_SAID}, p AS (SELECT id, CASE length(t) % 3
  WHEN 0 THEN '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || t || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
  WHEN 1 THEN '<start_of_turn>user' || chr(10) || 'Be brief.' || chr(10) || chr(10) || t || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)
  ELSE 'Be brief.' || chr(10) || chr(10) || t END AS p FROM s) SELECT id, substring(sha256(p), 1, 16) AS prompt, 'answer ' || id AS answer FROM p""",
    "client_addresses": """WITH a AS (SELECT CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id WHEN event_id % 2 = 0 THEN '8.8.8.' || user_id ELSE '127.0.0.1' END AS a FROM events)
SELECT substring(sha256(a), 1, 16) AS client, count(*) AS requests FROM a GROUP BY 1""",
    "local_urls": "SELECT DISTINCT user_id, user_id % 256 IN (10, 127, 172) AS local FROM events",
    "first_rules": f"WITH {LAWS}, x AS (SELECT law_id, lower(concat_ws(' ', law_title, law_key)) AS t FROM l) SELECT law_id, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in RULES) + " ELSE 'other' END AS rule FROM x",
    "embedded_words": f"WITH {LAWS} SELECT law_title, 1::BIGINT AS vectors, CASE WHEN trim(coalesce(law_title, '')) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS length, 64::BIGINT AS dim FROM l GROUP BY 1",
    "removed_keys": "SELECT DISTINCT id, folder_id FROM bookmarks WHERE folder_id IS NULL OR folder_id NOT IN (SELECT id FROM folders WHERE deleted_at IS NOT NULL)",
    "merged_explanations": """WITH n AS (SELECT law_id, CASE WHEN id % 5 = 0 THEN '-' WHEN id % 2 = 0 THEN 'de' ELSE 'en' END AS lang, id, coalesce(loaded_at >= TIMESTAMP '2024-09-01', false) AS new FROM norms WHERE law_id IS NOT NULL)
SELECT law_id, lang, id FROM n QUALIFY row_number() OVER (PARTITION BY law_id, lang ORDER BY new DESC, id) = 1""",
    "sparse_totals": """SELECT id, len(regexp_extract_all(lower(content), '[\\wäöüß]+')) AS words, 0::BIGINT AS outside FROM norms WHERE len(regexp_extract_all(lower(content), '[\\wäöüß]+')) > 0""",
}
