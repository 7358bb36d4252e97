"""Dictionary classifiers: of queries with margins, of records with penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import letters_only


def _covered(text: Column, keywords: Column) -> Column:
    """How many characters of a text lie in an occurrence of a keyword, overlapping ones included."""
    starts = lambda k: F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(k)) == k
    )
    spans = F.flatten(F.transform(keywords, lambda k: F.flatten(F.transform(starts(k), lambda i: F.sequence(i, i + F.length(k) - 1)))))
    return F.size(F.array_distinct(spans))


def detect_category(queries: DataFrame, dictionary: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(query_id, category, score) for every query; category is null where none is clear enough.

    queries: query_id, text; dictionary: category, keyword, weight, ord. A keyword counts wherever it occurs inside the
    text, and as often as it is listed. A narrow lead over the second category needs a higher score. Of equal scores
    the lower ord wins. Texts of fewer than three characters and null ones have no category. The dictionary is folded
    to one row of arrays per category first, so that each query meets each category once.
    """
    folded = dictionary.groupBy("category").agg(
        F.sort_array(F.collect_list(F.lower("keyword"))).alias("keywords"), F.max("weight").alias("weight"), F.min("ord").alias("ord")
    )
    entry = F.struct("ord", "category", "keywords", "weight")
    all_of = folded.agg(F.sort_array(F.collect_list(entry))).scalar()  # one array: the dictionary itself
    text = F.trim(F.lower(F.coalesce("text", F.lit(""))))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    base = queries.select("query_id", text.alias("t"), words.alias("n"))
    each = base.withColumn("e", F.explode(all_of)).withColumn(
        "hits", F.filter("e.keywords", lambda k: F.contains(F.col("t"), k))
    ).where((F.size("hits") > 0) & (F.length("t") >= 3))
    cover = _covered(F.col("t"), F.array_distinct("hits")) / F.length("t")
    density = F.least(F.lit(1.0), F.size("hits") / F.sqrt(F.greatest(F.col("n"), F.lit(1))))
    score = F.round(density * F.col("e.weight") * (0.5 + 0.5 * F.least(F.lit(1.0), cover * 3)), 9)
    scored = each.select("query_id", F.col("e.category").alias("category"), F.col("e.ord").alias("ord"), score.alias("score"))
    best = scored.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "category"))).alias("r")
    )
    top, second = -F.col("r")[0]["s"], F.coalesce(-F.try_element_at("r", F.lit(2))["s"], F.lit(0.0))
    margin = (top - second) / top
    needed = F.when(margin < 0.5, threshold + (1 - threshold) * (1 - margin * 2)).otherwise(F.lit(threshold))
    found = best.select("query_id", F.when(top >= needed, F.col("r")[0]["category"]).alias("category"), top.alias("score"))
    return queries.select("query_id").join(found, "query_id", "left")


def classify_records(records: DataFrame, dictionary: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """(id, title, category, confidence): two for each keyword in the text, less one for each generic term.

    records: id, title, text. `other` where no category scores or two tie; of equal scores the lower ord is the best.
    """
    folded = dictionary.groupBy("category").agg(F.sort_array(F.collect_list("keyword")).alias("keywords"), F.min("ord").alias("ord"))
    all_of = folded.agg(F.sort_array(F.collect_list(F.struct("ord", "category", "keywords")))).scalar()
    text = letters_only(F.col("text"))
    lost = F.size(F.filter(F.array(*[F.lit(g) for g in generic]), lambda g: F.contains(F.col("t"), g)))
    scores = F.array_sort(
        F.filter(
            F.transform(
                "dictionary",
                lambda e: F.struct(
                    (F.col("lost") - 2 * F.size(F.filter(e["keywords"], lambda k: F.contains(F.col("t"), k)))).alias("s"),
                    e["ord"].alias("ord"), e["category"].alias("category"),
                ),
            ),
            lambda x: x["s"] < 0,
        )
    )
    r = records.withColumn("dictionary", all_of).withColumn("t", text).withColumn("lost", lost).withColumn("r", scores)
    best = -F.get("r", F.lit(0))["s"]
    second = F.coalesce(-F.try_element_at("r", F.lit(2))["s"], F.lit(0))
    clear = (best >= 2) & (best - second >= 1)
    sure = F.least(F.lit(0.98), 0.55 + best / 12.0 + (best - second) / 10.0)
    unsure = F.least(F.lit(0.49), F.greatest(F.lit(0.1), best / 10.0))
    some = F.size("r") > 0
    return r.select(
        "id", "title",
        F.when(some & clear, F.get("r", F.lit(0))["category"]).otherwise("other").alias("category"),
        F.round(F.when(~some, F.lit(0.0)).when(clear, sure).otherwise(unsure), 6).alias("confidence"),
    )


def review_queue(classified: DataFrame, n: int = 50) -> DataFrame:
    """The n least certain records, then by title and id."""
    return classified.orderBy("confidence", "title", "id").limit(n)


def first_match(text: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    """The first rule with a keyword in the lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    result = F.lit(otherwise)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        result = F.when(hit, name).otherwise(result)
    return result


def category_words(titles: DataFrame, per_category: int, least: int = 5) -> DataFrame:
    """A dictionary (category, keyword, weight, ord) out of titles: the words of a category that occur in most titles.

    titles: category, title. Of equally frequent words the alphabetically first are taken.
    """
    words = titles.where(F.col("category").isNotNull() & (F.col("category") != "")).select(
        "category", F.explode(F.array_distinct(F.split(letters_only(F.col("title")), " "))).alias("keyword")
    )
    counted = words.where(F.length("keyword") >= least).groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.col("n").desc(), "keyword"))
    top = counted.withColumn("r", rank).where(F.col("r") <= per_category)
    order = F.dense_rank().over(Window.orderBy("category"))  # over the few rows of the dictionary
    return top.withColumn("ord", order).select("category", "keyword", F.lit(1.0).alias("weight"), "ord")
