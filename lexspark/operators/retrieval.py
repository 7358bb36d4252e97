"""Answering many search queries at once: dense pool, BM25, fusion, boosts, caps, tiers, grouping.

Every stage keeps `query_id` and is a function of DataFrames. Pools are bounded per query, so that all windows over a
query's pool are small; the corpus itself is only scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.lookup import light_stem, matches_search
from lexspark.functions.text import tokens
from lexspark.operators.topn import TopN
from lexspark.session import durable

K1, B, USUAL_LENGTH = 1.2, 0.75, 600.0
ALPHA = 0.85


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(qid: np.ndarray, best: TopN, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qid[best.row], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.float64())], names=["query_id", "id", name]
    )


def dense_topn(queries: DataFrame, rows: DataFrame, n: int, dim: int = 64, query_block: int = 4096, within: str | None = None) -> DataFrame:
    """(query_id, id, dense, place): the n rows with the greatest cosine, rounded to 6 digits; of equals the lower id.

    queries: query_id, vec; rows: id, vec, usable vectors only. With `within`, a column of both sides, a query that has a value
    there is compared with rows of this value alone, before the ranking; one that has none with all rows. Queries go to the tasks in blocks of a fixed size, one
    pass over the rows for each; a task keeps n rows per query, so that only these are shuffled, never vectors.
    """
    spark = rows.sparkSession
    # 0 stands for no value; two values of one hash are as likely as a broken disk
    group = F.lit(0).cast("long") if within is None else F.coalesce(F.when(F.col(within).isNotNull(), F.xxhash64(within)), F.lit(0))
    parts = max(1, ceil(queries.count() / query_block))
    found = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        t = mine.select("query_id", "vec", group.alias("g")).toArrow().combine_chunks()
        qx = _matrix(t["vec"].combine_chunks(), dim) if t.num_rows else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast((t["query_id"].to_numpy(), qx, t["g"].to_numpy()))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qx, wanted = shared.value
            best = TopN(len(qid), n)
            for b in batches:
                if not b.num_rows or not len(qid):
                    continue
                x, ids, own = _matrix(b.column("vec"), dim), b.column("id").to_numpy(), b.column("g").to_numpy(zero_copy_only=False)
                for s in range(0, len(x), 2048):
                    c = np.round(qx @ x[s : s + 2048].T, 6)
                    if within is not None:
                        c[(wanted[:, None] != 0) & (wanted[:, None] != own[None, s : s + 2048])] = -np.inf
                    best.add(c, ids[s : s + 2048])
            yield _rows(qid, best, "dense")

        one = rows.select("id", "vec", group.alias("g")).mapInArrow(work, "query_id long, id long, dense double")
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("dense").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= n)


def term_weight(tf: Column, length: Column) -> Column:
    """Saturated frequency of a term in a text of `length` tokens."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / USUAL_LENGTH))


def rarity(n: Column, df: Column) -> Column:
    """Inverse document frequency, positive for every term."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_pool(pool: DataFrame, text: str, terms: str) -> DataFrame:
    """`pool` with `bm25`: statistics within each query's pool, 0 where no term occurs.

    pool: query_id, id, the text and the query's array of terms. Duplicate ids in a pool count once each.
    """
    words = tokens(F.col(text))
    counted = pool.withColumn("_len", F.size(words)).withColumn("_words", words)
    each = counted.select(
        "query_id", "id", "_len", F.explode(terms).alias("term"), "_words"
    ).withColumn("tf", F.size(F.filter("_words", lambda w: w == F.col("term"))))
    by_term = Window.partitionBy("query_id", "term")
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    df = F.sum((F.col("tf") > 0).cast("long")).over(by_term)
    scored = (
        each.withColumn("df", df)
        .where(F.col("tf") > 0)
        .join(sizes, "query_id")
        .groupBy("query_id", "id")
        .agg(F.sum(rarity(F.col("_n"), F.col("df")) * term_weight(F.col("tf"), F.col("_len"))).alias("bm25"))
    )
    return pool.join(scored, ["query_id", "id"], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 6))


def bm25_topn(docs: DataFrame, queries: DataFrame, n: int, query_block: int = 1024, term_block: int = 1_000_000) -> DataFrame:
    """(query_id, id, bm25, place) over the whole corpus, rounded to 6 digits. docs: id, text; queries: query_id, terms.

    First one pass over the corpus counts the texts that have each term of the queries (one for every `term_block` terms,
    which is what tasks are sent at once), then one pass for each block of queries scores: words are hashed in the JVM, and a
    task adds up the weights of its texts for all queries of a block at once, through lists of the queries that have a term.
    Only n rows per query and task are shuffled. Texts without a term of a query have no score for it.
    """
    spark = docs.sparkSession
    hashed = docs.select("id", F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    wanted = queries.select("query_id", F.explode("terms").alias("t")).select("query_id", F.xxhash64("t").alias("h")).distinct()
    pairs = wanted.toArrow()
    asked_by, of = pairs["query_id"].to_numpy(), pairs["h"].to_numpy()
    every = np.unique(of)
    df = np.zeros(len(every))
    total = 0
    for s in range(0, max(len(every), 1), term_block):
        shared = spark.sparkContext.broadcast(every[s : s + term_block])
        counted = hashed.mapInArrow(partial(_frequencies, shared=shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        at, count = counted["term"].to_numpy(), counted["n"].to_numpy()
        df[s + at[at >= 0]] = count[at >= 0]
        total = int(count[at < 0].sum())
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    ids = np.unique(asked_by)
    found = None
    for s in range(0, max(len(ids), 1), query_block):
        qid = ids[s : s + query_block]
        mine = np.isin(asked_by, qid)
        terms, tcol = np.unique(of[mine], return_inverse=True)
        order = np.argsort(tcol, kind="stable")
        lists = np.searchsorted(tcol[order], np.arange(len(terms) + 1)), np.searchsorted(qid, asked_by[mine])[order]
        ready = spark.sparkContext.broadcast((qid, terms, idf[np.searchsorted(every, terms)], lists))
        one = hashed.mapInArrow(partial(_scores, shared=ready, n=n), "query_id long, id long, bm25 double")
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= n)


def _known(b: pa.RecordBatch, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency) of the terms that occur, and the length of each text."""
    w = b.column("w")
    ends = w.offsets.to_numpy().astype("i8")
    size = np.diff(ends)
    flat = w.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    k = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    row = np.repeat(np.arange(b.num_rows), size)
    hit = terms[k] == flat
    cell, tf = np.unique(row[hit] * len(terms) + k[hit], return_counts=True)
    return cell // len(terms), cell % len(terms), tf, size


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """How many texts have each term, and under -1 how many there are."""
    terms = shared.value
    n, rows = np.zeros(len(terms), "i8"), 0
    for b in batches:
        rows += b.num_rows
        if len(terms) and b.num_rows:
            n += np.bincount(_known(b, terms)[1], minlength=len(terms))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1], pa.int64()), pa.array(np.r_[n[some], rows], pa.int64())], names=["term", "n"])


def _scores(batches: Iterator[pa.RecordBatch], shared, n: int) -> Iterator[pa.RecordBatch]:
    qid, terms, idf, (start, asked) = shared.value
    best = TopN(len(qid), n)
    for b in batches:
        if not len(terms) or not b.num_rows:
            continue
        row, term, tf, size = _known(b, terms)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / USUAL_LENGTH)) * idf[term]
        ids = b.column("id").to_numpy()
        for s in range(0, b.num_rows, 512):
            part = slice(*np.searchsorted(row, (s, s + 512)))
            many = (start[term + 1] - start[term])[part]
            e = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start[term[part]], many)
            rows = min(512, b.num_rows - s)
            cell = asked[e] * rows + np.repeat(row[part] - s, many)
            scores = np.bincount(cell, np.repeat(weight[part], many), minlength=len(qid) * rows).reshape(len(qid), rows)
            best.add(np.round(scores, 6), ids[s : s + 512], least=0.0)
    yield _rows(qid, best, "bm25")


def fuse(pool: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """`pool` with `fused`: both scores over their greatest in the pool, weighted; `dense` where the query has no terms."""
    q = Window.partitionBy("query_id")
    top = lambda c: F.greatest(F.max(c).over(q), F.lit(0.001))
    mixed = alpha * F.col("dense") / top("dense") + (1 - alpha) * F.col("bm25") / top("bm25")
    return pool.withColumn("fused", F.when(F.size("terms") > 0, mixed).otherwise(F.col("dense")))


def keyword_boost(pool: DataFrame, keywords: str, searched: Column) -> DataFrame:
    """`boosted`: a tenth more for each keyword inside the searched text, half more at most."""
    hits = F.size(F.filter(keywords, lambda k: F.lower(searched).contains(k)))
    return pool.withColumn("boosted", F.col("fused") * (1 + F.least(F.lit(0.1) * hits, F.lit(0.5))))


def diversify(pool: DataFrame, group: str, k: int) -> DataFrame:
    """The k best with at most max(3, a quarter of k) of a group; groups with many hits gain up to a fifth.

    Hits are counted before the cap; the cap keeps the first by `boosted`; of equals the lower id.
    """
    g = Window.partitionBy("query_id", group)
    rank = F.row_number().over(g.orderBy(F.col("boosted").desc(), "id"))
    score = F.col("boosted") * (1 + F.least(F.lit(0.2), 0.02 * (F.count(F.lit(1)).over(g) - 1)))
    capped = pool.withColumns({"score": F.round(score, 6), "_rank": rank}).where(F.col("_rank") <= max(3, ceil(k * 0.25)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return capped.withColumn("place", place).where(F.col("place") <= k).drop("_rank")


def group_hits(rows: DataFrame, group: str, order: list[Column], shown: int = 3) -> DataFrame:
    """(query_id, group, hits, relevance, norms): hits of a group, its best score in per cent, its first `shown` ids."""
    g = Window.partitionBy("query_id", group)
    ranked = rows.withColumns({"_n": F.row_number().over(g.orderBy(*order)), "hits": F.count(F.lit(1)).over(g), "top": F.max("score").over(g)})
    return (
        ranked.where(F.col("_n") <= shown)
        .groupBy("query_id", group)
        .agg(
            F.max("hits").alias("hits"),
            F.floor(F.greatest(F.max("top"), F.lit(0.0)) * 100 + 0.5).cast("long").alias("relevance"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "id"))), lambda s: s["id"].cast("string")), ",").alias("norms"),
        )
    )


def similar_grams(queries: DataFrame, laws: DataFrame, least: float) -> DataFrame:
    """(query_id, law_id) whose sets of grams share at least `least` of all their grams. queries: query_id, grams; laws: law_id,
    grams. Sides meet in common grams, which are counted; sets that differ too much in size are not."""
    left = queries.select("query_id", F.size("grams").alias("_m"), F.explode("grams").alias("_g"))
    right = laws.select("law_id", F.size("grams").alias("_n"), F.explode("grams").alias("_g"))
    sized = left.join(right, (left["_g"] == right["_g"]) & (F.col("_n") >= least * F.col("_m")) & (F.col("_m") >= least * F.col("_n")))
    shared = sized.groupBy("query_id", "law_id", "_m", "_n").agg(F.count(F.lit(1)).alias("_both"))
    return shared.where(F.col("_both") / (F.col("_m") + F.col("_n") - F.col("_both")) >= least).select("query_id", "law_id")


def gated(tier: DataFrame, so_far: DataFrame, fewer_than: int) -> DataFrame:
    """Rows of `tier` for queries with fewer than that many rows so far."""
    full = so_far.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewer_than)
    return tier.join(full, "query_id", "left_anti")


def occurring(rows: DataFrame, id_: str, cols: list[str], texts: DataFrame, text: str, block_chars: int = 4_000_000) -> DataFrame:
    """(text, id_): the distinct `texts` and the rows that have them in any of the columns, without regard to case.

    All texts are looked for at once by an automaton in one pass over the rows, for each block of texts of at most
    `block_chars` characters, which bounds what tasks are sent. Null texts are left out, an empty one is in every row.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_].dataType.simpleString()
    asked = texts.select(F.lower(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    lower = rows.select(id_, *[F.lower(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)])

    def passed(block: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, p in enumerate(patterns):
                if p:
                    automaton.add_word(p, i)
            automaton.make_automaton()
            empty = [i for i, p in enumerate(patterns) if not p]
            for b in batches:
                at, which = [], []
                columns = [b.column(1 + i).to_pylist() for i in range(b.num_columns - 1)]
                for r in range(b.num_rows):
                    hits = set(empty)
                    for c in columns:
                        if c[r] and len(automaton):
                            hits.update(i for _, i in automaton.iter(c[r]))
                    at += [r] * len(hits)
                    which += hits
                yield pa.RecordBatch.from_arrays(
                    [pa.array([patterns[i] for i in which], pa.string()), b.column(0).take(pa.array(at, pa.int64()))], names=[text, id_]
                )

        return lower.mapInArrow(work, f"`{text}` string, `{id_}` {kind}")

    found, block, size = None, [], 0
    for r in asked.toLocalIterator():
        if block and size + len(r["t"]) > block_chars:
            found, block, size = passed(block) if found is None else found.unionByName(passed(block)), [], 0
        block.append(r["t"])
        size += len(r["t"]) + 1
    last = passed(block)
    return last if found is None else found.unionByName(last)


def containing(rows: DataFrame, id_: str, cols: list[str], queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id_): the n rows with the lowest ids that have the text of a query in any of the columns, without regard to case.

    queries: query_id, text. Each text is looked for once, and all of them in one pass (`occurring`).
    """
    found = occurring(rows, id_, cols, queries, "text")
    place = F.row_number().over(Window.partitionBy("text").orderBy(id_))
    first = found.distinct().withColumn("_place", place).where(F.col("_place") <= n).select(F.col("text").alias("_t"), id_)
    return queries.select("query_id", F.lower("text").alias("_t")).join(first, "_t").select("query_id", id_)


def full_text(rows: DataFrame, id_: str, text: Column, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id_): the n rows with the lowest ids whose text meets the search of a query (`matches_search`).

    Every choice of a search needs its longest wanted word, so that only rows with this word are looked at.
    """
    stems = lambda c: F.transform(tokens(c), light_stem)
    wanted = lambda g: F.regexp_replace(g, r'(^|\s)-("[^"]*"|\S+)', " ")
    longest = lambda g: F.array_max(F.transform(stems(wanted(g)), lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    words = rows.select(id_, text.alias("_text")).withColumn("_w", F.explode(F.array_distinct(stems(F.col("_text")))))
    texts = queries.select("text").distinct()
    asked = texts.select("text", F.explode(F.array_distinct(F.transform(F.split("text", r"(?i)\s+or\s+"), longest))).alias("_w"))
    hit = words.join(asked, "_w").where(matches_search(F.col("_text"), F.col("text"))).select("text", id_).distinct()
    place = F.row_number().over(Window.partitionBy("text").orderBy(id_))
    first = hit.withColumn("_place", place).where(F.col("_place") <= n)
    return queries.select("query_id", "text").join(first, "text").select("query_id", id_)


def cascade(queries: DataFrame, search: DataFrame, norms: DataFrame, laws: DataFrame, few: int = 3, short: int = 20) -> DataFrame:
    """(query_id, tier, id, law_id, law_key, score): all tiers of a search, one appended to the other; tiers may repeat a law.

    abbreviation 0.95: laws whose key is a word of the query; search: rows of the search with their scores; norm 0.65: for
    queries with fewer than `few` rows of the search, norms with the text of the query in content, title or norm_id; full text
    0.9: laws that meet the query; law 0.5: for queries without any row, laws with the text in title, other title or key. Where
    a key is named, a query of at most `short` characters has no other tier.

    queries: query_id, text; search: query_id, id, law_key, score; norms: id, law_key, norm_title, norm_id, content; laws:
    law_id, law_key, law_title, alt_title. At most 20 rows of each tier and query, 50 of the full text.
    """
    asked = queries.where(F.trim("text") != "").select("query_id", "text")
    keys = laws.select("law_id", "law_key").where(F.col("law_key").isNotNull())
    words = F.array_union(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+(?:[-/_][\p{L}\p{N}]+)*"), 0))
    named = asked.select("query_id", F.explode(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))).alias("law_key")).join(keys, "law_key")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("law_id"))
    named = named.withColumn("_place", place).where(F.col("_place") <= 20).select("query_id", "law_id")
    rest = asked.join(named.select("query_id", F.lit(True).alias("_named")).distinct(), "query_id", "left")
    rest = rest.where(F.col("_named").isNull() | (F.length("text") > short)).select("query_id", "text")

    def of_laws(found: DataFrame, tier: str, score: float) -> DataFrame:
        return found.join(laws.select("law_id", "law_key"), "law_id").select(
            "query_id", F.lit(tier).alias("tier"), F.lit(None).cast("long").alias("id"), "law_id", "law_key", F.lit(score).alias("score")
        )

    def of_norms(found: DataFrame, tier: str) -> DataFrame:
        none = F.lit(None).cast("long").alias("law_id")
        return found.select("query_id", F.lit(tier).alias("tier"), "id", none, "law_key", "score")

    searched = search.join(rest, "query_id", "left_semi")
    weak = containing(norms, "id", ["content", "norm_title", "norm_id"], gated(rest, searched, few), 20)
    weak = weak.join(norms.select("id", "law_key"), "id").withColumn("score", F.lit(0.65))
    title = F.concat_ws(" ", "law_key", "law_title", "alt_title")
    # each tier is found once, the gate of the last one needs them all
    so_far = durable(
        of_laws(named, "abbreviation", 0.95).unionByName(of_norms(searched, "search")).unionByName(of_norms(weak, "norm"))
        .unionByName(of_laws(full_text(laws, "law_id", title, rest, 50), "full text", 0.9))
    )
    last = containing(laws, "law_id", ["law_title", "alt_title", "law_key"], gated(rest, so_far, 1), 20)
    return so_far.unionByName(of_laws(last, "law", 0.5))


def homogeneity(rows: DataFrame, group: str) -> DataFrame:
    """(query_id, share, top): share of the commonest group among a query's rows, and the best score."""
    per = rows.groupBy("query_id", group).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    return per.groupBy("query_id").agg(
        F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.max("top").alias("top")
    )


def widened(first: DataFrame, second: DataFrame, flagged: DataFrame, group: str) -> DataFrame:
    """`first`, and for the queries of `flagged` the best row of each group of `second` that `first` does not have.

    first, second: query_id, id, group, score. Rows that are added are marked by `added`.
    """
    new = second.join(flagged.select("query_id").distinct(), "query_id", "left_semi").join(first.select("query_id", group).distinct(), ["query_id", group], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.col("score").desc(), "id"))
    best = new.withColumn("_n", rank).where(F.col("_n") == 1).drop("_n")
    return first.withColumn("added", F.lit(False)).unionByName(best.select(*first.columns).withColumn("added", F.lit(True)))
