import math

import pytest
from pyspark.sql import functions as F

from lexspark.operators import classify, corpus, evaluate, quality, retrieval, store
from lexspark.streaming.merge import merging


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def pool(spark, data):
    return spark.createDataFrame([(1, i, d, g) for i, d, g in data], "query_id long, id long, boosted double, grp string")


def test_cap_counts_before_and_ties_go_to_lower_ids(spark):
    p = pool(spark, [(i, 0.5, "a") for i in range(6)] + [(10, 0.1, "b")])
    got = retrieval.diversify(p, "grp", 10)
    assert rows(got, "id", "place") == [(0, 1), (1, 2), (2, 3), (10, 4)]
    assert got.where("id = 0").first()["score"] == pytest.approx(0.5 * 1.1)


@pytest.mark.parametrize(("k", "cap"), [(1, 1), (10, 3), (50, 13)])
def test_cap_of_one_group(spark, k, cap):
    assert retrieval.diversify(pool(spark, [(i, 1.0 / (i + 1), "a") for i in range(60)]), "grp", k).count() == min(cap, k)


def test_fusion_without_terms_or_matches(spark):
    df = spark.createDataFrame([(1, 1, 0.8, 0.0, []), (2, 1, 0.8, 0.0, ["x"]), (2, 2, 0.4, 0.0, ["x"])], "query_id long, id long, dense double, bm25 double, terms array<string>")
    assert [round(r[0], 4) for r in retrieval.fuse(df).orderBy("query_id", "id").select("fused").collect()] == [0.8, 0.85, 0.425]


def test_bm25_in_a_pool(spark):
    df = spark.createDataFrame([(1, 1, "miete miete haus", ["miete"]), (1, 2, "haus", ["miete"]), (1, 3, None, ["miete"])], "query_id long, id long, t string, terms array<string>")
    got = dict(rows(retrieval.bm25_pool(df, "t", "terms"), "id", "bm25"))
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got == {1: round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 600)), 6), 2: 0.0, 3: 0.0}


def test_bm25_over_a_corpus_and_an_empty_one(spark):
    docs = spark.createDataFrame([(1, "miete haus"), (2, "haus haus"), (3, ""), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(7, ["haus"]), (8, ["nie"]), (9, [])], "query_id long, terms array<string>")
    assert rows(retrieval.bm25_topn(docs, asked, 5), "query_id", "id", "place") == [(7, 1, 2), (7, 2, 1)]
    assert retrieval.bm25_topn(docs.where("id > 9"), asked, 5).count() == 0


def test_dense_ties_blocks_and_emptiness(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 2.0]) for i in range(8)], "id long, vec array<float>")
    q = v.where("id in (0, 6)").withColumnRenamed("id", "query_id")
    want = [(0, 0, 1), (0, 1, 2), (0, 2, 3), (6, 5, 1), (6, 6, 2), (6, 7, 3)]
    assert rows(retrieval.dense_topn(q, v, 3, 2), "query_id", "id", "place") == want
    assert rows(retrieval.dense_topn(q, v, 3, 2, query_block=1), "query_id", "id", "place") == want
    assert retrieval.dense_topn(q.where("query_id > 9"), v, 3, 2).count() == 0
    assert retrieval.dense_topn(q, v.where("id > 9"), 3, 2).count() == 0


def test_grouping_sums_hits(spark):
    df = spark.createDataFrame([(1, i, g, s) for i, (g, s) in enumerate([("a", 0.4), ("a", 1.8), ("b", 0.2), ("a", 0.1), ("a", 0.0)])], "query_id long, id long, g string, score double")
    got = rows(retrieval.group_hits(df, "g", [F.col("id")]))
    assert got == [(1, "a", 4, 180, "0,1,3"), (1, "b", 1, 20, "2")]


def test_gates(spark):
    t = spark.createDataFrame([(1, 5), (2, 6)], "query_id long, law_id long")
    so_far = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, law_id long")
    assert rows(retrieval.gated(t, so_far, 3)) == [(2, 6)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 2), (1, "b", 4), (1, "a", 9)], "query_id long, item string, place int")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "z")], "query_id long, item string")
    per = evaluate.ranking_metrics(ranked, wanted, (1, 3, 10))
    assert rows(per) == [(1, 2, 0.5, 0.0, 0.5, 1.0), (2, 1, 0.0, 0.0, 0.0, 0.0)]
    assert rows(evaluate.mean_metrics(per)) == [(2, 0.25, 0.0, 0.25, 0.5)]


WORDS = [("housing", "miete", 1.0, 1), ("housing", "kaution", 1.0, 1), ("labor", "lohn", 0.8, 2), ("labor", "lohn", 0.8, 2)]


def test_query_categories(spark):
    words = spark.createDataFrame(WORDS, "category string, keyword string, weight double, ord int")
    asked = [(1, "Miete und Kaution"), (2, "Lohn"), (3, "Lohn oder Miete bei langen Fragen ohne Ende und ohne klaren Sinn"), (4, "ab"), (5, ""), (6, None), (7, "nichts davon")]
    got = dict(rows(classify.detect_category(spark.createDataFrame(asked, "query_id long, text string"), words), "query_id", "category"))
    assert got == {1: "housing", 2: "labor", 3: None, 4: None, 5: None, 6: None, 7: None}


def test_record_categories(spark):
    words = spark.createDataFrame(WORDS[:3], "category string, keyword string, weight double, ord int")
    records = spark.createDataFrame([(1, "a", "Miete, Kaution"), (2, "b", "Miete Lohn"), (3, "c", "Gesetz Miete"), (4, "d", None)], "id long, title string, text string")
    got = classify.classify_records(records, words, ("gesetz",))
    assert rows(got, "id", "category", "confidence") == [(1, "housing", 0.98), (2, "other", 0.2), (3, "other", 0.1), (4, "other", 0.0)]
    assert [r["id"] for r in classify.review_queue(got, 2).collect()] == [4, 3]


def test_first_match(spark):
    c = classify.first_match(F.col("x"), [("a", ("eins",)), ("b", ("zwei", "eins"))], "other")
    df = spark.createDataFrame([("Zwei Eins",), ("zwei",), (None,)], "x string")
    assert [r[0] for r in df.select(c).collect()] == ["a", "b", "other"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "k", "xx"), (2, "k", "xxx"), (3, "k", "yyy"), (4, None, "z"), (5, None, "z")], "n long, k string, t string")
    assert rows(corpus.best_duplicate(df, ["k"], [F.length("t")], "n"), "n", "slot") == [(2, 1), (4, 4), (5, 5)]
    assert rows(corpus.drop_exact(df, ["k", "t"], "n"), "n") == [(1,), (2,), (3,), (4,)]
    assert rows(corpus.distinct_ids(df.where("k = 'k'").withColumn("g", F.lit(1)), ["g"], "k", "n"), "unique_id") == [("k",), ("k_",), ("k__",)]


def test_key_collisions(spark):
    df = spark.createDataFrame([("A 2001", 1), ("A 2002", 1), ("A 2002", 2), ("B 2003", 1), (None, 1)], "k string, at int")
    short = F.trim(F.regexp_replace("k", r"\d{4}$", ""))
    assert rows(corpus.resolve_keys(df, "k", short, "at"), "k", "key") == [("A 2001", "A 2001"), ("A 2002", "A 2002"), ("B 2003", "B")]


def test_paragraphs(spark):
    df = spark.createDataFrame([("Vorspruch\r\n(1) eins\nmehr\n\n2. zwei",), ("",), (None,)], "t string")
    got = [[tuple(p) for p in r[0]] for r in df.select(corpus.stitch_paragraphs(F.col("t"))).collect()]
    assert got == [[("0", "Vorspruch"), ("1", "(1) eins\nmehr"), ("2", "2. zwei")], [], []]


def test_sections(spark):
    html = "<p>vor</p><p class='x'><b>§ 1</b> A</p><p>eins</p><p>zwei <i>x</i></p><p>§ 2</p>"
    df = spark.createDataFrame([(1, html), (2, "ohne"), (3, None)], "id long, h string")
    assert rows(corpus.sections(df, "id", "h", "^§")) == [(1, 0, None, "vor"), (1, 1, "§ 1 A", "eins zwei x"), (1, 2, "§ 2", "")]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), (None, 2), ("c", 2)], "k string, v int")
    key = lambda r: (r[0] or "", r[1])
    got = sorted((tuple(r) for r in store.upsert(old, new, ["k"]).collect()), key=key)
    assert got == [(None, 2), ("a", 1), ("b", 2), ("c", 2)]
    again = sorted((tuple(r) for r in store.upsert(store.upsert(old, new, ["k"]), new, ["k"]).collect()), key=key)
    assert again == got
    kept = sorted((tuple(r) for r in store.insert_ignore(old, new, ["k"]).collect()), key=key)
    assert kept == [(None, 1), ("a", 1), ("b", 1), ("c", 2)]
    assert [r["k"] for r in store.delete_keys(old, new, ["k"]).collect()] == ["a"]


def test_patch_sets_named_fields_only(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, s string, n string")
    change = spark.createDataFrame([(1, ["n"], "ignored", None)], "id int, fields array<string>, s string, n string")
    assert rows(store.patch(old, change, "id", ["s", "n"]), "id", "s") == [(1, "a"), (2, "b")]
    assert {r["id"]: r["n"] for r in store.patch(old, change, "id", ["s", "n"]).collect()} == {1: None, 2: "y"}


def test_cascade_nested_owned_and_pages(spark):
    parents = spark.createDataFrame([(1, "u"), (2, "v"), (3, "u")], "id int, user string")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "c int, parent int")
    left, kids = store.cascade(parents, children, parents.where("id = 1"), "id", "parent")
    assert rows(left, "id") == [(2,), (3,)] and rows(kids, "c") == [(12,), (13,)]
    got = {r["id"]: [x["c"] for x in r["kids"]] for r in store.nested(parents, children, "id", "parent", -F.col("c"), ["c"], "kids").collect()}
    assert got == {1: [11, 10], 2: [12], 3: []}
    assert rows(store.owned_children(children, parents, "parent", "id", "user", "u"), "c") == [(10,), (11,)]
    assert [r["id"] for r in store.page(parents, [F.col("id")], 2, 2).collect()] == [3]
    assert store.page(parents, [F.col("id")], 0, 0).count() == 1


def test_commit_keeps_a_complete_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.current(spark, path) is None
    assert store.commit(spark.range(3), path) == 3
    assert store.commit(store.current(spark, path).where("id > 0"), path) == 2
    # a writer that broke off before its mark
    spark.range(9).write.parquet(f"{path}/v3")
    assert rows(store.current(spark, path)) == [(1,), (2,)]
    reader = store.current(spark, path)
    assert store.commit(store.current(spark, path).where("id > 1"), path) == 1
    assert rows(store.current(spark, path)) == [(2,)] and rows(reader) == [(1,), (2,)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v2", "v4"]
    assert store.commit(spark.range(0), path) == 0 and store.current(spark, path).count() == 0
    twice = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    with pytest.raises(ValueError):
        store.commit(twice, path, ["k"])
    assert store.deleted(spark.range(5), path, F.col("id") < 2) == 2 and rows(store.current(spark, path)) == [(2,), (3,), (4,)]


def test_merging_goes_on_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    work = merging(path, ["id"], [F.col("v")])
    work(spark.range(100).withColumn("v", F.lit(1)), 0)
    spark.range(3).withColumn("v", F.lit(9)).write.parquet(f"{path}/v2")  # the batch broke off while it was writing
    for _ in range(2):
        work(spark.range(99, 101).withColumn("v", F.lit(2)), 1)
        assert store.current(spark, path).groupBy("v").count().orderBy("v").collect() == [(1, 99), (2, 2)]


def test_points_go_on_where_they_were(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    first = store.write_points(df.where("id < 30").union(df.where("id < 3")), path, "id", 4)
    assert first == [0, 1, 2, 3] and store.points(spark, path, 4).count() == 30
    assert store.write_points(df.where("id < 30"), path, "id", 4) == []
    store.write_points(df, path, "id", 4)
    assert rows(store.points(spark, path, 4)) == rows(df)


def test_rows_of_state(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "p int, c string, n long")
    fresh = spark.createDataFrame([(1, "d"), (1, "c"), (2, "x"), (3, "y"), (None, "z")], "p int, c string")
    got = store.append_children(kids, fresh, parents, "p", "id", [F.col("c")], "n")
    assert rows(got, "p", "c", "n") == [(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (2, "x", 1)]
    assert store.only(parents.where("id = 1"))["id"] == 1 and store.only(parents.where("id = 9")) is None
    with pytest.raises(ValueError):
        store.only(parents)
    assert tuple(store.page_count(spark.range(101), 50).first()) == (101, 3) and tuple(store.page_count(spark.range(0)).first()) == (0, 0)
    assert store.visible(parents, "denied").count() == 0 and store.visible(parents, "public").count() == 2
    cache = spark.createDataFrame([("a", "d1", 1), ("b", "d2", 2)], "k string, h string, v int")
    asked = spark.createDataFrame([("a", "d1"), ("b", "old"), ("c", "d"), (None, "d1"), ("a", None)], "k string, h string")
    got = store.validated_cache(asked, cache, ["k"], "h", "v")
    assert {(r["k"], r["h"], r["state"], r["v"]) for r in got.collect()} == {("a", "d1", "hit", 1), ("b", "old", "stale", None), ("c", "d", "miss", None), (None, "d1", "miss", None), ("a", None, "stale", None)}


def test_quality(spark):
    df = spark.createDataFrame([("a", "-"), ("a", None), ("a", "text"), ("b", "x" * 101), ("b", " ")], "g string, t string")
    assert rows(quality.empty_share(df, "g", "t")) == [("a", 3, 2, 0.666667), ("b", 2, 1, 0.5)]
    assert rows(quality.length_histogram(df, "t")) == [("0-100", 4), ("101-500", 1)]
    assert rows(quality.shares(df, "g")) == [("a", 3, 0.6), ("b", 2, 0.4)]
    st = spark.createDataFrame([("ok",), ("warn",), ("error",), ("warn",)], "status string")
    assert rows(quality.worst_status(st)) == [("error", 3)]


def test_mean_cosine_equals_pairs(spark):
    v = spark.createDataFrame([(i, i % 2, [float(i + 1), float(i * i % 5), 1.0]) for i in range(9)], "id long, g int, vec array<float>")
    pairs = {r["g"]: r["mean"] for r in quality.sampled_cosines(v, "g").collect()}
    assert {r["g"]: r["mean"] for r in quality.mean_cosines(v, "g").collect()} == pytest.approx(pairs, abs=1e-6)


def test_cascade_has_all_tiers(spark):
    asked = [(1, "Kostenrecht"), (2, "BauG Luftantrag der Gemeinde"), (3, "BauG"), (4, "sonderfall"), (5, "Strand"), (6, " "), (7, "Strand -Ordnung"), (8, "kurz or Hafen")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    search = spark.createDataFrame([(2, i, "X", 0.8) for i in (1, 2, 3)] + [(3, 1, "X", 0.8), (1, 9, "X", 0.7)], "query_id long, id long, law_key string, score double")
    norms = [(1, "X", "a", "1", "Vom KOSTENRECHT allgemein"), (2, "X", "Kostenrecht", "2", None), (3, "Y", "c", "Kostenrecht 3", ""), (4, "Y", "d", "4", "BauG Luftantrag der Gemeinde, BauG")]
    norms = spark.createDataFrame(norms, "id long, law_key string, norm_title string, norm_id string, content string")
    laws = [(10, "BauG", "Gesetz zum Bau", None), (11, "HfO", "Hafenordnung", "Strand und Hafen"), (12, "SFV", "Sonderfallverordnung", "")]
    laws = spark.createDataFrame(laws, "law_id long, law_key string, law_title string, alt_title string")
    got = retrieval.cascade(queries, search, norms, laws).collect()
    assert sorted((r["query_id"], r["tier"], r["id"] or r["law_id"], r["law_key"], r["score"]) for r in got) == [
        (1, "norm", 1, "X", 0.65), (1, "norm", 2, "X", 0.65), (1, "norm", 3, "Y", 0.65), (1, "search", 9, "X", 0.7),
        (2, "abbreviation", 10, "BauG", 0.95), (2, "search", 1, "X", 0.8), (2, "search", 2, "X", 0.8), (2, "search", 3, "X", 0.8),
        (3, "abbreviation", 10, "BauG", 0.95), (4, "law", 12, "SFV", 0.5), (5, "full text", 11, "HfO", 0.9),
        (7, "full text", 11, "HfO", 0.9), (8, "full text", 11, "HfO", 0.9),
    ]


def test_label_cosines_use_all_rows(spark):
    # the lowest ids are all alike, the others point elsewhere
    v = spark.createDataFrame([(i, "a", [1.0, 0.0] if i < 60 else [0.0, 1.0]) for i in range(600)] + [(600, "b", [1.0, 1.0])], "id long, g string, vec array<float>")
    got = {r["g"]: r for r in quality.label_cosines(v, "g").collect()}
    same = 60 * 59 + 540 * 539
    assert got["a"]["n"] == 600 and got["a"]["pairs"] == 1225 and got["a"]["mean"] == pytest.approx(same / (600 * 599), abs=1e-6)
    assert (got["a"]["least"], got["a"]["greatest"]) == (0.0, 1.0)
    assert tuple(got["b"])[1:] == (1, None, 0, None, None)
    assert quality.sampled_cosines(v, "g").where("g = 'a'").first()["least"] == 1.0


def test_texts_that_occur(spark):
    docs = spark.createDataFrame([(1, "Kaufvertrag", None), (2, "x", "VERTRAG a.b"), (3, None, None), (4, "ver trag", "")], "id long, a string, b string")
    asked = spark.createDataFrame([("Vertrag",), ("vertrag",), ("a.b",), ("nie",), (None,), ("",)], "t string")
    for block in (4_000_000, 1):
        got = rows(retrieval.occurring(docs, "id", ["a", "b"], asked, "t", block))
        assert got == [("", 1), ("", 2), ("", 3), ("", 4), ("a.b", 2), ("vertrag", 1), ("vertrag", 2)]
    assert retrieval.occurring(docs.where("id > 9"), "id", ["a"], asked, "t").count() == 0
    assert retrieval.occurring(docs, "id", ["a"], asked.where("t = 'q'"), "t").count() == 0


def test_similar_grams_against_brute_force(spark):
    import random

    r = random.Random(3)
    left, right = ([(i, r.sample("abcdefghij", r.randint(0, 8))) for i in range(40)] for _ in range(2))
    got = rows(retrieval.similar_grams(spark.createDataFrame(left, "query_id long, grams array<string>"), spark.createDataFrame(right, "law_id long, grams array<string>"), 0.5))
    assert got == sorted((i, j) for i, a in left for j, b in right if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.5)


def test_dense_search_within_a_group(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 10], "ab"[i % 2] if i < 8 else None) for i in range(10)], "id long, vec array<double>, g string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "b"), (2, [1.0, 0.0], None), (3, [1.0, 0.0], "z")], "query_id long, vec array<double>, g string")
    got = rows(retrieval.dense_topn(asked, vectors, 3, 2, within="g"), "query_id", "id")
    assert got == [(1, 1), (1, 3), (1, 5), (2, 0), (2, 1), (2, 2)]


def test_widening_adds_the_first_row_of_each_new_group(spark):
    schema = "query_id long, id long, g string, score double"
    first = spark.createDataFrame([(1, 1, "a", 0.5), (2, 2, "a", 0.9)], schema)
    second = spark.createDataFrame([(1, 7, "a", 0.8), (1, 8, "b", 0.3), (1, 9, "b", 0.4), (1, 6, "c", 0.2), (1, 5, "c", 0.2), (2, 8, "b", 0.3)], schema)
    got = rows(retrieval.widened(first, second, spark.createDataFrame([(1,), (1,)], "query_id long"), "g"), "query_id", "id", "added")
    assert got == [(1, 1, False), (1, 5, True), (1, 9, True), (2, 2, False)]


def test_blocks_of_queries_and_terms_score_alike(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 1 + i % 9))) for i in range(60)] + [(99, None)], "id long, text string")
    asked = spark.createDataFrame([(q, [f"w{q % 7}", f"w{q % 5}", "w1"]) for q in range(9)] + [(50, []), (51, None)], "query_id long, terms array<string>")
    whole = rows(retrieval.bm25_topn(docs, asked, 4))
    assert whole and whole == rows(retrieval.bm25_topn(docs, asked, 4, 2, 3))


def test_any_in_top(spark):
    ranked = spark.createDataFrame([(1, "a", 4), (1, "b", 3), (2, "a", 4)], "query_id long, item string, place int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "query_id long, item string")
    assert rows(evaluate.any_in_top(ranked, relevant)) == [(1, True), (2, False), (3, False)]


def test_join_with_a_hot_key_repeated_as_a_whole(spark):
    from lexspark.operators.skew import salted_left_join

    left = spark.createDataFrame([(i, None if i % 5 == 0 else "h" if i % 3 else f"k{i}") for i in range(60)], "id long, k string")
    right = spark.createDataFrame([("h", 1), ("k3", 2)], "k string, v int")
    want = sorted(((i, {"h": 1, "k3": 2}.get(k)) for i, k in ((r["id"], r["k"]) for r in left.collect())))
    assert sorted((r["id"], r["v"]) for r in salted_left_join(left, right, "k", "id", 4).collect()) == want
