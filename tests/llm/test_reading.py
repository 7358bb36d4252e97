import random

import numpy as np

from lexspark.llm.reading import NGrams, difficulty, fit_reading_model, isotonic, reading_levels


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 4]), np.array([1.0, 3, 2, 4, 6])
    at, to = isotonic(x, y)
    assert at.tolist() == [1, 2, 3, 4] and to.tolist() == [1, 2.5, 2.5, 5]
    r = np.random.default_rng(0)
    at, to = isotonic(r.random(300), r.integers(0, 3, 300))
    assert (np.diff(to) >= 0).all()


def test_surprisal_is_a_probability():
    flat = np.array([1, 2, 3, 1, 2, 4], "u8")
    m = NGrams(flat, np.zeros(6, int), np.zeros(6, int), 1)
    seen = np.unique(flat)
    # over all words behind `2`: what is known, and one unknown word for the rest
    p = [2 ** -m.surprisal(np.array([2, w], "u8"), np.zeros(2, int))[1, 0] for w in [*seen, 99]]
    assert abs(sum(p) - 1) < 1e-6


def test_difficulty_follows_the_words():
    easy, hard = np.arange(20, dtype="u8"), np.arange(100, 120, dtype="u8")
    flat, row = np.concatenate([easy, hard]), np.repeat([0, 1], 20)
    m = NGrams(flat, row, row, 2)
    mixed = np.concatenate([easy, hard])
    got = difficulty(m, np.concatenate([easy, hard, mixed]), np.repeat([0, 1, 2], [20, 20, 40]), 4)
    assert got[0] < 0.05 and got[1] > 0.95 and 0.3 < got[2] < 0.7 and np.isnan(got[3])


def corpus(spark, n=240):
    r = random.Random(3)
    words = {1: "haus geld brief amt frage hilfe".split(), 2: "antrag frist gebühr vertrag miete beratung".split(), 3: "rechtsgrund maßgabe vorbehaltlich haftung bescheid zustellung".split()}
    docs, labels = [], []
    for i in range(n):
        y = i % 3 + 1
        docs.append((i, " ".join(r.choice(words[y] if r.random() < 0.9 else words[r.randint(1, 3)]) for _ in range(60)), y, "x"))
        if i % 2:
            labels += [(i, "a", y), (i, "a", y), (i, "b", y), (i, "c", r.choice((y, None)))]
    docs += [(1000, None, 1, "x"), (1001, "", 1, "x"), (1002, "— " * 60, 1, "x"), (1003, "kurz " * 49, 1, "x"), (1004, "\xa0".join(["haus"] * 50), 1, "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, y int, reading_level string"), spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = fit_reading_model(labels, docs, "doc_id", "text")
    got = {r["doc_id"]: r["reading_level"] for r in reading_levels(docs, "doc_id", "text", model).collect()}
    want = {r["doc_id"]: r["y"] for r in docs.where("doc_id < 1000").collect()}
    assert set(got) == set(want) | {1002, 1004}
    held = [i for i in want if i % 2 == 0]
    assert sum(got[i] == want[i] for i in held) / len(held) > 0.95
    assert got[1004] == 1 and got[1002] in (1, 2, 3)


def test_without_labels_and_documents(spark):
    docs, labels = corpus(spark, 6)
    assert fit_reading_model(labels.where("doc_id < 0"), docs, "doc_id", "text") is None
    assert {r["reading_level"] for r in reading_levels(docs, "doc_id", "text", None, ("y",)).collect()} == {None}
    model = fit_reading_model(labels, docs, "doc_id", "text")
    assert reading_levels(docs.where("doc_id < 0"), "doc_id", "text", model).count() == 0


def test_the_sample_is_bounded_and_stable(spark):
    docs, labels = corpus(spark)
    a, b = (fit_reading_model(labels, docs.orderBy(o), "doc_id", "text", sample=20) for o in ("doc_id", "text"))
    assert np.array_equal(a.at, b.at) and len(a.at) <= 20
