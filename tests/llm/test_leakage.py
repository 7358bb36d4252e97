import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm.leakage import WuManber, find_leaks


def brute(doc, item, run=12, stretch=24, per=7):
    best_run = best = 0
    for off in range(-len(item), len(doc)):
        eq = [doc[off + i] == item[i] if 0 <= off + i < len(doc) else None for i in range(len(item))]
        n = 0
        for e in eq:
            n = n + 1 if e else 0
            best_run = max(best_run, n)
        for i in range(len(eq)):
            bad = 0
            for j in range(i, len(eq)):
                if eq[j] is None:
                    break
                bad += not eq[j]
                if j - i + 1 >= stretch and per * bad <= j - i + 1:
                    best = max(best, j - i + 1)
    return best_run >= run or best >= stretch


def hashes(words):
    return np.array([abs(hash(w)) for w in words], "u8")


def test_occurrences_against_brute_force():
    r = random.Random(1)
    texts = [[r.choice("abc") for _ in range(r.randint(3, 12))] for _ in range(6)]
    docs = [[r.choice("abcd") for _ in range(r.randint(0, 60))] for _ in range(30)]
    w = WuManber([hashes(t) for t in texts], 5)
    flat = np.concatenate([hashes(d) for d in docs])
    end = np.cumsum([len(d) for d in docs])
    got = set(zip(*(x.tolist() for x in w.occurrences(flat, end - [len(d) for d in docs], end))))
    want = {(k, i, t, j) for k, d in enumerate(docs) for i in range(len(d) - 4) for t, p in enumerate(texts) for j in range(len(p) - 4) if d[i : i + 5] == p[j : j + 5]}
    assert got == want


def test_passages_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[r.choice(vocabulary) for _ in range(r.randint(12, 60))] for _ in range(8)]
    docs = []
    for k in range(120):
        part = list(r.choice(items))
        a = r.randint(0, max(0, len(part) - 12))
        part = part[a : a + r.randint(8, 60)]
        for i in range(len(part)):
            if r.random() < r.choice((0, 0.08, 0.14, 0.2)):
                part[i] = "anders"
        docs.append([r.choice(vocabulary) for _ in range(r.randint(0, 30))] + part + [r.choice(vocabulary) for _ in range(5)])
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc long, text string")
    q = spark.createDataFrame([(k, " ".join(w).upper(), None) for k, w in enumerate(items)], "item long, a string, b string")
    got = {tuple(x) for x in find_leaks(d, "doc", "text", q, "item", ["a", "b"]).select("doc", "item").collect()}
    assert got == {(k, j) for k, w in enumerate(docs) for j, i in enumerate(items) if brute(w, i)}
    blocks = {tuple(x) for x in find_leaks(d, "doc", "text", q, "item", ["a", "b"], block_words=50).select("doc", "item").collect()}
    assert blocks == got


def test_writing_and_odd_rows(spark):
    item = "Der Verein muss auf eigene Rechnung die verbindliche Prüfungsanlage für zwölf Personen übertragen und erneuern"
    docs = [
        (1, item.upper(), 0), (2, item.replace(" ", "\n"), 0), (3, f"<p>{item.replace('für', '<b>f&uuml;r</b>')}</p>", 0), (4, item.replace("Prüfungsanlage", "Prüfungs-\nanlage"), 0),
        (5, item.replace("ü", "Ã¼"), 0), (6, item.replace("Rechnung", "Kosten"), 0), (7, None, 0), (8, "", 0), (9, "x " * 50_000 + item + " y" * 50_000, 0), (1, item, 0),
    ]
    d = spark.createDataFrame(docs, "id long, t string, run_words int")
    q = spark.createDataFrame([(5, item, None), (6, None, ""), (7, "kurz", "zu kurz")], "id long, a string, b string")
    got = find_leaks(d, "id", "t", q, "id", ["a", "b"])
    assert got.columns[:2] == ["id", "item_id"]
    assert sorted((r["id"], r["item_id"]) for r in got.collect()) == [(i, 5) for i in (1, 2, 3, 4, 5, 9)]
    assert find_leaks(d.where(F.lit(False)), "id", "t", q, "id", ["a"]).count() == 0
    assert find_leaks(d, "id", "t", q.where(F.lit(False)), "id", ["a"]).count() == 0
    with pytest.raises(ValueError):
        find_leaks(d, "id", "t", q, "id", ["a"], seed=9)


def test_passages_hold_few_cells_and_long_texts():
    r = np.random.default_rng(4)
    item = r.integers(0, 2**60, 30_000).astype("u8")
    doc = item.copy()
    doc[::7] += np.uint64(1)
    w = WuManber([item], 5)
    flat = np.concatenate([doc, doc[5_000:20_000]])
    begin, end = np.array([0, 30_000]), np.array([30_000, 45_000])
    row, text, run, best = w.leaks(flat, begin, end, 12, 24, 7)
    assert row.tolist() == [0, 1] and run.tolist() == [6, 6]
    few = w.leaks(flat, begin, end, 12, 24, 7, cells=1)
    assert all(np.array_equal(a, b) for a, b in zip((row, text, run, best), few))
    # one of seven words is altered, beginning with the first: all but the very last block of the whole text fit
    assert best[0] >= 29_990 and best[1] >= 14_990
