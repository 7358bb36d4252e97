import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.llm.packing import combinations, make_plan, nnls, pack


def test_combinations_fill():
    c = combinations(24)
    assert ((c[:, 0] * c[:, 1] + c[:, 2] * c[:, 3] + c[:, 4] * c[:, 5]) == 24).all()


def test_nnls_against_projected_gradient():
    c = combinations(12)
    a = np.zeros((13, len(c)))
    for k in (0, 2, 4):
        np.add.at(a, (c[:, k], np.arange(len(c))), c[:, k + 1])
    a[0] = 0
    target = np.array([0, 5, 3, 8, 1, 9, 2, 4, 4, 0, 1, 7, 2.0])
    chosen, x = nnls(c, target)
    got = target.copy()
    for (i, mi, j, mj, k, mk), w in zip(chosen, x):
        for p, m in ((i, mi), (j, mj), (k, mk)):
            if m:
                got[p] -= m * w
    y = np.zeros(len(c))
    for _ in range(20000):
        y = np.maximum(0, y - (a.T @ (a @ y - target)) / np.linalg.norm(a, 2) ** 2)
    assert (x >= 0).all()
    assert np.linalg.norm(got) <= np.linalg.norm(a @ y - target) + 1e-3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=16, max_size=16))
def test_every_item_has_one_place_and_no_container_overflows(h):
    h = np.array([0, *h])
    plan = make_plan(h)
    fill, count = np.zeros(max(plan.containers, 1), int), np.zeros(17, int)
    for c, first, n, base, m in plan.ranges:
        assert first == count[c] and n % m == 0
        count[c] += n
        for r in range(n):
            fill[base + r // m] += c
    assert (count == h).all() and (fill <= 16).all()
    assert plan.containers <= max(2 * (h * np.arange(17)).sum() / 16, 1)


def test_rows(spark):
    rng = np.random.default_rng(0)
    sizes = [*rng.integers(1, 300, 900).tolist(), *[77] * 400, 64, 65, 128, 1000, 0, None, 64, 64]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "id long, n int, cell string, cls int")
    got = pack(df, "id", F.col("n"), 64, 16).toPandas()
    assert sorted(got.id.unique()) == [i for i, s in enumerate(sizes) if s]
    per = got.groupby("container_id")["size"].sum()
    assert per.max() <= 64 and per.index.min() == 0 and per.index.max() == len(per) - 1
    assert (got.groupby("id")["size"].sum() == [s for s in sizes if s]).all()
    whole = got[got.id.map(lambda i: sizes[i] <= 64)]
    assert (whole.pieces == 1).all()
    for _, g in got.groupby("id"):
        assert g.sort_values("piece_no").start.tolist() == [64 * k for k in range(len(g))]


def test_fill_of_fine_classes(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(rng.lognormal(5.5, 0.8, 5000))], "id long, n long")
    got = pack(df, "id", F.col("n"), 4096, 256).groupBy("container_id").agg(F.sum("size").alias("s")).toPandas()
    assert got.s.max() <= 4096 and got.s.sum() / (4096 * len(got)) > 0.97


def test_empty_and_equal_rows(spark):
    df = spark.createDataFrame([], "id long, n long")
    assert pack(df, "id", F.col("n"), 64, 16).count() == 0
    twice = spark.createDataFrame([(1, 40)] * 5, "id long, n long")
    assert pack(twice, "id", F.col("n"), 64, 16).select("container_id").distinct().count() == 5
    with pytest.raises(ValueError):
        pack(df, "id", F.col("n"), 100, 64)
