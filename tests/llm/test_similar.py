from time import perf_counter

import numpy as np
import pytest

from lexspark.llm import similar
from lexspark.llm.similar import _chunks, _footrule, _number, _permutations, _reranked, near_pairs, nearest

SCHEMA = "id long, v array<float>, rows int, pivot string, h1 long"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if r is None else [None if c is None else float(c) for c in r], 1, "x", 2) for i, r in zip(ids, x)], SCHEMA)


def clusters(n=400, dim=64, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(n // 4, dim))
    x = np.concatenate([centre + 0.25 * r.normal(size=centre.shape) for _ in range(4)])
    return (x * r.uniform(0.3, 3, (len(x), 1))).astype("f4")


def brute(x, k=10, least=0.9):
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in top[i] if i < j and s[i, j] >= least and i in top[j]}, top


def test_pairs_against_brute_force(spark):
    x = clusters()
    want, _ = brute(x)
    got = [tuple(r) for r in near_pairs(frame(spark, x), "id", "v").select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and len(want) > 300
    assert len(want & set(got)) / len(want) >= 0.99 and len(set(got) - want) <= 0.01 * len(want)


def test_blocks_of_long_files_lose_nothing(spark):
    x = clusters(200)
    a, b = ({tuple(r) for r in near_pairs(frame(spark, x), "id", "v", block=s).select("id_a", "id_b").collect()} for s in (2048, 8))
    assert a == b and a


def crowd(n, cosine, others, seed=7, dim=64):
    """n vectors around one centre with a mean pair cosine of `cosine`, and others in small clusters, mixed."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=dim) / dim**0.5
    x = centre / np.linalg.norm(centre) + (1 / cosine - 1) ** 0.5 * r.normal(size=(n, dim)) / dim**0.5
    return r.permutation(np.concatenate([x * r.uniform(0.3, 3, (n, 1)), clusters(others, dim, seed + 1)])).astype("f4")


@pytest.mark.parametrize("cosine", [0.95, 0.85])
def test_recall_in_a_crowd(spark, cosine):
    x = crowd(1500, cosine, 3000)
    want, _ = brute(x)
    got = [tuple(r) for r in near_pairs(frame(spark, x), "id", "v").select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and len(want) > 6000
    assert len(want & set(got)) / len(want) >= 0.99 and len(set(got) - want) <= 0.01 * len(want)


def test_blocks_of_crowds_lose_nothing(spark):
    x = crowd(400, 0.9, 800)
    a, b = ({tuple(r) for r in near_pairs(frame(spark, x), "id", "v", crowd_block=s).select("id_a", "id_b").collect()} for s in (8192, 90))
    assert a == b and a


def test_exact_copies(spark):
    x = clusters(40, seed=5)
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0), np.repeat(x[1:2], 4, axis=0)])
    want, _ = brute(x)
    got = {tuple(r) for r in near_pairs(frame(spark, x), "id", "v").select("id_a", "id_b").collect()}
    assert got == want


def test_repeated_rows_count_once(spark):
    x = clusters(60, seed=6)
    x = np.concatenate([x, np.repeat(x[:1], 14, axis=0), np.repeat(x[1:2], 3, axis=0)])
    want, _ = brute(x)
    ids = list(range(len(x))) * 2 + [0] * 10 + [2] * 10 + [len(x) - 1] * 10
    got = near_pairs(frame(spark, x[ids], ids), "id", "v").select("id_a", "id_b").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_unusable_vectors_and_empty_tables(spark):
    ones = [1.0] * 64
    x = [ones, ones, None, [0.0] * 64, [float("nan")] + ones[1:], [float("inf")] + ones[1:], ones[:32], [None] + ones[1:], [1e-30] * 64]
    got = {tuple(r) for r in near_pairs(frame(spark, x), "id", "v").select("id_a", "id_b").collect()}
    assert got == {(0, 1), (0, 8), (1, 8)}
    empty = frame(spark, x).where("id > 99")
    assert near_pairs(empty, "id", "v").count() == 0 and nearest(empty, "id", "v", empty).count() == 0
    assert near_pairs(frame(spark, x).where("id = 2"), "id", "v").count() == 0


def test_usable_vectors_of_either_type(spark):
    inf, nan = float("inf"), float("nan")
    good = [[1.0, 0.0], [-1.0, 0.0], [-1.0, -2.0], [0.0, 1e-30]]
    bad = [None, [], [1.0], [0.0, -0.0], [1.0, None], [None, None], [inf, 1.0], [1.0, -inf], [nan, 1.0], [nan, None], [inf, None], [1.0, 2.0, 3.0]]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(v, v in good) for v in good + bad], f"v array<{kind}>, want boolean")
        assert df.where(similar.usable(df.v, 2) != df.want).count() == 0 and df.where(similar.usable(df.v, 2)).count() == len(good)


def test_footrule_sums():
    r = np.random.default_rng(2)
    perm = np.stack([r.permutation(20)[:6] for _ in range(50)]).astype("u2")
    got = _footrule(perm)
    assert (got == got.T).all() and (np.diag(got) == 0).all()
    for a in range(50):
        for b in range(a + 1, 50):
            far = sum(abs((list(perm[a]).index(p) if p in perm[a] else 6) - (list(perm[b]).index(p) if p in perm[b] else 6)) for p in set(perm[a]) | set(perm[b]))
            assert got[a, b] == (6 * 7 - far) / 2


def test_footrule_sums_of_some_pairs():
    r = np.random.default_rng(4)
    perm = np.stack([r.permutation(300)[:12] for _ in range(1500)]).astype("u2")
    a, b = r.integers(0, 1500, (2, 250_000))
    a[:2000], b[:2000] = 1, np.arange(2000) % 1500
    want = sum(np.where(perm[a, i] == perm[b, j], 12 - max(i, j), 0) for i in range(12) for j in range(12))
    assert (_footrule(perm, a, b) == want).all() and _footrule(perm, a[:0], b[:0]).shape == (0,)


def twins(n, dim=64, seed=9):
    """n vectors; the i-th of the first half is similar to the i-th of the second, and to no other."""
    r = np.random.default_rng(seed)
    half = r.normal(size=(n // 2, dim))
    return np.concatenate([half, half + 0.2 * r.normal(size=half.shape)]).astype("f4")


def test_long_files_cost_little_more_than_short_ones(spark):
    # with few pivots every file has thousands of vectors, as at many millions of rows
    df, want = frame(spark, twins(24_000)), {(i, i + 12_000) for i in range(12_000)}
    df = df.repartition(8).persist()
    df.count()
    took = {}
    for most in (16384, 24, 16384, 24):
        began = perf_counter()
        got = [tuple(r) for r in near_pairs(df, "id", "v", most_pivots=most).select("id_a", "id_b").collect()]
        took[most] = perf_counter() - began
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want)
    df.unpersist()
    assert took[24] < 2.5 * took[16384]


@pytest.mark.parametrize("cells", [2_000_000, 5000])
@pytest.mark.parametrize("ranked", [12, 128])
def test_only_rows_with_many_similar_ones_are_ranked_by_footrule(monkeypatch, ranked, cells):
    monkeypatch.setattr(similar, "CELLS", cells)
    r = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(np.concatenate([twins(2000), r.normal(size=(1, 64)) + 0.05 * r.normal(size=(200, 64))])).astype("f4")
    perm, own = _permutations(x, x[::7], 12), np.arange(len(x))
    asked, whole = [], _footrule(perm)
    monkeypatch.setattr(similar, "_footrule", lambda perm, row, col: asked.append(len(row)) or _footrule(perm, row, col))
    got = {(i, j) for a, b in similar._similar(x, perm, np.zeros(len(x), "f4"), own, own, 12, ranked, 0.9) for i, j in zip(a.tolist(), b.tolist())}
    assert sum(asked) == 200 * 199
    cosine = x @ x.T
    near = np.where(cosine >= 0.9, whole, 0)
    for i in range(len(x)):
        mine = np.flatnonzero((cosine[i] >= 0.9) & (own != i))
        if len(mine) > ranked:
            mine = mine[near[i, mine] >= np.sort(near[i, mine])[-ranked]]
        edge = np.sort(cosine[i, mine])[-12:][0]
        kept = {j for a, j in got if a == i}
        assert {j for j in mine.tolist() if cosine[i, j] > edge + 1e-5} <= kept <= {j for j in mine.tolist() if cosine[i, j] >= edge - 1e-5}


def test_permutations_take_the_lower_of_equal_pivots():
    r = np.random.default_rng(12)
    pivots = r.integers(-1, 2, (700, 8)).astype("f4")
    x = r.integers(-1, 2, (600, 8)).astype("f4")
    assert (_permutations(x, pivots, 12) == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :12]).all()


def test_candidates_are_the_nearest_by_footrule_and_bounded():
    r = np.random.default_rng(8)
    near, c = r.integers(0, 30, (200, 300)), r.uniform(0.8, 1, (200, 300))
    kept = np.zeros(c.shape, bool)
    kept[_reranked(near, c, np.zeros(200), np.zeros(300), 12, 100, 0.9)] = True
    edge = -np.sort(-near, axis=1)[:, 99:100]
    assert (kept.sum(axis=1) <= 12).all() and (near[kept] >= np.broadcast_to(edge, near.shape)[kept]).all()
    among = np.where((near >= edge) & (near > 0), c, 0)
    assert (kept == ((among >= -np.sort(-among, axis=1)[:, 11:12]) & (among >= 0.9))).all()


def test_many_pivots_have_wide_numbers():
    pivots = np.zeros((70_000, 2), "f4")
    pivots[:, 0] = 1
    angle = np.linspace(0, 1, 70_000)
    pivots = np.stack([np.cos(angle), np.sin(angle)], axis=1).astype("f4")
    assert _number(len(pivots)) == "<u4" and _permutations(pivots[-1:], pivots, 1)[0, 0] >= 69_900


def test_chunks_do_not_depend_on_batches():
    import pyarrow as pa

    rows = pa.table({"v": list(range(25))})
    for size in (1, 4, 25):
        got = [t["v"].to_pylist() for t in _chunks(iter(rows.to_batches(size)), 10)]
        assert got == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


@pytest.mark.parametrize(("n", "noise"), [(1000, 0.02), (1000, 0.1), (2000, 0.2), (4000, 0.05)])
def test_clusters_of_near_copies(spark, n, noise):
    r = np.random.default_rng(n)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = r.permutation(np.concatenate([unit(r.normal(size=64)) + noise / 8 * r.normal(size=(n, 64)), unit(r.normal(size=(2000, 64)))])).astype("f4")
    want, _ = brute(x)
    got = {tuple(p) for p in near_pairs(frame(spark, x), "id", "v").select("id_a", "id_b").collect()}
    assert len(want & got) / len(want) >= 0.95 and len(want & got) / len(got) >= 0.95


@pytest.mark.parametrize("n", [30, 100, 300])
def test_small_clusters_of_near_copies_without_a_crowd(spark, n):
    r = np.random.default_rng(n)
    x = np.concatenate([r.normal(size=(1, 64)) + 0.05 * r.normal(size=(n, 64)), r.normal(size=(40 * n, 64))]).astype("f4")
    want, _ = brute(x)
    got = {tuple(p) for p in near_pairs(frame(spark, x), "id", "v").select("id_a", "id_b").collect()}
    assert len(want & got) / len(want) >= 0.95 and len(want & got) / len(got) >= 0.95


@pytest.mark.parametrize("block", [20_000, 7])
def test_recall_of_nearest(spark, block):
    r = np.random.default_rng(3)
    x = (r.normal(size=(5000, 64)) + 0.5).astype("f4")
    df = frame(spark, x)
    got = nearest(df, "id", "v", df.where("id % 100 = 0"), query_block=block, at_least=800).toPandas()
    _, top = brute(x)
    assert sorted(got.groupby("id").size().unique()) == [10]
    hit = sum(len(set(g.neighbour) & set(top[i].tolist())) for i, g in got.groupby("id"))
    assert hit / len(got) >= 0.9
    assert (got.neighbour != got.id).all()
