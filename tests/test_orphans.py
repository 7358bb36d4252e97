import random

from pyspark.sql import functions as F

from lexspark.operators.orphans import advance, current_references, empty_state, open_by_batch, orphan_cases, orphan_counts, replay
from lexspark.operators.skew import skew_left_join
from lexspark.session import durable

REFS = "src_table string, src_id string, ref_field string, target string, key string, ref_at long, extra string"
EVENTS = "target string, key string, first_at long, deleted_at long, extra string"


def refs(spark, rows):
    return spark.createDataFrame([("t", i, "f", "p", k, at, "x") for i, k, at in rows], REFS)


def events(spark, rows):
    return spark.createDataFrame([("p", k, first, gone, "y") for k, first, gone in rows], EVENTS)


def cases(log):
    return sorted(r["src_id"] for r in orphan_cases(current_references(log)).collect())


def step(state, *batch):
    """The next logs, written as a job between batches would."""
    last = state[1].agg(F.max("batch")).collect()[0][0]
    return tuple(durable(x) for x in advance(*state, *batch, 0 if last is None else last + 1))


def test_each_kind(spark):
    r = [("ok", "a", 10), ("missing", "z", 10), ("late", "a", 1), ("deleted", "d", 10), ("null", None, 10), ("untimed", "a", None), ("same", "a", 5)]
    e = [("a", 5, None), ("a", 9, None), ("d", 1, 20), (None, 1, None)]
    state = advance(*empty_state(spark), refs(spark, r + r), events(spark, e))[1]
    assert cases(state) == ["deleted", "late", "missing"]
    counts = {x["month"]: (x["cases"], x["still_open"]) for x in orphan_counts(current_references(state)).collect()}
    assert counts == {"1970-01": (3, 2)}


def test_empty(spark):
    assert cases(advance(*empty_state(spark), refs(spark, []), events(spark, []))[1]) == []
    assert cases(advance(*empty_state(spark), refs(spark, [("a", "k", 1)]), events(spark, []))[1]) == ["a"]


def test_batches_equal_one_batch(spark):
    rnd = random.Random(1)
    keys = [f"k{i}" for i in range(12)]
    r = [(f"r{i}", rnd.choice(keys), rnd.randint(1, 100)) for i in range(60)]
    e = [(k, rnd.randint(1, 100), rnd.choice((None, None, 120))) for k in keys[:9]]
    whole = cases(advance(*empty_state(spark), refs(spark, r), events(spark, e))[1])
    state = empty_state(spark)
    for part in range(3):
        state = step(state, refs(spark, r[part::3]), events(spark, e[part::3]))
    assert cases(state[1]) == whole


def test_divisions_with_repeated_rows_equal_one_batch(spark):
    rnd = random.Random(2)
    keys = [f"k{i}" for i in range(8)]
    r = [(rnd.choice((None, *(f"r{i}" for i in range(25)))), rnd.choice(keys), rnd.choice((None, rnd.randint(1, 100)))) for _ in range(90)]
    e = [(rnd.choice(keys[:6]), rnd.choice((None, *[rnd.randint(1, 150)] * 9)), rnd.choice((None, None, None, None, 120))) for _ in range(24)]

    def result(log):
        state = current_references(log)
        rows = [tuple(x[c] for c in ("src_id", "key", "ref_at", "was_late", "was_deleted", "open", "resolved_at")) for x in state.collect()]
        return sorted(rows, key=str), sorted(map(tuple, orphan_counts(state).collect()), key=str)

    whole = advance(*empty_state(spark), refs(spark, r), events(spark, e))[1]
    for cuts in (2, 4):
        state = empty_state(spark)
        for part in range(cuts):
            state = step(state, refs(spark, r[part::cuts]), events(spark, e[part::cuts]))
        assert result(state[1]) == result(whole)


def test_earlier_arrival_and_second_delivery(spark):
    state = step(empty_state(spark), refs(spark, [("a", "k", 5), ("b", "k", 9)]), events(spark, [("k", 8, None)]))
    assert cases(state[1]) == ["a"]
    state = step(state, refs(spark, [("b", "k", 2)]), events(spark, []))
    assert cases(state[1]) == ["a", "b"]
    state = step(state, refs(spark, [("b", "k", 9)]), events(spark, [("k", 3, None)]))
    assert cases(state[1]) == ["b"] and current_references(state[1]).count() == 2


def test_deletion_reopens_and_arrival_resolves(spark):
    state = step(empty_state(spark), refs(spark, [("a", "k", 5)]), events(spark, []))
    assert cases(state[1]) == ["a"]
    state = step(state, refs(spark, []), events(spark, [("k", 3, None)]))
    assert cases(state[1]) == []
    state = step(state, refs(spark, []), events(spark, [("k", 3, 9)]))
    assert cases(state[1]) == ["a"]
    # a second arrival resolves what the deletion has opened, an arrival before it does not
    assert cases(step(state, refs(spark, []), events(spark, [("k", 7, None)]))[1]) == ["a"]
    state = step(state, refs(spark, []), events(spark, [("k", 12, None)]))
    assert cases(state[1]) == [] and current_references(state[1]).first()["resolved_at"] == 12
    assert [(r["batch"], r["opened"], r["closed"], r["open"]) for r in open_by_batch(state[1]).orderBy("batch").collect()] == [(0, 1, 0, 1), (1, 0, 1, 0), (2, 1, 0, 1), (3, 0, 1, 0)]


def test_a_batch_writes_what_it_changes(spark):
    r = [(f"r{i}", f"k{i % 50}", i) for i in range(1000)]
    state = step(empty_state(spark), refs(spark, r), events(spark, [(f"k{i}", 0, None) for i in range(40)]))
    after = step(state, refs(spark, [("new", "k1", 5)]), events(spark, [("k45", 1, None)]))
    assert after[1].count() - state[1].count() == 20 + 1 and after[0].count() - state[0].count() == 1
    assert len(cases(state[1])) == 200 and len(cases(after[1])) == 180


def test_replay_by_period_equals_one_batch(spark, tmp_path):
    rnd = random.Random(5)
    r = [(f"r{i}", f"k{rnd.randint(0, 9)}", rnd.choice((None, rnd.randint(1, 100)))) for i in range(80)]
    e = [(f"k{i}", rnd.choice((None, rnd.randint(1, 150))), rnd.choice((None, None, 120))) for i in range(8)]
    whole = advance(*empty_state(spark), refs(spark, r), events(spark, e))[1]
    log = replay(refs(spark, r), events(spark, e), F.floor(F.col("ref_at") / 20), F.floor(F.greatest("first_at", "deleted_at") / 20), str(tmp_path / "a"))
    assert cases(log) == cases(whole) and log.select("batch").distinct().count() > 3
    empty = replay(refs(spark, []), events(spark, []), F.col("ref_at"), F.col("first_at"), str(tmp_path / "b"))
    assert empty.count() == 0


def test_hot_key_join_loses_nothing(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else f"k{i % 7}")) for i in range(600)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3)], "k string, v int")
    import lexspark.operators.skew as skew

    usual = skew.hot_keys
    skew.hot_keys = lambda df, key: usual(df, key, 10, 5)
    try:
        got = sorted((r["id"], r["k"], r["v"]) for r in skew_left_join(left, right, "k", "id", 4).collect())
    finally:
        skew.hot_keys = usual
    want = {"hot": 1, "k0": 2, "k6": 3}
    assert got == sorted((r["id"], r["k"], want.get(r["k"])) for r in left.collect())
