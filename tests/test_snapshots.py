import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark.operators.snapshots import assign_ordinals, snapshot_changes

SCHEMA = "snap int, name string, c string, d string, at long, bits string, word string"


def brute(rows):
    by = {}
    for s, k, c, d, at, *_ in rows:
        if s is None or k is None:
            continue
        rank = (at is not None, at or 0, (c is not None, c or ""), (d is not None, d or ""))
        if (s, k) not in by or rank > by[s, k][0]:
            by[s, k] = (rank, (c, d))
    snaps = sorted({r[0] for r in rows if r[0] is not None})
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        old, new = ({k: v for (s, k), (_, v) in by.items() if s == x} for x in (a, b))
        out |= {(b, k, "added") for k in new.keys() - old.keys()} | {(b, k, "removed") for k in old.keys() - new.keys()}
        out |= {
            (b, k, "changed") for k in new.keys() & old.keys()
            if any(x is not None and y is not None and x != y for x, y in zip(old[k], new[k]))
        }
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in snapshot_changes(df, "snap", "name", ["c", "d"], "at", **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_many_keys_gaps_copies_and_nulls(spark):
    r = random.Random(3)
    rows = []
    for s in (1, 2, 5, 6, None):
        for i in range(500):
            for _ in range(r.choice((0, 1, 1, 1, 2))):
                rows.append((s, f"k{i}" if i % 50 else None, r.choice("ab") if i % 7 else None, r.choice("xy"), r.choice((1, 2, 3, None))))
    rows += rows[:40]
    # few buckets, so that words are full and every bit is used
    assert run(spark, rows, buckets=3) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [(4, "a", "1", "2", 1)]) == set()


def test_key_may_have_an_internal_name(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 1)], "q int, word string, bits string, bucket int")
    got = {tuple(r) for r in snapshot_changes(df, "q", "word", ["bits"], "bucket").collect()}
    assert got == {(2, "b", "added"), (2, "a", "removed")}


def test_ordinals_persist(spark):
    first = assign_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(0, 100, 2)], "k string"), "k", None, 4)
    second = assign_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(100)] + [(None,)], "k string"), "k", first, 4)
    old, new = ({r["k"]: (r["bucket"], r["ordinal"]) for r in x.collect()} for x in (first, second))
    assert all(new[k] == v for k, v in old.items())
    assert len(set(new.values())) == len(new) == 100


def test_registry_changes_nothing(spark):
    rows = [(s, f"k{i}", str(i * s % 3), None, 1) for s in (1, 2, 3) for i in range(s, 40)]
    registry = assign_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(60)], "name string"), "name", None, 2)
    assert run(spark, rows, registry=registry, buckets=2) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 4), st.sampled_from("abcdef"), st.sampled_from(["1", "2", None]), st.sampled_from(["x", None]), st.integers(1, 3)), max_size=30))
def test_any_rows(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_input_order_is_irrelevant(spark):
    rows = [(s, f"k{i}", str(i * s % 3), None, 1) for s in (1, 2) for i in range(70)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).orderBy(F.rand(5))
    assert {tuple(r) for r in snapshot_changes(df, "snap", "name", ["c", "d"], "at").collect()} == brute(rows)


def test_registry_is_stored_and_extended(spark, tmp_path):
    from lexspark.operators.snapshots import extend_registry

    path = str(tmp_path / "ordinals")
    keys = lambda *k: spark.createDataFrame([(x, 1) for x in k], "k string, bucket int")
    found = lambda df: {r["k"]: (r["bucket"], r["ordinal"]) for r in df.collect()}
    first = found(extend_registry(keys("a", "c", "a", None), "k", path, 2))
    second = found(extend_registry(keys("b", "c"), "k", path, 2))
    assert set(first) == {"a", "c"} and set(second) == {"a", "b", "c"} and {k: second[k] for k in first} == first
    assert len(set(second.values())) == 3
    assert found(extend_registry(keys(), "k", path, 2)) == second
