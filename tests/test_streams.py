import datetime as dt
import json
import random

import pytest

from pyspark.sql import functions as F

from lexspark.operators.store import current
from lexspark.streaming.merge import merge_stream
from lexspark.streaming.windows import anchored_stream, anchored_windows, assembled, debounced, fifo_hits, fixed_windows, fixed_windows_stream

T0 = dt.datetime(2024, 1, 1)


def log(spark, n=300):
    r = random.Random(2)
    return spark.createDataFrame([(i, r.choice("abbb"), T0 + dt.timedelta(seconds=r.randint(0, 3000))) for i in range(n)], "id long, who string, ts timestamp")


def brute(events, width):
    out, open_at, n = {}, {}, {}
    for i, who, ts in sorted(events, key=lambda e: (e[2], e[0])):
        if who not in open_at or ts >= open_at[who] + width:
            open_at[who], n[who] = ts, 0
        n[who] += 1
        out[i] = (open_at[who], n[who])
    return out


def test_anchored_windows_across_batches(spark):
    df = log(spark)
    events = [(r["id"], r["who"], int(r["ts"].timestamp() * 1e6)) for r in df.collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = anchored_windows(df, "who", F.unix_micros("ts"), "id", 60_000_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: (r["opened"], r["number"]) for r in got} == brute(events, 60_000_000)


def test_border_opens_a_new_window_and_nulls_are_left_out(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 59), (3, "a", 60), (4, None, 1), (5, "b", None)], "id long, who string, at long")
    got = {r["id"]: (r["opened"], r["number"]) for r in anchored_windows(df, "who", F.col("at"), "id", 60).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (60, 1)}
    assert anchored_windows(df.where("id > 9"), "who", F.col("at"), "id", 60).count() == 0


@pytest.mark.parametrize(("slices", "span"), [(1, 300), (2, 3000), (3, 40)])
def test_slices_of_a_log_change_nothing(spark, slices, span):
    r = random.Random(slices)
    events = sorted(((i, r.choice("abbb"), r.randint(-span, span * r.choice((1, 1, 30)))) for i in range(400)), key=lambda e: (e[2], e[0]))
    df = spark.createDataFrame(events, "id long, who string, at long").repartition(5)
    got = {x["id"]: (x["opened"], x["number"]) for x in anchored_windows(df, "who", F.col("at"), "id", 20, slices).collect()}
    assert got == brute(events, 20)


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_cache_pushes_out_the_oldest(spark, capacity):
    r = random.Random(capacity)
    log = [(i, r.choice("ab"), r.choice((None, *"uvwxyz")), r.randint(0, 400)) for i in range(300)]
    made, want = {}, {}
    for i, who, key, at in sorted(log, key=lambda e: (e[3], e[0])):
        cache = made.setdefault(who, [])
        want[i] = any(k == key and at - t <= 30 for k, t in cache) and key is not None
        if key is not None and not want[i]:
            made[who] = ([c for c in cache if c[0] != key] + [(key, at)])[-capacity:]
    df = spark.createDataFrame([*log, (900, None, "u", 1), (901, "a", "u", None)], "id long, who string, k string, at long")
    assert {x["id"]: x["hit"] for x in fifo_hits(df, "who", F.col("at"), "id", "k", 30, capacity).collect()} == want
    assert fifo_hits(df.where("id > 999"), "who", F.col("at"), "id", "k", 30, capacity).count() == 0


def stream(spark, df, path):
    df.orderBy("ts").write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_stream_of_fixed_windows_equals_batch(spark, tmp_path):
    df = log(spark)
    got = drained(fixed_windows_stream(stream(spark, df, str(tmp_path / "in")), "who", "ts", "5 minutes", 3), "fixed", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, fixed_windows(df, "who", "ts", "5 minutes", 3).collect()))


def test_stream_of_anchored_windows_equals_batch(spark, tmp_path):
    df = log(spark)
    got = drained(anchored_stream(stream(spark, df, str(tmp_path / "in")), "who", "ts", 60_000_000, 2), "anchored", "append")
    want = anchored_windows(df, "who", F.unix_micros("ts"), "id", 60_000_000).select("client", "at", (F.col("number") <= 2).alias("allowed"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_debounce(spark):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    df = spark.createDataFrame([("a", at(0)), ("a", at(299)), ("a", at(599)), ("b", at(0))], "who string, ts timestamp")
    got = sorted((r["who"], (r["at"] - T0).microseconds // 1000, r["events"]) for r in debounced(df, "who", "ts", 300_000).collect())
    assert got == [("a", 299, 2), ("a", 599, 1), ("b", 0, 1)]


def test_answers_from_lines(spark):
    line = lambda c, done=False: json.dumps({"message": {"content": c}, "done": done})
    df = spark.createDataFrame([(1, 2, line("b")), (1, 1, line("a")), (1, 3, '{"done": true}'), (2, 1, "kaputt"), (2, 2, None)], "k int, n int, l string")
    got = {r["k"]: (r["answer"], r["done"], r["unreadable"]) for r in assembled(df, "k", "n", "l").collect()}
    assert got == {1: ("ab", True, 0), 2: ("", False, 2)}


def test_merging_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int").write.parquet(src)
    for more in (None, [("b", 5), ("c", 1)]):
        if more:
            spark.createDataFrame(more, "k string, v int").write.mode("append").parquet(src)
        merge_stream(spark.readStream.schema("k string, v int").parquet(src), out, mark, ["k"], [F.col("v").desc()]).awaitTermination(120)
    assert sorted(map(tuple, current(spark, out).collect())) == [("a", 2), ("b", 5), ("c", 1)]
