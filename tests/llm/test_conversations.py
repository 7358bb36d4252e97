import datetime as dt
import random

from lexspark.llm.conversations import judge_conversations, rebuild_conversations

SCHEMA = "id string, conversation_id string, role string, content string, created_at timestamp_ntz, ingested_at timestamp_ntz, turns int, state int"
T = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, c, r, x, None if t is None else T + dt.timedelta(seconds=t), T, 0, 0) for i, c, r, x, t in rows], SCHEMA)


def brute(rows):
    seen, talks = set(), {}
    for i, c, r, x, t in rows:
        if not (c or "").strip() or (i and i.strip().lower() in seen):
            continue
        seen.add(i.strip().lower())
        talks.setdefault(c.strip().lower(), []).append((i, (r or "").strip().lower(), x, t))
    whole = {}
    for c, ms in talks.items():
        turns = sorted((t, r != "user", i, r, x) for i, r, x, t in ms if r != "system" and x and x.strip())
        roles = [r for *_, r, _ in turns]
        ok = all(r in ("user", "assistant", "system") for _, r, _, _ in ms)
        ok = ok and bool(roles) and len(roles) % 2 == 0 and all(r == ("user", "assistant")[n % 2] for n, r in enumerate(roles))
        whole[c] = [(r, x) for *_, r, x in turns] if ok else None
    return whole


def run(spark, rows):
    want = brute(rows)
    df = frame(spark, rows)
    assert {r["conversation_id"]: r["whole"] for r in judge_conversations(df).collect()} == {c: v is not None for c, v in want.items()}
    got = {}
    for r in sorted(rebuild_conversations(df).collect(), key=lambda r: r["turn_no"]):
        got.setdefault(r["conversation_id"], []).append((r["role"], r["content"]))
        assert r["turn_no"] == len(got[r["conversation_id"]])
    assert got == {c: v for c, v in want.items() if v}


def test_kinds(spark):
    run(spark, [
        ("1", "A", " User\n", "q", 1), ("2", "a", "ASSISTANT", "r", 1), ("2", "a", "assistant", "r", 1), ("3", "a", "system", "s", 0), ("4", "a ", "user", "  ", 5),
        ("5", "b", "user", "q", 1), ("6", "c", "assistant", "r", 1), ("7", "c", "user", "q", 2), ("8", "d", "system", "only", 1), ("9", "e", "tool", "", 1),
        ("10", "e", "user", "q", 2), ("11", "e", "assistant", "r", 3), ("12", None, "user", "q", 1), ("13", "f", None, "x", 1), ("14", " ", "user", "q", 1),
        ("15", "g", "user", "q", 1), ("16", "g", "user", "q", 2), ("17", "g", "assistant", "r", 3), ("18", "h", "user", "q", 1), ("19", "h", "assistant", None, 2),
    ])


def test_hot_conversation_over_many_stretches(spark):
    r = random.Random(4)
    rows = []
    for c, n in [("hot", 400), ("cut", 301)] + [(f"c{i}", r.randint(0, 6)) for i in range(60)]:
        for k in range(n):
            role = "user" if k % 2 == 0 else "assistant"
            rows.append((f"{c}-{k}", c, role if r.random() > 0.01 or c == "hot" else "user", f"t{k}", k // 2 * 2))
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    df = frame(spark, [])
    assert judge_conversations(df).count() == 0 and rebuild_conversations(df).count() == 0


def test_missing_times_and_ids(spark):
    rows = [(None, "a", "user", "q", None), (None, "a", "assistant", "r", 1), (None, "a", "assistant", "r", 1)]
    got = judge_conversations(frame(spark, rows)).collect()
    assert [(r["whole"], r["turns"]) for r in got] == [(True, 2)]
