import json

import numpy as np
from pyspark.sql import functions as F

from lexspark.functions import dialog as D
from lexspark.functions.embed import HashedWords, embed
from lexspark.functions.lookup import matches_search, translated_terms


def of(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expr).collect()]


def test_answers(spark):
    j = '{"paths": [{"title": "A", "success_probability": 1.7}, {"summary": "s", "success_probability": -1}, {}]}'
    raw = [j, f"```json\n{j}\n```", f"Hier: {j} Ende", f"<think>{{x</think>{j}", "kein JSON", "{kaputt", None]
    got = of(spark, D.answer_paths(F.col("x")), *raw)
    want = [(1, "A", "", 1.0), (2, "", "s", 0.0), (3, "", "", 0.5)]
    assert [[tuple(p) for p in g] for g in got[:4]] == [want] * 4 and got[4:] == [None] * 3
    assert of(spark, D.answer_field(F.col("x"), "t"), json.dumps({"t": "ja"}), "<think>a</think> roh") == ["ja", "roh"]


def test_prompts(spark):
    p = D.wrapped_prompt(F.col("x"), F.lit("S"), F.lit("U"))
    chat, tags, plain, none = of(spark, p, "Qwen2", "gemma-3", "other", None)
    assert chat == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"
    assert tags.startswith("<start_of_turn>user\nS") and plain == none == "S\n\nU"
    assert of(spark, D.without_prompt(F.col("x"), F.lit("ab")), "ab c", "xab") == ["c", "xab"]


def test_terms(spark):
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("rent", "Miete"), ("rent control", "Mietbremse"), ("control", "Kontrolle"), ("flat", "Wohnung"), ("home", "Wohnung"))])
    assert of(spark, translated_terms(F.col("x"), pairs), "My flat, my home: RENT control", "rent", "", None) == ["Wohnung Mietbremse", "Miete", "", ""]


def test_search(spark):
    text = "Gesetz zur Regelung der Netzkammern"
    ok = lambda q: spark.range(1).select(matches_search(F.lit(text), F.lit(q))).first()[0]
    assert ok("gesetz netzkammer") and ok('"zur regelung"') and ok("nichts or Regelung") and ok("Gesetz -Miete")
    assert not (ok("Gesetz -Regelung") or ok('"Regelung zur"') or ok("Miete") or ok("") or ok("-Miete"))


def test_embedding(spark):
    a, b, c, n = of(spark, embed(F.col("x"), HashedWords(8)), "Miete zahlen", "miete  ZAHLEN", "", None)
    assert a == b and abs(np.linalg.norm(a) - 1) < 1e-6 and c == n == [0.0] * 8
