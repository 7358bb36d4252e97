import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from lexspark.functions import notation as N
from lexspark.functions import text as T
from lexspark.functions import vectors as V
from lexspark.functions import words as W


def of(spark, expr, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_dates(spark):
    got = of(spark, N.date_value(F.col("x")), "2024-03-06T00:00:00Z", " 6.3.2024", "06.03.2024\n", "20240306", "2024-3-6", "", None, "bald", "31.02.2024", "99999999")
    assert got == [dt.date(2024, 3, 6)] * 5 + [None] * 5


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_do_not_depend_on_the_session(spark, zone):
    values = ["2024-10-03T09:06:41.586Z", "2024-10-03 09:06:41.586", "2024-10-03T11:06:41.586+02:00", "1727946401586", "3.10.2024 09:06:41.586", "unknown", "", None, "2024-13-01 00:00:00", "T12:00"]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = of(spark, N.instant_micros(F.col("x")), *values)
        day = of(spark, N.month_of_micros(F.lit(0) + F.col("x")), 1727946401586000, None, schema="x long")
        ntz = of(spark, N.ntz_micros(F.col("x")), dt.datetime(1970, 1, 2), schema="x timestamp_ntz")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1727946401586000] * 5 + [None] * 5
    assert day == ["2024-10", None] and ntz == [86_400_000_000]


def test_keys_and_checksums(spark):
    assert of(spark, N.stripped(F.col("x")), " a b\n", " k", "", None) == ["a b", "k", None, None]
    assert of(spark, N.uuid_key(F.col("x")), " AB ", "ab") == ["ab", "ab"]
    assert of(spark, N.checksum_value(F.col("x")), "md5:0A", " 0a\n", "", None) == ["0a", "0a", None, None]


def test_words_whatever_the_writing(spark):
    same = [
        "Die Prüfungspflicht der Nachbarin", "DIE PRÜFUNGSPFLICHT DER NACHBARIN", "Die PrÃ¼fungspflicht der  Nachbarin", "<p>Die Pr&uuml;fungspflicht <b>der</b><br/> Nachbarin</p>",
        "Die Prüfungs-\npflicht der Nachba­rin", "die Pruefungspflicht, der (Nachbarin)!",
    ]
    got = of(spark, W.words(F.col("x")), *same, None, "", "…")
    assert got[:6] == [["die", "pruefungspflicht", "der", "nachbarin"]] * 6 and got[6:] == [[], [], []]


def test_terms_and_keywords(spark):
    assert of(spark, T.query_terms(F.col("x")), "§ 12a, (Miete) miete!! x", None) == [["12a", "miete"], []]
    assert of(spark, T.query_keywords(F.col("x")), "Die Miete und der 12 Lärm") == [["miete", "lärm"]]
    assert of(spark, T.tokens(F.col("x")), "Öl-Preis_1 ß", None) == [["öl", "preis_1", "ß"], []]


def test_ids_and_forms(spark):
    space = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    assert of(spark, T.point_id(F.lit("norm"), F.col("x")), "a", "§ 3") == [str(uuid.uuid5(space, f"norm:{v}")) for v in ("a", "§ 3")]
    assert of(spark, T.official_section(F.col("x")), "Section 12a x", "article 3", "§ 3") == ["§ 12a", "Art 3", "§ 3"]
    assert of(spark, T.without_year(F.col("x")), "AbG 2007", "AbG") == ["AbG", "AbG"]
    assert of(spark, T.slug(F.col("x"), 5), "Ein Text hier") == ["ein-t"]
    assert of(spark, T.safe_name(F.col("x")), "http://h/a b/c.zip", "x") == ["a_b", None]
    assert of(spark, T.title_case(F.col("x")), "some_case") == ["Some Case"]
    assert of(spark, T.bare_norm_id(F.col("x")), " § 12 ") == ["12"]


def test_texts_of_a_model(spark):
    assert of(spark, T.hidden_thoughts_removed(F.col("x")), "<think>a\nb</think> c", "d") == ["c", "d"]
    assert of(spark, T.inside_thought(F.col("x")), "<think>a", "<think>a</think>b", "x", "</think><think>y") == [True, False, False, True]
    assert of(spark, T.has_secret(F.col("x")), "key sk-abcdefghijklmnopqrst", "nothing", None) == [True, False, False]


def test_templates(spark):
    m = F.create_map(F.lit("a"), F.lit("$&"), F.lit("b"), F.lit(None).cast("string"))
    assert of(spark, T.filled(F.col("x"), m), "{{a}} {{b}} {{a}} {{c}}") == ["$&  $& {{c}}"]


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4, 5.6.7.8", None), ("", "9.9.9.9"), (None, None)], "f string, r string")
    assert [r[0] for r in df.select(T.first_hop(F.col("f"), F.col("r"))).collect()] == ["1.2.3.4", "9.9.9.9", "127.0.0.1"]
    urls = ["http://localhost:11434/x", "https://192.168.1.4", "http://172.20.0.1", "https://example.org", "ftp://x@10.0.0.1/", None]
    assert of(spark, T.is_local_url(F.col("x")), *urls) == [True, True, True, False, True, False]


def test_trigrams(spark):
    assert sorted(of(spark, T.trigrams(F.col("x")), "Cat")[0]) == ["  c", " ca", "at ", "cat"]
    sim = T.trigram_similarity(T.trigrams(F.col("x")), T.trigrams(F.lit("cat")))
    assert of(spark, sim, "cat", "dog", None, "") == [1.0, 0.0, 0.0, 0.0]


def test_vectors(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(V.is_vector(F.col("v"), 2)).collect()] == [True] + [False] * 6
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert tuple(spark.range(1).select(V.cosine(a, a), V.cosine(a, b), V.magnitude(a)).first()) == (1.0, 0.0, 5.0)


def test_queries_and_prompts(spark):
    terms = F.array(F.lit("a"), F.lit("b"))
    assert of(spark, T.query_text(T.expanded(F.col("x"), terms)), "q") == ["query: a b q"]
    assert of(spark, T.expanded(F.col("x"), F.array().cast("array<string>")), "q", None) == ["q", ""]
    assert of(spark, T.assembled_prompt([("A", F.col("x")), ("B", F.lit("y"))]), "x", " ", None) == ["A: x\nB: y", "B: y", "B: y"]
    assert of(spark, T.tagged_passage(F.lit("BGB"), F.col("x"), F.lit("c")), "t", None) == ["passage: [BGB] t. c", "passage: [BGB] c"]
    assert of(spark, T.url_encoded(F.col("x")), "a b/ü", None) == ["a%20b%2F%C3%BC", None]
    assert of(spark, T.fallback_words(F.col("x")), "Was ist die alte neue rote blaue gute letzte siebte Frist", None, "") == ["was alte neue rote blaue gute", "", ""]
    assert of(spark, T.only_keys(F.col("x"), F.array(F.lit("BGB"), F.lit("StGB"))), "BGB", "BGB StGB", "BGB x", "", None, "BGB BGB BGB BGB") == [True, True, False, False, False, False]
    assert of(spark, T.is_landmark(F.col("x"), 5), "Table of Contents here", "Back to top", "abcd", "abcde", None) == [True, True, True, False, True]


def test_fields_of_a_law(spark):
    assert of(spark, T.authority(F.col("x"), F.lit("K")), "Gesetz", "Verordnung", "x", None) == ["Federal Law", "Regulation", "Regulation", "Regulation"]
    assert of(spark, T.authority(F.lit("x"), F.col("x")), "BGH 1", "StVG", None) == ["Court Decision", "Federal Law", "Regulation"]
    assert of(spark, T.in_force(F.col("x")), "X (weggefallen)", "Außer Kraft", "x", None) == ["Invalid/Amended", "Invalid/Amended", "Active", "Active"]
    assert of(spark, T.jurisdiction(F.col("x"), F.lit("k")), "Bauordnung Berlin", None) == ["Berlin (State)", "Germany (Federal)"]


def test_functions_for_sql_texts(spark):
    from lexspark.functions.register import register

    register(spark)
    register(spark)
    got = spark.sql("SELECT trigram_similarity('Haus', 'haus') a, trigram_similarity('', NULL) b, vector_cosine(array(0D), array(1D)) c, bm25_score(0D, 5D, 10D, 1D) d, request_allowed(5, 3) e").first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (1.0, 0.0, 0.0, 0.0) and tuple(got["e"]) == (False, 0)


def test_reverse_terms(spark):
    from lexspark.functions.lookup import reverse_term

    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("rent", "miete"), ("tenancy", "miete"), ("rental deposit", "mietkaution"))])
    assert of(spark, reverse_term(F.col("x"), pairs), " Miete", "Die Mietkaution", "die miete", "x", None) == ["rent", "rental deposit", "rent", None, None]
