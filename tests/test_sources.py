import json

from lexspark.sources import law_files as L

LAW = """<dokumente><norm doknr="D1"><metadaten><jurabk>AbG 2007</jurabk><jurabk>AbG2</jurabk><langue>Ein  Gesetz</langue></metadaten></norm>
<norm doknr="D2"><metadaten><jurabk>AbG 2007</jurabk><enbez>§ 1</enbez><titel>Zweck</titel></metadaten>
<textdaten><text><Content><P>(1) Eins <B>zwei</B></P><P> </P><P>(2) drei</P></Content></text></textdaten></norm></dokumente>"""


def test_law_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("a/one.xml", LAW), ("a/two.xml", LAW.replace("jurabk", "amtabk")), (".hid.xml", LAW), ("none.xml", "<dokumente><norm doknr='x'/></dokumente>"), ("x.txt", LAW), ("bad.xml", "<dokumente")):
        (tmp_path / name).write_text(text)
    files = L.law_paths(spark, str(tmp_path))
    assert sorted(r["name"] for r in files.collect()) == ["bad.xml", "none.xml", "one.xml", "two.xml"]
    assert [r["name"] for r in L.law_paths(spark, str(tmp_path), ("one",)).collect()] == ["one.xml"]
    laws = {r["path"].split("/")[-1]: r for r in L.parse_laws(files).collect()}
    assert set(laws) == {"one.xml", "two.xml"}
    assert laws["one.xml"]["raw_key"] == laws["two.xml"]["raw_key"] == "AbG 2007" and laws["one.xml"]["title"] == "Ein Gesetz"
    assert [(n["norm_id"], n["title"], n["paragraphs"]) for n in laws["one.xml"]["norms"]] == [("§ 1", "Zweck", ["(1) Eins zwei", "(2) drei"])]


def test_contents(spark):
    xml = "<items><item><title>A</title><link>http://a</link></item><item><title>B</title></item><item><title>C</title><link>http://c</link></item></items>"
    items = L.contents(spark.createDataFrame([(xml,)], "content string"))
    assert sorted(map(tuple, items.collect())) == [("A", "http://a"), ("C", "http://c")]
    assert [r["title"] for r in L.still_to_fetch(items, spark.createDataFrame([("http://a",)], "link string"), "link").collect()] == ["C"]


def test_questions_and_dictionaries(spark, tmp_path):
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"Question_text": "a", "Paragraphs": ["§ 1", "§ 2"]}, {"Question_text": "b", "Paragraphs": "§ 3"}, {"Question_text": "c"}, {"Paragraphs": "x"}]))
    assert sorted((r[0], r[1]) for r in L.questions(spark, str(q)).collect()) == [("a", ["§ 1", "§ 2"]), ("b", ["§ 3"]), ("c", [])]
    t = tmp_path / "t.ts"
    t.write_text('export const de = {\n  "a.b": "x: y",\n  title: \'Z\',\n  // note\n};\n')
    assert sorted(map(tuple, L.dictionary_lines(spark, str(t)).collect())) == [("a.b", "x: y"), ("title", "Z")]


def test_report(spark, tmp_path):
    L.write_report(spark.range(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
