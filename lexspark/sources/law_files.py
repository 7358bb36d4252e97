"""Readers for law files in XML, tables of contents, question files and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_P = "array<string>"
#: What is read of a law file; repeated elements are arrays, single ones are read as arrays of one.
LAW = (
    "norm array<struct<_doknr:string,"
    "metadaten:struct<jurabk:array<string>,amtabk:array<string>,langue:string,titel:string,enbez:string>,"
    "textdaten:struct<text:struct<Content:struct<P:array<string>>>>>>"
)


def law_paths(spark: SparkSession, root: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, content) of the XML files under `root`, hidden ones left out; with `prefixes` only names that begin so."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root)
    )
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.decode("content", "UTF-8").alias("content")).where(~F.col("name").startswith("."))
    keep = F.lit(not prefixes)
    for p in prefixes:
        keep = keep | F.col("name").startswith(p)
    return rows.where(keep)


def _text(c: Column) -> Column:
    """Text of a piece of markup: tags as blanks, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def parse_laws(files: DataFrame) -> DataFrame:
    """(path, raw_key, title, norms array<struct<norm_id, title, paragraphs array<string>>>) of each readable law file.

    The key is the first short name, else the first official one; files with neither are left out, as are norms with
    neither title nor paragraphs. Unreadable XML gives no row.
    """
    x = files.select("path", F.from_xml("content", LAW, {"mode": "PERMISSIVE", "attributePrefix": "_"}).alias("x"))
    head = F.get("x.norm", F.lit(0))["metadaten"]
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    key = F.coalesce(some(F.get(head["jurabk"], F.lit(0))), some(F.get(head["amtabk"], F.lit(0))))
    norms = F.transform(
        F.coalesce("x.norm", F.array()),
        lambda n: F.struct(
            F.coalesce(some(n["metadaten"]["enbez"]), some(n["_doknr"]), some(F.get(n["metadaten"]["jurabk"], F.lit(0))), F.lit("unknown")).alias("norm_id"),
            F.coalesce(some(n["metadaten"]["titel"]), F.lit("")).alias("title"),
            F.filter(F.transform(F.coalesce(n["textdaten"]["text"]["Content"]["P"], F.array().cast(_P)), _text), lambda p: p != "").alias("paragraphs"),
        ),
    )
    return x.select(
        "path", key.alias("raw_key"), _text(head["langue"]).alias("title"),
        F.filter(norms, lambda n: (n["title"] != "") | (F.size(n["paragraphs"]) > 0)).alias("norms"),
    ).where(F.col("raw_key").isNotNull())


def contents(files: DataFrame) -> DataFrame:
    """(title, link) of the items of tables of contents; items that lack one are left out."""
    schema = "item array<struct<title:string,link:string>>"
    items = files.select(F.inline(F.from_xml("content", schema)["item"]))
    clean = items.select(F.trim("title").alias("title"), F.trim("link").alias("link"))
    return clean.where((F.col("title") != "") & (F.col("link") != ""))


def still_to_fetch(items: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Items that have not been fetched."""
    return items.join(fetched.select(key).distinct(), key, "left_anti")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, paragraphs array<string>) of a JSON array or lines; paragraphs may be a list, one string, or absent."""
    raw = spark.read.option("multiLine", True).schema("Question_text string, Paragraphs string").json(path)
    return raw.where(F.col("Question_text").isNotNull()).select(F.col("Question_text").alias("question"), paragraphs_of(F.col("Paragraphs")).alias("paragraphs"))


def paragraphs_of(c: Column) -> Column:
    """array<string> of a JSON list, of one text, or of nothing."""
    p = F.trim(F.coalesce(c, F.lit("")))
    listed = F.from_json(p, "array<string>")
    return F.when(p == "", F.array().cast("array<string>")).when(p.startswith("["), listed).otherwise(F.array(p))


def dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines like `key: "value",`; others are left out."""
    return dictionary_of(spark.read.text(path), "value")


def dictionary_of(lines: DataFrame, column: str) -> DataFrame:
    """(key, value) of lines that are in a column."""
    line = r"""^\s*["']?([\w.]+)["']?\s*:\s*["'](.*)["']\s*,?\s*$"""
    rows = lines.select(F.regexp_extract(column, line, 1).alias("key"), F.regexp_extract(column, line, 2).alias("value"))
    return rows.where(F.col("key") != "")


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
