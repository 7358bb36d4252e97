"""Building a corpus: duplicates, keys, paragraphs, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_exact(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row by `order` of rows that agree in all `columns`; nulls agree with nulls.

    Rows meet by a hash of the columns, so that long texts are not shuffled as keys; the columns decide within it.
    """
    same = Window.partitionBy(F.xxhash64(*columns), *columns).orderBy(order)
    return df.withColumn("_n", F.row_number().over(same)).where(F.col("_n") == 1).drop("_n")


def best_duplicate(df: DataFrame, keys: list[str], scores: list[Column], order: str) -> DataFrame:
    """Of rows with the same keys the one with the greatest scores; of equals the first by `order`. A row with a null
    key is kept. `slot` is the place of the first of them."""
    keyless = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    w = Window.partitionBy(*keys, F.when(keyless, F.col(order)))  # rows without key do not meet in one task
    rank = F.row_number().over(w.orderBy(*[s.desc() for s in scores], order))
    picked = df.withColumns({"slot": F.when(keyless, F.col(order)).otherwise(F.min(order).over(w)), "_n": rank})
    return picked.where((F.col("_n") == 1) | keyless).drop("_n")


def distinct_ids(df: DataFrame, group: list[str], id_: str, order: str) -> DataFrame:
    """`unique_id`: the id, with one `_` more for each row of the group that has it already."""
    rank = F.row_number().over(Window.partitionBy(*group, id_).orderBy(order))
    return df.withColumn("unique_id", F.concat(F.col(id_), F.repeat(F.lit("_"), rank - 1)))


def resolve_keys(df: DataFrame, raw: str, stripped: Column, order: str) -> DataFrame:
    """(`raw`, key): without the year where only one raw key has that form, else as it is; the newest row of a raw key."""
    newest = F.row_number().over(Window.partitionBy(raw).orderBy(F.col(order).desc_nulls_last()))
    one = df.withColumn("_n", newest).where((F.col("_n") == 1) & F.col(raw).isNotNull()).drop("_n")
    one = one.withColumn("_short", stripped)
    alone = F.count(F.lit(1)).over(Window.partitionBy("_short")) == 1
    return one.withColumn("key", F.when(alone, F.col("_short")).otherwise(F.col(raw))).drop("_short")


_NUMBER = r"^\s*(?:\((\d+[a-z]?)\)|(\d+[a-z]?)[.)](?=\s)|§\s*(\d+[a-z]?))"


def stitch_paragraphs(text: Column) -> Column:
    """array<struct<number, text>>: lines of a text, an unnumbered one joined to the numbered one before it.

    Lines before the first number are paragraphs of their own, numbered by their place from 0. Blank lines are left out.
    """
    lines = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    number = lambda x: F.concat(*[F.regexp_extract(x, _NUMBER, g) for g in (1, 2, 3)])

    def starts(v: Column) -> Column:
        """Places of the lines that begin a paragraph: those with a number, and all before the first of these."""
        first = F.array_position(F.transform(v["numbers"], lambda n: n != ""), F.lit(True))
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(v["lines"]), F.lit(1))), lambda i: i <= F.size(v["lines"]))
        return F.filter(places, lambda i: (F.get(v["numbers"], i - 1) != "") | (first == 0) | (i < first))

    def paragraphs(v: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            end = F.coalesce(F.get(v["starts"], k + 1), F.size(v["lines"]) + 1)
            n = F.get(v["numbers"], i - 1)
            return F.struct(F.when(n != "", n).otherwise((i - 1).cast("string")).alias("number"), F.array_join(F.slice(v["lines"], i, end - i), "\n").alias("text"))

        return F.transform(v["starts"], one)

    # each step once per text, as variables of functions over arrays of one entry
    held = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.transform(x, number).alias("numbers")))
    begun = F.transform(held, lambda v: F.struct(v["lines"].alias("lines"), v["numbers"].alias("numbers"), starts(v).alias("starts")))
    return F.transform(begun, paragraphs)[0]


def sections(df: DataFrame, key: str, html: str, header: str) -> DataFrame:
    """(key, section_no, heading, body): `<p>` elements cut into sections, each from a paragraph that matches `header`.

    Paragraphs before the first header are section 0 without heading. Tags inside paragraphs are dropped.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p\b[^>]*>(.*?)(?:</p>|$)"), 1)
    plain = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    rows = df.select(key, F.posexplode(plain).alias("pos", "p")).where(F.col("p") != "")
    by = Window.partitionBy(key).orderBy("pos")
    head = F.col("p").rlike(header)
    marked = rows.withColumns({"head": head, "section_no": F.sum(head.cast("long")).over(by)})
    body = F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "p")))), lambda s: s["p"])
    return marked.groupBy(key, "section_no").agg(
        F.max(F.when(F.col("head"), F.col("p"))).alias("heading"), F.array_join(body, " ").alias("body")
    )


def carry_over(fresh: DataFrame, old: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`fresh` with `column` taken from `old` where it is null; `old` has each key at most once."""
    before = old.select(*keys, F.col(column).alias("_old"))
    return fresh.join(before, keys, "left").withColumn(column, F.coalesce(column, "_old")).drop("_old")
