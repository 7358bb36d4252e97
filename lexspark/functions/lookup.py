"""Term dictionaries and word searches over short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import tokens


def translated_terms(text: Column, pairs: Column) -> Column:
    """Translations of the terms of a text, joined by blanks.

    pairs: array<struct<a, b>>, b the translation of a. Each term counts where it first occurs; of terms that overlap
    the earlier one wins, of those at one place the longer; a translation is given once.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.filter(pairs, lambda p: F.contains(t, F.lower(p["a"])))
    placed = F.array_sort(
        F.transform(found, lambda p: F.struct(F.instr(t, F.lower(p["a"])).alias("at"), (-F.length(p["a"])).alias("less"), p["b"].alias("b")))
    )
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(
        placed,
        start,
        lambda s, p: F.when(p["at"] > s["end"], F.struct((p["at"] - p["less"] - 1).alias("end"), F.concat(s["out"], F.array(p["b"])).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return F.array_join(F.array_distinct(kept), " ")


def light_stem(word: Column) -> Column:
    """A word without common German endings, if it is long enough; an approximation, no dictionary."""
    return F.when(F.length(word) > 5, F.regexp_replace(word, "(?:ungen|ung|ern|en|em|er|es|e|n|s)$", "")).otherwise(word)


def matches_search(text: Column, query: Column) -> Column:
    """Whether a text meets a search: words and "phrases" must all occur, `-` before one forbids it, `or` parts choices.

    Words are compared by their light stems. A search without words matches nothing.
    """
    stems = lambda c: F.transform(tokens(c), light_stem)
    padded = F.concat(F.lit(" "), F.array_join(stems(text), " "), F.lit(" "))
    parts = lambda g: F.filter(F.regexp_extract_all(g, F.lit(r'-?"[^"]*"|\S+'), 0), lambda w: F.size(tokens(w)) > 0)
    phrase = lambda w: F.concat(F.lit(" "), F.array_join(stems(w), " "), F.lit(" "))
    meets = lambda w: F.contains(padded, phrase(w)) != w.startswith("-")
    wanted = lambda g: F.exists(parts(g), lambda w: ~w.startswith("-"))
    groups = F.split(F.coalesce(query, F.lit("")), r"(?i)\s+or\s+")
    return F.exists(groups, lambda g: wanted(g) & F.forall(parts(g), meets))


def reverse_term(text: Column, pairs: Column) -> Column:
    """The first term whose translation is the text, else the first one whose translation occurs in it; without regard to case.

    pairs: array<struct<a, b>> in order; null where there is none.
    """
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    same = F.filter(pairs, lambda p: F.lower(p["b"]) == low)
    part = F.filter(pairs, lambda p: F.contains(low, F.lower(p["b"])))
    return F.coalesce(F.get(same, F.lit(0))["a"], F.get(part, F.lit(0))["a"])
