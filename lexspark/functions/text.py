"""Tokens, terms, ids and small text forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning for a search, German and English; a parameter wherever it is used.
STOP_WORDS = (
    "aber", "als", "am", "an", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einem", "einen", "einer",
    "eines", "für", "hat", "im", "in", "ist", "mit", "nach", "nicht", "oder", "sich", "sie", "sind", "und", "von", "vor", "wer", "wie",
    "wird", "zu", "zum", "zur", "über", "a", "an", "and", "are", "at", "by", "for", "from", "has", "how", "is", "of", "on", "or", "the",
    "this", "to", "what", "when", "which", "with",
)


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII word characters and German letters; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\wäöüß]+"), 0)


def _edges(kind: str) -> str:
    return f"^[^{kind}]+|[^{kind}]+$"


def _parts(c: Column, kind: str, least: int) -> Column:
    bare = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, _edges(kind), ""))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= least))


def query_terms(c: Column) -> Column:
    """Distinct words of a query without edge punctuation, of two characters or more."""
    return _parts(c, "a-zäöüß0-9", 2)


def query_keywords(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of letters at their edges, of three characters or more, that are no stop words."""
    return F.array_except(_parts(c, "a-zäöüß", 3), F.array(*[F.lit(w) for w in stop]))


def word_count(c: Column) -> Column:
    """Words between white space; null and blank have none."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), 0)).cast("long")


def letters_only(c: Column) -> Column:
    """Lower case, with every run of other characters than German letters as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-zäöüß]+", " "))


def bare_norm_id(c: Column) -> Column:
    """Without leading section signs and white space."""
    return F.trim(F.ltrim(F.trim(c), F.lit("§")))


def official_section(c: Column) -> Column:
    """`Section 12a` as `§ 12a`, `Article 1` as `Art 1`, else unchanged."""
    section = F.regexp_extract(c, r"(?i)^\s*section\s+(\d+[a-z]?)", 1)
    article = F.regexp_extract(c, r"(?i)^\s*article\s+(\d+[a-z]?)", 1)
    return F.when(section != "", F.concat(F.lit("§ "), section)).when(
        article != "", F.concat(F.lit("Art "), article)
    ).otherwise(c)


def without_year(c: Column) -> Column:
    """A key without a trailing year of four digits."""
    return F.trim(F.regexp_replace(F.trim(c), r"\d{4}$", ""))


def safe_name(c: Column) -> Column:
    """The last but one part of a URL's path as a directory name."""
    return F.regexp_replace(F.try_element_at(F.split(c, "/"), F.lit(-2)), r"[^\w.-]", "_")


def slug(c: Column, longest: int = 40) -> Column:
    """Lower case, white space as hyphens, cut to `longest` characters."""
    return F.substring(F.lower(F.regexp_replace(c, r"\s+", "-")), 1, longest)


def passage(law_title: Column, norm_title: Column, content: Column, longest: int = 4000) -> Column:
    """The text to embed: `passage: ` with title, norm title and the start of the content, without empty parts."""
    some = lambda c, end: F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit(end))).otherwise("")
    return F.concat(
        F.lit("passage: "), some(law_title, ". "), some(norm_title, ". "), F.coalesce(F.substring(content, 1, longest), F.lit(""))
    )


def point_id(*parts: Column) -> Column:
    """UUID version 5 in the DNS name space of the parts joined by colons."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(F.concat_ws(":", *parts), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(
        cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12)
    )


def client_hash(c: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def first_hop(forwarded: Column, real: Column) -> Column:
    """The client's address from proxy headers, else 127.0.0.1."""
    hop = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(hop != "", hop), F.when(F.trim(real) != "", F.trim(real)), F.lit("127.0.0.1"))


def is_local_url(c: Column) -> Column:
    """Whether a URL points to this machine or a private network."""
    host = F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://(?:[^@/]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    private = r"^(localhost|\[::1\]|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|169\.254\..*|0\.0\.0\.0|.*\.local)$"
    return F.coalesce(host.rlike(private), F.lit(False))


def hidden_thoughts_removed(c: Column) -> Column:
    """Without `<think>` parts."""
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""))


def inside_thought(c: Column) -> Column:
    """Whether a text that is still growing ends inside an unclosed `<think>`."""
    opened = F.length(c) - F.instr(F.reverse(c), F.reverse(F.lit("<think>")).cast("string"))
    closed = F.length(c) - F.instr(F.reverse(c), F.reverse(F.lit("</think>")).cast("string"))
    return c.contains("<think>") & (~c.contains("</think>") | (opened > closed))


def filled(template: Column, values: Column) -> Column:
    """`{{name}}` replaced from a map; unknown names stay."""
    return F.aggregate(
        F.map_entries(values),
        template,
        lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))),
    )


def title_case(c: Column) -> Column:
    """`some_snake_case` as `Some Snake Case`."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


#: Shapes of access keys that must not leave the system.
SECRETS = (r"sk-[A-Za-z0-9_-]{16,}", r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"AIza[0-9A-Za-z_-]{30,}", r"(?i)bearer\s+[a-z0-9._-]{16,}")


def has_secret(c: Column) -> Column:
    """Whether a text holds something like an access key."""
    found = F.lit(False)
    for p in SECRETS:
        found = found | c.rlike(p)
    return F.coalesce(found, F.lit(False))


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of the words, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9äöüß]+", " "), " "), lambda w: w != "")
    pieces = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(pieces))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def share_of(words: Column, listed: tuple[str, ...]) -> Column:
    """Share of the words that are in a list; 0 for no words."""
    known = F.array(*[F.lit(w) for w in listed])
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.array_contains(known, w))), F.size(words)), F.lit(0.0))


def expanded(c: Column, terms: Column) -> Column:
    """A query with the terms of its category before it; as it is without any."""
    return F.concat_ws(" ", F.when(F.size(terms) > 0, F.array_join(terms, " ")), c)


def query_text(c: Column) -> Column:
    """The query to embed."""
    return F.concat(F.lit("query: "), c)


def tagged_passage(law_key: Column, norm_title: Column, content: Column, longest: int = 4096) -> Column:
    """The text to embed with the law's key in front: `passage: [KEY] title. content`, without empty parts."""
    some = lambda c, a, b: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(a), c, F.lit(b))).otherwise("")
    return F.concat(
        F.lit("passage: "), some(law_key, "[", "] "), some(norm_title, "", ". "), F.coalesce(F.substring(content, 1, longest), F.lit(""))
    )


def assembled_prompt(parts: list[tuple[str, Column]]) -> Column:
    """Lines of `name: value`; parts that are null or blank are left out."""
    return F.concat_ws("\n", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in parts])


def url_encoded(c: Column) -> Column:
    """Percent-encoded, blanks as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def fallback_words(c: Column, stop: tuple[str, ...] = STOP_WORDS, longest: int = 6) -> Column:
    """The first words of more than two characters that are no stop words, as one text."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.array_join(F.slice(words, 1, longest), " ")


def only_keys(c: Column, keys: Column, most: int = 3) -> Column:
    """Whether a text is one to `most` words that are all known keys."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & (F.size(words) <= most) & F.forall(words, lambda w: F.array_contains(keys, w))


def is_landmark(c: Column, least: int = 3) -> Column:
    """Whether a line only helps to find one's way: a table of contents, a link to the top, or shorter than `least`."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return low.contains("table of contents") | low.contains("back to top") | (F.length(low) < least)


def authority(title: Column, key: Column) -> Column:
    """Who made a law, by words of its title and the form of its key."""
    t, k = F.upper(F.coalesce(title, F.lit(""))), F.upper(F.coalesce(key, F.lit("")))
    court = k.contains("BGH") | k.contains("BVERFG") | k.contains("BSG") | k.contains("BFH")
    law = t.contains("GESETZ") | k.endswith("G")
    return F.when(law, "Federal Law").when(t.contains("ORDNUNG"), "Regulation").when(court, "Court Decision").otherwise("Regulation")


def in_force(title: Column) -> Column:
    """Whether a law is in force, by notes in its title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(t.contains("außer kraft") | t.contains("weggefallen") | t.contains("(a.f.)"), "Invalid/Amended").otherwise("Active")


def jurisdiction(title: Column, key: Column) -> Column:
    """Where a law holds: in Berlin if title or key name it, else in all of Germany."""
    named = F.lower(F.concat_ws(" ", key, title)).contains("berlin")
    return F.when(named, "Berlin (State)").otherwise("Germany (Federal)")
