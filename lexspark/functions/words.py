"""Words of a text, whatever its markup, layout or encoding damage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named and numeric character references, as text.
_REFERENCES = {
    "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß",
    "&#228;": "ä", "&#246;": "ö", "&#252;": "ü", "&#196;": "Ä", "&#214;": "Ö", "&#220;": "Ü", "&#223;": "ß",
    "&nbsp;": " ", "&#160;": " ", "&shy;": "", "&#173;": "", "&sect;": "§", "&#167;": "§", "&amp;": "&",
}
# UTF-8 that was read as Windows-1252 or Latin-1.
_MISREAD = {
    "Ã¤": "ä", "Ã¶": "ö", "Ã¼": "ü", "Ã„": "Ä", "Ã–": "Ö", "Ãœ": "Ü", "ÃŸ": "ß", "Ã\x84": "Ä", "Ã\x96": "Ö", "Ã\x9c": "Ü",
    "Ã\x9f": "ß", "Ã©": "é", "Ã¨": "è", "Â§": "§", "Â\xa0": " ", "â€“": "–", "â€¦": "…", "â€ž": '"', "â€œ": '"',
}
# Letters with more than one spelling.
_FOLDED = {
    "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ä": "ae", "ö": "oe", "ü": "ue", "ﬁ": "fi", "ﬂ": "fl",
}

_INLINE = r"(?i)</?(?:a|b|code|em|font|i|mark|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>"
_TAG = r"</?[a-zA-Z!][^<>]*>"
_INVISIBLE = r"[\x{00ad}\x{200b}-\x{200d}\x{2060}\x{feff}]"
_BROKEN_WORD = r"(?<=\p{L})[-\x{2010}][ \t]*[\r\n]\s*(?=\p{Ll})"
# What makes each costly replacement worth a look.
_HIDDEN = ("\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def _let(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def _where(c: Column, needed, f) -> Column:
    """f(c) where `needed` holds for c, else c."""
    return _let(c, lambda s: F.when(needed(s), f(s)).otherwise(s))


def plain_text(c: Column) -> Column:
    """Without markup, character references, invisible characters, words broken at line ends and misread bytes."""
    s = _where(c, lambda s: s.contains("&"), lambda s: _replaced(s, _REFERENCES))
    s = _where(s, lambda s: _any(s, ("Ã", "Â", "â€")), lambda s: _replaced(s, _MISREAD))
    s = _where(
        s, lambda s: s.contains("<"), lambda s: F.regexp_replace(F.regexp_replace(s, _INLINE, ""), _TAG, " ")
    )
    s = _where(s, lambda s: _any(s, _HIDDEN), lambda s: F.regexp_replace(s, _INVISIBLE, ""))
    hyphen = lambda s: _any(s, ("-", "\u2010")) & _any(s, ("\n", "\r"))
    return _where(s, hyphen, lambda s: F.regexp_replace(s, _BROKEN_WORD, ""))


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case, with umlauts and sharp s spelt out; null gives no words."""
    s = _replaced(F.lower(plain_text(F.coalesce(c, F.lit("")))), _FOLDED)
    return F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), 0)


def word_hashes(c: Column) -> Column:
    """64-bit hashes of the words; a comparison of texts of a thousand words errs once in 10^13."""
    return F.transform(words(c), lambda w: F.xxhash64(w))
