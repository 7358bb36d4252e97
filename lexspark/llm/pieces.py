"""Splitting oversized texts at natural boundaries.

A text is parsed into a tree: sections in the depth of their headings, paragraphs, list items in the depth of their
nesting, lines, sentences, clauses, words. The tree is packed bottom-up: neighbouring siblings are merged as long as they
fit, and only a node that is larger than the limit is descended into. The pieces of such a node stay inside it: its last
one is not joined with what follows. Between words of a stretch without any boundary the cut is hard, and the piece says
so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths, the strongest first: six depths of headings, paragraph, four depths of lists, line, sentence,
#: clause, and the hard cut between words.
DEPTHS, NESTED = 6, 4
PARAGRAPH = DEPTHS
ITEM = PARAGRAPH + 1
LINE, SENTENCE, CLAUSE, WORD = range(ITEM + NESTED, ITEM + NESTED + 4)
KINDS = (*["section"] * DEPTHS, "paragraph", *["item"] * NESTED, "line", "sentence", "clause", "hard")

_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_STOPS = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029.;:!?]")
_MARKS = re.compile(r"(#{1,6})\s|<h([1-6])\b", re.I)
#: Words that begin a heading of a law or a book, by depth.
_PARTS = (
    ("buch", "book", "teil", "part"), ("titel", "title", "kapitel", "chapter"), ("abschnitt", "unterabschnitt", "section"), ("artikel", "article", "art."), ("§", "§§"),
)
_NAMED = re.compile(
    r"(?:(" + "|".join(re.escape(w) for words in _PARTS for w in sorted(words, key=len, reverse=True)) + r")\s*(?:\d+[a-z]?|[IVX]+)\b[^.;:!?]{0,80}$)", re.I
)
_NAMED_DEPTH = {w: d + 1 for d, words in enumerate(_PARTS) for w in words}
_NUMBERED = re.compile(r"\(\d+[a-z]?\)\s|<p\b", re.I)
_ITEM = re.compile(r"(?:(\d{1,3}[.)])|([a-z]{2}\))|([a-z]\))|([-*•–]))\s|(<li\b)", re.I)
_LIST_TAG = re.compile(r"<(/?)(?:ul|ol)\b", re.I)
_ENDS = re.compile(r"[.!?…][\"'»“”’)\]]*$")
_CLAUSE = re.compile(r"[;:][\"'»“”’)\]]*$")
#: Abbreviations after which a full stop ends no sentence.
_ABBREVIATED = {
    "abs.", "nr.", "s.", "ff.", "f.", "vgl.", "i.", "v.", "m.", "art.", "bzw.", "z.", "b.", "d.", "h.", "u.", "a.", "ggf.", "usw.",
    "no.", "sec.", "cf.", "e.g.", "i.e.", "para.", "dr.", "st.",
}


class _Lines:
    """What the beginning of each line says about the boundary before it; remembers the list that is open."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = []  # (indent, kind of mark) of the items around
        self.tags = 0  # <ul> and <ol> that are open
        self.headed = False  # whether the line before is a heading, which is not parted from what it heads

    def strength(self, indent: int, line: str, breaks: int) -> int:
        headed, found = self.headed, self._strength(indent, line, breaks)
        self.headed = found < DEPTHS
        return WORD if headed and not self.headed else found

    def _strength(self, indent: int, line: str, breaks: int) -> int:
        marks = _MARKS.match(line)
        named = None if marks else _NAMED.match(line)
        if marks or named:
            self.open = []
            depth = (len(marks[1]) if marks[1] else int(marks[2])) if marks else _NAMED_DEPTH[named[1].lower()]
            return min(depth, DEPTHS) - 1
        item = _ITEM.match(line)
        if item:
            return ITEM + min(self._nesting(indent, item), NESTED - 1)
        if breaks > 1 or _NUMBERED.match(line):
            self.open = []
            return PARAGRAPH
        return LINE

    def _nesting(self, indent: int, item: re.Match) -> int:
        if item[5]:  # an element: the tags around it tell
            return max(self.tags - 1, 0)
        mark = item[4] or str(next(g for g in (1, 2, 3) if item[g]))
        known = [i for i, (_, m) in enumerate(self.open) if m == mark]
        if known and self.open[known[-1]][0] >= indent:
            back = [i for i in known if self.open[i][0] <= indent] or known[:1]
            self.open = self.open[: back[-1] + 1]
        else:
            self.open.append((indent, mark))
        return len(self.open) - 1

    def passed(self, text: str) -> None:
        for close in _LIST_TAG.findall(text):
            self.tags = max(0, self.tags - 1) if close else self.tags + 1


def _strengths(text: str, found: list[tuple[int, int]]) -> list[int]:
    """The strength of the boundary behind each token."""
    lines, out = _Lines(), []
    lines.strength(0, _BREAK.split(text[found[0][0] : found[0][0] + 120], maxsplit=1)[0], 0)
    listed = "<ul" in text.lower() or "<ol" in text.lower()
    if listed:
        lines.passed(text[: found[0][1]])
    for i, (a, b) in enumerate(found[:-1]):
        after, end = found[i + 1]
        gap = text[b:after]
        breaks = len(_BREAK.findall(gap))
        if breaks:
            line = _BREAK.split(text[after : after + 120], maxsplit=1)[0]
            indent = len(_BREAK.split(gap)[-1].expandtabs(4))
            out.append(lines.strength(indent, line, breaks))
        else:
            out.append(_inline(text[a:b]))
        if listed:
            lines.passed(text[after:end])
    return out


def _inline(token: str) -> int:
    """The strength of the boundary behind a token inside a line."""
    if _ENDS.search(token):
        if token.lower().lstrip("([\"'") in _ABBREVIATED or re.fullmatch(r"\(?\d{1,3}\.", token):
            return WORD
        return SENTENCE
    return CLAUSE if _CLAUSE.search(token) else WORD


@dataclass
class Node:
    """Tokens begin..end of a text, parted into children at the strongest boundary inside; leaves are words."""

    begin: int
    end: int
    children: list[Node] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.end - self.begin


def parse_tree(strengths: list[int], limit: int) -> Node:
    """The tree over len(strengths) + 1 tokens, at most as deep as there are strengths; nodes within `limit` are not parted
    any further."""
    root = Node(0, len(strengths) + 1)
    todo = [root]
    while todo:
        node = todo.pop()
        if node.size <= limit:
            continue
        inside = strengths[node.begin : node.end - 1]
        strongest = min(inside)
        if strongest == WORD:
            continue
        cuts = [node.begin, *[node.begin + i + 1 for i, s in enumerate(inside) if s == strongest], node.end]
        node.children = [Node(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        todo += node.children
    return root


def pack_tree(root: Node, room: int) -> list[tuple[int, int]]:
    """Spans of at most `room` tokens in order. Only whole siblings are merged."""
    spans: list[tuple[int, int]] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.size <= room:
            spans.append((node.begin, node.end))
        elif not node.children:
            spans += [(i, min(i + room, node.end)) for i in range(node.begin, node.end, room)]
        else:
            merged: list[Node] = []
            for c in node.children:
                if merged and c.size <= room and merged[-1].size + c.size <= room:
                    merged[-1] = Node(merged[-1].begin, c.end)
                else:
                    merged.append(c)
            todo += reversed(merged)
    return spans


def split_text(text: str, limit: int = 256, overlap: int = 32) -> list[tuple[int, int, int, int, int]]:
    """Pieces (start, fresh, stop, tokens, strength) as offsets: text[start:stop] is the piece, which up to `fresh` repeats
    the last `overlap` tokens of its predecessor; text[fresh:stop] of all pieces in order is the text.

    Tokens are runs of non-space. No piece has more than `limit`. A text within the limit is one piece.
    """
    found = [m.span() for m in re.finditer(r"\S+", text)]
    n = len(found)
    if n <= limit:
        return [(0, 0, len(text), n, 0)]
    strengths = _strengths(text, found)
    pieces = []
    for a, b in pack_tree(parse_tree(strengths, limit - overlap), limit - overlap):
        back = min(overlap, a)
        fresh = found[a][0] if a else 0
        stop = found[b][0] if b < n else len(text)
        pieces.append((found[a - back][0] if a else 0, fresh, stop, b - a + back, strengths[b - 1] if b < n else 0))
    return pieces


def longest_stretch(text: str) -> int:
    """Tokens in the longest stretch without any line break or stop."""
    return max(len(x.split()) for x in _STOPS.split(text))


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 256, overlap: int = 32) -> DataFrame:
    """(key, piece_no, content, tokens, overlap, fresh_at, ends_at, unbroken) for every row whose text has more than `limit` tokens.

    Pieces count from 1, have at most `limit` tokens, and each but the first begins with the last `overlap` tokens of
    its predecessor; what is new in a piece begins behind its first `fresh_at` characters, so that these parts in order are
    the text. `ends_at` is the boundary kind behind the piece. `unbroken` is 1 if the text has a stretch of more
    than `limit` tokens without line break or any of `. ; : ! ?`. Null, blank and small texts give no rows. Repeated
    rows give repeated pieces. Rows are handled one by one; nothing is shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                parts = split_text(t, limit, overlap)
                if len(parts) == 1:
                    continue
                flag = int(longest_stretch(t) > limit)
                for i, (start, fresh, stop, size, kind) in enumerate(parts, 1):
                    repeated = len(t[start:fresh].split())
                    out.append((k, i, t[start:stop], size, repeated, fresh - start, KINDS[kind], flag))
            yield pd.DataFrame(out, columns=[key, "piece_no", "content", "tokens", "overlap", "fresh_at", "ends_at", "unbroken"])

    kind = df.schema[key].dataType.simpleString()
    # more than `limit` tokens take at least 2 * limit + 1 characters: the small texts never leave the JVM
    large = df.where(F.length(text) > 2 * limit).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return large.mapInPandas(
        work,
        f"`{key}` {kind}, piece_no long, content string, tokens long, overlap long, fresh_at long, ends_at string, unbroken long",
    )
