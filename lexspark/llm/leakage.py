"""Evaluation texts leaking into training text: Wu-Manber search over words.

The patterns are all windows of `seed` words of the evaluation texts. The text is read in blocks of two words: the shift
table says how far a window may move on when its last block is in no pattern or ends none; only where the shift is zero
is the bucket of patterns with this last block looked up, and the patterns are compared word for word. Each occurrence
puts text and evaluation text side by side, and the passages are confirmed there: a run of `run` equal words, or a
stretch of at least `stretch` words of which at most one in `per` differs.

A stretch of 24 or more words with at most one in seven altered has five unaltered words in a row, so that windows of
five words miss none: with a altered words among n there are at most a + 1 unaltered runs, and (n - a) / (a + 1) > 4 for
all n >= 24 and a <= n / 7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.words import word_hashes

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the block of the words a, b."""
    with np.errstate(over="ignore"):
        return (a * _MIX) ^ (b + (a >> np.uint64(29)))


class WuManber:
    """Tables for patterns of `m` words out of texts given as arrays of word hashes."""

    def __init__(self, texts: list[np.ndarray], m: int = 5):
        self.m = m
        self.texts = texts
        self.flat = np.concatenate([*texts, np.empty(0, "u8")]).astype("u8")
        self.length = np.array([len(t) for t in texts], "i8")
        self.begin = np.cumsum(self.length) - self.length
        of = np.repeat(np.arange(len(texts)), self.length)
        place = np.arange(len(self.flat)) - self.begin[of]
        # every window of m words is a pattern: (text, place of its first word)
        start = np.flatnonzero(place + m <= self.length[of])
        self.most = m - 1  # the shift of a block that no pattern has
        keys, shifts = [], []
        for j in range(m - 1):  # the block of words j, j + 1 of a pattern
            keys.append(_blocks(self.flat[start + j], self.flat[start + j + 1]))
            shifts.append(np.full(len(start), m - 2 - j))
        keys, shifts = np.concatenate([*keys, np.empty(0, "u8")]), np.concatenate([*shifts, np.empty(0, "i8")])
        self.block, where = np.unique(keys, return_inverse=True)
        self.shift = np.full(len(self.block), self.most, "i8")
        np.minimum.at(self.shift, where, shifts)
        # buckets of patterns by their last block
        last = np.searchsorted(self.block, _blocks(self.flat[start + m - 2], self.flat[start + m - 1]))
        order = np.argsort(last, kind="stable")
        self.pattern_text, self.pattern_place = of[start][order], place[start][order]
        self.bucket = np.searchsorted(last[order], np.arange(len(self.block) + 1))

    def occurrences(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the row, text, place in the text) of all occurrences in rows flat[begin:end].

        All rows are scanned at once, each by its own shifts, until every window has passed the end of its row.
        """
        none = np.empty(0, "i8")
        if not len(self.block):
            return none, none, none, none
        m, row = self.m, np.flatnonzero(end - begin >= self.m)
        at = begin[row] + m - 1  # the last word of the window
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            key = _blocks(flat[at - 1], flat[at])
            k = np.minimum(np.searchsorted(self.block, key), len(self.block) - 1)
            step = np.where(self.block[k] == key, self.shift[k], self.most)
            hit = step == 0
            if hit.any():
                hits.append((row[hit], at[hit]))
            at = at + np.maximum(step, 1)
            on = at < end[row]
            row, at = row[on], at[on]
        if not hits:
            return none, none, none, none
        row, at = (np.concatenate(x) for x in zip(*hits, strict=True))
        k = np.searchsorted(self.block, _blocks(flat[at - 1], flat[at]))
        size = self.bucket[k + 1] - self.bucket[k]
        p = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bucket[k], size)
        row, first = np.repeat(row, size), np.repeat(at, size) - m + 1
        text, place = self.pattern_text[p], self.pattern_place[p]
        same = np.ones(len(p), bool)
        for j in range(m):  # direct comparison
            same &= flat[first + j] == self.flat[self.begin[text] + place + j]
        return row[same], (first - begin[row])[same], text[same], place[same]

    def leaks(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, run: int, stretch: int, per: int, cells: int = 2_000_000) -> tuple[np.ndarray, ...]:
        """(row, text, longest run, longest stretch) of the confirmed pairs of row and text.

        Text and row are laid side by side at each offset at which a window occurs, and only the words that lie beside one
        another are held, `cells` of them at a time, or those of one offset.
        """
        row, at, text, place = self.occurrences(flat, begin, end)
        if not len(row):
            return row, text, row, row
        lay = np.unique(np.stack([row, text, at - place], 1), axis=0)
        r, t, off = lay.T
        low, high = np.maximum(0, -off), np.minimum(self.length[t], (end - begin)[r] - off)
        size = high - low
        some = size >= min(run, stretch)  # shorter ones cannot hold a passage
        r, t, off, low, size = r[some], t[some], off[some], low[some], size[some]
        total = np.cumsum(size)
        out = [(row[:0], text[:0], row[:0], row[:0])]
        first = 0
        while first < len(r):
            last = max(first + 1, int(np.searchsorted(total, total[first] - size[first] + cells, side="right")))
            k = slice(first, last)
            longest, best = self._passages(flat, begin[r[k]] + off[k] + low[k], self.begin[t[k]] + low[k], size[k], stretch, per)
            ok = (longest >= run) | (best >= stretch)
            out.append((r[k][ok], t[k][ok], longest[ok], best[ok]))
            first = last
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _passages(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, stretch: int, per: int) -> tuple[np.ndarray, np.ndarray]:
        """Longest run of equal words, and longest stretch (0 below `stretch`) with at most one word in `per` altered, of
        flat[a : a + size] beside self.flat[b : b + size], for each of many such layouts."""
        n = len(size)
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(n), size)
        i = np.arange(size.sum()) - start[of]
        equal = flat[a[of] + i] == self.flat[b[of] + i]
        place = np.arange(len(i))
        longest = np.maximum.reduceat(place - np.maximum.accumulate(np.where(equal, start[of] - 1, place)), start)
        # with s the sum of 1 for equal and 1 - per for altered words, i .. j is such a stretch if s[j] >= s[i]
        s = np.zeros(len(i) + n, "i8")
        wide = start + np.arange(n)  # a layout has one sum more than words
        within = np.cumsum(np.where(equal, 1, 1 - per))
        s[place + of + 1] = within - (within[start] - np.where(equal[start], 1, 1 - per))[of]
        # layouts one below the other, so that each is searched by itself
        owner = np.repeat(np.arange(n), size + 1)
        s -= owner * (2 * per * (int(size.max()) + 1))
        lowest = np.minimum.accumulate(s)
        highest = np.maximum.accumulate(s[::-1])[::-1]  # the highest that is still to come never rises
        end = np.searchsorted(-highest, -lowest, side="right") - 1
        best = np.maximum.reduceat(end - np.arange(len(s)), wide)
        return longest, np.where(best >= stretch, best, 0)


def find_leaks(
    corpus: DataFrame,
    corpus_id: str,
    corpus_text: str,
    items: DataFrame,
    item_id: str,
    item_texts: list[str],
    run: int = 12,
    stretch: int = 24,
    per: int = 7,
    seed: int = 5,
    block_words: int = 2_000_000,
) -> DataFrame:
    """(corpus_id, item_id, run_words, stretch_words), the second as `item_...` where both ids have one name: documents with a passage of a text of an item, each pair once.

    run_words is the longest run of unaltered words, stretch_words the longest stretch with few alterations (0: none of
    `stretch` words). The evaluation texts are what every task searches for; they are held in memory in blocks of at
    most `block_words` words, one pass over the corpus for each block, so that a set of any size is searched. A task compares
    a bounded number of words at a time, and the work for a document and an item grows with their length. Null and
    empty texts on either side match nothing; repeated rows and extra columns change nothing.
    """
    spark = corpus.sparkSession
    if not all((seed - 1) * (a + 1) < n - a for n in range(stretch, 60 * per) for a in [n // per]) or run < seed:
        raise ValueError("seed is too long for these limits")
    sides = items.select(
        F.col(item_id).alias("i"), F.explode(F.array(*[word_hashes(F.col(c)) for c in item_texts])).alias("w")
    ).where(F.size("w") >= seed)
    # a filter on the number of words would compute them twice
    texts = corpus.where(F.col(corpus_text).isNotNull()).select(
        F.col(corpus_id).alias("d"), word_hashes(F.col(corpus_text)).alias("w")
    )
    pair = (corpus_id, item_id if item_id != corpus_id else f"item_{item_id}")
    kind, item_kind = corpus.schema[corpus_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{pair[0]}` {kind}, `{pair[1]}` {item_kind}, run_words long, stretch_words long"

    def passed(block: list) -> DataFrame:
        names = [x["i"] for x in block]
        search = spark.sparkContext.broadcast(WuManber([np.array(x["w"], "i8").view("u8") for x in block], seed))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = search.value
            for b in batches:
                w = b.column("w")
                ends = w.offsets.to_numpy().astype("i8")
                flat = w.values.to_numpy(zero_copy_only=False).view("u8")
                row, text, longest, best = tables.leaks(flat, ends[:-1], ends[1:], run, stretch, per)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("d").take(pa.array(row, pa.int64())),
                        pa.array([names[t] for t in text], pa.int64() if item_kind == "bigint" else None),
                        pa.array(longest, pa.int64()),
                        pa.array(best, pa.int64()),
                    ],
                    names=[*pair, "run_words", "stretch_words"],
                )

        return texts.mapInArrow(work, schema)

    found, block, size = None, [], 0
    for x in sides.toLocalIterator():  # the evaluation set, block by block
        if block and size + len(x["w"]) > block_words:
            found, block, size = passed(block) if found is None else found.unionByName(passed(block)), [], 0
        block.append(x)
        size += len(x["w"])
    last = passed(block)
    found = last if found is None else found.unionByName(last)
    return found.groupBy(*pair).agg(
        F.max("run_words").alias("run_words"), F.max("stretch_words").alias("stretch_words")
    )
