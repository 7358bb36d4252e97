"""Reading level of each document, from the surprisal of its words under n-gram models of the levels.

One interpolated n-gram model is trained for each level on rated documents. Every word of a document then has a surprisal
under each model; over a sliding stretch of words these give the weight of each level, so that the document becomes a
distribution of difficulty over all its words, and its mean is the score. Isotonic regression maps scores to levels; it
is fitted on scores that came from models trained without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.words import word_hashes

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(flat: np.ndarray, row: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each word, and whether the row has that many words before."""
    key, ok = flat.copy(), np.ones(len(flat), bool)
    with np.errstate(over="ignore"):
        for back in range(1, order):
            before = np.roll(flat, back)
            key = key * _MIX + (before ^ (before >> np.uint64(31)))
            ok &= np.roll(row, back) == row
            ok[:back] = False
    return key, ok


class NGrams:
    """Counts of the n-grams up to `order` in texts of each level, and their interpolated probabilities."""

    def __init__(self, flat: np.ndarray, row: np.ndarray, level: np.ndarray, levels: int, order: int = 2, weight: float = 0.6):
        self.order, self.weight, self.levels = order, weight, levels
        self.tables = []
        for n in range(1, order + 1):
            key, ok = _grams(flat, row, n)
            keys, where = np.unique(key[ok], return_inverse=True)
            counts = np.bincount(where * levels + level[ok], minlength=len(keys) * levels)
            self.tables.append((keys, counts.reshape(-1, levels).astype("f4")))
        self.total = self.tables[0][1].sum(axis=0)
        self.kinds = len(self.tables[0][0]) + 1

    def _counts(self, n: int, key: np.ndarray, ok: np.ndarray) -> np.ndarray:
        keys, counts = self.tables[n - 1]
        if not len(keys):
            return np.zeros((len(key), self.levels), "f4")
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(((keys[k] == key) & ok)[:, None], counts[k], 0)

    def surprisal(self, flat: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Bits of each word under the model of each level."""
        key, ok = _grams(flat, row, 1)
        p = (self._counts(1, key, ok) + 0.5) / (self.total + 0.5 * self.kinds)
        below = key, ok
        for n in range(2, self.order + 1):
            key, ok = _grams(flat, row, n)
            context = np.zeros((len(flat), self.levels), "f4")
            context[1:] = self._counts(n - 1, below[0][:-1], below[1][:-1])
            context[~ok] = 0
            mixed = self.weight * self._counts(n, key, ok) / np.maximum(context, 1) + (1 - self.weight) * p
            p = np.where(context > 0, mixed, p)
            below = key, ok
        return -np.log2(p)


    def least_surprised(self, flat: np.ndarray, row: np.ndarray, level: np.ndarray, weights: tuple[float, ...]) -> float:
        """Takes and returns the weight of longer n-grams with which the words of texts of known levels have the fewest bits."""
        bits = []
        for self.weight in weights:
            bits.append(self.surprisal(flat, row)[np.arange(len(flat)), level].mean())
        self.weight = weights[int(np.argmin(bits))]
        return self.weight


def difficulty(model: NGrams, flat: np.ndarray, row: np.ndarray, rows: int, reach: int = 8) -> np.ndarray:
    """The mean level over the words of each row, from 0; NaN for rows without words.

    The weight of a level at a word comes from the surprisals of the words up to `reach` before and behind it.
    """
    if not len(flat):
        return np.full(rows, np.nan)
    s = model.surprisal(flat, row)
    total = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0, dtype="f8")])
    size = np.bincount(row, minlength=rows)
    begin = (np.cumsum(size) - size)[row]
    end = begin + size[row]
    i = np.arange(len(flat))
    bits = total[np.minimum(i + reach, end)] - total[np.maximum(i - reach, begin)]
    weight = np.exp2(bits.min(axis=1, keepdims=True) - bits)
    mean = (weight @ np.arange(s.shape[1])) / weight.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(row, mean, minlength=rows) / size


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function with the least squared error (pool adjacent violators)."""
    at, where = np.unique(x, return_inverse=True)
    n = np.bincount(where).astype("f8")
    sums = np.bincount(where, y)
    pools: list[list[float]] = []
    for s, k in zip(sums, n, strict=True):
        pools.append([s, k, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], b, strict=True)]
    return at, np.concatenate([np.full(int(m), s / k) for s, k, m in pools])


@dataclass
class ReadingModel:
    levels: tuple[int, ...]
    grams: NGrams
    at: np.ndarray
    to: np.ndarray

    def grade(self, score: np.ndarray) -> np.ndarray:
        """The level of each score; that of the middle score where there is none."""
        known = np.where(np.isnan(score), (len(self.levels) - 1) / 2, score)
        step = np.interp(known, self.at, self.to)
        return np.asarray(self.levels)[np.clip(np.floor(step + 0.5).astype(int), 0, len(self.levels) - 1)]


def rated_sample(
    labels: DataFrame, docs: DataFrame, key: str, text: str, levels: tuple[int, ...], sample: int, most_words: int, all_words: int
) -> DataFrame:
    """(y, w, k): level and word hashes of at most `sample` rated documents, chosen by hash, of at most `most_words` words each
    and of `all_words` together.

    Repeated ratings count once, null ones and levels outside `levels` not at all; raters that disagree are settled by
    their median, and a document without a median level is left out.
    """
    agreed = (
        labels.where(F.col("reading_level").isin(*levels) & F.col(key).isNotNull())
        .select(key, "rater", "reading_level")
        .distinct()
        .groupBy(key)
        .agg(F.percentile("reading_level", F.lit(0.5)).alias("y"))
        .where(F.col("y").isin(*[float(x) for x in levels]))
        .orderBy(F.xxhash64(key), key)
        .limit(sample)
    )
    # at most `sample` rows of a key and a number; words are made of the chosen texts alone, which the join leaves
    chosen = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(agreed), key)
    short = F.length(text) <= 20 * most_words
    made = chosen.where(short).select(F.col("y").cast("int").alias("y"), word_hashes(F.col(text)).alias("w"), F.col(key).alias("k"))
    # a document that was delivered again counts once; one task sees the sample, which is bounded
    one = made.groupBy("k").agg(F.max(F.struct("w", "y")).alias("one"))
    # words are counted behind the grouping, as a filter before it would make them again
    so_far = F.sum(F.size("one.w")).over(Window.orderBy(F.xxhash64("k"), "k"))
    return one.where(F.size("one.w").between(1, most_words)).withColumn("so_far", so_far).where(F.col("so_far") <= all_words).select("one.y", "one.w", "k")


def fit_reading_model(
    labels: DataFrame, docs: DataFrame, key: str, text: str, levels: tuple[int, ...] = (1, 2, 3), sample: int = 3000,
    most_words: int = 5000, order: int = 2, folds: int = 4, all_words: int = 2_000_000, weights: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8),
) -> ReadingModel | None:
    """Fitted on at most `sample` rated documents of at most `most_words` words each and of `all_words` together; these bound
    the driver's memory and the model's size, nothing else. None without any rated document.

    The model has 20 bytes for each different n-gram of the sample. Of `weights` the one counts with which models without a
    quarter of the documents are least surprised by it.
    """
    t = rated_sample(labels, docs, key, text, levels, sample, most_words, all_words).toArrow().combine_chunks()
    if not t.num_rows:
        return None
    order_of = np.argsort(t["k"].to_numpy(zero_copy_only=False), kind="stable")
    y = np.searchsorted(levels, t["y"].to_numpy()[order_of])
    w = t["w"].combine_chunks()
    ends, every = w.offsets.to_numpy().astype("i8"), w.values.to_numpy().view("u8")
    begin, length = ends[:-1][order_of], np.diff(ends)[order_of]
    fold = np.arange(len(y)) % folds

    def flat(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = length[chosen]
        at = np.repeat(begin[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return every[at], np.repeat(np.arange(len(chosen)), size), np.repeat(y[chosen], size)

    score, weight = np.full(len(y), np.nan), 0.6
    for f in range(folds):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(rest) and len(own):
            part, (words, r, level) = NGrams(*flat(rest), len(levels), order, weight), flat(own)
            if f == 0:
                weight = part.least_surprised(words, r, level, weights)
            score[own] = difficulty(part, words, r, len(own))
    known = ~np.isnan(score)
    at, to = isotonic(score[known], y[known]) if known.any() else (np.array([0.0]), np.array([y.mean()]))
    return ReadingModel(levels, NGrams(*flat(np.arange(len(y))), len(levels), order, weight), at, to)


def reading_levels(docs: DataFrame, key: str, text: str, model: ReadingModel | None, keep: tuple[str, ...] = (), least_words: int = 50) -> DataFrame:
    """(key, `keep`, reading_level, difficulty) of every row whose text has at least `least_words` words between white space.

    difficulty is the mean over all words, from the lowest level to the highest. Null and small texts give no row;
    without a model both values are null. Texts are read whole and row by row; nothing is shuffled.
    """
    spark = docs.sparkSession
    enough = docs.where(F.size(F.regexp_extract_all(F.col(text), F.lit(r"(?U)\S+"), 0)) >= least_words)
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(key, *keep).schema]
    schema = ", ".join([*rest, "reading_level long", "difficulty double"])
    if model is None:
        return enough.select(
            key, *keep, F.lit(None).cast("long").alias("reading_level"), F.lit(None).cast("double").alias("difficulty")
        )
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            w = b.column(b.num_columns - 1)
            ends = w.offsets.to_numpy().astype("i8")
            flat = w.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].view("u8")
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            score = difficulty(own.grams, flat, row, b.num_rows)
            low = own.levels[0]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:-1],
                    pa.array(own.grade(score).astype("i8")),
                    pa.array(score + low, from_pandas=True),
                ],
                names=[*b.schema.names[:-1], "reading_level", "difficulty"],
            )

    return enough.select(key, *keep, word_hashes(F.col(text)).alias("_words")).mapInArrow(work, schema)
