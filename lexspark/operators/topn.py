"""The n best of many, for many queries at once, inside a task."""

from __future__ import annotations

import numpy as np


class TopN:
    """Running n best per query; of equal scores the lower id. Holds n rows per query whatever it is shown."""

    def __init__(self, queries: int, n: int):
        self.n, self.queries = n, queries
        self.row, self.score, self.id = np.empty(0, "i8"), np.empty(0), np.empty(0, "i8")
        self.bound = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, least: float = -np.inf) -> None:
        """scores: queries x rows, those under `least` or equal to it are none; ids: rows."""
        bound = self.bound
        if scores.shape[1] > self.n:
            bound = np.maximum(bound, np.partition(scores, scores.shape[1] - self.n, axis=1)[:, -self.n])
        r, c = np.nonzero((scores >= bound[:, None]) & (scores > least))
        row, score, id_ = np.r_[self.row, r], np.r_[self.score, scores[r, c]], np.r_[self.id, ids[c]]
        o = np.lexsort((id_, -score, row))
        row, score, id_ = row[o], score[o], id_[o]
        first = np.searchsorted(row, np.arange(self.queries))
        keep = np.arange(len(row)) - first[row] < self.n
        self.row, self.score, self.id = row[keep], score[keep], id_[keep]
        full = np.bincount(self.row, minlength=self.queries) == self.n
        last = np.searchsorted(self.row, np.arange(self.queries), side="right") - 1
        self.bound = np.where(full, self.score[np.maximum(last, 0)] if len(self.score) else -np.inf, -np.inf)
