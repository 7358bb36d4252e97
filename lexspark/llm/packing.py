"""Filling containers of fixed capacity with items of varying length.

Lengths are counted in a histogram whose size depends on the capacity alone. Shallow combinations of lengths that fill a
container are enumerated, non-negative least squares says how often each should be used to consume the histogram, the
counts are rounded down, and what remains is packed greedily, again by length. The plan is a small table of ranges: the
r-th item of a length goes to a known container. Items are ranked inside their length in cells, so that a length that a
third of all items share is ranked by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import durable


def combinations(classes: int, deepest: int = 4) -> np.ndarray:
    """Columns (a, ma, b, mb, c, mc): `ma` items of class a, `mb` of b, `mc` of c, that together fill `classes` units.

    Shallow: at most three different classes, and at most `deepest` items of each; c is what the others leave.
    """
    found = []
    a, b = np.triu_indices(classes + 1, 1)
    a, b = a[a > 0], b[a > 0]
    for ma in range(1, deepest + 1):
        for mb in range(deepest + 1):
            left = classes - ma * a - mb * b
            for mc in (0, 1, 2):
                ok = (left == 0) if mc == 0 else (left > 0) & (left % mc == 0)
                if mb == 0:
                    ok &= b == a + 1  # b is not used: one of each a
                c = left[ok] // mc if mc else np.zeros(ok.sum(), int)
                k = ok.sum()
                found.append(
                    np.stack([a[ok], np.full(k, ma), b[ok] * (mb > 0), np.full(k, mb), c, np.full(k, mc)], 1)
                )
    top = np.zeros((1, 6), int)
    top[0, :2] = classes, 1
    return np.concatenate([top, *found])


def _gather(columns: np.ndarray, r: np.ndarray) -> np.ndarray:
    return columns[:, 1] * r[columns[:, 0]] + columns[:, 3] * r[columns[:, 2]] + columns[:, 5] * r[columns[:, 4]]


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(chosen columns, their weights >= 0) with the least squared distance to `target` (active set method)."""
    size = len(target)
    norm = np.sqrt(columns[:, 1] ** 2 + columns[:, 3] ** 2 + columns[:, 5] ** 2)
    active: list[int] = []
    x = np.zeros(0)

    def dense(js: list[int]) -> np.ndarray:
        m = np.zeros((size, len(js)))
        for k in (0, 2, 4):
            np.add.at(m, (columns[js, k], np.arange(len(js))), columns[js, k + 1])
        m[0] = 0
        return m

    residual = target.copy()
    for _ in range(rounds or 3 * size):
        gain = _gather(columns, residual) / norm
        gain[active] = 0
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * max(1.0, target.max()):
            break
        active.append(j)
        x = np.append(x, 0.0)
        while True:
            m = dense(active)
            z = np.linalg.lstsq(m, target, rcond=None)[0]
            if (z > 1e-12).all():
                x = z
                break
            bad = z <= 1e-12
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            keep = x > 1e-12
            active, x = [a for a, k in zip(active, keep, strict=True) if k], x[keep]
            if not active:
                break
        residual = target - dense(active) @ x if active else target.copy()
    return columns[active], x


@dataclass
class Plan:
    """Ranges (class, first rank, number of items, first container, items of the class in a container)."""

    ranges: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0

    def use(self, taken: np.ndarray, pattern: dict[int, int], times: int) -> None:
        for c, m in pattern.items():
            self.ranges.append((c, int(taken[c]), m * times, self.containers, m))
            taken[c] += m * times
        self.containers += times


def make_plan(histogram: np.ndarray) -> Plan:
    """Containers for histogram[c] items of c units, for c = 1 .. capacity in units; every item has a place."""
    classes = len(histogram) - 1
    plan, taken, left = Plan(), np.zeros(classes + 1, "i8"), histogram.astype("i8").copy()
    if left.sum() == 0:
        return plan
    target = left.astype("f8")
    chosen, weight = nnls(combinations(classes), target / target.max())
    for j in np.argsort(-weight, kind="stable"):
        pattern: dict[int, int] = {}
        for k in (0, 2, 4):
            if chosen[j, k + 1]:
                pattern[int(chosen[j, k])] = pattern.get(int(chosen[j, k]), 0) + int(chosen[j, k + 1])
        times = min([int(weight[j] * target.max()), *(int(left[c]) // m for c, m in pattern.items())])
        if times > 0:
            plan.use(taken, pattern, times)
            for c, m in pattern.items():
                left[c] -= m * times
    # what rounding left: the largest item that fits, again and again; equal containers at once
    while left.any():
        room, pattern = classes, {}
        while room:
            fits = np.flatnonzero(left[: room + 1] > np.array([pattern.get(c, 0) for c in range(room + 1)]))
            if not len(fits):
                break
            c = int(fits[-1])
            pattern[c] = pattern.get(c, 0) + 1
            room -= c
        times = min(int(left[c]) // m for c, m in pattern.items())
        plan.use(taken, pattern, times)
        for c, m in pattern.items():
            left[c] -= m * times
    return plan


def items_of(df: DataFrame, key: str, size, capacity: int) -> DataFrame:
    """(key, piece_no, start, size, pieces): a row for each item; items larger than the capacity are divided.

    Division is at exact multiples of the capacity, so that all pieces but the last fill a container.
    Items of size null or 0 are none.
    """
    sized = df.select(F.col(key), size.cast("long").alias("n")).where(F.col("n") > 0)
    pieces = F.ceil(F.col("n") / capacity).cast("long")
    each = sized.withColumn("pieces", pieces).select(
        key, "n", "pieces", F.explode(F.sequence(F.lit(1).cast("long"), "pieces")).alias("piece_no")
    )
    start = (F.col("piece_no") - 1) * capacity
    return each.select(key, "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).alias("size"), "pieces")


def pack(df: DataFrame, key: str, size, capacity: int = 4096, classes: int = 256, per_cell: int = 100_000) -> DataFrame:
    """(key, piece_no, start, size, pieces, container_id): every item or piece in its container.

    `size` is a column, the length of the row's item. Sizes are rounded up to `capacity / classes` for planning, so that
    no container is over its capacity. Containers are numbered from 0. Repeated rows are items of their own; rows
    without size have no place. Only keys and sizes are kept and shuffled, and what the sizes come from is read once.

    A class has a cell for about every `per_cell` items, which is what one task ranks, so that a length that a third of all
    items share is ranked by as many tasks as it needs. The driver sees the histogram of cells and nothing else: `classes`
    counts and one more for every `per_cell` items.
    """
    if capacity % classes:
        raise ValueError("classes must divide capacity")
    unit = capacity // classes
    spark = df.sparkSession
    items = durable(items_of(df, key, size, capacity).withColumn("cls", F.ceil(F.col("size") / unit).cast("int")))
    # as many rows as there are classes
    parts = {r["cls"]: max(1, ceil(r["n"] / per_cell)) for r in items.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), "cls") if parts else F.lit(1), F.lit(1))
    placed = items.withColumn("cell", F.pmod(F.xxhash64(key, "piece_no"), number).cast("int"))
    cells = placed.groupBy("cls", "cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    cls, cell, n = (cells[c].to_numpy() for c in ("cls", "cell", "n"))
    plan = make_plan(np.bincount(cls, n, minlength=classes + 1).astype("i8"))
    order = np.lexsort((cell, cls))
    cls, cell, n = cls[order], cell[order], n[order]
    total = np.cumsum(n) - n
    before = total - total[np.searchsorted(cls, cls)]
    offsets = spark.createDataFrame(pa.table({"cls": cls.astype("i4"), "cell": cell.astype("i4"), "before": before.astype("i8")}))
    by_class: dict[int, list] = {}
    for c, first, k, base, m in plan.ranges:
        by_class.setdefault(c, []).append((first, k, base, m))
    ranges = spark.createDataFrame(
        list(by_class.items()), "cls int, ranges array<struct<first: long, n: long, base: long, m: long>>"
    )
    rank = F.row_number().over(Window.partitionBy("cls", "cell").orderBy(key, "piece_no")) - 1
    ranked = (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), ["cls", "cell"])
        .join(F.broadcast(ranges), "cls")
        .withColumn("_rank", F.col("_rank") + F.col("before"))
    )
    own = F.filter(
        "ranges", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["n"])
    )[0]
    container = own["base"] + F.floor((F.col("_rank") - own["first"]) / own["m"])
    return ranked.select(key, "piece_no", "start", "size", "pieces", container.cast("long").alias("container_id"))


def divided(packed: DataFrame, key: str) -> DataFrame:
    """(key, containers) of the items of `pack` that lie in several containers."""
    spread = packed.where(F.col("pieces") > 1).groupBy(key).agg(F.count_distinct("container_id").alias("containers"))
    return spread.where(F.col("containers") > 1)
