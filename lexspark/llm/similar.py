"""Most similar vectors by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots in order. Pivot p's inverted
file lists the vectors that have p among their first, with their permutations. Two permutations are compared by
Spearman's footrule with missing pivots at the end, for which

    footrule(a, b) = m (m + 1) - 2 * sum over shared pivots of min(weight in a, weight in b),   weight = m - place

so that ranking by footrule distance is ranking by the sum, which shared pivots alone make up. In each inverted file every
vector ranks by footrule the others that can be similar enough, and the nearest of them are reranked by their cosines. What
can be similar comes from one product of small vectors, as footrules of all pairs of a long file would cost many times that.

Where pivots crowd, that is, many of them are similar to one another, the nearest pivots of a vector all come from its own
cluster, and permutations of neighbours hardly overlap. Such clusters have heads; vectors near a head are compared by
cosine with all that can be similar to them, and do not stand in inverted files.

`near_pairs` finds all pairs above a cosine together with the mutual k nearest; `nearest` finds the k nearest of given
query rows. Cosines are exact in both results; only which pairs are looked at depends on the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import durable

LENGTH = 12  # pivots in a permutation
POSTED = 6  # inverted files that a vector stands in
BLOCK = 16384  # most vectors of an inverted file that one task compares with one another or with as many others
MOST_PIVOTS = 16384
RANKED = 128  # similar vectors of an inverted file, nearest by footrule, that a vector is reranked with; ties of the last one too
CELLS = 2_000_000  # most pairs of similar vectors of a block that are held together
FEW = 500_000  # most rows of 24 bytes that are sent to all tasks; more of them are shuffled
CROWD = 0.8  # cosine to its head from which a vector belongs to a crowd
CROWD_BLOCK = 8192  # rows of a crowd that one task compares with as many others


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has `dim` finite components that are not all zero."""
    low, high, inf = F.array_min(vector), F.array_max(vector), F.lit(float("inf")).cast("float")
    # without lambdas, which are not compiled; NaN is above infinity, and where there are nulls the search gives null
    finite = ~F.array_contains(vector, inf) & (low > -inf) & (high < inf)
    return F.coalesce((F.size(vector) == dim) & finite & ((low != 0) | (high != 0)), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column whose lists all have `dim` values."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f4").reshape(-1, dim)
    with np.errstate(over="ignore"):
        return _unit(x.astype("f8")).astype("f4")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(rows: DataFrame, id_: str, vector: str, dim: int, total: int, most: int = MOST_PIVOTS) -> np.ndarray:
    """Distinct unit vectors of rows with the smallest id hashes: about 8 * sqrt(total), at most `most` of them.

    With a number of pivots that grows as the root of the rows, inverted files grow as slowly.
    """
    wanted = min(most, max(64, ceil(8 * sqrt(max(total, 1)))))
    share = min(1.0, 1.5 * wanted / max(total, 1))
    scale = 1 << 40
    h = F.pmod(F.xxhash64(id_, F.lit("pivot")), F.lit(scale))
    # the filter bounds what comes to the driver to 1.5 times the pivots; no sort of all rows
    got = rows.where(h < int(share * scale)).select(h.alias("h"), F.col(vector).alias("v")).toArrow()
    if not got.num_rows:
        return np.zeros((0, dim), "f4")
    x = _matrix(got["v"].combine_chunks(), dim)[np.argsort(got["h"].to_numpy(), kind="stable")]
    first = np.sort(np.unique(x.round(6), axis=0, return_index=True)[1])
    return x[first[:wanted]]


def crowd_heads(pivots: np.ndarray, length: int = LENGTH, near: float = CROWD) -> np.ndarray:
    """Unit vectors in the middle of crowds: places where a pivot has `length` other pivots with a cosine >= `near`."""
    around = [np.flatnonzero(pivots @ p >= near) for p in pivots]
    size = np.array([len(a) for a in around])
    free = size > length
    heads = np.zeros((0, pivots.shape[1]), "f4")
    for i in np.argsort(-size, kind="stable"):
        if free[i]:
            head = _unit(pivots[around[i]].astype("f8").mean(axis=0, keepdims=True)).astype("f4")
            heads = np.concatenate([heads, head])
            free &= pivots @ head[0] < near
            free[i] = False
    return heads


def _number(pivots: int) -> str:
    """The type of a pivot's number, the low byte first."""
    return "<u2" if pivots <= 1 << 16 else "<u4"


def _permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first; of equals the lower number."""
    length = min(length, len(pivots))
    out = np.empty((len(x), length), _number(len(pivots)))
    step = _step(len(pivots))
    for s in range(0, len(x), step):
        c = x[s : s + step] @ pivots.T
        bound = _at_least(c, length)
        if bound is not None:
            row, col = np.divmod(np.flatnonzero(c >= bound[:, None]), len(pivots))
            order = np.lexsort((col, -c[row, col], row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            out[s : s + step] = col[order][place < length].reshape(-1, length)
            continue
        near = np.sort(np.argpartition(-c, length - 1, axis=1)[:, :length], axis=1)
        order = np.argsort(-np.take_along_axis(c, near, 1), axis=1, kind="stable")
        out[s : s + step] = np.take_along_axis(near, order, 1)
    return out


def _step(columns: int) -> int:
    """How many rows to multiply at a time with so many columns, so that the product stays in a core's cache."""
    return min(512, max(64, (1 << 20) // max(columns, 1)))


def _at_least(s: np.ndarray, keep: int) -> np.ndarray | None:
    """For each row of `s` a value that `keep` of its values or more reach: the keep-th of the greatest of each of many sets of
    columns. None if there are too few columns for that to be of use."""
    n, m = s.shape
    width = max(1, min(64, m // (8 * keep)))
    parts = m // width
    if parts <= keep or width < 2:
        return None
    top = s[:, : parts * width].reshape(n, width, parts).max(axis=1)
    return np.partition(top, parts - keep, axis=1)[:, parts - keep]


def _fixed(a: np.ndarray) -> pa.Array:
    """Rows of `a` as binary values."""
    width = a.dtype.itemsize * a.shape[1]
    offsets = pa.py_buffer(np.arange(len(a) + 1, dtype="i4") * width)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, offsets, pa.py_buffer(np.ascontiguousarray(a))])


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    """A column of binary values of one width as a matrix."""
    at = np.frombuffer(column.buffers()[1], "i4" if column.type == pa.binary() else "i8")[column.offset :][: len(column) + 1]
    kind = np.dtype(dtype)
    return np.frombuffer(column.buffers()[2], kind, int(at[-1] - at[0]) // kind.itemsize, int(at[0])).reshape(len(column), -1)


def _lists(a: np.ndarray) -> pa.Array:
    """Rows of `a` as lists of int."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype="i4") * a.shape[1]), pa.array(a.astype("i4").ravel()))


def _hashed(good: DataFrame) -> DataFrame:
    """(id, h1, h2) with hashes of the vector as it is."""
    return good.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))


def _represent(good: DataFrame, dim: int, pivots: np.ndarray, length: int, heads: np.ndarray, least: float, posted: int) -> DataFrame:
    """(id, perm, posts, q, scale, home, crowds, x) of rows (id, v).

    perm: the permutation; posts: the first `posted` of it, as numbers; q, scale: what parts the unit vector from its nearest pivot, in 8 bits, so that the error is
    small where vectors are close together; home: the nearest head if it is near enough; crowds: heads whose members can
    have a cosine >= `least` with the vector (angles add up at most); x: the unit vector of those that have any.
    """
    shared = good.sparkSession.sparkContext.broadcast((pivots, heads))
    wide = np.cos(min(np.pi, np.arccos(CROWD) + np.arccos(min(1.0, max(-1.0, least))))) - 1e-4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, heads = shared.value
        for b in batches:
            x = _matrix(b.column("v"), dim)
            perm = _permutations(x, pivots, length)
            apart = x - pivots[perm[:, 0]]
            scale = np.maximum(np.abs(apart).max(axis=1, initial=0), 1e-30).astype("f4") / 127
            q = np.rint(apart / scale[:, None]).astype("i1")
            if len(heads) and len(x):
                c = x @ heads.T
                home = np.where(c.max(axis=1) >= CROWD, c.argmax(axis=1), -1)
                crowds = [np.flatnonzero(r >= wide) for r in c]
            else:
                home, crowds = np.full(len(x), -1), [()] * len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), _fixed(perm), _lists(perm[:, :posted]), _fixed(q), pa.array(scale),
                    pa.array(home, pa.int32()), pa.array(crowds, pa.list_(pa.int32())),
                    pa.array([r.tobytes() if len(k) else None for r, k in zip(x, crowds)], pa.binary()),
                ],
                names=["id", "perm", "posts", "q", "scale", "home", "crowds", "x"],
            )

    return good.select("id", "v").mapInArrow(work, "id long, perm binary, posts array<int>, q binary, scale float, home int, crowds array<int>, x binary")


def _nearest_of(s: np.ndarray, cols: np.ndarray, keep: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the `keep` greatest cosines of each row that are >= `least`, to 6 digits; of equals the lower id.

    `cols`: the ids of the columns, ascending.
    """
    n, m = s.shape
    bound = np.full(n, least, "f4")
    reached = _at_least(s, keep)
    if reached is not None:
        bound = np.maximum(bound, reached - 2e-6)
    row, col = np.divmod(np.flatnonzero(s >= bound[:, None]), m)
    c = np.round(s[row, col].astype("f8"), 6)
    order = np.lexsort((col, -c, row))
    row, col, c = row[order], col[order], c[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < keep
    return row[first], cols[col[first]], c[first]


def _crowd_pairs(index: DataFrame, k: int, least: float, block: int) -> DataFrame:
    """(a, b), a < b: what the members of crowds are similar to: the `k` nearest of each member among all vectors, and of each
    other vector among all members.

    All cosines are computed, in pairs of blocks that are a task each, which keeps `k` of each row. The work is the square
    of the size of a crowd; nothing is left out. A few more than `k` go on, so that rounding cannot decide.
    """
    keep = k + 2
    member = F.col("crowd") == F.col("home")
    each = index.where(F.size("crowds") > 0).select("id", "x", "home", F.explode("crowds").alias("crowd")).withColumn("member", member)
    # as many rows as there are crowds
    sizes = each.groupBy("crowd").agg(
        F.ceil(F.count_if("member") / block).cast("int").alias("inner"), F.ceil(F.count_if(~F.col("member")) / block).cast("int").alias("outer")
    )
    # blocks of members come first, the others meet only these
    placed = each.join(F.broadcast(sizes.where("inner > 0")), "crowd").withColumn(
        "own", F.when(F.col("member"), F.pmod(F.xxhash64("id"), "inner")).otherwise(F.col("inner") + F.pmod(F.xxhash64("id"), "outer")).cast("int")
    )
    others = F.sequence(F.lit(0), F.when(F.col("member"), F.col("inner") + F.col("outer")).otherwise(F.col("inner")) - 1)
    met = placed.select(
        "id", "x", "home", "crowd", "own",
        F.explode(F.transform(others, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))).alias("part"),
    ).select("id", "x", "home", "crowd", "own", "part.i", "part.j")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, first = np.unique(t["id"].to_numpy(), return_index=True)  # an id that was delivered again counts once
        home, own = t["home"].to_numpy()[first], t["own"].to_numpy()[first]
        x = _rows(t["x"].combine_chunks(), "f4")[first]
        crowd, i, j = (v.as_py() for v in key)
        found = []
        for here, there in {(i, j), (j, i)}:
            # a member of another crowd has its neighbours from there
            rows = np.flatnonzero((own == here) & ((home == crowd) | (home == -1)))
            cols = np.flatnonzero(own == there)
            for s in range(0, len(rows) if len(cols) else 0, 512):
                r = rows[s : s + 512]
                c = x[r] @ x[cols].T
                c[ids[r][:, None] == ids[cols][None, :]] = -2
                row, other, cosine = _nearest_of(c, ids[cols], keep, least - 1e-5)
                found.append((ids[r][row], other, cosine))
        u, v, c = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))
        return pa.table({"u": u, "v": v, "c": c})

    near = met.groupBy("crowd", "i", "j").applyInArrow(compare, "u long, v long, c double")
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("c").desc(), "v"))
    first = near.withColumn("place", place).where(F.col("place") <= keep)
    return first.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _footrule(perm: np.ndarray, row: np.ndarray | None = None, col: np.ndarray | None = None) -> np.ndarray:
    """The sums of footrule weights of the pairs (row, col) of rows of `perm`; without these of all pairs, a symmetric matrix
    in which a row with itself has 0."""
    n, m = perm.shape
    if row is None:
        row, col = np.divmod(np.arange(n * n), n)
        return np.where(row == col, 0, _footrule(perm, row, col)).reshape(n, n)
    weight = np.arange(m, 0, -1, dtype="i1")
    out = np.empty(len(row), "i4")
    mine, at = np.unique(row, return_inverse=True)
    weights = np.zeros((min(len(mine), 512), int(perm.max(initial=0)) + 1), "i1")
    order = np.argsort(at, kind="stable")
    for s in range(0, len(mine), 512):
        # the weights of pivots in some rows as a table, in which the pivots of the others are looked up
        some = perm[mine[s : s + 512]].astype("i8")
        np.put_along_axis(weights[: len(some)], some, weight[None, :], 1)
        a, b = np.searchsorted(at, [s, s + 512], sorter=order)
        for e in range(a, b, 100_000):
            p = order[e : min(e + 100_000, b)]
            out[p] = np.minimum(weights[(at[p] - s)[:, None], perm[col[p]]], weight).sum(axis=1, dtype="i4")
        np.put_along_axis(weights[: len(some)], some, 0, 1)
    return out


def _similar(x: np.ndarray, perm: np.ndarray, error: np.ndarray, r: np.ndarray, c: np.ndarray, keep: int, ranked: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column), of rows `r` and columns `c` of the vectors of an inverted file, in pieces: the pairs that each row keeps.

    Of the vectors whose cosine can be >= `least`, the `ranked` nearest by footrule are reranked. Footrules are computed
    for the rows that have more than `ranked` of them. Where rows and columns are the same, each pair is multiplied once,
    unless so many are similar (`CELLS`) that they are better not held together.
    """
    if not len(r) or not len(c):
        return
    y, columns, step = x[r], x[c], _step(len(c))
    low = least - error[c].max() - error[r]

    def cells(s: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in r, places in c, and cosines, of the rows from place s and the columns from place `first`."""
        cosine = y[s : s + step] @ columns[first:].T
        at = np.flatnonzero(cosine >= low[s : s + step, None])
        a, b = np.divmod(at, cosine.shape[1])
        return a + s, b + first, cosine.ravel()[at]

    def best(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (rows, row), (cols, col) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        near, cosine = np.zeros((len(rows), len(cols)), "i4"), np.zeros((len(rows), len(cols)), "f4")
        near[row, col], cosine[row, col] = 1, value
        many = (np.bincount(row, minlength=1) > ranked)[row]
        if many.any():
            near[row[many], col[many]] = _footrule(perm, r[a[many]], c[b[many]])
        kept = _reranked(near, cosine, error[r[rows]], error[c[cols]], keep, ranked if many.any() else len(cols), least)
        return r[rows[kept[0]]], c[cols[kept[1]]]

    if np.array_equal(r, c):
        found, held = [], 0
        for s in range(0, len(r), step):
            a, b, value = cells(s, s)
            later = a < b
            found.append((a[later], b[later], value[later]))
            held += len(found[-1][0])
            if held > CELLS:
                break
        else:
            a, b, value = (np.concatenate(p) for p in zip(*found))
            a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
            order = np.argsort(a, kind="stable")
            a, b, value = a[order], b[order], value[order]
            # pieces of 256 rows that have any
            mine = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])[::256] if len(a) else []
            for i, j in pairwise([*mine, len(a)]):
                yield best(a[i:j], b[i:j], value[i:j])
            return
    for s in range(0, len(r), step):
        a, b, value = cells(s, 0)
        other = r[a] != c[b]
        if other.any():
            yield best(a[other], b[other], value[other])


def _reranked(near: np.ndarray, c: np.ndarray, error: np.ndarray, other: np.ndarray, keep: int, ranked: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) that each row keeps: of the `ranked` nearest by footrule, with ties of the last, those whose cosine can
    be among the `keep` greatest and can be >= `least`. c: cosines, each in error by at most `error` of its row and `other` of
    its column."""
    far = error[:, None] + other[None, :]
    kept = (c + far >= least) & (near > 0)
    some = np.flatnonzero(kept.any(axis=1))
    if near.shape[1] > ranked and len(some):
        edge = np.partition(near[some], near.shape[1] - ranked, axis=1)[:, near.shape[1] - ranked]
        kept[some] &= near[some] >= edge[:, None]
    row, col = np.nonzero(kept)
    low, high = c[row, col] - far[row, col], c[row, col] + far[row, col]
    # the keep-th greatest lower bound of each row that has so many
    order = np.lexsort((-low, row))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    bound = np.full(len(near), -np.inf)
    last = place == keep - 1
    bound[row[last]] = low[order][last]
    within = high >= bound[row]
    return row[within], col[within]


def _spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` by `keys` in as many parts as it takes for about 25,000 of `rows` in each, as many as the session has at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, ceil(rows / 25_000)), *keys)


def near_pairs(
    df: DataFrame, id_: str, vector: str, dim: int = 64, k: int = 10, least: float = 0.9, ranked: int = RANKED,
    length: int = LENGTH, posted: int = POSTED, block: int = BLOCK, most_pivots: int = MOST_PIVOTS,
    crowd_block: int = CROWD_BLOCK,
) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: rows each among the `k` most similar of the other, with a cosine >= `least`.

    Every row with a usable vector takes part; others are left out. Of equally similar rows those with lower ids count
    as more similar, which settles exact copies: of any number of them the first k + 1 pair up with one another, and only
    the first k can be neighbours of other vectors. Copies are folded into one before they are posted, so that a vector
    that a third of all rows share costs as much as one row. Ids are distinct non-null integers; repeated rows with one
    id and vector count once. Inverted files of more than `block` vectors are cut into blocks that meet in pairs, in
    tasks of their own. In each of them a vector goes on with those that can be among its `k` best of the `ranked` nearest
    by footrule that can have a cosine >= `least`, so that candidates grow with the rows and not with their pairs. Members of crowds (`crowd_heads`) are
    compared with all vectors that can be similar to them, at the cost of the square of the size of a crowd. At most
    `most_pivots` * `dim` floats are sent to the tasks.
    """
    if ranked < k + 1 or posted < 1 or length < 1:
        raise ValueError("ranked must be over k, posted and length at least 1")
    good = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull())
    good = good.where(usable(F.col("v"), dim))
    total = df.count()
    pivots = choose_pivots(good, "id", "v", dim, total, most_pivots)
    spark = df.sparkSession
    if not len(pivots):
        return spark.createDataFrame([], "id_a long, id_b long, cosine double")
    posted = min(posted, length, len(pivots))
    heads = crowd_heads(pivots)
    members = durable(_members(good, k))
    # a vector that several rows share is represented by its lowest id; the others never leave the JVM
    hashes = F.xxhash64("v"), F.xxhash64(F.lit(7), "v")
    shares = members.select("h1", "h2", "rep")
    if members.count() <= FEW:
        shares = F.broadcast(shares)
    single = good.withColumns({"h1": hashes[0], "h2": hashes[1]}).join(shares, ["h1", "h2"], "left")
    single = single.where(F.col("rep").isNull() | (F.col("rep") == F.col("id")))
    index = durable(_represent(single, dim, pivots, length, heads, least, posted))

    # the inverted files: vectors stand in the first `posted` of their permutation
    postings = index.where(F.col("home") == -1).select("id", "perm", "q", "scale", F.explode("posts").alias("pivot"))
    # at most as many rows as there are pivots, and only those of long files are kept
    blocks = postings.groupBy("pivot").count().where(F.col("count") > block)
    blocks = blocks.select("pivot", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = postings.join(F.broadcast(blocks), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.select(
        "id", "perm", "q", "scale", "pivot", "own",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")),
            )
        ).alias("part"),
    ).select("id", "perm", "q", "scale", "pivot", "own", "part.i", "part.j")
    shared = spark.sparkContext.broadcast(pivots)
    kind = _number(len(pivots))

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, first = np.unique(t["id"].to_numpy(), return_index=True)  # an id that was delivered again counts once
        perm, q = _rows(t["perm"].combine_chunks(), kind)[first], _rows(t["q"].combine_chunks(), "i1")[first]
        scale, own = t["scale"].to_numpy()[first], t["own"].to_numpy()[first]
        x = shared.value[perm[:, 0]] + q * scale[:, None]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        # rounding moves a component by half a unit of the scale at most, and a cosine by a normal sum of these
        error = (1.5 * scale + 1e-6).astype("f4")
        i, j = key[1].as_py(), key[2].as_py()
        some = [np.empty((2, 0), "i8")]
        for here, there in {(i, j), (j, i)}:
            r, c = np.flatnonzero(own == here), np.flatnonzero(own == there)
            some += [np.stack(kept) for kept in _similar(x, perm, error, r, c, k + 2, ranked, least)]
        a, b = np.concatenate(some, axis=1)
        # a pair that both rows keep goes on once
        pair = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        return pa.table({"a": ids[pair // max(len(ids), 1)], "b": ids[pair % max(len(ids), 1)]})

    pairs = _spread(met, posted * total, "pivot", "i", "j").groupBy("pivot", "i", "j").applyInArrow(compare, "a long, b long")
    if len(heads):
        pairs = pairs.unionByName(_crowd_pairs(index, k, least, crowd_block))
    candidates = durable(pairs.distinct())
    ends = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    exact = _spread(good, total, "id").join(ends, "id", "left_semi").groupBy("id").agg(F.first("v").alias("v"))
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with(wide("va"), wide("vb"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = exact.select("id", "v", size(wide("v")).alias("size"))
    half = _spread(candidates, total, "a").join(unit.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("size").alias("sa")), "a")
    scored = (
        _spread(half, k * total, "b").join(unit.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("size").alias("sb")), "b")
        .select("a", "b", (dot / (F.col("sa") * F.col("sb"))).alias("cosine"))
        .where(F.col("cosine") >= least)
    )
    return _mutual(scored, members.select("rep", "ids").where(F.size("ids") > 1), k)


def _members(good: DataFrame, k: int) -> DataFrame:
    """(h1, h2, rep, ids) of each vector that several rows share: the lowest id, and the lowest k + 1 ids.

    Only hashes and ids are shuffled, and tasks drop what is beyond the k + 1 lowest before that.
    """
    place = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))
    lowest = _hashed(good).withColumn("place", place).where(F.col("place") <= k + 1)
    each = lowest.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("id")).alias("ids"))
    return each.where(F.col("rows") > 1).select("h1", "h2", F.col("ids")[0].alias("rep"), "ids")


def _mutual(scored: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Mutual k nearest among rows, from the similar pairs (a, b, cosine) of folded vectors; members: rep, ids of the vectors
    that several rows have."""
    # more than k + 1 rows count as k + 1, which already leaves no place for others
    sizes = members.select(F.col("rep").alias("id"), F.size("ids").cast("long").alias("n"))
    # both ways at once: as a union the cosines would be computed twice
    ways = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    both = scored.select("cosine", F.inline(ways))
    one = F.lit(1).cast("long")
    sized = both.join(sizes.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y", "left").join(
        sizes.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x", "left"
    ).withColumns({"ny": F.coalesce("ny", one), "nx": F.coalesce("nx", one)})
    nearer = Window.partitionBy("x").orderBy(F.col("cosine").desc(), "y")
    # every vector is at least one row, so that only the k nearest vectors can hold any of the k nearest rows
    first = sized.withColumn("place", F.row_number().over(nearer)).where(F.col("place") <= k)
    closer = F.coalesce(F.sum("ny").over(nearer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # so many rows of y, the lowest ids, are among the k nearest of every row of x
    allowed = first.withColumn("n", F.lit(k) - (F.col("nx") - 1) - closer).where(F.col("n") > 0)
    one = allowed.select(F.col("x").alias("a"), F.col("y").alias("b"), "cosine", F.col("n").alias("nb"))
    two = allowed.select(F.col("y").alias("a"), F.col("x").alias("b"), F.col("n").alias("na"))
    mutual = one.where(F.col("a") < F.col("b")).join(two, ["a", "b"])

    def own(name: str) -> DataFrame:
        return members.select(F.col("rep").alias(name), F.col("ids").alias(f"ids_{name}"))

    wide = mutual.join(own("a"), "a", "left").join(own("b"), "b", "left")
    some = lambda name, n: F.slice(F.coalesce(F.col(f"ids_{name}"), F.array(name)), 1, F.col(n).cast("int"))
    across = wide.select("cosine", F.explode(some("a", "na")).alias("u"), some("b", "nb").alias("vs")).select(
        "cosine", "u", F.explode("vs").alias("v")
    )
    within = members.select(F.lit(1.0).alias("cosine"), F.posexplode("ids").alias("p", "u"), "ids").select(
        "cosine", "u", F.explode(F.slice("ids", F.col("p") + 2, k + 1)).alias("v")
    )
    return across.unionByName(within).select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"), "cosine")


def nearest(
    df: DataFrame, id_: str, vector: str, queries: DataFrame, dim: int = 64, k: int = 10, budget: float = 0.1, at_least: int = 1000,
    length: int = LENGTH, most_pivots: int = MOST_PIVOTS, query_block: int = 20_000, chunk: int = 10_000,
) -> DataFrame:
    """(id, neighbour, place, cosine): the `k` most similar other rows of every row of `queries`, which has the same columns.

    A query is compared with the permutations of all rows; its own permutation is as long as an eighth of the pivots.
    Of every `chunk` rows the share `budget` that is nearest by footrule, `at_least` rows or more, is reranked by cosine. Of
    equals the lower id counts. Queries go to the tasks in blocks of at most `query_block`, one pass over the rows for
    each block; vectors are never shuffled. Rows and queries without usable vector are left out.
    """
    spark = df.sparkSession
    row = lambda d: d.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where(
        F.col(id_).isNotNull() & usable(F.col(vector), dim)
    )
    good = row(df)
    pivots = choose_pivots(good, "id", "v", dim, df.count(), most_pivots)
    if not len(pivots):
        return spark.createDataFrame([], "id long, neighbour long, place int, cosine double")
    longest = max(length, len(pivots) // 8)
    n_queries = queries.count()
    result = None
    for part in range(parts := max(1, ceil(n_queries / query_block))):
        mine = row(queries).where(F.pmod(F.xxhash64("id", F.lit("query")), F.lit(parts)) == part).toArrow()
        qx = _matrix(mine["v"].combine_chunks(), dim) if mine.num_rows else np.zeros((0, dim), "f4")
        found = _search(good, mine["id"].to_numpy(), qx, pivots, dim, k, budget, at_least, length, longest, chunk)
        result = found if result is None else result.unionByName(found)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour"))
    return result.withColumn("place", place).where(F.col("place") <= k)


def _search(good: DataFrame, qid: np.ndarray, qx: np.ndarray, pivots: np.ndarray, dim: int, k: int, budget: float, at_least: int, length: int, longest: int, chunk: int) -> DataFrame:
    shared = good.sparkSession.sparkContext.broadcast((qid, qx, pivots))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qx, pivots = shared.value
        top_c = np.full((len(qid), k), -2.0, "f4")
        top_i = np.full((len(qid), k), -1, "i8")
        qperm = _permutations(qx, pivots, longest) if len(qid) else np.zeros((0, 1), "u2")
        for b in _chunks(batches, chunk):
            if not len(qid):
                continue
            x, ids = _matrix(b["v"].combine_chunks(), dim), b["id"].to_numpy()
            perm = _permutations(x, pivots, length)
            n, m = perm.shape
            flat = perm.ravel()
            order = np.argsort(flat, kind="stable")
            row, weight = (order // m).astype("i4"), (m - order % m).astype("f4")
            starts = np.searchsorted(flat[order], np.arange(len(pivots) + 1))
            keep = min(n, max(at_least, ceil(budget * n)))
            drop = m * (1 - np.arange(qperm.shape[1], dtype="f4") / qperm.shape[1])
            for s in range(len(qid)):
                p = qperm[s].astype("i8")
                size = starts[p + 1] - starts[p]
                e = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - starts[p], size)
                near = np.bincount(row[e], np.minimum(weight[e], np.repeat(drop, size)), minlength=n)
                c = np.argpartition(-near, keep - 1)[:keep]
                cosine = x[c] @ qx[s]
                cosine[ids[c] == qid[s]] = -2
                all_c, all_i = np.concatenate([top_c[s], cosine]), np.concatenate([top_i[s], ids[c]])
                best = _best(all_c, all_i, k)
                top_c[s], top_i[s] = all_c[best], all_i[best]
        full = top_i >= 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(qid, k)[full.ravel()]), pa.array(top_i[full]), pa.array(top_c[full].astype("f8"))],
            names=["id", "neighbour", "cosine"],
        )

    return good.mapInArrow(work, "id long, neighbour long, cosine double")


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of `size`, whatever the batches they come in; the last one has what is left."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= size:
            yield pa.Table.from_batches([*held, b.slice(0, size - n)])
            b, held, n = b.slice(size - n), [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _best(c: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of c, of equals the lower i."""
    edge = np.partition(c, len(c) - k)[len(c) - k]  # at least k: the best so far are among them
    some = np.flatnonzero(c >= edge)
    return some[np.lexsort((i[some], -c[some]))[:k]]
