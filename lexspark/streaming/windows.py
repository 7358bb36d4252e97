"""Request windows, caches and debouncing over a log of events, as batch plans and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_windows(events: DataFrame, client: str, at: str, width: str, most: int) -> DataFrame:
    """(client, start, requests, allowed, refused) of windows that all clients share. The same plan over a stream needs
    a watermark on `at`."""
    return events.groupBy(client, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(
        client, F.col("w.start").alias("start"), "requests",
        F.least("requests", F.lit(most)).cast("long").alias("allowed"),
        F.greatest(F.col("requests") - most, F.lit(0)).cast("long").alias("refused"),
    )


def fixed_windows_stream(events: DataFrame, client: str, at: str, width: str, most: int, late: str = "10 minutes") -> DataFrame:
    """`fixed_windows` over a stream; events later than `late` are left out."""
    return fixed_windows(events.withWatermark(at, late), client, at, width, most)


def _anchors(at: np.ndarray, open_at: int | None, width: int) -> tuple[np.ndarray, int | None]:
    """For ascending times of one client the time its window was opened; and the last one. A window ends at its border."""
    out, i = np.empty(len(at), "i8"), 0
    while i < len(at):
        if open_at is None or at[i] >= open_at + width:
            open_at = int(at[i])
        j = int(np.searchsorted(at, open_at + width))
        j = max(j, i + 1)
        out[i:j] = open_at
        i = j
    return out, open_at


def anchored_windows(events: DataFrame, client: str, at: Column, id_: str, width_micros: int, slice_widths: int = 64) -> DataFrame:
    """(client, id, at, opened, number): windows that open with the first event after the last one has ended.

    `number` counts the events of a window from 1. A window depends on all before it, so that the log is cut into slices of
    `slice_widths` widths that tasks take by themselves: first each slice says, for every time at which it could become free to
    open a window, with which window it would be left; one pass over these tables, which are as long as the events of a
    width at most, tells in which window each slice really begins; then its windows are laid out. A task holds the times
    of one slice, so that a client with a large share of all events is spread over as many tasks as it has slices. Events
    without client or time are left out; at equal times the lower id comes first.
    """
    kind = events.schema[client].dataType.simpleString()
    rows = events.select(F.col(client).alias("client"), F.col(id_).alias("id"), at.cast("long").alias("at")).where(
        F.col("client").isNotNull() & F.col("at").isNotNull()
    )
    length = slice_widths * width_micros
    sliced = rows.withColumn("slice", F.floor(F.col("at") / length).cast("long"))
    times = sliced.select("client", "slice", "at").distinct()

    def ways(key: tuple, t: pa.Table) -> pa.Table:
        x = np.sort(t["at"].to_numpy())
        follows = np.searchsorted(x, x + width_micros)
        last, step = np.arange(len(x)), follows
        while (inside := step < len(x)).any():  # windows by powers of two
            last[inside] = last[step[inside]]
            step = np.where(inside, np.append(step, len(x))[step], step)
        entries = min(len(x), int(np.searchsorted(x, key[1].as_py() * length + width_micros, side="right")) + 1)
        end = last[:entries]
        keep = np.flatnonzero(np.r_[end[1:] != end[:-1], True])
        return pa.table({"client": pa.array([key[0].as_py()] * len(keep), t.schema.field("client").type), "slice": pa.array([key[1].as_py()] * len(keep), pa.int64()), "until": x[keep], "left_in": x[end[keep]]})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who = now = None
        window, done, entered = None, True, None
        for b in batches:
            out = []
            for c, s, until, left_in in b.itertuples(index=False, name=None):
                if c != who:
                    who, now, window = c, None, None
                if s != now:
                    now, done, entered = s, False, window
                    out.append((c, s, window))
                if not done and (entered is None or until >= entered + width_micros):
                    window, done = left_in, True
            yield pd.DataFrame({"client": [o[0] for o in out], "slice": [o[1] for o in out], "entered": pd.array([o[2] for o in out], "Int64")})

    def lay(key: tuple, t: pa.Table) -> pa.Table:
        x, entered = np.sort(t["at"].to_numpy()), t["entered"][0].as_py()
        opened, i = [] if entered is None else [entered], 0 if entered is None else int(np.searchsorted(x, entered + width_micros))
        while i < len(x):
            opened.append(int(x[i]))
            i = int(np.searchsorted(x, opened[-1] + width_micros))
        return pa.table({"client": pa.array([key[0].as_py()], t.schema.field("client").type), "slice": pa.array([key[1].as_py()], pa.int64()), "windows": pa.array([opened], pa.list_(pa.int64()))})

    tables = times.groupBy("client", "slice").applyInArrow(ways, f"client {kind}, slice long, until long, left_in long")
    entered = tables.repartition("client").sortWithinPartitions("client", "slice", "until").mapInPandas(enter, f"client {kind}, slice long, entered long")
    windows = times.join(entered, ["client", "slice"]).groupBy("client", "slice").applyInArrow(lay, f"client {kind}, slice long, windows array<long>")
    opened = F.array_max(F.filter("windows", lambda w: w <= F.col("at")))
    placed = sliced.join(windows, ["client", "slice"]).select("client", "id", "at", opened.alias("opened"))
    return placed.withColumn("number", F.row_number().over(Window.partitionBy("client", "opened").orderBy("at", "id")).cast("long"))


def fifo_hits(requests: DataFrame, server: str, at: Column, id_: str, key: str, ttl_micros: int, capacity: int) -> DataFrame:
    """(server, id, hit): which requests a cache of `capacity` answers serves, one cache for each server.

    An answer is kept from the request that makes it, for `ttl_micros` at most, and goes when it is the oldest and there are
    `capacity` younger ones. A request without key is never served. A cache depends on all requests before, so that those
    of a server are read in order by one task, which holds the cache and one batch; at equal times the lower id comes
    first. Requests without server or time are left out.
    """
    kinds = [requests.schema[c].dataType.simpleString() for c in (server, id_)]
    rows = requests.select(F.col(server).alias("server"), F.col(id_).alias("id"), at.cast("long").alias("at"), F.xxhash64(key).alias("key"), F.col(key).isNull().alias("none")).where(
        F.col("server").isNotNull() & F.col("at").isNotNull()
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, made = None, {}
        for b in batches:
            hits = np.zeros(len(b), bool)
            for i, (s, _, t, k, none) in enumerate(b.itertuples(index=False, name=None)):
                if s != who:
                    who, made = s, {}
                if none:
                    continue
                if k in made and t - made[k] <= ttl_micros:
                    hits[i] = True
                    continue
                made.pop(k, None)
                while len(made) >= capacity:
                    made.pop(next(iter(made)))  # the one that was made first
                made[k] = t
            yield pd.DataFrame({"server": b["server"], "id": b["id"], "hit": hits})

    ordered = rows.repartition("server").sortWithinPartitions("server", "at", "id")
    return ordered.mapInPandas(work, f"server {kinds[0]}, id {kinds[1]}, hit boolean")


def anchored_stream(events: DataFrame, client: str, at: str, width_micros: int, most: int, late: str = "10 minutes") -> DataFrame:
    """(client, at, allowed) for a stream: windows as in `anchored_windows`, kept per client and forgotten when the
    watermark, which is `late` behind the newest event, has passed their end. Events behind it are left out."""
    kind = events.schema[client].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_at, n = state.get if state.exists else (None, 0)
        times = np.sort(np.concatenate([b["at"].to_numpy() for b in batches]))
        opened, last = _anchors(times, open_at, width_micros)
        allowed = np.empty(len(times), bool)
        for i, o in enumerate(opened):
            n = n + 1 if o == open_at else 1
            open_at = int(o)
            allowed[i] = n <= most
        state.update((last, n))
        state.setTimeoutTimestamp(max((last + width_micros) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"client": key[0], "at": times, "allowed": allowed})

    return (
        events.withWatermark(at, late)
        .select(F.col(client).alias("client"), F.unix_micros(F.col(at)).alias("at"), F.col(at).alias("event_time"))
        .groupBy("client")
        .applyInPandasWithState(step, f"client {kind}, at long, allowed boolean", "open long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def debounced(events: DataFrame, client: str, at: str, gap_micros: int) -> DataFrame:
    """(client, at, events): the last event of each burst, bursts being parted by `gap_micros` or more."""
    # sessions also merge where one begins exactly at the end of another
    gap = f"{gap_micros - 1} microseconds"
    return events.groupBy(client, F.session_window(at, gap).alias("w")).agg(
        F.max(at).alias("at"), F.count(F.lit(1)).alias("events")
    ).select(client, "at", "events")


LINE = "struct<message:struct<content:string>,done:boolean>"


def assembled(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, answer, done, unreadable): the parts of each answer in order, from lines of JSON; bad lines are counted.

    An answer is as long as its lines; lines of one answer meet in one row, which is the result.
    """
    parsed = lines.select(key, order, F.col(line).alias("_raw"), F.from_json(line, LINE).alias("j"))
    bad = F.col("j.message.content").isNull() & ~F.coalesce(F.col("j.done"), F.lit(False))
    parts = F.sort_array(F.collect_list(F.when(F.col("j.message.content").isNotNull(), F.struct(order, F.col("j.message.content").alias("c")))))
    return parsed.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("answer"),
        F.coalesce(F.max("j.done"), F.lit(False)).alias("done"),
        F.sum(bad.cast("long")).alias("unreadable"),
    )
