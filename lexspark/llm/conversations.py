"""Rebuilding conversations from message rows.

Messages are range-partitioned and sorted by (conversation, time, speaker, id), so that a conversation of any size is
spread over as many tasks as its rows need. Each task runs the automaton over the stretches of conversations that it
holds. A stretch has no known start state, so its result is a function from state to state; the functions of a
conversation's stretches are composed in order. The automaton:

    START --user--> ASKED --assistant--> ANSWERED --user--> ASKED ...      everything else --> BROKEN

and a conversation is whole if it ends in ANSWERED. An alternating stretch of turns is fully described by its first and
its last speaker, which is the form in which the function is carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.notation import ntz_micros, stripped, uuid_key
from lexspark.session import durable

START, ASKED, ANSWERED, BROKEN = 0, 1, 2, 3
#: Symbols of the automaton.
SKIP, USER, ASSISTANT, FOREIGN = 0, 1, 2, 3


def clean_messages(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(conversation_id, at, sym, mid and `keep`) with every message id once.

    Rows without conversation are dropped. Of rows with one id the first ingested counts, of equals the smallest.
    Rows with a null or blank id count once per conversation, role, content and time. System rows and rows with null or blank content are SKIP;
    a null, blank or unknown role is FOREIGN even when its content is blank. A null time stands before all others.
    """
    role = F.lower(stripped(F.col("role")))
    blank = stripped(F.col("content")).isNull()
    sym = (
        F.when(role.isNull() | ~role.isin("user", "assistant", "system"), FOREIGN)
        .when(blank | (role == "system"), SKIP)
        .when(role == "user", USER)
        .otherwise(ASSISTANT)
    )
    rows = messages.select(
        F.coalesce(
            uuid_key(F.col("id")),
            F.concat_ws(":", F.lit("row"), F.xxhash64("conversation_id", "role", "content", "created_at").cast("string")),
        ).alias("mid"),
        uuid_key(F.col("conversation_id")).alias("conversation_id"),
        F.coalesce(ntz_micros(F.col("ingested_at")), F.lit(0)).alias("seen"),
        F.coalesce(ntz_micros(F.col("created_at")), F.lit(-(2**62))).alias("at"),
        sym.cast("int").alias("sym"),
        *[F.col(c) for c in keep],
    ).where(F.col("conversation_id").isNotNull())
    rest = [c for c in rows.columns if c != "mid"]
    first = F.min(F.struct("seen", *[c for c in rest if c != "seen"])).alias("r")
    return rows.groupBy("mid").agg(first).select("mid", *[F.col(f"r.{c}") for c in rest if c != "seen"])


def _ordered(clean: DataFrame) -> DataFrame:
    # at equal times the user's message comes first; FOREIGN and SKIP stand anywhere
    keys = ["conversation_id", "at", F.when(F.col("sym") == USER, 0).otherwise(1), "mid"]
    return clean.repartitionByRange(*keys).sortWithinPartitions(*keys)


_SEGMENT = (
    "conversation_id string, part int, batch int, first int, last int, alternates boolean, foreign boolean, "
    "turns long, messages long"
)


def _runs(ids: np.ndarray) -> np.ndarray:
    """Where a new conversation begins in a sorted batch, and the end."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    for n, b in enumerate(batches):
        if not len(b):
            continue
        ids, sym = b["conversation_id"].to_numpy(), b["sym"].to_numpy()
        cut = _runs(ids)
        run = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        foreign = np.bincount(run[sym == FOREIGN], minlength=len(cut) - 1) > 0
        talk = np.flatnonzero((sym == USER) | (sym == ASSISTANT))
        r, s = run[talk], sym[talk]
        turns = np.bincount(r, minlength=len(cut) - 1)
        same = (r[1:] == r[:-1]) & (s[1:] == s[:-1])
        alternates = np.bincount(r[1:][same], minlength=len(cut) - 1) == 0
        end = np.cumsum(turns)
        begin = end - turns
        some = turns > 0
        first, last = np.zeros(len(turns), "i4"), np.zeros(len(turns), "i4")
        first[some], last[some] = s[begin[some]], s[end[some] - 1]
        yield pd.DataFrame(
            {
                "conversation_id": ids[cut[:-1]], "part": np.int32(part), "batch": np.int32(n), "first": first, "last": last,
                "alternates": alternates, "foreign": foreign, "turns": turns.astype("i8"), "messages": np.diff(cut).astype("i8"),
            }
        )


def _step(state: Column, seg: Column) -> Column:
    """The state after a stretch: its function applied to the state before."""
    ends = F.when(seg["last"] == USER, ASKED).otherwise(ANSWERED)
    fits = F.when(seg["first"] == USER, state.isin(START, ANSWERED)).otherwise(state == ASKED)
    return (
        F.when(seg["foreign"] | (state == BROKEN), BROKEN)
        .when(seg["turns"] == 0, state)
        .when(seg["alternates"] & fits, ends)
        .otherwise(BROKEN)
    )


def verdicts(segments: DataFrame) -> DataFrame:
    """(conversation_id, state, turns, messages): composed over the stretches of each conversation.

    A conversation has one stretch per Arrow batch that it touches, thousands of times fewer than messages.
    """
    ordered = F.sort_array(
        F.collect_list(F.struct("part", "batch", "first", "last", "alternates", "foreign", "turns"))
    )
    return segments.groupBy("conversation_id").agg(
        F.aggregate(ordered, F.lit(START), _step).alias("state"),
        F.sum("turns").alias("turns"),
        F.sum("messages").alias("messages"),
    )


def judge_conversations(messages: DataFrame) -> DataFrame:
    """(conversation_id, whole, state, turns, messages) for every conversation with at least one message."""
    talk = _ordered(clean_messages(messages)).select("conversation_id", "sym")
    return verdicts(talk.mapInPandas(_segments, _SEGMENT)).withColumn("whole", F.col("state") == ANSWERED)


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with their task, batch and place among the turns of their stretch."""
    part = TaskContext.get().partitionId()
    for n, b in enumerate(batches):
        if not len(b):
            continue
        cut = _runs(b["conversation_id"].to_numpy())
        talk = b["sym"].isin((USER, ASSISTANT)).to_numpy().astype("i8")
        upto = np.cumsum(talk)
        before = np.repeat((upto - talk)[cut[:-1]], np.diff(cut))
        yield b.assign(part=np.int32(part), batch=np.int32(n), place=upto - before)


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_no, role, content, created_at) of the whole conversations; turns count from 1.

    Broken, empty and unanswered conversations are left out, as are system messages and blank ones. The sorted rows are
    written once to the checkpoint folder; stretches and rows are both taken from there. The join of rows with their
    stretch has at most one Arrow batch of rows to a key, however long the conversation.
    """
    clean = clean_messages(messages, ("content", "created_at"))
    schema = (
        "conversation_id string, at long, sym int, content string, created_at timestamp_ntz, part int, batch int, place long"
    )
    rows = durable(
        _ordered(clean)
        .select("conversation_id", "at", "sym", "content", "created_at")
        .mapInPandas(_numbered, schema)
    )
    talk = F.col("sym").isin(USER, ASSISTANT)
    key = ["conversation_id", "part", "batch"]
    segments = rows.groupBy(*key).agg(
        F.min_by("sym", F.when(talk, F.col("place"))).alias("first"),
        F.max_by("sym", F.when(talk, F.col("place"))).alias("last"),
        # in an alternating stretch the speaker follows from the parity of the place
        (F.count_distinct(F.when(talk, (F.col("sym") + F.col("place")) % 2)) <= 1).alias("alternates"),
        F.max(F.col("sym") == FOREIGN).alias("foreign"),
        F.sum(talk.cast("long")).alias("turns"),
        F.count(F.lit(1)).alias("messages"),
    )
    before = F.sum("turns").over(
        Window.partitionBy("conversation_id").orderBy("part", "batch").rowsBetween(Window.unboundedPreceding, -1)
    )
    good = verdicts(segments).where(F.col("state") == ANSWERED).select("conversation_id")
    offsets = (
        segments.withColumn("offset", F.coalesce(before, F.lit(0)))
        .join(good, "conversation_id", "left_semi")
        .select(*key, "offset")
    )
    return rows.where(talk).join(offsets, key).select(
        "conversation_id",
        (F.col("offset") + F.col("place")).cast("long").alias("turn_no"),
        F.when(F.col("sym") == USER, "user").otherwise("assistant").alias("role"),
        "content",
        "created_at",
    )
