"""Streams that are merged into a keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexspark.operators.store import commit, current, unique, upsert


def merging(path: str, keys: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that upserts each batch into the stored table at `path`; of a key's rows in a batch the
    first by `order` counts. A batch that is repeated after a failure changes nothing."""

    def work(batch: DataFrame, _: int) -> None:
        old = current(batch.sparkSession, path)
        fresh = unique(batch, keys, order)
        commit(fresh if old is None else upsert(old, fresh, keys), path)

    return work


def merge_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[Column]) -> StreamingQuery:
    """Everything that is there now, merged into `path`; goes on from `checkpoint` when called again."""
    writer = stream.writeStream.foreachBatch(merging(path, keys, order)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
