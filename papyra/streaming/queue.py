"""The stateful flows: a queue of changed documents, and commands that must run once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, time: str) -> DataFrame:
    """The last change of each key; ties go to the larger row."""
    rest = [c for c in changes.columns if c not in (key, time)]
    return changes.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("r")).select(key, "r.*")


def drain(stream: DataFrame, key: str, time: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Hand on the last change of each key, batch by batch, until the stream's present end; the checkpoint says what was handled."""
    return stream.writeStream.foreachBatch(lambda df, n: handle(latest(df, key, time), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: str, time: str, keep: str) -> DataFrame:
    """A stream with one row of each key within ``keep`` of event time."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])
