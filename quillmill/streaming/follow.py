"""Following collections and logs as streams.  An extension: the files' own tool has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.changes import last_wins, replay
from quillmill.plans.stage import written


class Replica:
    """An index kept by a stream of log records: each batch is replayed on it, and a
    batch delivered again changes nothing."""

    def __init__(self, index: DataFrame, key: str, order: list[str]):
        self.table, self.key, self.order, self.batch = index, key, order, -1

    def __call__(self, log: DataFrame, batch: int) -> None:
        if batch <= self.batch:
            return
        self.table = written(replay(self.table, log, self.key, self.order))
        self.batch = batch

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        return log.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(log: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records by kind and window of time; those later than `late` are dropped."""
    return log.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"))


def on_change(stream: DataFrame, act: Callable[[DataFrame], None], key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Calls act with the last record of each key of every batch."""
    return stream.writeStream.foreachBatch(lambda df, _: act(last_wins(df, key, order))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
