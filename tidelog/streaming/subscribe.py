"""Subscriptions to a log: a backlog, one mark when it is caught up, then what is appended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def subscribe(spark: SparkSession, path: str, schema: str, after: int | None = None, files: int | None = None) -> DataFrame:
    """A streaming DataFrame of the events under ``path``, strictly after a position."""
    reader = spark.readStream.schema(schema)
    log = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
    return log if after is None else log.where(F.col("position") > after)


def subscribe_stream(spark: SparkSession, path: str, schema: str, stream_id: object, after: int | None = None) -> DataFrame:
    log = subscribe(spark, path, schema).where(F.col("stream_id") == F.lit(stream_id))
    return log if after is None else log.where(F.col("version") > after)


class Steps:
    """Hands batches to ``on_events`` in position order within a batch and calls ``on_caught_up`` once.

    The backlog is what the source holds when the run starts; it is drained first, then marked, and later
    runs with the same checkpoint deliver only what came after. A batch id seen before is not handed on, so a
    batch that is retried after a failure counts once.
    """

    def __init__(self, on_events: Callable[[DataFrame, int], None], on_caught_up: Callable[[], None]):
        self.on_events, self.on_caught_up = on_events, on_caught_up
        self.last, self.caught_up = -1, False

    def _batch(self, batch: DataFrame, number: int) -> None:
        if number > self.last:
            self.on_events(batch.orderBy("position"), number)
            self.last = number

    def drain(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        query = log.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if not self.caught_up:
            self.caught_up = True
            self.on_caught_up()
        return query

    def follow(self, log: DataFrame, checkpoint: str, every: str = "1 second") -> StreamingQuery:
        return log.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Balance(StatefulProcessor):
    """A stream's running balance with a latch at the first overdraft; events are applied in version order.

    Files may arrive in any order, so an event that is ahead of the stream's next version waits in the state
    until the gap is closed. Versions at or below the head are repeats and are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("balance", "head long, balance long, poisoned_at long")
        self.waiting = handle.getMapState("waiting", "version long", "delta long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        head, balance, poisoned = self.state.get() if self.state.exists() else (0, 0, None)
        for part in rows:
            for version, delta in zip(part["version"], part["delta"]):
                if version > head:
                    self.waiting.updateValue((int(version),), (int(delta),))
        while self.waiting.containsKey((head + 1,)):
            head += 1
            (delta,) = self.waiting.getValue((head,))
            self.waiting.removeKey((head,))
            balance += delta
            if poisoned is None and balance < 0:
                poisoned = head
        self.state.update((head, balance, poisoned))
        out = pd.DataFrame({"stream_id": [key[0]], "head": [head], "balance": [balance], "poisoned_at": pd.array([poisoned], "Int64")})
        yield out

    def close(self) -> None:
        pass


def live_balances(log: DataFrame) -> DataFrame:
    """Updates (stream_id, head, balance, poisoned_at) of a streaming log (stream_id, version, delta)."""
    return log.groupBy("stream_id").transformWithStateInPandas(
        Balance(), "stream_id long, head long, balance long, poisoned_at long", "Update", "None"
    )
