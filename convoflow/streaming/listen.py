"""A listener to a run's stream: what each wave took, as it ends."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from convoflow.operators.extract import speed


class Waves(StreamingQueryListener):
    """Counts what waves have taken in and how fast, from the stream's own progress events; `told` is called with each count.

    total: how many chunks there are to do, if that is known. What failed is in the run's own progress table.
    """

    def __init__(self, total: int | None = None, told: Callable[[dict], None] | None = None):
        self.total, self.told, self.waves, self.ended = total, told, [], 0
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802  the interface's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if not p.numInputRows:
            return
        with self._lock:
            done = (self.waves[-1]["processed"] if self.waves else 0) + p.numInputRows
            took = (self.waves[-1]["elapsed"] if self.waves else 0.0) + p.batchDuration / 1000
            row = {"batch": p.batchId, "processed": done, "elapsed": took} | speed(done, max(done, self.total or done), took)
            self.waves.append(row)
        if self.told:
            self.told(row)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended += 1


class listening:
    """with listening(spark, Waves()) as waves: a listener for as long as the block runs."""

    def __init__(self, spark: SparkSession, listener: Waves):
        self.spark, self.listener = spark, listener

    def __enter__(self) -> Waves:
        self.spark.streams.addListener(self.listener)
        return self.listener

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        self.spark.streams.removeListener(self.listener)
