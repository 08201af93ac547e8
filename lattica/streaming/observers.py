"""Observation that never blocks the solver, and a streaming front end."""

from __future__ import annotations

import queue
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AsyncObserver:
    """Hands snapshots to sinks on a thread of its own. With ``ring`` snapshots still waiting, a new one is
    dropped and counted. ``finish`` drains what waits and closes the sinks."""

    def __init__(self, sinks, every: int = 1, ring: int = 3):
        self.sinks, self.every, self.dropped, self.errors = list(sinks), every, 0, []
        self.waiting: queue.Queue = queue.Queue(maxsize=ring)
        self.thread = threading.Thread(target=self._drain, daemon=True)
        self.thread.start()

    def wants(self, step: int) -> bool:
        return step == 1 or (step > 0 and step % self.every == 0)

    def next_stop(self, step: int) -> int:
        return 1 if step < 1 else (step // self.every + 1) * self.every

    def observe(self, *snapshot) -> None:
        try:
            self.waiting.put_nowait(snapshot)
        except queue.Full:
            self.dropped += 1

    def _drain(self) -> None:
        while (snapshot := self.waiting.get()) is not None:
            for sink in self.sinks:
                try:
                    sink.observe(*snapshot)
                except Exception as error:  # a sink must not stop the others or the solver
                    self.errors.append(error)

    def finish(self) -> None:
        self.waiting.put(None)
        self.thread.join()
        for sink in self.sinks:
            sink.finish()


def step_stream(spark: SparkSession, simulation, dt: float, rows_per_second: int = 10, steps_per_batch: int = 8):
    """A query that advances a simulation by ``steps_per_batch`` steps with each micro-batch of ticks."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.writeStream.foreachBatch(lambda batch, epoch: simulation.run(steps_per_batch, dt)).start()


def binned_events(events: DataFrame, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Sums of an event stream (ts, event_type, value) by window, late rows past the watermark left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
