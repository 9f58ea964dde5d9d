"""Streams that keep the engine fresh: events folded into feedback, changed files indexed, health counted, deadlines kept."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import feedback as B
from ..sources import index as X


def folding(events: DataFrame) -> DataFrame:
    """A stream of (event_id, request_id, path, kind, ts timestamp, dwell_seconds) -> running (path, used, total), each event key once, none folded twice."""
    once = events.withWatermark("ts", "3650 days").dropDuplicatesWithinWatermark(["request_id", "kind", "path"])
    rows = B.labelled(once).where(F.col("used").isNotNull())
    return rows.groupBy("path").agg(F.sum(F.col("used").cast("int")).alias("used"), F.count("*").alias("total"))


def watch_files(spark: SparkSession, folder: str, index: str, state: str, *, most: int = 50, every: str | None = None):
    """Starts a stream that indexes the files that come into a folder, ``most`` of them a turn; ``every`` gathers changes for so long, else it runs once and ends."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most).option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content"))
        rows = last.select("path", F.decode("content", "UTF-8").alias("text"))
        if rows.take(1):
            X.index_paths(rows, index)  # the same files again give the same index

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", state)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_baskets(baskets: DataFrame, update: Callable[[DataFrame], None], state: str, *, every: str = "600 seconds", once: bool = False):
    """Starts a stream that hands new baskets to ``update``, a turn at a time."""

    def put(batch: DataFrame, number: int) -> None:
        if batch.take(1):
            update(batch)

    writer = baskets.writeStream.foreachBatch(put).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class Health(StreamingQueryListener):
    """Counts turns, rows and time of every stream; ``rows()`` has them as counters and samples for the metrics text."""

    def __init__(self) -> None:
        self.turns: dict[str, int] = {}
        self.read: dict[str, int] = {}
        self.took: list[tuple[str, float]] = []
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.turns.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.turns[name] = self.turns.get(name, 0) + 1
        self.read[name] = self.read.get(name, 0) + p.numInputRows
        self.took.append((name, p.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[str(event.id)] = event.exception

    def rows(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        count = [("stream_turns_total", f'stream="{k}"', float(v)) for k, v in self.turns.items()] + [("stream_rows_total", f'stream="{k}"', float(v)) for k, v in self.read.items()]
        return spark.createDataFrame(count, "name string, labels string, value double"), spark.createDataFrame([("stream_seconds", f'stream="{k}"', v) for k, v in self.took], "name string, labels string, value double")


class Deadline:
    """Phases within a time limit: one that starts too late does not run, and the answer so far is marked truncated."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.clock, self.end = clock, clock() + seconds
        self.truncated: str | None = None
        self.seconds: dict[str, float] = {}

    def run(self, phase: str, rows: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        if self.truncated or self.clock() >= self.end:
            self.truncated = self.truncated or phase
            return rows
        began = self.clock()
        out = fn(rows)
        self.seconds[phase] = self.clock() - began
        return out

    def profile(self) -> list[tuple[str, float, float]]:
        """(phase, seconds, per cent) of what ran."""
        total = sum(self.seconds.values()) or 1.0
        return [(k, v, round(100 * v / total, 1)) for k, v in self.seconds.items()]
