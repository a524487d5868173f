"""Incremental indexing as a stream of files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All files there are now, in micro-batches; a later call goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows a day of event time, closed once the watermark has passed the day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


class Progress(StreamingQueryListener):
    """Rows done, batches, and whether the query has ended."""

    def __init__(self):
        self.done, self.batches, self.finished = 0, 0, False

    def onQueryStarted(self, event):
        self.done, self.batches, self.finished = 0, 0, False

    def onQueryProgress(self, event):
        self.done += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.finished = True

    def reset(self) -> None:
        """Before a run over another folder starts: whoever asks in between must not take the last run's end for its own."""
        self.done, self.batches, self.finished = 0, 0, False

    def event(self, total: int, indexed: int) -> str:
        """One server-sent event; the last one says that indexing has ended."""
        return "data: " + json.dumps({"done": self.done, "total": total, "indexed": indexed, "indexing": not self.finished}, separators=(",", ":")) + "\n\n"

    def percent(self, total: int) -> int:
        return round(self.done / total * 100) if total else 0
