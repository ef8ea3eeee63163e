"""Throughput of running streams, measured in passing.

``observed`` counts the rows of a stream as they go by (``DataFrame.observe``: no second pass). A listener receives the
counts of every finished batch, adds them up per window of the clock and stores a row per window.
"""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sentispark.functions.numeric import round_half_up
from sentispark.sources import chunks

NAME = "throughput"
WINDOW_S = 60
_COUNTS = ("messages_received", "posts_processed", "total_matched")
_LAYOUT = chunks.Layout("day", ("window_start",))


def observed(stream: DataFrame, is_post: Column, matched: Column, name: str = NAME) -> DataFrame:
    """The same rows; per batch, all of them, the posts and the matches among them are counted."""
    return stream.observe(
        name,
        F.count(F.lit(1)).alias(_COUNTS[0]),
        F.count_if(is_post).alias(_COUNTS[1]),
        F.coalesce(F.sum(matched.cast("long")), F.lit(0)).alias(_COUNTS[2]),
    )


class ThroughputListener(StreamingQueryListener):
    """Adds up what ``observed`` streams report and stores a row per window and query.

    A window is stored when a later one begins or the query ends; only the open window of a driver that dies is lost. A batch
    is reported once, when it is finished; idle reports hold no counts. ``ended`` is set when a query has ended.
    """

    def __init__(self, spark: SparkSession, path: str, window_s: int = WINDOW_S, name: str = NAME):
        self._spark, self._path, self._window, self._name = spark, path, window_s, name
        self._open: dict[str, tuple[int, list[int]]] = {}
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self._name)
        if row is None or row[_COUNTS[0]] is None:
            return
        seconds = dt.datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).timestamp()
        self.add(str(progress.runId), int(seconds) // self._window * self._window, [int(row[c]) for c in _COUNTS])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._store(str(event.runId))
        self.ended.set()

    def add(self, run: str, window: int, counts: list[int]) -> None:
        """Counts of a finished batch."""
        begin, sums = self._open.get(run, (window, [0] * len(_COUNTS)))
        if begin != window:
            self._store(run)
            begin, sums = window, [0] * len(_COUNTS)
        self._open[run] = begin, [a + b for a, b in zip(sums, counts)]

    def _store(self, run: str) -> None:
        if run not in self._open:
            return
        begin, sums = self._open.pop(run)
        rows = self._spark.createDataFrame([(run, begin, *sums)], f"run string, window_start long, {', '.join(f'{c} long' for c in _COUNTS)}")
        chunks.append(rows.withColumn("day", F.floor(F.col("window_start") / 86_400).cast("int")), self._path, _LAYOUT)


def read_throughput(spark: SparkSession, path: str, window_s: int = WINDOW_S) -> DataFrame:
    """Counts per window over all queries, and messages per second to one decimal."""
    rows = chunks.read_table(spark, path)
    if rows is None:
        raise ValueError(f"no window has been stored at {path}")
    counted = rows.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    rate = round_half_up(F.col(_COUNTS[0]) / F.lit(float(window_s)) * F.lit(10.0)) / F.lit(10.0)
    return counted.withColumn("messages_per_second", rate)
