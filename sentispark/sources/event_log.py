"""An event log as a Spark data source whose offset is the cursor: the time of the last event that was read.

The log is a chunked table with a chunk per hour of event time, sorted by time. As a batch source it replays what comes after a
cursor; as a stream it goes on from any cursor, and its checkpoint holds nothing but cursors. Either way
the hours that can hold wanted events are partitions of their own, and hours before the cursor are not opened.

    spark.dataSource.register(EventLog)
    spark.readStream.format("event_log").option("path", path).option("cursor", 1700000000000000).load()

An event that arrives with a time at or before the cursor is not read any more, as with the service the events come from.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sentispark.sources import chunks
from sentispark.sources.events import parse_events

HOUR_US = 3_600_000_000
_SCHEMA = "time_us long, value string"
_LAYOUT = chunks.Layout("hour", ("time_us",))


def write_log(lines: DataFrame, path: str, batch: int | None = None) -> None:
    """Add event lines (column ``value``) to a log; lines without a readable, non-zero time are left out."""
    timed = parse_events(lines).filter(~F.col("corrupt") & (F.col("time_us") != 0)).select("time_us", "value")
    hour = F.floor(F.col("time_us") / F.lit(HOUR_US)).cast("int")
    chunks.append(timed.withColumn("hour", hour).repartitionByRange("hour", "time_us"), path, _LAYOUT, batch)


def read_log(spark: SparkSession, path: str, cursor: int | None = None) -> DataFrame:
    """Events after ``cursor``, by Spark's own reader; only folders of hours that can hold any are listed."""
    now = chunks.manifest_of(spark, path)
    if now is None:
        raise ValueError(f"no event log at {path}")
    if cursor is None:
        return chunks.read_entries(spark, path, now).drop("hour")
    entries = [e for e in now.entries if (int(e.chunk) + 1) * HOUR_US > cursor]
    return chunks.read_entries(spark, path, now, entries).drop("hour").filter(F.col("time_us") > F.lit(cursor))


def register(spark: SparkSession) -> None:
    """Make ``event_log`` a format of this session."""
    spark.dataSource.register(EventLog)


@dataclass
class Hours(InputPartition):
    """Events of some folders of one hour, after ``begin`` up to ``end``."""

    folders: list[str]
    begin: int
    end: int


class _Log:
    """The newest manifest, read without a session: planning runs in a Python process of its own."""

    def __init__(self, path: str):
        from pyarrow import fs

        # Spark's names of object stores are those of Hadoop's connectors.
        path = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
        if urlparse(path).scheme:
            self.files, self.root = fs.FileSystem.from_uri(path)
        else:
            self.files, self.root = fs.LocalFileSystem(), os.path.abspath(path)
        self._fs = fs

    def manifest(self) -> dict | None:
        folder = self.files.get_file_info(self._fs.FileSelector(f"{self.root}/_manifest", allow_not_found=True))
        names = sorted(f.path for f in folder if f.path.endswith(".json") and not f.base_name.startswith("."))
        if not names:
            return None
        with self.files.open_input_stream(names[-1]) as stream:
            return json.loads(stream.read())

    def entries(self) -> list[tuple[int, str]]:
        """(hour, folder) of all that count."""
        found = self.manifest() or {"entries": []}
        return [(int(e["chunk"]), f"{self.root}/write={e['write']}/hour={e['chunk']}") for e in found["entries"]]

    def tables(self, folder: str):
        import pyarrow.parquet as pq

        for info in self.files.get_file_info(self._fs.FileSelector(folder)):
            if info.path.endswith(".parquet"):
                yield pq.ParquetFile(self.files.open_input_file(info.path))

    def latest(self) -> int:
        """The time of the last event, from the footers of the last hour's files; 0 for an empty log."""
        entries = self.entries()
        if not entries:
            return 0
        last = max(h for h, _ in entries)
        best = 0
        for hour, folder in entries:
            if hour == last:
                for table in self.tables(folder):
                    column = table.schema_arrow.get_field_index("time_us")
                    groups = (table.metadata.row_group(g).column(column).statistics for g in range(table.metadata.num_row_groups))
                    best = max([best, *(s.max for s in groups if s is not None and s.has_min_max)])
        return best


def _partitions(path: str, begin: int, end: int) -> list[InputPartition]:
    hours: dict[int, list[str]] = {}
    for hour, folder in _Log(path).entries():
        if hour * HOUR_US <= end and (hour + 1) * HOUR_US > begin:
            hours.setdefault(hour, []).append(folder)
    return [Hours(folders, begin, end) for _, folders in sorted(hours.items())]


def _read(path: str, partition: Hours) -> Iterator:
    """Record batches of the wanted events; row groups outside the times are passed over."""
    import pyarrow.compute as pc

    log = _Log(path)
    for folder in partition.folders:
        for table in log.tables(folder):
            column = table.schema_arrow.get_field_index("time_us")
            for g in range(table.metadata.num_row_groups):
                known = table.metadata.row_group(g).column(column).statistics
                if known is not None and known.has_min_max and (known.max <= partition.begin or known.min > partition.end):
                    continue
                for batch in table.iter_batches(row_groups=[g], columns=["time_us", "value"], batch_size=4096):
                    time = batch.column(0)
                    mine = pc.and_(pc.greater(time, partition.begin), pc.less_equal(time, partition.end))
                    if (some := batch.filter(mine)).num_rows:
                        yield some


class _Replay(DataSourceReader):
    def __init__(self, path: str, cursor: int):
        self.path, self.cursor = path, cursor

    def partitions(self) -> list[InputPartition]:
        return _partitions(self.path, self.cursor, _Log(self.path).latest()) or [Hours([], 0, 0)]

    def read(self, partition: Hours) -> Iterator:
        return _read(self.path, partition)


class _Follow(DataSourceStreamReader):
    def __init__(self, path: str, cursor: int):
        self.path, self.cursor = path, cursor

    def initialOffset(self) -> dict:
        return {"time_us": self.cursor}

    def latestOffset(self) -> dict:
        return {"time_us": max(self.cursor, _Log(self.path).latest())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _partitions(self.path, start["time_us"], end["time_us"]) or [Hours([], 0, 0)]

    def read(self, partition: Hours) -> Iterator:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    """Format ``event_log``: options ``path`` and ``cursor`` (events after this time; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return _SCHEMA

    def _place(self) -> tuple[str, int]:
        # Times may be negative only before 1970, where there are no events.
        return self.options["path"], int(self.options.get("cursor", 0))

    def reader(self, schema) -> DataSourceReader:
        return _Replay(*self._place())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follow(*self._place())
