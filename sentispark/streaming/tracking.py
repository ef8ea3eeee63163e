"""Timed job state: expiry of active jobs and completion of processing.

Input rows are (job_id, ts, kind, amount). The state is a handful of numbers per job; counts
arrive already summed per batch (see ``pipeline``), so a job with a third of all posts brings no
more rows than any other. Needs the RocksDB state store, which ``build_session`` sets; a session
made otherwise sets ``spark.sql.streaming.stateStore.providerClass`` to ``session.ROCKSDB``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from sentispark.operators.lifecycle import (
    COMPLETION_RATIO,
    COMPLETION_TIMEOUT_MS,
    IDLE_TTL_MS,
    MAX_TTL_MS,
)

EXPIRY_SCHEMA = "job_id string, total_items long, completed_ms long"
COMPLETION_SCHEMA = "job_id string, decision string, processed long, expected long"


def _millis(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[ms]").astype("int64")


class JobExpiry(StatefulProcessor):
    """Emits the matched count of a job when its time is over; a cancelled job emits nothing.

    Kinds: ``start`` (amount = duration in ms, 0 = unbounded), ``match`` (amount = posts),
    ``cancel``. Matches outside the job's time are not counted. Matches that arrive before the
    job's start wait for it, summed per time, for up to a day.
    """

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("job", "started long, ends long, matched long")
        self._waiting = handle.getMapState("waiting", "ms long", "amount long")

    def handleInputRows(self, key, rows, timerValues):
        batch = [frame.assign(ms=_millis(frame["ts"])) for frame in rows]
        started, ends, matched = self._state.get() if self._state.exists() else (None, None, 0)
        for frame in batch:
            for row in frame[frame["kind"] == "start"].itertuples():
                self._clear_timers()
                started, matched = int(row.ms), 0
                ends = started + int(row.amount) if row.amount > 0 else None
        if started is None:
            if any((frame["kind"] == "cancel").any() for frame in batch):
                self._clear_timers()
                self._waiting.clear()
                return
            self._keep_waiting(batch)
            return
        for (ms,), (amount,) in list(self._waiting.iterator()):
            if ms >= started and (ends is None or ms < ends):
                matched += amount
        self._waiting.clear()
        for frame in batch:
            active = (frame["kind"] == "match") & (frame["ms"] >= started)
            if ends is not None:
                active &= frame["ms"] < ends
            matched += int(frame.loc[active, "amount"].sum())
        if any((frame["kind"] == "cancel").any() for frame in batch):
            self._clear_timers()
            self._state.clear()
            return
        self._state.update((started, ends, matched))
        if ends is not None and not list(self._handle.listTimers()):
            self._handle.registerTimer(ends)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self._state.exists():
            _, ends, matched = self._state.get()
            self._state.clear()
            yield pd.DataFrame({"job_id": [key[0]], "total_items": [matched], "completed_ms": [ends]})
        else:
            self._waiting.clear()

    def _keep_waiting(self, batch: list[pd.DataFrame]) -> None:
        latest = None
        for frame in batch:
            found = frame[frame["kind"] == "match"].groupby("ms")["amount"].sum()
            for ms, amount in found.items():
                known = self._waiting.getValue((int(ms),)) if self._waiting.containsKey((int(ms),)) else (0,)
                self._waiting.updateValue((int(ms),), (known[0] + int(amount),))
                latest = max(latest or 0, int(ms))
        if latest is not None:
            self._clear_timers()
            self._handle.registerTimer(latest + MAX_TTL_MS)

    def _clear_timers(self) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)

    def close(self) -> None:
        pass


class CompletionTracker(StatefulProcessor):
    """Decides when a job is done.

    Kinds: ``processed`` (amount = rows) and ``ingestion_complete`` (amount = expected rows), in
    any order. ``complete`` once all expected rows are processed. Otherwise, from 30 s after the
    end of ingestion on, ``fallback`` if at least 95 % are processed and nothing came for 15 s;
    else the job is looked at again 30 s later. ``expired`` state is dropped.
    """

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState(
            "tracker", "processed long, expected long, ended long, created long, updated long"
        )

    def handleInputRows(self, key, rows, timerValues):
        processed, expected, ended, created, updated = (
            self._state.get() if self._state.exists() else (0, None, None, None, None)
        )
        for frame in rows:
            ms = _millis(frame["ts"])
            done = frame["kind"] == "processed"
            end = frame["kind"] == "ingestion_complete"
            processed += int(frame.loc[done, "amount"].sum())
            if end.any():
                latest = ms[end].idxmax()
                expected, ended = int(frame.loc[latest, "amount"]), int(ms[latest])
            first, last = int(ms.min()), int(ms.max())
            created = first if created is None else min(created, first)
            updated = last if updated is None else max(updated, last)
        if expected is not None and processed >= expected:
            self._finish()
            yield self._row(key, "complete", processed, expected)
            return
        self._state.update((processed, expected, ended, created, updated))
        self._arm(self._next_check(expected, ended, created, updated))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self._state.exists():
            return
        processed, expected, ended, created, updated = self._state.get()
        now = max(
            expiredTimerInfo.getExpiryTimeInMs(),
            timerValues.getCurrentWatermarkInMs(),
            timerValues.getCurrentProcessingTimeInMs() if timerValues.getCurrentWatermarkInMs() <= 0 else 0,
        )
        idle, age = now - updated, now - created
        if expected is not None and self._enough(processed, expected, now - ended, idle):
            self._finish()
            yield self._row(key, "fallback", processed, expected)
        elif (idle > IDLE_TTL_MS and expected is None) or age > MAX_TTL_MS:
            self._finish()
            yield self._row(key, "expired", processed, expected)
        else:
            later = COMPLETION_TIMEOUT_MS if expected is not None else IDLE_TTL_MS
            self._arm(now + later)

    @staticmethod
    def _enough(processed, expected, waited, idle) -> bool:
        ratio = processed / expected if expected > 0 else 1.0
        return (
            waited >= COMPLETION_TIMEOUT_MS
            and ratio >= COMPLETION_RATIO
            and idle >= COMPLETION_TIMEOUT_MS / 2
        )

    @staticmethod
    def _next_check(expected, ended, created, updated) -> int:
        if expected is not None:
            return ended + COMPLETION_TIMEOUT_MS
        return min(updated + IDLE_TTL_MS, created + MAX_TTL_MS) + 1

    def _arm(self, at: int) -> None:
        self._clear_timers()
        self._handle.registerTimer(at)

    def _finish(self) -> None:
        self._clear_timers()
        self._state.clear()

    def _clear_timers(self) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)

    @staticmethod
    def _row(key, decision, processed, expected) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "job_id": [key[0]],
                "decision": [decision],
                "processed": [processed],
                "expected": pd.array([expected], dtype="Int64"),
            }
        )

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, processor, schema: str, watermark: str | None) -> DataFrame:
    """Timers follow the event time when a watermark is given, else the clock."""
    if watermark is not None:
        stream = stream.withWatermark("ts", watermark)
    return stream.groupBy("job_id").transformWithStateInPandas(
        processor, schema, "Append", "EventTime" if watermark is not None else "ProcessingTime"
    )


def job_expiry(activity: DataFrame, watermark: str | None = None) -> DataFrame:
    return _timed(activity, JobExpiry(), EXPIRY_SCHEMA, watermark)


def completion(activity: DataFrame, watermark: str | None = None) -> DataFrame:
    return _timed(activity, CompletionTracker(), COMPLETION_SCHEMA, watermark)
