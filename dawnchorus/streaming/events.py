"""Event-log streams: intake, run counters, deduplication and progress throttling."""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from dawnchorus import schemas
from dawnchorus.constants import PROGRESS_INTERVAL_MS, PROGRESS_STEP_PERCENT
from dawnchorus.operators.summaries import run_status, status_counts
from dawnchorus.sources.events import payloads


# Updates of a file are decided together for so long.
SLICE_MS = 10_000
# Updates of a file that wait as one value; a file with more is held by slices.
HELD_TOGETHER = 4096
# Rows of one output batch.
ROWS_AT_ONCE = 10_000

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_event_log(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Envelopes as new log files arrive, at most ``max_files`` per trigger."""
    reader = spark.readStream.schema(schemas.EVENT_ENVELOPE).option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def completed_files(envelopes: DataFrame, run: str = "run") -> DataFrame:
    """(run, file, status, detections, timestamp) of ``file_completed`` events."""
    done = payloads(envelopes, "file_completed")
    owner = F.col(run) if run in envelopes.columns else F.lit("default")
    return done.select(
        owner.alias("run"),
        F.col("payload.file").alias("file"),
        F.col("payload.status").alias("status"),
        F.col("payload.detections").alias("detections"),
        "timestamp",
    )


def dedupe_completed(completed: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """First completion of each (run, file) inside the watermark."""
    return completed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(
        ["run", "file"]
    )


def stream_run_status(completed: DataFrame) -> DataFrame:
    """Live counters and status per run; use output mode ``update`` or ``complete``."""
    counted = completed.groupBy("run").agg(
        *status_counts(F.col("status")),
        F.coalesce(F.sum("detections"), F.lit(0)).alias("total_detections"),
    )
    return counted.withColumn(
        "status", run_status(F.col("files_processed"), F.col("files_failed"))
    )


def progress_updates(envelopes: DataFrame) -> DataFrame:
    """(file, percent, timestamp) of per-file ``progress`` events."""
    updates = payloads(envelopes, "progress")
    return updates.select(
        F.col("payload.file.path").alias("file"),
        F.col("payload.file.percent").alias("percent"),
        "timestamp",
    ).filter(F.col("file").isNotNull())


def passes_throttle(
    percent: float, at_ms: int, last_percent: int, last_ms: int
) -> tuple[bool, int]:
    """Whether an update is shown, and its whole percentage."""
    whole = int(min(max(percent // 1, 0), 100))
    shown = (
        whole in (0, 100)
        or whole - last_percent >= PROGRESS_STEP_PERCENT
        or at_ms - last_ms >= PROGRESS_INTERVAL_MS
    )
    return shown, whole


class _OrderedThrottle(StatefulProcessor):
    """Holds a file's updates and decides on a slice of time when the watermark has passed it.

    A file of few updates is one value, read and written once a trigger. One that waits with more than HELD_TOGETHER keeps
    them by slices until all of these are decided.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The number of the next part (0: no part is held), the time of the only timer, what is known of the file, and its updates.
        self.file = handle.getValueState(
            "file", "part bigint, timer bigint, percent int, shown_ms bigint, seen_ms bigint, micros binary, percents binary"
        )
        self.held = handle.getMapState("held", "slice bigint, part bigint", "micros binary, percents binary")

    def _read(self) -> tuple[int, int | None, tuple | None, np.ndarray, np.ndarray]:
        if not self.file.exists():
            return 0, None, None, np.empty(0, np.int64), np.empty(0, np.float32)
        part, timer, percent, shown_ms, seen_ms, micros, percents = self.file.get()
        last = None if percent is None else (percent, shown_ms, seen_ms)
        return part, timer, last, np.frombuffer(micros, np.int64), np.frombuffer(percents, np.float32)

    def _write(self, part: int, timer: int | None, last: tuple | None, micros: np.ndarray, percents: np.ndarray) -> None:
        self.file.update((part, timer, *(last or (None, None, None)), micros.tobytes(), percents.tobytes()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        part, timer, last, micros, percents = self._read()
        due, changed = timer, False
        for batch in rows:
            # Microseconds from the timestamp, whatever unit pandas holds it in.
            at = batch["timestamp"].astype("datetime64[us]").astype("int64").to_numpy()
            new = batch["percent"].to_numpy(dtype=np.float32, na_value=np.nan)
            usable = ~np.isnan(new)
            at, new = at[usable], new[usable]
            if not len(at):
                continue
            changed = True
            ends = (int(at.min()) // (SLICE_MS * 1000) + 1) * SLICE_MS
            due = ends if due is None else min(due, ends)
            micros, percents = np.append(micros, at), np.append(percents, new)
            if part or len(micros) > HELD_TOGETHER:
                part = self._spill(part, micros, percents)
                micros, percents = micros[:0], percents[:0]
        if due is not None and due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        if changed:
            self._write(part, due, last, micros, percents)
        yield from ()

    def _spill(self, part: int, micros: np.ndarray, percents: np.ndarray) -> int:
        slices = micros // (SLICE_MS * 1000)
        order = np.argsort(slices, kind="stable")
        slices, micros, percents = slices[order], micros[order], percents[order]
        names, begins = np.unique(slices, return_index=True)
        for one, low, high in zip(names.tolist(), begins.tolist(), np.append(begins[1:], len(slices)).tolist()):
            self.held.updateValue((one, part), (micros[low:high].tobytes(), percents[low:high].tobytes()))
            part += 1
        return part

    def _ready(self, upto: int, parts: list[tuple], micros: np.ndarray, percents: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Updates of slices that end by ``upto``, in the order of time."""
        if len(micros):
            yield micros, percents
        # Slice by slice, so that what is read at once is bounded by a slice.
        for _, group in itertools.groupby([k for k in parts if (k[0] + 1) * SLICE_MS <= upto], key=lambda k: k[0]):
            names = list(group)
            values = [self.held.getValue(k) for k in names]
            at = np.concatenate([np.frombuffer(v[0], np.int64) for v in values])
            new = np.concatenate([np.frombuffer(v[1], np.float32) for v in values])
            order = np.lexsort((new, at))
            for k in names:
                self.held.removeKey(k)
            yield at[order], new[order]

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is due, so a file has one timer and not one for each slice.
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        part, _, last, micros, percents = self._read()
        parts = sorted(tuple(k) for k in self.held.keys()) if part else []
        order = np.lexsort((percents, micros))
        micros, percents = micros[order], percents[order]
        now = int(np.searchsorted(micros, upto // SLICE_MS * SLICE_MS * 1000))
        for at, new in self._ready(upto, parts, micros[:now], percents[:now]):
            shown, last = throttled(at // 1000, new, last, self.silence_ms)
            for low in range(0, len(shown), ROWS_AT_ONCE):
                some = shown[low : low + ROWS_AT_ONCE]
                yield pd.DataFrame({"file": key[0], "percent": new[some], "timestamp": pd.to_datetime(at[some], unit="us", utc=True)})
        micros, percents = micros[now:], percents[now:]
        waiting = [k[0] for k in parts if (k[0] + 1) * SLICE_MS > upto][:1] + (micros[:1] // (SLICE_MS * 1000)).tolist()
        if waiting:
            timer = (min(waiting) + 1) * SLICE_MS
        elif last is not None and upto < last[2] + self.silence_ms:
            timer = last[2] + self.silence_ms
        else:
            # Nothing for so long: what comes next starts anew, as it would with the state kept.
            self.file.clear()
            return
        self.handle.registerTimer(timer)
        # With all its slices decided, a file is one value again.
        self._write(part if len(parts) and (parts[-1][0] + 1) * SLICE_MS > upto else 0, timer, last, micros, percents)

    def close(self) -> None:
        pass


def throttled(
    millis: np.ndarray, percents: np.ndarray, last: tuple | None, silence_ms: int
) -> tuple[list[int], tuple | None]:
    """Places of the updates that are shown, of a file's updates in order, and what is kept of the file after them."""
    shown = []
    for place, (at, percent) in enumerate(zip(millis.tolist(), percents.tolist())):
        # The clock of a file starts with its first update, and again after a silence.
        known = last if last is not None and at - last[2] < silence_ms else (0, at, at)
        emit, whole = passes_throttle(percent, at, known[0], known[1])
        last = (whole, at, at) if emit else (known[0], known[1], at)
        if emit:
            shown.append(place)
            last = None if whole == 100 else last
    return shown, last


def throttle_progress(updates: DataFrame, watermark: str = "1 hour", silence_s: float = 3600.0) -> DataFrame:
    """Progress updates worth showing, decided per file in the order of time.

    Shown are 0 and 100 percent, steps of ten points, and anything half a second after the last
    shown one. A file begins anew after 100 percent and after ``silence_s`` without an update.

    Updates wait in state until the watermark has passed their slice of time (SLICE_MS), and are then decided in
    the order of time, ties by percent, whatever files and triggers they came in; so the result is the same for
    every arrival order of updates that are not later than ``watermark`` allows. Later ones are dropped, as are those
    without a percentage. Up to HELD_TOGETHER waiting updates of a file are one value in the state store (RocksDB, as ``tune`` sets
    it); a file with more is held by slices and read a slice at a time.
    """
    return (
        updates.select("file", "percent", "timestamp")
        .withWatermark("timestamp", watermark)
        .groupBy("file")
        .transformWithStateInPandas(
            _OrderedThrottle(int(silence_s * 1000)),
            "file string, percent float, timestamp timestamp",
            "append",
            "EventTime",
        )
    )
