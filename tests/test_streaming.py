import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from dawnchorus.operators.intervals import merge_detections
from dawnchorus.session import checkpoint_root
from dawnchorus.streaming import detections as live
from dawnchorus.streaming import events as log

DET = "file string, start double, end double, scientific_name string, common_name string, confidence float, recorded_at timestamp"


def run(stream, tmp_path, mode="append", name="sink"):
    """Drain a stream into a table and return it."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def write_log(tmp_path, batches):
    folder = tmp_path / "log"
    folder.mkdir(exist_ok=True)
    for i, batch in enumerate(batches):
        text = "\n".join(json.dumps({"spec_version": "1.1", "timestamp": at, "event": kind, "payload": payload}) for at, kind, payload in batch)
        path = folder / f"{i:03d}.json"
        path.write_text(text + "\n")
        # Streams take files in the order of their times.
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def completed(at, file, status, detections=None):
    payload = {"file": file, "status": status}
    return (at, "file_completed", payload if detections is None else {**payload, "detections": detections})


def test_run_status_and_dedupe(spark, tmp_path):
    folder = write_log(tmp_path, [
        [("2024-05-01T12:00:00Z", "pipeline_started", {"total_files": 4, "model": "m"}), completed("2024-05-01T12:00:01Z", "a", "processed", 5)],
        [completed("2024-05-01T12:00:02Z", "a", "locked"), completed("2024-05-01T12:00:03Z", "b", "failed"), completed("2024-05-01T12:00:04Z", "c", "processed", 2)],
    ])
    envelopes = log.stream_event_log(spark, folder, max_files=1)
    status = run(log.stream_run_status(log.completed_files(envelopes)), tmp_path, "complete", "status").first()
    assert (status["files_processed"], status["files_failed"], status["files_skipped"], status["total_detections"], status["status"]) == (2, 1, 1, 7, "partial_success")
    once = run(log.dedupe_completed(log.completed_files(log.stream_event_log(spark, folder, 1))), tmp_path, name="once")
    assert rows_of(once, "file", "status") == [("a", "processed"), ("b", "failed"), ("c", "processed")]


def progress(ms, file, percent):
    at = pd.Timestamp("2024-05-01T12:00:00Z") + pd.Timedelta(milliseconds=ms)
    return (at.isoformat().replace("+00:00", "Z"), "progress", {"file": {"path": file, "segments_done": 1, "segments_total": 100, "percent": percent}})


END = [progress(10**8, "end", 5.0)]


def throttle_batches(spark, tmp_path, batches, name):
    """Shown (file, percent, ms) of updates that come batch by batch; a last one far ahead moves the watermark on."""
    (tmp_path / name).mkdir()
    updates = log.progress_updates(log.stream_event_log(spark, write_log(tmp_path / name, [*batches, END]), 1))
    shown = run(log.throttle_progress(updates), tmp_path / name, name=name)
    rows = shown.select("file", "percent", F.unix_millis("timestamp").alias("ms")).orderBy("file", "timestamp", "percent")
    return [(r["file"], round(r["percent"], 2), r["ms"]) for r in rows.collect()]


def test_progress_throttle(spark, tmp_path):
    steps = [(0, 0.5), (10, 3.0), (20, 12.0), (30, 15.0), (600, 16.0), (610, 17.0), (620, 99.9), (630, 100.0)]
    batches = [[progress(ms, "a", p) for ms, p in steps[:4]], [progress(ms, "a", p) for ms, p in steps[4:]]]
    got = throttle_batches(spark, tmp_path, batches, "throttled")
    assert [p for _, p, _ in got] == [0.5, 12.0, 16.0, 99.9, 100.0]


def test_throttle_is_in_the_order_of_time_whatever_arrives_first(spark, tmp_path):
    """Many triggers that overlap in time give what one fold over the sorted updates gives."""
    draw = random.Random(5)
    steps = [(f"f{draw.randrange(3)}", draw.randrange(0, 3_000_000), round(draw.uniform(0, 100), 2)) for _ in range(3000)]
    steps += [("hot", i * 7, round(i / 60, 2)) for i in range(6000)]
    draw.shuffle(steps)
    want = []
    for file in sorted({f for f, _, _ in steps}):
        mine = sorted((ms, np.float32(p)) for f, ms, p in steps if f == file)
        shown, _ = log.throttled(np.array([m for m, _ in mine]), np.array([p for _, p in mine], np.float32), None, 3_600_000)
        want += [(file, round(float(mine[i][1]), 2), mine[i][0]) for i in shown]
    batches = [[progress(ms, f, p) for f, ms, p in steps[i::12]] for i in range(12)]
    got = throttle_batches(spark, tmp_path, batches, "mixed")
    first = min(ms for _, _, ms in got) - min(ms for _, _, ms in want)
    assert sorted((f, p, ms - first) for f, p, ms in got) == sorted(want)


def test_throttle_starts_anew_after_silence(spark, tmp_path):
    batches = [[progress(0, "a", 50.0), progress(100, "a", 55.0)], [progress(7_200_000, "a", 5.0), progress(7_200_100, "a", 14.0)]]
    got = throttle_batches(spark, tmp_path, batches, "silent")
    assert [p for _, p, _ in got] == [50.0, 14.0]


def test_throttle_rule():
    assert log.passes_throttle(-3.0, 0, 50, 0) == (True, 0)
    assert log.passes_throttle(19.9, 10, 10, 0) == (False, 19)
    assert log.passes_throttle(20.0, 10, 10, 0) == (True, 20)
    assert log.passes_throttle(11.0, 500, 10, 0) == (True, 11)


def test_filtered_stream_equals_batch(spark, tmp_path):
    rows = [("f", i, float(i), float(i + 3), f"l{i % 4}", (i % 10) / 10, i) for i in range(40)]
    fields = "file string, seg_idx bigint, start_s float, end_s float, label string, confidence float, class_index int"
    batch = spark.createDataFrame(rows, fields)
    batch.write.json(str(tmp_path / "pred"))
    projected = spark.createDataFrame([("l0", 0.9), ("l1", 0.001), ("l2", 0.5)], "classifier_label string, score float")
    listed = spark.createDataFrame([("l1",)], "label string")
    for name, options in {"ranged": {"projected": projected, "rerank": True}, "listed": {"species": listed}, "both": {"projected": projected, "species": listed}}.items():
        stream = spark.readStream.schema(fields).json(str(tmp_path / "pred"))
        got = run(live.stream_detections(stream, 0.2, **options), tmp_path, name=name)
        assert rows_of(got) == rows_of(live.stream_detections(batch, 0.2, **options)) and got.count() > 0


@pytest.mark.parametrize("pre,post", [(0.0, 0.0), (5.0, 2.0)])
def test_merged_stream_equals_batch(spark, tmp_path, pre, post):
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(2)}", s, s + rng.choice([1.0, 3.0]), f"s{rng.randrange(2)}", "c", 0.5) for s in (float(rng.randrange(0, 900)) for _ in range(150))]
    df = spark.createDataFrame(rows, DET.rsplit(",", 1)[0]).withColumn("recorded_at", F.lit("2024-05-01 04:00:00").cast("timestamp"))
    late = df.limit(1).withColumn("file", F.lit("end")).withColumn("start", F.lit(9e5)).withColumn("end", F.lit(9e5 + 3))
    folder = str(tmp_path / "det")
    df.coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(DET).option("maxFilesPerTrigger", 1).json(folder)
    got = run(live.stream_merge_clips(stream, pre, post), tmp_path, "complete", f"clips{int(pre)}")
    columns = ["file", "scientific_name", "start", "end", "detection_count"]
    assert rows_of(got, *columns) == rows_of(merge_detections(df, pre, post), *columns)
    # In append mode clips come out once the watermark has passed them.
    late.write.mode("append").json(folder)
    closed = run(live.stream_merge_clips(spark.readStream.schema(DET).option("maxFilesPerTrigger", 1).json(folder), pre, post), tmp_path, "append", f"closed{int(pre)}")
    assert rows_of(closed.filter("file != 'end'"), *columns) == rows_of(got, *columns)


def test_pending_recordings_arrive_once(spark, tmp_path):
    root = tmp_path / "rec"
    root.mkdir()
    for name in ("a.wav", "b.wav", "note.txt"):
        (root / name).write_bytes(b"1")
    handled, done = [], []

    def outputs():
        return spark.createDataFrame(done, "file string, format string")

    def handle(batch, epoch):
        handled.append(sorted(r["file"].rsplit("/", 1)[1] for r in batch.collect()))

    for _ in range(2):
        query = live.stream_pending(spark, str(root), outputs, ["csv"], handle, str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
        (root / "c.wav").write_bytes(b"1")
        (root / "d.wav").write_bytes(b"1")
        done.append((f"file:{root}/d.wav", "csv"))
    assert handled == [["a.wav", "b.wav"], ["c.wav"]]


class Named:
    """A session that knows only its settings."""

    def __init__(self, **settings):
        self.conf = {key.replace("_", "."): value for key, value in settings.items()}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(Named(spark_checkpoint_dir="/shared/cp", spark_master="yarn")) == "/shared/cp"
    with pytest.raises(ValueError):
        checkpoint_root(Named(spark_master="yarn"))
    own = checkpoint_root(spark)
    assert own and checkpoint_root(spark) == own


class _CountingState:
    """A state variable that counts its calls."""

    def __init__(self):
        self.value, self.parts, self.calls = None, {}, 0

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear", "updateValue", "getValue", "removeKey", "keys"):
            object.__setattr__(self, "calls", object.__getattribute__(self, "calls") + 1)
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def updateValue(self, key, value):
        self.parts[key] = value

    def getValue(self, key):
        return self.parts[key]

    def removeKey(self, key):
        del self.parts[key]

    def keys(self):
        return list(self.parts)


class _Handle:
    def __init__(self):
        self.states, self.timers = [], set()

    def getValueState(self, name, schema):
        self.states.append(_CountingState())
        return self.states[-1]

    def getMapState(self, name, key, value):
        return self.getValueState(name, value)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_throttle_asks_the_state_a_few_times_a_file_not_for_each_update():
    handle, throttle = _Handle(), log._OrderedThrottle(3_600_000)
    throttle.init(handle)
    times = pd.to_datetime(np.arange(1000)[::-1] * 60_000, unit="ms")
    percents = (np.arange(1000)[::-1] % 90 + 5).astype(np.float32)
    halves = [pd.DataFrame({"timestamp": times[i::2], "percent": percents[i::2]}) for i in (0, 1)]
    for half in halves:
        list(throttle.handleInputRows(("a",), iter([half]), _Clock(0)))
    assert handle.timers == {log.SLICE_MS}
    clock = _Clock(500 * 60_000)
    got = pd.concat(throttle.handleExpiredTimer(("a",), clock, clock))
    # The first is not ten points above nothing.
    assert len(got) == 499 and got["timestamp"].is_monotonic_increasing
    clock = _Clock(10**9)
    got = pd.concat(throttle.handleExpiredTimer(("a",), clock, clock))
    assert len(got) == 500 and handle.states[0].value is None
    assert sum(s.calls for s in handle.states) < 20


def test_files_of_a_trigger_are_looked_up_by_few_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(100):
        (tmp_path / "in" / f"r{i}.wav").write_bytes(b"x")
    context, before = spark.sparkContext, []

    def handle(batch, epoch):
        before.append(batch.count())

    started = context._jsc.sc().dagScheduler().nextJobId()
    outputs = spark.createDataFrame([], "file string, format string")
    live.stream_pending(spark, str(tmp_path / "in"), lambda: outputs, ["csv"], handle, str(tmp_path / "cp")).awaitTermination()
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(k).numTasks for j in range(started, started + 60) if (i := tracker.getJobInfo(j)) for k in i.stageIds if tracker.getStageInfo(k)]
    assert before == [100] and max(tasks) <= 64
