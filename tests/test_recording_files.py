"""One file per recording and format: contents, restarts, failures, hot recordings."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dawnchorus.operators.work import outputs_of, pending_recordings
from dawnchorus.sinks import recordings as out
from dawnchorus.sinks.recordings import ResultOptions, write_recordings
from dawnchorus.sources.results import read_detections_csv, read_result_documents
from dawnchorus.storage import open_store

DET = "file string, start_s float, end_s float, scientific_name string, common_name string, confidence float, week int"
ALL = ["csv", "raven", "audacity", "kaleidoscope", "json", "parquet"]


def detections(spark, rows):
    return spark.createDataFrame(rows, DET)


def sample(spark):
    rows = [
        ("/a/one.wav", 3.0, 6.0, "Turdus merula", "Common Blackbird", 0.5, 3),
        ("/a/one.wav", 0.0, 3.0, "Parus major", "Great, \"big\" Tit", 0.25, 3),
        ("/a/one.wav", 0.0, 3.0, "Turdus merula", "Common Blackbird", 0.75, 3),
        ("/b/two.flac", 1.5, 4.5, "Parus major", "Great_Tit", 0.9, 3),
    ]
    recordings = spark.createDataFrame([("/a/one.wav", 9.0), ("/b/two.flac", 6.0), ("/b/quiet.wav", 60.0)], "file string, duration_s double")
    return detections(spark, rows), recordings


def read(path):
    with open(path, encoding="utf-8") as file:
        return file.read()


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("ranges", [1, 8, 40])
def test_every_format_and_recording(spark, tmp_path, ranges):
    det, recordings = sample(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        options = ResultOptions(include=["week"], model="m1", analysed_at=F.lit("2024-05-01").cast("timestamp"))
        manifest = write_recordings(det, recordings, ALL, str(tmp_path), options).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(manifest) == 18 and not [r for r in manifest if r["error"]]
    assert {(r["file"], r["rows"]) for r in manifest} == {("/a/one.wav", 3), ("/b/two.flac", 1), ("/b/quiet.wav", 0)}
    assert len(listed(tmp_path)) == 18
    head = "Start (s),End (s),Scientific name,Common name,Confidence,File,week\n"
    assert read(tmp_path / "one.BirdNET.results.csv") == "﻿" + head + (
        "0.0,3.0,Turdus merula,Common Blackbird,0.7500,/a/one.wav,3\n"
        '0.0,3.0,Parus major,"Great, ""big"" Tit",0.2500,/a/one.wav,3\n'
        "3.0,6.0,Turdus merula,Common Blackbird,0.5000,/a/one.wav,3\n"
    )
    assert read(tmp_path / "quiet.BirdNET.results.csv") == "﻿" + head
    assert read(tmp_path / "two.BirdNET.results.txt") == "1.5\t4.5\tGreat, Tit\t0.9000\n"
    assert read(tmp_path / "quiet.BirdNET.results.txt") == ""
    table = read(tmp_path / "one.BirdNET.selection.table.txt").splitlines()
    assert [line.split("\t")[0] for line in table] == ["Selection", "1", "2", "3"]
    document = json.loads(read(tmp_path / "one.BirdNET.json"))
    assert document["source_file"] == "one.wav" and len(document["detections"]) == 3
    assert document["summary"] == {"total_detections": 3, "unique_species": 2, "audio_duration_seconds": 9.0}
    assert json.loads(read(tmp_path / "quiet.BirdNET.json"))["detections"] == []
    assert pq.read_table(tmp_path / "one.BirdNET.results.parquet").num_rows == 3
    assert pq.read_table(tmp_path / "quiet.BirdNET.results.parquet").num_rows == 0
    for r in manifest:
        assert os.path.getsize(r["path"]) == r["bytes"]
    # What was written is read back and leaves nothing pending.
    parsed = read_detections_csv(spark, str(tmp_path / "*.results.csv"))
    assert parsed.count() == 4
    assert read_result_documents(spark, str(tmp_path / "*.json")).count() == 3
    paths = spark.createDataFrame([(str(tmp_path / f),) for f in listed(tmp_path)], "path string")
    assert pending_recordings(recordings, outputs_of(paths, recordings, ALL, str(tmp_path)), ALL).count() == 0


def test_a_hot_recording_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("/x/hot.wav")).otherwise(F.concat(F.lit("/x/r"), F.col("id") % 7, F.lit(".wav"))).alias("file"),
        (F.col("id") % 5000).cast("float").alias("start_s"), (F.col("id") % 5000 + 3).cast("float").alias("end_s"),
        F.lit("s").alias("scientific_name"), F.lit("c").alias("common_name"), F.lit(0.5).cast("float").alias("confidence"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = write_recordings(rows, rows.select("file").distinct().withColumn("duration_s", F.lit(1.0)), ["csv", "raven", "parquet"], str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["rows"] for r in done) == 90_000 and not [r for r in done if r["error"]]
    assert len(listed(tmp_path)) == 24
    starts = [float(line.split(",")[0]) for line in read(tmp_path / "hot.BirdNET.results.csv").splitlines()[1:]]
    assert len(starts) == 20_000 and starts == sorted(starts)
    numbers = [line.split("\t")[0] for line in read(tmp_path / "hot.BirdNET.selection.table.txt").splitlines()[1:]]
    assert numbers == [str(i + 1) for i in range(20_000)]
    held = pq.read_table(tmp_path / "hot.BirdNET.results.parquet")["start_s"].to_pylist()
    assert len(held) == 20_000 and held == sorted(held)


def test_writing_again_replaces(spark, tmp_path):
    det, recordings = sample(spark)
    for rows in (det, det.where("confidence > 0.6")):
        write_recordings(rows, recordings, ["csv", "json"], f"file://{tmp_path}")
    assert len(listed(tmp_path)) == 6
    assert len(read(tmp_path / "one.BirdNET.results.csv").splitlines()) == 2


def test_next_to_the_recording(spark, tmp_path):
    rows = [(f"{tmp_path}/in/a.wav", 0.0, 3.0, "s", "c", 0.5, 1), (f"{tmp_path}/in/deep/a.wav", 0.0, 3.0, "s", "c", 0.5, 1)]
    det = detections(spark, rows)
    write_recordings(det, det.select("file"), ["audacity"])
    assert listed(tmp_path) == ["in/a.BirdNET.results.txt", "in/deep/a.BirdNET.results.txt"]


def test_unlisted_shared_and_null_recordings(spark, tmp_path):
    rows = [(f, 0.0, 3.0, "s", "c", 0.5, 1) for f in ("/a/x.wav", "/b/x.wav", "/a/unlisted.wav", None)]
    recordings = spark.createDataFrame([("/b/x.wav",), ("/a/x.wav",), ("/a/x.wav",), (None,)], "file string")
    done = {r["file"]: r["error"] for r in write_recordings(detections(spark, rows), recordings, ["csv"], str(tmp_path)).collect()}
    assert done["/a/x.wav"] is None and "another" in done["/b/x.wav"] and "not among" in done["/a/unlisted.wav"]
    assert listed(tmp_path) == ["x.BirdNET.results.csv"] and len(done) == 3


def test_no_rows(spark, tmp_path):
    det, recordings = sample(spark)
    assert write_recordings(det.limit(0), recordings.limit(0), ALL, str(tmp_path)).collect() == []
    assert write_recordings(det.limit(0), recordings, ["csv"], str(tmp_path)).count() == 3
    with pytest.raises(ValueError, match="unknown"):
        write_recordings(det, recordings, ["csv", "xls"], str(tmp_path))


def test_an_unwritable_file_is_a_row(spark, tmp_path):
    def half_broken(address):
        """A store that holds no files of one recording."""
        if "/two." in address:
            raise OSError("no such bucket")
        return open_store(address)

    det, recordings = sample(spark)
    done = write_recordings(det, recordings, ["csv", "json"], str(tmp_path), store=half_broken).collect()
    assert {r["file"] for r in done if r["error"]} == {"/b/two.flac"}
    assert len(listed(tmp_path)) == 4


def test_a_user_format(spark, tmp_path):
    fmt = out.RecordingFormat(
        ".count.txt",
        lambda det, options: det.select("_place", F.concat("scientific_name", F.lit(";")).alias("text")),
        lambda options: F.concat(F.col("total_detections"), F.lit(":")),
        lambda options: F.lit("end"),
    )
    out.register_recording_format("count", fmt)
    try:
        det, recordings = sample(spark)
        write_recordings(det, recordings, ["count"], str(tmp_path))
    finally:
        del out.RECORDING_FORMATS["count"]
    assert read(tmp_path / "one.count.txt") == "3:Turdus merula;Parus major;Turdus merula;end"
    assert read(tmp_path / "quiet.count.txt") == "0:end"
