import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from dawnchorus.operators import summaries
from dawnchorus.operators.scoring import score_segments
from dawnchorus.operators.segments import segment_grid
from dawnchorus.plans.analysis import AnalysisSettings, analyze
from dawnchorus.plans.clips import plan_clips
from dawnchorus.schemas import PARSED
from dawnchorus.sources import audio
from dawnchorus.sources.inventory import recording_inventory


def tone(rate, seconds, hz, level=0.5):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype(np.float32)


def pcm16(path, samples, rate, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes((samples * 32767).astype("<i2").tobytes())


def float_wav(path, samples, rate):
    body = samples.astype("<f4").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 3, 1, rate, rate * 4, 4, 32)
    extra = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    path.write_bytes(head + extra + struct.pack("<4sI", b"data", len(body)) + body)


def loudest(samples, rate):
    return np.argmax(np.abs(np.fft.rfft(samples))) * rate / len(samples)


def test_probe(spark, tmp_path):
    pcm16(tmp_path / "a.wav", tone(8000, 2.5, 440), 8000)
    pcm16(tmp_path / "s" / "b.wav", np.repeat(tone(8000, 1, 440), 2), 8000, 2)
    float_wav(tmp_path / "f.wav", tone(16000, 1, 440), 16000)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    got = {r["file"].rsplit("/", 1)[1]: r for r in audio.probe_wav(recording_inventory(spark, [str(tmp_path)])).collect()}
    assert (got["a.wav"]["sample_rate"], got["a.wav"]["frames"], got["a.wav"]["duration_s"]) == (8000, 20000, 2.5)
    assert (got["b.wav"]["channels"], got["b.wav"]["frames"]) == (2, 8000)
    assert got["f.wav"]["frames"] == 16000
    assert got["bad.wav"]["error"] == "not a WAV file" and got["bad.wav"]["frames"] is None


def test_decode_mono_and_padding(spark, tmp_path):
    left, right = tone(8000, 2.5, 440), np.zeros(20000, np.float32)
    pcm16(tmp_path / "st.wav", np.stack([left, right], axis=1).ravel(), 8000, 2)
    found = audio.probe_wav(recording_inventory(spark, [str(tmp_path)]))
    segments = audio.decode_segments(segment_grid(found, 1.0), 8000, 8000).orderBy("seg_idx").collect()
    assert [len(s["samples"]) for s in segments] == [8000] * 3
    assert np.allclose(segments[0]["samples"], left[:8000] / 2, atol=1e-4)
    assert np.allclose(segments[2]["samples"][4000:], 0)


def test_unreadable_file_keeps_its_segments(spark, tmp_path, monkeypatch):
    # Batches of one segment each.
    monkeypatch.setattr(audio, "_BATCH_BYTES", 1)
    pcm16(tmp_path / "a.wav", tone(8000, 3, 440), 8000)
    pcm16(tmp_path / "b.wav", tone(8000, 2, 440), 8000)
    grid = segment_grid(audio.probe_wav(recording_inventory(spark, [str(tmp_path)])), 1.0)
    grid = spark.createDataFrame(grid.collect(), grid.schema)
    (tmp_path / "b.wav").write_bytes(b"broken")
    got = audio.decode_segments(grid, 8000, 8000).collect()
    good = [r for r in got if r["error"] is None]
    assert len(good) == 3 and all(len(r["samples"]) == 8000 for r in good)
    assert [r["error"] for r in got if r["samples"] is None] == ["not a WAV file"] * 2
    scored = score_segments(audio.decode_segments(grid, 8000, 8000), lambda: lambda batch: batch[:, :1] * 0 + 1, ["a"])
    assert scored.count() == 3


def test_resampling_keeps_tone_and_removes_alias(spark, tmp_path):
    mixed = tone(48000, 1, 1000) + tone(48000, 1, 15000, 0.4)
    pcm16(tmp_path / "m.wav", mixed, 48000)
    found = audio.probe_wav(recording_inventory(spark, [str(tmp_path)]))
    row = audio.decode_segments(segment_grid(found, 1.0, model_rate=16000), 16000, 16000).first()
    samples = np.array(row["samples"])
    assert len(samples) == 16000 and abs(loudest(samples, 16000) - 1000) < 2
    assert abs(np.abs(samples).max() - 0.5) < 0.02
    same = tone(8000, 1, 500)
    assert audio.resample(same, 8000, 8000) is same
    up = audio.resample(same, 8000, 12000)
    assert len(up) == 12000 and abs(loudest(up, 12000) - 500) < 2


def test_resample_segments(spark):
    df = spark.createDataFrame([("f", 0, 0.0, 1.0, tone(8000, 1, 440).tolist())], "file string, seg_idx bigint, start_s float, end_s float, samples array<float>")
    row = audio.resample_segments(df, 8000, 4000, 4100).first()
    assert len(row["samples"]) == 4100 and np.allclose(row["samples"][4000:], 0)


def test_recordings_to_detections(spark, tmp_path):
    def band_model():
        """Share of energy below and above a quarter of the rate."""

        def score(batch):
            power = np.abs(np.fft.rfft(batch, axis=1)) ** 2
            cut = power.shape[1] // 2
            low = power[:, :cut].sum(axis=1)
            high = power[:, cut:].sum(axis=1)
            return np.stack([low, high], axis=1) / power.sum(axis=1, keepdims=True)

        return score

    pcm16(tmp_path / "low.wav", tone(8000, 3, 300), 8000)
    pcm16(tmp_path / "high.wav", tone(8000, 3, 3500), 8000)
    found = audio.probe_wav(recording_inventory(spark, [str(tmp_path)]))
    segments = audio.decode_segments(segment_grid(found, 1.0), 8000, 8000)
    pred = score_segments(segments, band_model, ["Bubo bubo_Low", "Regulus regulus_High"], batch_size=2)
    det = analyze(pred, AnalysisSettings(min_confidence=0.5, model="bands"))
    got = {(r["file"].rsplit("/", 1)[1], r["common_name"]) for r in det.collect()}
    assert got == {("low.wav", "Low"), ("high.wav", "High")} and det.count() == 6
    assert {r["model"] for r in det.collect()} == {"bands"}
    with pytest.raises(ValueError):
        score_segments(segments, band_model, ["a"], batch_size=513)


def test_clips_from_results_to_files(spark, tmp_path):
    pcm16(tmp_path / "r.wav", tone(8000, 20, 440), 8000)
    file = f"{tmp_path}/r.BirdNET.results.csv"
    other = f"{tmp_path}/gone.BirdNET.results.csv"
    rows = [(file, 2.0, 5.0, "Parus major", "Great Tit", 0.85), (file, 4.0, 7.0, "Parus major", "Great Tit", 0.9), (file, 18.0, 21.0, "Tyto/alba", "Owl", 0.5), (file, 500.0, 503.0, "Far", "Far", 0.5), (other, 0.0, 3.0, "Gone", "Gone", 0.5)]
    parsed = spark.createDataFrame(rows, PARSED.simpleString()[7:-1].replace(":", " "))
    inventory = spark.createDataFrame([(f"{tmp_path}/r.wav",)], "file string")
    planned = plan_clips(parsed, inventory, 0.1, 1.0, 1.0, layout="shared")
    out = tmp_path / "clips"
    manifest = {r["clip_path"]: r for r in audio.write_clips(planned, str(out)).collect()}
    assert manifest["Parus major/Parus major_90p_1.0-8.0.wav"]["frames"] == 7 * 8000
    assert manifest["Tyto_alba/Tyto_alba_50p_17.0-22.0.wav"]["frames"] == 3 * 8000
    assert manifest["Far/Far_50p_499.0-504.0.wav"]["error"] == "no audio in the range"
    assert manifest["Gone/Gone_50p_0.0-4.0.wav"]["error"] == "source audio not found"
    with wave.open(str(out / "Parus major" / "Parus major_90p_1.0-8.0.wav")) as clip:
        assert (clip.getframerate(), clip.getnchannels(), clip.getsampwidth(), clip.getnframes()) == (8000, 1, 2, 56000)
        cut = np.frombuffer(clip.readframes(56000), "<i2") / 32767
    assert np.allclose(cut, tone(8000, 20, 440)[8000:64000], atol=1e-3)
    assert not [f for f in (out / "_drafts").iterdir()]
    summary = summaries.clip_batch_summary(audio.write_clips(planned.withColumn("batch", F.lit("b")), f"file://{tmp_path}/again"))
    assert tuple(summary.first()) == ("b", 2, 1, 1, False)
    tree = [sorted(str(f.relative_to(top)) for f in top.rglob("*.wav")) for top in (out, tmp_path / "again")]
    assert tree[0] == tree[1]
    again = audio.write_clips(planned, str(out)).filter("error is null").count()
    assert again == 2 and len(list(out.rglob("*.wav"))) == 2


def test_extracted_blocks_join_up(spark, tmp_path):
    pcm16(tmp_path / "r.wav", tone(8000, 10, 440), 8000)
    clips = spark.createDataFrame([(f"{tmp_path}/r.wav", "a", 1.0, 9.5), (f"{tmp_path}/r.wav", "b", 30.0, 31.0)], "audio_path string, clip_path string, start double, end double")
    got = audio.extract_clips(clips, block_s=2.0).orderBy("clip_path", "block").collect()
    blocks = [r for r in got if r["clip_path"] == "a"]
    assert [len(b["samples"]) for b in blocks] == [16000] * 4 + [4000]
    joined = np.concatenate([b["samples"] for b in blocks])
    assert np.allclose(joined, tone(8000, 10, 440)[8000:76000], atol=1e-3)
    assert [r["error"] for r in got if r["clip_path"] == "b"] == ["no audio in the range"]


def test_clip_folders(spark):
    assert audio.mounted_folder("file:///a%20b/c") == "/a b/c" and audio.mounted_folder("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="nosuch"):
        audio.write_clips(spark.range(0), "nosuch://bucket/out")


def test_a_store_that_breaks_off_leaves_nothing(spark, tmp_path):
    pcm16(tmp_path / "r.wav", tone(8000, 20, 440), 8000)
    rows = [(f"{tmp_path}/r.wav", f"{n}.wav", 0.0, float(n)) for n in (1, 2, 19)]
    clips = spark.createDataFrame(rows, "audio_path string, clip_path string, start double, end double")

    def breaking(address):
        from pyarrow import fs

        class Stream:
            def __init__(self, out):
                self.out, self.left = out, 50_000

            def write(self, data):
                self.left -= len(data)
                if self.left < 0:
                    raise OSError("no space left")
                return self.out.write(data)

            def close(self):
                self.out.close()

        class Full:
            """A file system that has no room for long files."""

            def __init__(self):
                self.inner = fs.LocalFileSystem()

            def __getattr__(self, name):
                return getattr(self.inner, name)

            def open_output_stream(self, path):
                return Stream(self.inner.open_output_stream(path))

        return Full(), address

    done = {r["clip_path"]: (r["outcome"], r["error"]) for r in audio.write_clips(clips, str(tmp_path / "out"), breaking).collect()}
    assert done == {"1.wav": ("written", None), "2.wav": ("written", None), "19.wav": ("clip_failed", "no space left")}
    assert sorted(f.name for f in (tmp_path / "out").rglob("*") if f.is_file()) == ["1.wav", "2.wav"]


def test_recordings_never_share_clip_paths(spark):
    rows = [(f"/{d}/r.BirdNET.results.csv", 2.0, 5.0, "a", "A", 0.5) for d in ("x", "y")]
    parsed = spark.createDataFrame(rows, PARSED.simpleString()[7:-1].replace(":", " "))
    inventory = spark.createDataFrame([("/x/r.wav",), ("/y/r.wav",)], "file string")
    paths = rows_of(plan_clips(parsed, inventory), "clip_path")
    assert len(set(paths)) == 2
    assert plan_clips(parsed, inventory).filter(F.col("audio_path").isNull()).count() == 0
