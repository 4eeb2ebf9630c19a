"""Audio jobs over PCM WAV files: probing, decoding by byte range, cutting clips.

Spark partitions the work (one row per segment or clip); inside a task numpy turns byte
ranges into samples. Files are reached through pyarrow file systems, so local and object
storage paths work alike, and no file is ever read whole.
"""

from __future__ import annotations

import struct
import sys
import urllib.parse
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions.paths import clip_path
from dawnchorus.storage import Store, draft, open_store, publish

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Frames read from a file at a time when a clip is cut.
_CHUNK_FRAMES = 1 << 20
# Bytes of samples that a task hands on at a time.
_BATCH_BYTES = 32 << 20
# Rows that it hands on at a time, where they are short.
_BATCH_ROWS = 10_000


@dataclass(frozen=True)
class WavFormat:
    sample_rate: int
    channels: int
    kind: str
    data_offset: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * np.dtype(self.kind).itemsize


_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE
_KINDS = {(_PCM, 16): "<i2", (_PCM, 32): "<i4", (_FLOAT, 32): "<f4"}
_SCALE = {"<i2": 32768.0, "<i4": 2147483648.0, "<f4": 1.0}


def open_audio(path: str):
    """Random-access handle for a local path or a file-system URI."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file" or "://" not in path:
        local = "/" + rest.lstrip("/") if scheme == "file" and colon else path
        return pafs.LocalFileSystem().open_input_file(local)
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_header(handle) -> WavFormat:
    """Format of a WAV file from its chunk headers only."""
    size = handle.size()
    riff = handle.read_at(12, 0)
    if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", handle.read_at(8, at))
        if name == b"fmt ":
            body = handle.read_at(min(length, 40), at + 8)
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if tag == _EXTENSIBLE and len(body) >= 26:
                tag = struct.unpack("<H", body[24:26])[0]
            if (tag, bits) not in _KINDS or channels == 0 or rate == 0:
                raise ValueError(f"unsupported WAV format: tag {tag}, {bits} bits")
            layout = (rate, channels, _KINDS[tag, bits])
        elif name == b"data":
            if layout is None:
                raise ValueError("WAV data before its format")
            usable = min(length, size - at - 8)
            rate, channels, kind = layout
            frames = usable // (channels * np.dtype(kind).itemsize)
            return WavFormat(rate, channels, kind, at + 8, frames)
        at += 8 + length + (length & 1)
    raise ValueError("WAV file without data")


def read_mono(handle, wav: WavFormat, start: int, count: int) -> np.ndarray:
    """Mono samples in [-1, 1] of frames start .. start+count, cut at the end of the file."""
    count = max(0, min(count, wav.frames - start))
    raw = handle.read_at(count * wav.frame_bytes, wav.data_offset + start * wav.frame_bytes)
    values = np.frombuffer(raw, dtype=wav.kind).astype(np.float32) / np.float32(_SCALE[wav.kind])
    if wav.channels == 1:
        return values
    frames = values.reshape(-1, wav.channels)
    return (frames.sum(axis=1, dtype=np.float32) / np.float32(wav.channels)).astype(np.float32)


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Band-limited resampling of one segment by cutting or padding its spectrum."""
    if source == target or len(samples) == 0:
        return samples
    length = -(-len(samples) * target // source)
    spectrum = np.fft.rfft(samples.astype(np.float64))
    bins = min(len(spectrum), length // 2 + 1)
    out = np.zeros(length // 2 + 1, dtype=complex)
    out[:bins] = spectrum[:bins]
    return (np.fft.irfft(out, length) * (length / len(samples))).astype(np.float32)


def fit_length(samples: np.ndarray, length: int) -> np.ndarray:
    """Exactly ``length`` samples: cut or zero-padded."""
    if len(samples) >= length:
        return samples[:length]
    return np.pad(samples, (0, length - len(samples)))


class _OpenFile:
    """The file a task is working on; consecutive rows of one file share the handle."""

    def __init__(self):
        self._path = None

    def get(self, path: str):
        if path != self._path:
            self.close()
            self._handle = open_audio(path)
            self._path = path
            self._wav = read_header(self._handle)
        return self._handle, self._wav

    def close(self):
        if self._path is not None:
            self._handle.close()
            self._path = None


def probe_wav(inventory: DataFrame) -> DataFrame:
    """Add sample_rate, channels, frames and duration_s from file headers.

    An unreadable file keeps its row, with the reason in ``error``.
    """
    schema = (
        "file string, length bigint, modified timestamp, sample_rate int, channels int, "
        "frames bigint, duration_s double, error string"
    )

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for path in rows["file"]:
                try:
                    with open_audio(path) as handle:
                        w = read_header(handle)
                    found.append((w.sample_rate, w.channels, w.frames, w.frames / w.sample_rate, None))
                except (OSError, ValueError, struct.error) as error:
                    found.append((None, None, None, None, str(error)))
            names = ["sample_rate", "channels", "frames", "duration_s", "error"]
            added = pd.DataFrame(found, columns=names, index=rows.index)
            ints = added[names[:3]].astype("Int64")
            yield pd.concat([rows, ints, added[names[3:]]], axis=1)

    return inventory.select("file", "length", "modified").mapInPandas(probe, schema)


def decode_segments(grid: DataFrame, model_samples: int, model_rate: int) -> DataFrame:
    """Samples of every segment at the model's rate, zero-padded to ``model_samples``.

    The grid comes first, so a long recording is read by many tasks, each seeking to its own
    byte ranges. A segment of an unreadable file has null samples and the reason in ``error``;
    other files go on. Tasks hand on at most ``_BATCH_BYTES`` of samples at a time.
    """
    schema = (
        "file string, seg_idx bigint, start_s float, end_s float, samples array<float>, error string"
    )
    at_once = max(1, _BATCH_BYTES // (4 * max(1, model_samples)))

    def samples_of(current: _OpenFile, path: str, start: int, size: int):
        try:
            handle, wav = current.get(path)
            part = fit_length(read_mono(handle, wav, start, size), size)
        except (OSError, ValueError, struct.error) as error:
            current.close()
            return None, str(error)
        return fit_length(resample(part, wav.sample_rate, model_rate), model_samples), None

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = _OpenFile()
        for batch in batches:
            for first in range(0, len(batch), at_once):
                rows = batch.iloc[first : first + at_once]
                places = zip(rows["file"], rows["start_sample"], rows["segment_samples"])
                found = [samples_of(current, path, int(start), int(size)) for path, start, size in places]
                samples, errors = zip(*found)
                yield rows[["file", "seg_idx", "start_s", "end_s"]].assign(
                    samples=pd.Series(samples, index=rows.index, dtype=object),
                    error=pd.Series(errors, index=rows.index, dtype=object),
                )
        current.close()

    columns = ["file", "seg_idx", "start_s", "end_s", "start_sample", "segment_samples"]
    return grid.select(*columns).mapInPandas(decode, schema)


def resample_segments(segments: DataFrame, source: int, target: int, length: int) -> DataFrame:
    """Resample decoded segments, then fit them to an exact length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            resized = [
                fit_length(resample(np.asarray(s, dtype=np.float32), source, target), length)
                for s in rows["samples"]
            ]
            yield rows.assign(samples=resized)

    return segments.mapInPandas(run, segments.schema)


def _clip_frames(rate: int, start: float, end: float) -> tuple[int, int]:
    return int(start * rate), int(end * rate)


def extract_clips(clips: DataFrame, block_s: float = 60.0) -> DataFrame:
    """Mono samples of planned clips, in blocks of at most ``block_s`` seconds.

    Needs (audio_path, clip_path, start, end). Blocks keep a clip of any length within row
    limits. A clip that yields no audio gives one row with the reason in ``error``, and one whose
    reading breaks off a row behind its last block; other clips go on.
    """
    schema = (
        "clip_path string, block int, sample_rate int, samples array<float>, error string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = _OpenFile()
        held, size = [], 0
        for rows in batches:
            for row in rows.itertuples(index=False):
                for block, rate, samples, error in _clip_blocks(current, row, block_s):
                    held.append((row.clip_path, block, rate, samples, error))
                    size += 0 if samples is None else samples.nbytes
                    if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
                        yield _block_rows(held)
                        held, size = [], 0
        if held:
            yield _block_rows(held)
        current.close()

    return _spread(clips).mapInPandas(run, schema)


def _block_rows(held: list[tuple]) -> pd.DataFrame:
    paths, blocks, rates, samples, errors = zip(*held)
    return pd.DataFrame(
        {
            "clip_path": pd.Series(paths, dtype=object),
            "block": blocks,
            "sample_rate": pd.array(rates, dtype="Int64"),
            "samples": pd.Series(samples, dtype=object),
            "error": pd.Series(errors, dtype=object),
        }
    )


def _spread(clips: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One task handles neighbouring clips of a file; a file with many clips is split."""
    columns = ["audio_path", "clip_path", "start", "end", *carry]
    return (
        clips.select(*columns)
        .repartitionByRange("audio_path", "start", "clip_path")
        .sortWithinPartitions("audio_path", "start")
    )


def _clip_blocks(current: _OpenFile, row, block_s: float):
    done = 0
    try:
        if not (0 <= row.start < row.end < float("inf")):
            raise ValueError("invalid time range")
        if row.audio_path is None:
            raise FileNotFoundError("source audio not found")
        handle, wav = current.get(row.audio_path)
        first, last = _clip_frames(wav.sample_rate, row.start, row.end)
        last = min(last, wav.frames)
        if last <= first:
            raise ValueError("no audio in the range")
        step = max(1, int(block_s * wav.sample_rate))
        for block, at in enumerate(range(first, last, step)):
            yield block, wav.sample_rate, read_mono(handle, wav, at, min(step, last - at)), None
            done = block + 1
    except (OSError, ValueError, struct.error) as error:
        current.close()
        yield done, None, None, str(error)


def to_pcm16(samples: np.ndarray) -> bytes:
    return (np.clip(samples, -1.0, 1.0) * 32767.0).astype("<i2").tobytes()


def wav_header(rate: int, frames: int) -> bytes:
    """Header of a mono 16-bit PCM file."""
    data = frames * 2
    layout = struct.pack("<IHHIIHH", 16, _PCM, 1, rate, rate * 2, 2, 16)
    size = struct.pack("<I", 36 + data)
    return b"RIFF" + size + b"WAVEfmt " + layout + b"data" + struct.pack("<I", data)


def _write_one(current: _OpenFile, row, folder: str, drafts: str, store: Store) -> int:
    if not (0 <= row.start < row.end < float("inf")):
        raise ValueError("invalid time range")
    if row.audio_path is None:
        raise FileNotFoundError("source audio not found")
    handle, wav = current.get(row.audio_path)
    first, last = _clip_frames(wav.sample_rate, row.start, row.end)
    last = min(last, wav.frames)
    if last <= first:
        raise ValueError("no audio in the range")
    system, top = store(folder)
    with draft(system, f"{top}/{drafts}") as (out, name):
        out.write(wav_header(wav.sample_rate, last - first))
        for at in range(first, last, _CHUNK_FRAMES):
            out.write(to_pcm16(read_mono(handle, wav, at, min(_CHUNK_FRAMES, last - at))))
    publish(system, name, f"{top}/{row.clip_path}")
    return last - first


def mounted_folder(folder: str) -> str:
    """The path of a folder that every executor has mounted; other stores are refused."""
    parts = urllib.parse.urlsplit(folder)
    if parts.scheme == "file" and parts.netloc in ("", "localhost"):
        return urllib.parse.unquote(parts.path)
    if parts.scheme:
        raise ValueError(f"clips are written to mounted folders, not to {parts.scheme}: stores")
    return folder


def write_clips(clips: DataFrame, folder: str, store: Store = open_store) -> DataFrame:
    """Write planned clips as mono 16-bit WAV below a shared folder; returns a manifest.

    ``folder`` is a mounted path or an address that ``store`` opens (pyarrow file systems by default).

    Each clip is streamed from its byte range into a draft that takes its name when complete, so a
    repeated task leaves the same file and a lost one leaves no partial clip; on object stores, which show a file when its
    upload ends, that is a copy within the store. Drafts lie in the hidden folder ``_drafts``.

    The manifest has clip_path, frames, ``outcome`` (written or clip_failed, as ``clip_batch_summary`` takes it) and error, behind those of
    file, scientific_name, common_name and batch that the clips have.
    """
    store(folder)
    carry = [c for c in ("batch", "file", "scientific_name", "common_name") if c in clips.columns]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in clips.select(*carry).schema.fields]
    schema = ", ".join([*kept, "clip_path string, frames bigint, outcome string, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = _OpenFile()
        for rows in batches:
            done = []
            for row in rows.itertuples(index=False):
                try:
                    frames = _write_one(current, row, folder, "_drafts", store)
                    done.append((row.clip_path, frames, "written", None))
                except (OSError, ValueError, struct.error) as error:
                    done.append((row.clip_path, 0, "clip_failed", str(error)))
            made = pd.DataFrame(done, columns=["clip_path", "frames", "outcome", "error"])
            yield pd.concat([rows[carry].reset_index(drop=True), made], axis=1)
        current.close()

    return _spread(clips, carry).mapInPandas(run, schema)


def planned(clips: DataFrame, audio: str = "file") -> DataFrame:
    """Clips whose audio path is already in a column, with their target path added."""
    target = clip_path(
        F.col("scientific_name"), F.col("max_confidence"), F.col("start"), F.col("end")
    )
    return clips.withColumn("audio_path", F.col(audio)).withColumn("clip_path", target)
