"""Checks of the audio jobs and of finished outputs: each vector of the check tables is one short recording."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions.paths import base_name, output_suffix
from dawnchorus.operators import summaries, work
from dawnchorus.sources import audio
from dawnchorus.sources.inventory import recording_inventory
from dawnchorus.streaming import detections as live
from dawnchorus.testbed.registry import check
from dawnchorus.testbed.tables import Tables

RATE = 16
_NAME = "'vec_' || vec_id || '.wav'"
_FRAMES = "coalesce(len(embedding), 0)"


def recordings(t: Tables) -> str:
    """A shared folder with one mono float WAV per vector; files appear by rename."""
    folder = audio.mounted_folder(t.scratch())
    rate = RATE

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for rows in batches:
            for key, values in zip(rows["vec_id"], rows["embedding"]):
                body = b"" if values is None else values.astype("<f4").tobytes()
                layout = struct.pack("<IHHIIHH", 16, 3, 1, rate, rate * 4, 4, 32)
                size, data = struct.pack("<I", 36 + len(body)), struct.pack("<I", len(body))
                target = f"{folder}/vec_{key}.wav"
                draft = f"{target}.{uuid.uuid4().hex}.tmp"
                with open(draft, "wb") as out:
                    out.write(b"RIFF" + size + b"WAVEfmt " + layout + b"data" + data + body)
                os.replace(draft, target)
            yield pd.DataFrame({"n": [len(rows)]})

    vectors = t.raw("embeddings").select("vec_id", "embedding")
    vectors.mapInPandas(write, "n bigint").agg(F.sum("n")).first()
    return folder


def _name():
    return base_name(F.col("file")).alias("name")


@check(
    "recording_inventory",
    f"SELECT {_NAME} AS name, (44 + 4 * {_FRAMES})::BIGINT AS length FROM embeddings",
)
def inventory(t: Tables) -> DataFrame:
    return recording_inventory(t.spark, [recordings(t)]).select(_name(), "length")


@check(
    "probe_wav",
    f"""SELECT {_NAME} AS name, {RATE} AS sample_rate, 1 AS channels, {_FRAMES}::BIGINT AS frames,
               {_FRAMES} / {RATE}::DOUBLE AS duration_s FROM embeddings""",
)
def probe_wav(t: Tables) -> DataFrame:
    probed = audio.probe_wav(recording_inventory(t.spark, [recordings(t)]))
    return probed.select(_name(), "sample_rate", "channels", "frames", "duration_s")


@check(
    "decode_segments",
    f"""SELECT name, seg_idx, list_max(s)::DOUBLE AS highest, list_min(s)::DOUBLE AS lowest, s[1]::DOUBLE AS first
        FROM (SELECT {_NAME} AS name, i AS seg_idx, embedding[i * {RATE} + 1 : (i + 1) * {RATE}] AS s
              FROM embeddings, unnest(range(0, {_FRAMES} // {RATE})) AS u(i))""",
)
def decode_segments(t: Tables) -> DataFrame:
    """Whole seconds of every recording."""
    probed = audio.probe_wav(recording_inventory(t.spark, [recordings(t)]))
    count = F.floor(F.col("frames") / RATE)
    grid = probed.withColumn("seg_idx", F.explode(F.sequence(F.lit(1).cast("bigint"), count, F.lit(1).cast("bigint"))))
    grid = grid.filter(count > 0).withColumn("seg_idx", F.col("seg_idx") - 1)
    grid = grid.select(
        "file",
        "seg_idx",
        F.col("seg_idx").cast("float").alias("start_s"),
        (F.col("seg_idx") + 1).cast("float").alias("end_s"),
        (F.col("seg_idx") * RATE).alias("start_sample"),
        F.lit(RATE).alias("segment_samples"),
    )
    found = audio.decode_segments(grid, RATE, RATE)
    return found.select(
        _name(),
        "seg_idx",
        F.array_max("samples").cast("double").alias("highest"),
        F.array_min("samples").cast("double").alias("lowest"),
        F.get("samples", F.lit(0)).cast("double").alias("first"),
    )


def _clips(t: Tables) -> DataFrame:
    """The second and third second of every recording."""
    found = recording_inventory(t.spark, [recordings(t)])
    return found.select(
        F.col("file").alias("audio_path"),
        base_name(F.col("file")).alias("clip_path"),
        F.lit(1.0).alias("start"),
        F.lit(3.0).alias("end"),
    )


_CLIP_FRAMES = f"greatest(0, least(3 * {RATE}, {_FRAMES}) - {RATE})"


@check(
    "extract_clips",
    f"""SELECT {_NAME} AS clip_path, {_CLIP_FRAMES} AS frames,
               list_max(embedding[{RATE} + 1 : 3 * {RATE}])::DOUBLE AS highest FROM embeddings""",
)
def extract_clips(t: Tables) -> DataFrame:
    """Clips in blocks of half a second, put together again by their counts and highest samples."""
    blocks = audio.extract_clips(_clips(t), block_s=0.5)
    return blocks.groupBy("clip_path").agg(
        F.sum(F.coalesce(F.size("samples"), F.lit(0))).alias("frames"),
        F.max(F.array_max("samples")).cast("double").alias("highest"),
    )


@check("write_clips", f"SELECT {_NAME} AS clip_path, {_CLIP_FRAMES}::BIGINT AS frames FROM embeddings")
def write_clips(t: Tables) -> DataFrame:
    return audio.write_clips(_clips(t), t.scratch()).select("clip_path", "frames")


@check(
    "clip_manifest_summary",
    f"""WITH cut AS (
          SELECT vec_id % 7 AS batch, vec_id % 5 = 0 OR {_CLIP_FRAMES} = 0 AS failed FROM embeddings)
        SELECT batch, CAST(count(*) FILTER (WHERE NOT failed) AS BIGINT) AS total_clips, count(*) FILTER (WHERE NOT failed) AS total_files,
               count(*) FILTER (WHERE failed) AS failed_files, bool_and(failed) AS batch_failed
        FROM cut GROUP BY batch""",
)
def clip_manifest_summary(t: Tables) -> DataFrame:
    """Clips written, one per recording, every fifth of them beyond its recording's end, and their batches summed up."""
    number = F.regexp_extract("clip_path", r"(\d+)", 1).cast("bigint")
    clips = _clips(t).withColumns({"batch": number % 7, "file": F.col("clip_path")})
    clips = clips.withColumns(
        {"start": F.when(number % 5 == 0, 1e6).otherwise(F.col("start")), "end": F.when(number % 5 == 0, 2e6).otherwise(F.col("end"))}
    )
    return summaries.clip_batch_summary(audio.write_clips(clips, t.scratch()))


@check("stream_pending", f"SELECT {_NAME} AS name FROM embeddings WHERE label IS NULL OR label % 2 = 0")
def stream_pending(t: Tables) -> DataFrame:
    """Recordings that arrive as files, less those of odd labels, whose outputs exist."""
    folder, out = recordings(t), t.scratch()

    def outputs() -> DataFrame:
        file = F.concat(F.lit(f"file:{folder}/vec_"), F.col("vec_id").cast("string"), F.lit(".wav"))
        return t.raw("embeddings").filter("label % 2 = 1").select(file.alias("file"), F.lit("csv").alias("format"))

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.select("file").write.mode("overwrite").parquet(f"{out}/{epoch}")

    live.stream_pending(t.spark, folder, outputs, ["csv"], handle, t.scratch(), max_files=1000).awaitTermination()
    return t.spark.read.schema("file string").parquet(f"{out}/*").select(_name())


@check(
    "outputs_of",
    """SELECT 'in/ord_' || o_orderkey || '.wav' AS file FROM orders WHERE o_orderkey NOT IN (
           SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R')
           GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2)""",
)
def outputs_of(t: Tables) -> DataFrame:
    """Orders as recordings and returned lines as their result files: those not finished in both formats."""
    formats = ["csv", "json"]
    kind = F.when(F.col("l_returnflag") == "A", "csv").when(F.col("l_returnflag") == "R", "json").otherwise("raven")
    name = F.concat(F.lit("results/ord_"), F.col("l_orderkey").cast("string"), output_suffix(kind))
    listing = t.raw("lineitem").select(name.alias("path"))
    key = F.col("o_orderkey").cast("string")
    inventory = t.raw("orders").select(F.concat(F.lit("in/ord_"), key, F.lit(".wav")).alias("file"))
    done = work.outputs_of(listing, inventory, formats, "results")
    return work.pending_recordings(inventory, done, formats)
