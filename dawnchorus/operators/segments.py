"""Cutting recordings into segments, as closed-form row generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K

# Segments generated from one intermediate row; long recordings become many such rows.
SEGMENTS_PER_BLOCK = 4096


def _numbered_segments(df: DataFrame, count: Column) -> DataFrame:
    """Repeat each row for seg_idx 0 .. count-1, spreading long recordings over tasks."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = F.lit(SEGMENTS_PER_BLOCK)
    blocks = (
        df.withColumn("_count", count)
        .filter("_count > 0")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / per))))
        .repartition(spread, "file", "_block")
    )
    first = F.col("_block") * per
    last = F.least(F.col("_count"), first + per) - 1
    return blocks.withColumn("seg_idx", F.explode(F.sequence(first, last))).drop(
        "_count", "_block"
    )


def _samples(seconds: float, rate: Column) -> Column:
    """Whole samples in a duration, computed in single precision and cut off."""
    return (F.lit(float(seconds)).cast("float") * rate.cast("float")).cast("bigint")


def _at_source(samples: Column, source: Column, target: Column) -> Column:
    scaled = F.ceil(samples.cast("double") * source / target).cast("bigint")
    return F.when(source == target, samples).otherwise(scaled)


def _grid(rows: DataFrame, segment_length: Column) -> DataFrame:
    """Rows carry _size and _keep (samples per segment and shared with the next)."""
    frames, size, keep = F.col("frames"), F.col("_size"), F.col("_keep")
    rows = rows.withColumn("_step", size - keep)
    step = F.col("_step")
    full = F.when(frames >= size, F.floor((frames - size) / step) + 1).otherwise(F.lit(0))
    rows = rows.withColumn("_full", full.cast("bigint"))
    rest = frames - F.col("_full") * step
    # What is left after the full segments: longer than the overlap, it makes a padded
    # segment and, with overlap, one more holding only the overlap; shorter, just one.
    tails = F.when(rest > keep, F.when(keep > 0, 2).otherwise(1)).when(rest > 0, 1).otherwise(0)
    numbered = _numbered_segments(rows, F.col("_full") + tails)
    start = F.when(F.col("seg_idx") > F.col("_full"), frames - keep).otherwise(
        F.col("seg_idx") * step
    )
    start_s = (F.col("start_sample").cast("float") / F.col("sample_rate").cast("float")).cast(
        "float"
    )
    return (
        numbered.withColumn("start_sample", start)
        .withColumn("start_s", start_s)
        .withColumn("end_s", F.col("start_s") + segment_length)
        .withColumn("real_samples", F.least(size, frames - F.col("start_sample")))
        .withColumnRenamed("_size", "segment_samples")
        .drop("_keep", "_step", "_full")
    )


def with_frames(recordings: DataFrame) -> DataFrame:
    """Add the frame count from the duration where the header gave none."""
    if "frames" in recordings.columns:
        return recordings
    frames = (F.col("duration_s") * F.col("sample_rate")).cast("bigint")
    return recordings.withColumn("frames", frames)


def segment_grid(
    recordings: DataFrame,
    segment_s: float,
    overlap_s: float = K.DEFAULT_OVERLAP_S,
    model_rate: int | None = None,
) -> DataFrame:
    """Segments of every recording as the analysis cuts them.

    Needs (file, sample_rate, frames or duration_s). Segment and overlap are whole samples at
    the model's rate, rescaled (rounding up) when the recording's rate differs. The last
    segment is zero-padded; with overlap one more segment holds just the final overlap.
    """
    if not 0 <= overlap_s < segment_s:
        raise ValueError("overlap must be smaller than the segment")
    source = F.col("sample_rate")
    target = source if model_rate is None else F.lit(model_rate)
    size, keep = _samples(segment_s, target), _samples(overlap_s, target)
    rows = (
        with_frames(recordings)
        .select("file", "sample_rate", "frames")
        .withColumn("_size", _at_source(size, source, target))
        .withColumn("_keep", _at_source(keep, source, target))
    )
    length = (_samples(segment_s, target).cast("float") / target.cast("float")).cast("float")
    return _grid(rows, length)


def chunk_grid(recordings: DataFrame, segment_s: float, overlap_s: float = 0.0) -> DataFrame:
    """Plain chunking: starts every (segment - overlap), no rows when that is not positive."""
    rate = F.col("sample_rate")
    rows = (
        with_frames(recordings)
        .select("file", "sample_rate", "frames")
        .withColumn("segment_samples", _samples(segment_s, rate))
        .withColumn("_step", F.col("segment_samples") - _samples(overlap_s, rate))
    )
    step = F.when(F.col("_step") > 0, F.col("_step"))
    numbered = _numbered_segments(rows, F.ceil(F.col("frames") / step).cast("bigint"))
    start = F.col("seg_idx") * F.col("_step")
    start_s = (start.cast("float") / rate.cast("float")).cast("float")
    return (
        numbered.withColumn("start_sample", start)
        .withColumn("start_s", start_s)
        .withColumn("end_s", F.col("start_s") + F.lit(float(segment_s)).cast("float"))
        .drop("_step")
    )


def bat_segment_grid(recordings: DataFrame) -> DataFrame:
    """Ultrasonic segments: fixed sample counts at the recording's own rate.

    ``rate_warning`` marks recordings not made at the expected rate.
    """
    rows = (
        with_frames(recordings)
        .select("file", "sample_rate", "frames")
        .withColumn("_size", F.lit(K.BAT_SEGMENT_SAMPLES).cast("bigint"))
        .withColumn("_keep", F.lit(K.BAT_OVERLAP_SAMPLES).cast("bigint"))
    )
    length = (
        F.lit(K.BAT_SEGMENT_SAMPLES).cast("float") / F.col("sample_rate").cast("float")
    ).cast("float")
    return _grid(rows, length).withColumn(
        "rate_warning", F.col("sample_rate") != K.BAT_SAMPLE_RATE
    )
