"""Durations, segment estimates and throughput."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS, fractions cut off, hours running past 24."""
    total = F.floor(F.abs(seconds)).cast("bigint")

    def two_digits(value: Column) -> Column:
        text = value.cast("bigint").cast("string")
        return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)

    parts = [F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60]
    return F.concat_ws(":", *[two_digits(p) for p in parts])


def estimated_segments(duration: Column, segment: Column, overlap: Column) -> Column:
    """Segments expected from a duration; null when unknown or when the step is not positive."""
    step = segment.cast("float") - overlap.cast("float")
    return F.when(step > 0, F.ceil(duration / step.cast("double")).cast("bigint"))


def estimated_duration(
    hint: Column, segments: Column, segment: Column, overlap: Column
) -> Column:
    """Known duration, else what ``segments`` cover together, else 0."""
    step = segment.cast("double") - overlap.cast("double")
    covered = (segments - 1) * step + segment.cast("double")
    return F.coalesce(hint.cast("double"), F.when(segments > 0, covered), F.lit(0.0))


def segments_per_second(segments: Column, wall_s: Column) -> Column:
    usable = (wall_s > 0) & (segments > 0)
    return F.coalesce(F.when(usable, segments / F.nullif(wall_s, F.lit(0.0))), F.lit(0.0))


def realtime_factor(audio_s: Column, wall_s: Column) -> Column:
    usable = (wall_s > 0) & (audio_s > 0)
    return F.coalesce(F.when(usable, audio_s / F.nullif(wall_s, F.lit(0.0))), F.lit(0.0))
