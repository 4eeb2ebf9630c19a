"""From result tables to a clip plan, and from there to audio files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.paths import clip_path, join_path, safe_name, stem
from dawnchorus.operators.intervals import merge_detections
from dawnchorus.operators.quality import finite_rows, min_confidence, valid_ranges
from dawnchorus.operators.work import resolve_audio


def clean_detections(parsed: DataFrame, threshold: float = K.DEFAULT_CLIP_CONFIDENCE) -> DataFrame:
    """Parsed rows fit for merging: finite, from well-formed files, confident enough."""
    good, _ = finite_rows(valid_ranges(parsed))
    return min_confidence(good, threshold)


def plan_clips(
    parsed: DataFrame,
    inventory: DataFrame,
    threshold: float = K.DEFAULT_CLIP_CONFIDENCE,
    pre: float = K.DEFAULT_PADDING_S,
    post: float = K.DEFAULT_PADDING_S,
    explicit: str | None = None,
    folder: str | None = None,
    layout: str = "recording",
) -> DataFrame:
    """Clips of each result file with the audio to cut from and the path to write to.

    Layout ``recording`` puts the clips of each result file below a folder of their own, so
    equal species, confidences and times in two recordings never share a path; ``shared``
    puts the species folders side by side, for jobs over one result file.
    """
    if layout not in ("recording", "shared"):
        raise ValueError(f"unknown layout {layout!r}")
    clips = merge_detections(clean_detections(parsed, threshold), pre, post)
    names = [c for c in ("file", explicit, folder) if c]
    files = parsed.select(*names).distinct()
    audio = resolve_audio(files, inventory, explicit, folder)
    target = clip_path(
        F.col("scientific_name"), F.col("max_confidence"), F.col("start"), F.col("end")
    )
    if layout == "recording":
        own = F.concat(safe_name(stem(F.col("file"))), F.lit("-"), F.substring(F.md5("file"), 1, 12))
        target = join_path(own, target)
    return clips.join(audio, "file", "left").withColumn("clip_path", target)
