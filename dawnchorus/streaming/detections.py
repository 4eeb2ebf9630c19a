"""Detection streams: filtering, clip merging and incremental intake of recordings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dawnchorus import constants as K
from dawnchorus.operators.quality import min_confidence
from dawnchorus.operators.species import filter_species_list, range_filter
from dawnchorus.operators.work import pending_recordings
from dawnchorus.session import checkpoint_root
from dawnchorus.sources.inventory import audio_files


def stream_detections(
    pred: DataFrame,
    threshold: float = K.DEFAULT_MIN_CONFIDENCE,
    projected: DataFrame | None = None,
    species: DataFrame | None = None,
    range_threshold: float = K.DEFAULT_RANGE_THRESHOLD,
    policy: str = "keep",
    rerank: bool = False,
) -> DataFrame:
    """Confidence plus range or list filter on a stream of predictions.

    The static side is joined exactly as in batch; range filtering takes precedence.
    """
    kept = min_confidence(pred, threshold)
    if projected is not None:
        kept = range_filter(kept, projected, range_threshold, policy, rerank)
    elif species is not None:
        kept = filter_species_list(kept, species)
    return min_confidence(kept, threshold)


def stream_merge_clips(
    det: DataFrame,
    pre: float = K.DEFAULT_PADDING_S,
    post: float = K.DEFAULT_PADDING_S,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Clip merging over unbounded input, as session windows per recording and species.

    Needs ``recorded_at`` (start of the recording) beside the detection columns. Each row opens
    a session as long as its padded range, so sessions merge exactly when padded ranges overlap
    or touch; merging starts inside each task, before the shuffle. Rows later than the watermark
    drop out. The start is clamped after merging, which cannot change what merges. The common
    name is that of the clip's earliest detection: the recording's may still be to come.
    """
    opens = F.timestamp_micros(
        F.unix_micros("recorded_at") + F.round((F.col("start") - pre) * 1e6).cast("bigint")
    )
    length = F.round((F.col("end") - F.col("start") + (pre + post)) * 1e6).cast("bigint")
    gap = F.concat(length.cast("string"), F.lit(" microseconds"))
    sessions = (
        det.withColumn("_opens", opens)
        .withColumn("_gap", gap)
        .withWatermark("_opens", watermark)
        .groupBy("file", "scientific_name", "recorded_at", F.session_window("_opens", F.col("_gap")))
        .agg(
            F.min(F.struct("start", "common_name"))["common_name"].alias("common_name"),
            F.min("start").alias("_first"),
            F.max("end").alias("_last"),
            F.max("confidence").alias("max_confidence"),
            F.count(F.lit(1)).alias("detection_count"),
        )
    )
    return sessions.select(
        "file",
        "scientific_name",
        "common_name",
        F.greatest(F.lit(0.0), F.col("_first") - pre).alias("start"),
        (F.col("_last") + post).alias("end"),
        "max_confidence",
        "detection_count",
    )


_LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def stream_pending(
    spark: SparkSession,
    root: str,
    outputs: Callable[[], DataFrame],
    formats: Sequence[str],
    handle: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    max_files: int = 10_000,
) -> StreamingQuery:
    """Hand newly arrived recordings that still lack an output to ``handle``, per trigger.

    ``outputs`` is called each time, so results written meanwhile count. The checkpoint is a
    shared folder (by default below the session's), so a restarted job goes on where it stopped.
    """
    if checkpoint is None:
        checkpoint = f"{checkpoint_root(spark)}/pending-{hashlib.sha1(root.encode()).hexdigest()}"
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(_LISTING)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )

    def process(batch: DataFrame, epoch: int) -> None:
        handle(pending_recordings(batch, outputs(), formats), epoch)

    return (
        audio_files(arrivals)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
