"""Summaries of recordings, species, runs, clip batches and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.timing import realtime_factor, segments_per_second


def recording_summary(det: DataFrame, recordings: DataFrame) -> DataFrame:
    """Detections, distinct species and duration of every recording, also empty ones."""
    counts = det.groupBy("file").agg(
        F.count(F.lit(1)).alias("total_detections"),
        F.count_distinct("scientific_name").alias("unique_species"),
    )
    return recordings.select("file", "duration_s").join(counts, "file", "left").select(
        "file",
        F.coalesce("total_detections", F.lit(0)).alias("total_detections"),
        F.coalesce("unique_species", F.lit(0)).alias("unique_species"),
        F.col("duration_s").cast("float").alias("audio_duration_seconds"),
    )


def species_summary(
    det: DataFrame, window: str | None = None, sort: bool = True, at: str = "recorded_at"
) -> DataFrame:
    """Detections per species, most frequent first; optionally per tumbling time window."""
    keys = ["scientific_name"]
    if window is not None:
        det = det.withColumn("period_start", F.window(at, window)["start"])
        keys = ["period_start", *keys]
    summary = det.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detections"),
        F.max("confidence").alias("max_confidence"),
        F.avg(F.col("confidence").cast("double")).alias("mean_confidence"),
    )
    return summary.orderBy(F.col("detections").desc(), *keys) if sort else summary


def run_status(processed, failed):
    """success without failures, partial_success if something was processed, else failed."""
    return (
        F.when(failed == 0, F.lit("success"))
        .when(processed > 0, F.lit("partial_success"))
        .otherwise(F.lit("failed"))
    )


def status_counts(status):
    """Counters over file statuses; a lost lock counts as skipped."""
    return [
        F.count_if(status == "processed").alias("files_processed"),
        F.count_if(status == "failed").alias("files_failed"),
        F.count_if(status.isin("skipped", "locked")).alias("files_skipped"),
    ]


def run_summary(file_status: DataFrame) -> DataFrame:
    """Totals per run from one row per file.

    Needs (run, status, detections, segments, audio_s, wall_s); totals cover processed files.
    """
    done = F.col("status") == "processed"

    def total(column: str):
        return F.coalesce(F.sum(F.when(done, F.col(column))), F.lit(0))

    return (
        file_status.groupBy("run")
        .agg(
            *status_counts(F.col("status")),
            total("detections").alias("total_detections"),
            total("segments").alias("total_segments"),
            total("audio_s").cast("double").alias("audio_s"),
            F.coalesce(F.sum("wall_s"), F.lit(0)).cast("double").alias("wall_s"),
        )
        .withColumn("status", run_status(F.col("files_processed"), F.col("files_failed")))
        .withColumn(
            "segments_per_second", segments_per_second(F.col("total_segments"), F.col("wall_s"))
        )
        .withColumn("realtime_factor", realtime_factor(F.col("audio_s"), F.col("wall_s")))
    )


def clip_file_results(results: DataFrame) -> DataFrame:
    """Outcome of each detection file from one row per attempted clip.

    ``outcome`` is written, clip_failed, no_detections or file_failed. A file with clips to
    cut of which none was written has failed; a file without detections has not.
    """
    outcome = F.col("outcome")
    return (
        results.groupBy("batch", "file")
        .agg(
            F.count_if(outcome == "written").alias("clips"),
            F.count_if(outcome == "clip_failed").alias("_lost"),
            F.count_if(outcome == "file_failed").alias("_broken"),
        )
        .withColumn(
            "failed", (F.col("_broken") > 0) | ((F.col("_lost") > 0) & (F.col("clips") == 0))
        )
        .drop("_lost", "_broken")
    )


def clip_batch_summary(results: DataFrame) -> DataFrame:
    """Totals per batch; a batch fails only when nothing was processed and something failed."""
    failed = F.col("failed")
    return (
        clip_file_results(results)
        .groupBy("batch")
        .agg(
            F.sum(F.when(~failed, F.col("clips")).otherwise(0)).alias("total_clips"),
            F.count_if(~failed).alias("total_files"),
            F.count_if(failed).alias("failed_files"),
        )
        .withColumn("batch_failed", (F.col("total_files") == 0) & (F.col("failed_files") > 0))
    )


def rejected_report(
    rejected: DataFrame, line: str = "line", samples: int = K.REJECTED_SAMPLES_KEPT
) -> DataFrame:
    """Rejected rows per file, with the first ``samples`` line numbers of each.

    The row limit applies before the rows are collected, so the array stays small; all rejected
    rows are what was passed in.
    """
    counts = rejected.groupBy("file").agg(F.count(F.lit(1)).alias("skipped"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(line))
    kept = (
        rejected.select("file", line)
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= samples)
        .groupBy("file")
        .agg(F.sort_array(F.collect_list(line)).alias("sample_lines"))
    )
    return counts.join(kept, "file")
