"""Nested outputs per recording: result documents and detection events.

A recording with more detections than fit one document is written as several documents of
the same shape, numbered by ``part``; together they hold every detection once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.constants import SPEC_VERSION
from dawnchorus.functions.labels import species_label
from dawnchorus.functions.paths import base_name
from dawnchorus.operators.ordering import selection_number

DETECTIONS_PER_PART = 50_000


def detection_parts(det: DataFrame, item: Column, per_part: int) -> DataFrame:
    """(file, _part, detections): ordered arrays of at most ``per_part`` detections."""
    part = F.floor((F.col("_n") - 1) / per_part).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("_n", "item")))
    return (
        selection_number(det, "_n")
        .select("file", "_n", part.alias("_part"), item.alias("item"))
        .groupBy("file", "_part")
        .agg(F.transform(ordered, lambda r: r["item"]).alias("detections"))
    )


def _part_counts(parts: DataFrame) -> DataFrame:
    """(file, total_detections, unique_species) from the parts: no more than their species are gathered per recording."""
    species = F.array_distinct(F.transform("detections", lambda d: d["scientific_name"]))
    counted = parts.select("file", F.size("detections").alias("n"), F.filter(species, lambda s: s.isNotNull()).alias("species"))
    return counted.groupBy("file").agg(
        F.sum("n").alias("total_detections"),
        F.size(F.array_distinct(F.flatten(F.collect_set("species")))).cast("long").alias("unique_species"),
    )


def to_result_documents(
    det: DataFrame,
    recordings: DataFrame,
    model: str,
    min_confidence: float,
    overlap: float,
    analysed_at: Column | None = None,
    per_part: int = DETECTIONS_PER_PART,
) -> DataFrame:
    """One document per recording, also for recordings without detections.

    ``recordings`` lists every recording with (file, duration_s) and optionally lat, lon, week.
    """
    item = F.struct(
        F.col("start_s").cast("float").alias("start_time"),
        F.col("end_s").cast("float").alias("end_time"),
        "scientific_name",
        "common_name",
        F.col("confidence").cast("float").alias("confidence"),
    )
    place = [
        (F.col(c) if c in recordings.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in (("lat", "double"), ("lon", "double"), ("week", "smallint"))
    ]
    located = recordings.select("file", F.struct(*place).alias("_place"), F.col("duration_s").cast("float").alias("audio_duration_seconds"))
    parts = detection_parts(det, item, per_part)
    zero = F.lit(0).cast("long")
    summary = located.join(_part_counts(parts), "file", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("total_detections", "unique_species")}
    )
    none = F.array().cast(parts.schema["detections"].dataType)
    quiet = summary.filter("total_detections = 0").withColumns(
        {"_part": F.lit(0), "detections": none}
    )
    # Parts are the large side of an inner join, which may split a recording of many parts;
    # recordings without detections need no join at all.
    filled = parts.join(summary, "file").select(*quiet.columns)
    count = F.greatest(F.ceil(F.col("total_detections") / per_part).cast("int"), F.lit(1))
    settings = F.struct(
        F.lit(min_confidence).cast("float").alias("min_confidence"),
        F.lit(overlap).cast("float").alias("overlap"),
        F.col("_place.lat"),
        F.col("_place.lon"),
        F.col("_place.week"),
    )
    return filled.unionByName(quiet).select(
        base_name(F.col("file")).alias("source_file"),
        (F.current_timestamp() if analysed_at is None else analysed_at).alias("analysis_date"),
        F.lit(model).alias("model"),
        settings.alias("settings"),
        "detections",
        F.struct("total_detections", "unique_species", "audio_duration_seconds").alias("summary"),
        F.col("_part").alias("part"),
        count.alias("parts"),
    )


def write_result_documents(documents: DataFrame, target: str) -> None:
    """One JSON object per line; absent values are left out."""
    documents.write.option("ignoreNullFields", True).json(target)


def envelope(kind: str, payload: Column, at: Column | None = None) -> Column:
    """JSON text of an event envelope."""
    return F.to_json(
        F.struct(
            F.lit(SPEC_VERSION).alias("spec_version"),
            (F.current_timestamp() if at is None else at).alias("timestamp"),
            F.lit(kind).alias("event"),
            payload.alias("payload"),
        )
    )


def _detection_info() -> Column:
    return F.struct(
        species_label(F.col("scientific_name"), F.col("common_name")).alias("species"),
        "common_name",
        "scientific_name",
        F.col("confidence").cast("float").alias("confidence"),
        F.col("start_s").cast("float").alias("start_time"),
        F.col("end_s").cast("float").alias("end_time"),
    )


def to_detection_events(
    det: DataFrame,
    flags: DataFrame | None = None,
    at: Column | None = None,
    per_part: int = DETECTIONS_PER_PART,
    recordings: DataFrame | None = None,
) -> DataFrame:
    """``detections`` events (file, part, value), value being the envelope's JSON text.

    ``flags`` (from postprocess_flags) adds provenance for calibrated models. ``recordings`` (column file) lists those that
    get an event without detections if they have none; otherwise only recordings with detections have events.
    """
    parts = detection_parts(det, _detection_info(), per_part)
    if recordings is not None:
        none = F.array().cast(parts.schema["detections"].dataType)
        # Only the first part is asked for, so a recording of many parts is one row here.
        loud = parts.where("_part = 0").select("file")
        silent = recordings.select("file").distinct().join(loud, "file", "left_anti")
        parts = parts.unionByName(silent.select("file", F.lit(0).alias("_part"), none.alias("detections")))
    fields = [F.col("file"), F.col("detections")]
    if flags is not None:
        provenance = F.struct(
            "calibration_applied",
            "sdm_applied",
            F.col("sdm_latitude").alias("latitude"),
            F.col("sdm_longitude").alias("longitude"),
            F.col("sdm_day_of_year").alias("day_of_year"),
        )
        known = flags.select("file", F.when(F.col("calibration_applied"), provenance).alias("bsg"))
        parts = parts.join(known, "file", "left")
        fields.append(F.col("bsg"))
    value = envelope("detections", F.struct(*fields), at)
    return parts.select("file", F.col("_part").alias("part"), value.alias("value"))


def to_streamed_detection_events(det: DataFrame, at: Column | None = None) -> DataFrame:
    """One ``detections`` event per detection: the stateless form for streaming sinks."""
    payload = F.struct(F.col("file"), F.array(_detection_info()).alias("detections"))
    return det.select("file", envelope("detections", payload, at).alias("value"))
