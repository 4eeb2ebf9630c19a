"""Explicit schemas; nothing in the package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _F, _D, _I, _L = T.StringType(), T.FloatType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


METADATA_TYPES: dict[str, T.DataType] = {
    "lat": _D,
    "lon": _D,
    "week": T.ShortType(),
    "model": _S,
    "overlap": _F,
    "sensitivity": _F,
    "min_conf": _F,
    "species_list": _S,
}

# Column order of the detections Parquet files.
DETECTIONS = _struct(
    ("start_s", _F),
    ("end_s", _F),
    ("scientific_name", _S),
    ("common_name", _S),
    ("confidence", _F),
    ("file", _S),
)


def detections_with(include: list[str]) -> T.StructType:
    """Detections schema plus the named metadata columns, unknown names skipped."""
    extra = [T.StructField(c, METADATA_TYPES[c]) for c in include if c in METADATA_TYPES]
    return T.StructType(DETECTIONS.fields + extra)


PARSED = _struct(
    ("file", _S),
    ("start", _D),
    ("end", _D),
    ("scientific_name", _S),
    ("common_name", _S),
    ("confidence", _F),
)

CLIPS = _struct(
    ("file", _S),
    ("scientific_name", _S),
    ("common_name", _S),
    ("start", _D),
    ("end", _D),
    ("max_confidence", _F),
    ("detection_count", _L),
)

RESULT_DETECTION = _struct(
    ("start_time", _F),
    ("end_time", _F),
    ("scientific_name", _S),
    ("common_name", _S),
    ("confidence", _F),
)

RESULT_SETTINGS = _struct(
    ("min_confidence", _F), ("overlap", _F), ("lat", _D), ("lon", _D), ("week", T.ShortType())
)

RESULT_DOCUMENT = _struct(
    ("source_file", _S),
    ("analysis_date", T.TimestampType()),
    ("model", _S),
    ("settings", RESULT_SETTINGS),
    ("detections", T.ArrayType(RESULT_DETECTION)),
    (
        "summary",
        _struct(("total_detections", _L), ("unique_species", _L), ("audio_duration_seconds", _F)),
    ),
    ("part", _I),
    ("parts", _I),
)

EVENT_ENVELOPE = _struct(
    ("spec_version", _S), ("timestamp", T.TimestampType()), ("event", _S), ("payload", _S)
)

DETECTION_INFO = _struct(
    ("species", _S),
    ("common_name", _S),
    ("scientific_name", _S),
    ("confidence", _F),
    ("start_time", _F),
    ("end_time", _F),
)

_CALIBRATION = _struct(
    ("calibration_applied", T.BooleanType()),
    ("sdm_applied", T.BooleanType()),
    ("latitude", _F),
    ("longitude", _F),
    ("day_of_year", _I),
)

# One payload schema per event kind; ``result`` stays text, its shape varies.
PAYLOADS: dict[str, T.StructType] = {
    "pipeline_started": _struct(
        ("total_files", _L),
        ("model", _S),
        ("min_confidence", _F),
        (
            "execution_provider",
            _struct(("requested", _S), ("actual", _S), ("fallback_reason", _S)),
        ),
        (
            "range_filter",
            _struct(
                ("geomodel_version", _S),
                ("species_in_range", _L),
                ("total_species", _L),
                ("mapped_species", _L),
                ("unmatched_species", _L),
                ("unmatched_policy", _S),
                ("threshold", _F),
            ),
        ),
    ),
    "file_started": _struct(
        ("file", _S), ("index", _L), ("estimated_segments", _L), ("duration_seconds", _D)
    ),
    "progress": _struct(
        ("batch", _struct(("current", _L), ("total", _L), ("percent", _F))),
        (
            "file",
            _struct(
                ("path", _S), ("segments_done", _L), ("segments_total", _L), ("percent", _F)
            ),
        ),
        (
            "download",
            _struct(
                ("operation", _S),
                ("model", _S),
                ("file", _S),
                ("downloaded_bytes", _L),
                ("total_bytes", _L),
                ("percent", _F),
            ),
        ),
    ),
    "file_completed": _struct(
        ("file", _S),
        ("status", _S),
        ("detections", _L),
        ("duration_ms", _L),
        ("error", _struct(("code", _S), ("message", _S))),
    ),
    "pipeline_completed": _struct(
        ("status", _S),
        ("files_processed", _L),
        ("files_failed", _L),
        ("files_skipped", _L),
        ("total_detections", _L),
        ("total_segments", _L),
        ("duration_ms", _L),
        ("realtime_factor", _D),
    ),
    "error": _struct(("code", _S), ("severity", _S), ("message", _S), ("suggestion", _S)),
    "cancelled": _struct(("reason", _S), ("files_completed", _L), ("files_total", _L)),
    "detections": _struct(
        ("file", _S), ("detections", T.ArrayType(DETECTION_INFO)), ("bsg", _CALIBRATION)
    ),
}

REGION = _struct(
    ("region", _S),
    ("name", _S),
    ("group", _S),
    ("group_display", _S),
    ("group_order", _I),
    ("classes", _I),
    (
        "countries",
        _struct(("core", T.ArrayType(_S)), ("partial", T.ArrayType(_S))),
    ),
)
