"""Checks of the output projections and the nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus import schemas
from dawnchorus.scale import evaluated_once
from dawnchorus.sinks import documents, tables
from dawnchorus.sources import events, results
from dawnchorus.testbed.registry import check
from dawnchorus.testbed.sql import with_views
from dawnchorus.testbed.tables import Tables

_T = "printf('%.1f', {}::DOUBLE)"
_START, _END = _T.format("start_s"), _T.format("end_s")
_CONF = "printf('%.4f', confidence::DOUBLE)"
_ORDER = "start_s, confidence DESC, scientific_name, common_name, end_s"
_FOLDERED = "SELECT * REPLACE ('/site/' || scientific_name || '/' || file AS file) FROM detections"


def _located(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/site/"), F.col("scientific_name"), F.lit("/"), F.col("file"))
    return t.detections().withColumn("file", path)


@check(
    "to_csv_rows",
    with_views(
        f"""SELECT {_START} AS "Start (s)", {_END} AS "End (s)", scientific_name AS "Scientific name",
                   common_name AS "Common name", {_CONF} AS "Confidence", file AS "File",
                   CAST(CAST(start_s AS INTEGER) % 48 + 1 AS VARCHAR) AS week, 'm1' AS model,
                   CAST(CAST(end_s AS INTEGER) AS VARCHAR) || '.25' AS lat, '' AS sensitivity
            FROM detections""",
        "detections",
    ),
)
def to_csv_rows(t: Tables) -> DataFrame:
    det = (
        t.detections()
        .withColumn("week", (F.col("start_s").cast("int") % 48 + 1).cast("smallint"))
        .withColumn("model", F.lit("m1"))
        .withColumn("lat", F.col("end_s").cast("double") + 0.25)
    )
    return tables.to_csv_rows(det, ["week", "model", "lat", "sensitivity"])


@check(
    "csv_lines",
    with_views(
        f"""SELECT concat({_START}, ',', {_END}, ',"', scientific_name, ', or ""', common_name,
                   '"" ",', common_name, ',', {_CONF}, ',', file) AS line
            FROM detections""",
        "detections",
    ),
)
def csv_lines(t: Tables) -> DataFrame:
    name = F.concat("scientific_name", F.lit(', or "'), "common_name", F.lit('" '))
    rows = tables.to_csv_rows(t.detections().withColumn("scientific_name", name))
    return rows.select(tables.to_lines(rows, ",", quote=True).alias("line"))


@check(
    "to_parquet_rows",
    with_views(
        f"""WITH d AS ({_FOLDERED})
            SELECT start_s, end_s, scientific_name, common_name, confidence,
                   regexp_extract(file, '([^/]*)$', 1) AS file, 12::SMALLINT AS week,
                   CAST(0.1 AS FLOAT) AS min_conf FROM d""",
        "detections",
    ),
)
def to_parquet_rows(t: Tables) -> DataFrame:
    det = _located(t).withColumn("week", F.lit(12)).withColumn("min_conf", F.lit(0.1))
    return tables.to_parquet_rows(det, ["week", "unknown", "min_conf"])


@check(
    "to_raven_rows",
    with_views(
        f"""SELECT row_number() OVER (PARTITION BY file ORDER BY {_ORDER}) AS "Selection",
                   'Spectrogram 1' AS "View", 1 AS "Channel", {_START} AS "Begin Time (s)",
                   {_END} AS "End Time (s)", 150 AS "Low Freq (Hz)", 15000 AS "High Freq (Hz)",
                   replace(common_name, ' ', '_') AS "Common Name",
                   lower(substr(split_part(common_name, ' ', 1), 1, 3) ||
                         substr(split_part(common_name, ' ', -1), 1, 3)) AS "Species Code",
                   {_CONF} AS "Confidence", file AS "Begin Path", {_START} AS "File Offset (s)"
            FROM detections""",
        "detections",
    ),
)
def to_raven_rows(t: Tables) -> DataFrame:
    return tables.to_raven_rows(t.detections())


@check(
    "to_audacity_rows",
    with_views(
        f"""SELECT {_START} AS "start", {_END} AS "end", replace(common_name, '_', ', ') AS label,
                   {_CONF} AS confidence FROM detections""",
        "detections",
    ),
)
def to_audacity_rows(t: Tables) -> DataFrame:
    return tables.to_audacity_rows(t.detections())


@check(
    "to_kaleidoscope_rows",
    with_views(
        f"""WITH d AS ({_FOLDERED})
            SELECT '/site' AS "INDIR", scientific_name AS "FOLDER",
                   regexp_extract(file, '([^/]*)$', 1) AS "IN FILE", {_START} AS "OFFSET",
                   {_T.format('(end_s - start_s)')} AS "DURATION",
                   replace(common_name, ' ', '_') AS "TOP1MATCH", {_CONF} AS "TOP1DIST"
            FROM d""",
        "detections",
    ),
)
def to_kaleidoscope_rows(t: Tables) -> DataFrame:
    return tables.to_kaleidoscope_rows(_located(t))


@check(
    "result_documents",
    with_views(
        """SELECT r.file, count(d.file) AS total_detections,
                  count(DISTINCT d.scientific_name) AS unique_species,
                  CAST(any_value(r.duration_s) AS FLOAT) AS audio_duration_seconds,
                  CAST(greatest(ceil(count(d.file) / 4.0), 1) AS BIGINT) AS documents,
                  count(d.file) AS detections_held
           FROM recordings r LEFT JOIN detections d ON r.file = d.file GROUP BY r.file""",
        "recordings",
        "detections",
    ),
)
def result_documents(t: Tables) -> DataFrame:
    """Documents of at most four detections, summed up again per recording."""
    docs = documents.to_result_documents(
        t.detections(), t.recordings(), "m1", 0.1, 0.0, F.lit("2024-01-01").cast("timestamp"), per_part=4
    )
    return docs.groupBy(F.col("source_file").alias("file")).agg(
        F.max("summary.total_detections").alias("total_detections"),
        F.max("summary.unique_species").alias("unique_species"),
        F.max("summary.audio_duration_seconds").alias("audio_duration_seconds"),
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size("detections")).alias("detections_held"),
    )


@check(
    "result_document_round_trip",
    with_views(
        """SELECT r.file, start_s, end_s, scientific_name, common_name, confidence,
                  'm1' AS model, CAST(0.1 AS FLOAT) AS min_conf, r.lat, r.lon,
                  CAST(r.week AS SMALLINT) AS week
           FROM detections d JOIN recordings r ON d.file = r.file""",
        "recordings",
        "detections",
    ),
)
def result_document_round_trip(t: Tables) -> DataFrame:
    """Detections to documents, to JSON text, and back to flat detections."""
    docs = documents.to_result_documents(t.detections(), t.recordings(), "m1", 0.1, 0.0)
    text = docs.select(F.to_json(F.struct(*docs.columns)).alias("value"))
    parsed = text.select(evaluated_once(F.from_json("value", schemas.RESULT_DOCUMENT)).alias("d")).select("d.*")
    return results.document_detections(parsed).drop("overlap")


@check(
    "detection_events",
    with_views(
        """SELECT file, start_s, end_s, scientific_name, common_name, confidence,
                  scientific_name || '_' || common_name AS species FROM detections""",
        "detections",
    ),
)
def detection_events(t: Tables) -> DataFrame:
    """Detections to event envelopes, to JSON text, and back."""
    sent = documents.to_detection_events(t.detections())
    parsed = F.from_json("value", "spec_version string, timestamp timestamp, event string, payload string")
    envelopes = sent.select(evaluated_once(parsed).alias("e")).select("e.*")
    return events.event_detections(envelopes).drop("timestamp")


@check(
    "detection_events_of_all",
    with_views(
        """SELECT r.file, 1 AS events, count(d.file) AS detections
           FROM (SELECT DISTINCT file FROM recordings) r LEFT JOIN detections d ON r.file = d.file GROUP BY r.file""",
        "recordings",
        "detections",
    ),
)
def detection_events_of_all(t: Tables) -> DataFrame:
    """Events of every recording, also of those without detections, counted from their JSON text."""
    sent = documents.to_detection_events(t.detections(), recordings=t.recordings())
    listed = F.from_json(F.get_json_object("value", "$.payload.detections"), "array<struct<species: string>>")
    return sent.groupBy("file").agg(
        F.count(F.lit(1)).cast("int").alias("events"), F.sum(F.size(listed)).alias("detections")
    )
