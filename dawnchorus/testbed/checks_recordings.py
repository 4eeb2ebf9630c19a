"""Checks of the files that are written per recording: written, read back, compared line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions.paths import base_name
from dawnchorus.operators.work import outputs_of, pending_recordings
from dawnchorus.sinks.recordings import ResultOptions, write_recordings
from dawnchorus.sources.results import decoded_path, document_detections, read_detections_parquet, read_result_documents
from dawnchorus.testbed.registry import check
from dawnchorus.testbed.sql import with_views
from dawnchorus.testbed.tables import Tables

_T = "printf('%.1f', {}::DOUBLE)"
_START, _END = _T.format('"start"'), _T.format('"end"')
_CONF = "printf('%.4f', confidence::DOUBLE)"
_ORDER = '"start", confidence DESC, scientific_name, common_name, "end"'
_NUMBER = f"row_number() OVER (PARTITION BY file ORDER BY {_ORDER})"
# The days of the events, and one recording without any.
_FILES = "(SELECT DISTINCT file FROM det_ev UNION ALL SELECT 'silent.wav')"


def _detections(t: Tables) -> DataFrame:
    det = t.det_ev().drop("line")
    return det.withColumnsRenamed({"start": "start_s", "end": "end_s"})


def _recordings(t: Tables) -> DataFrame:
    silent = t.spark.createDataFrame([("silent.wav",)], "file string")
    listed = t.det_ev().select("file").distinct().unionByName(silent)
    return listed.withColumn("duration_s", F.lit(86_400.0))


def _written(t: Tables, *formats: str) -> tuple[str, DataFrame]:
    folder = t.scratch()
    options = ResultOptions(model="m1", bom=False, analysed_at=F.lit("2024-05-01").cast("timestamp"))
    return folder, write_recordings(_detections(t), _recordings(t), list(formats), folder, options)


def _lines(t: Tables, folder: str) -> DataFrame:
    """(name, place, line) of every text file of a folder."""
    files = t.spark.read.text(folder, wholetext=True).select(
        base_name(decoded_path(F.col("_metadata.file_path"))).alias("name"), F.split("value", "\n").alias("lines")
    )
    placed = files.select("name", F.posexplode("lines").alias("place", "line"))
    return placed.where("line <> ''")


def _lines_sql(suffix: str, header: str | None, line: str) -> str:
    head = f"SELECT replace(file, '.wav', '{suffix}') AS name, 0 AS place, '{header}' AS line FROM {_FILES} UNION ALL " if header else ""
    shift = "" if header else " - 1"
    return with_views(
        f"""{head}SELECT replace(file, '.wav', '{suffix}') AS name, CAST({_NUMBER}{shift} AS INTEGER) AS place, {line} AS line
            FROM det_ev""",
        "det_ev",
    )


@check(
    "per_recording_csv",
    _lines_sql(
        ".BirdNET.results.csv",
        "Start (s),End (s),Scientific name,Common name,Confidence,File",
        f"concat_ws(',', {_START}, {_END}, scientific_name, common_name, {_CONF}, file)",
    ),
)
def per_recording_csv(t: Tables) -> DataFrame:
    folder, _ = _written(t, "csv")
    return _lines(t, folder)


@check(
    "per_recording_raven",
    _lines_sql(
        ".BirdNET.selection.table.txt",
        "\t".join(
            ["Selection", "View", "Channel", "Begin Time (s)", "End Time (s)", "Low Freq (Hz)", "High Freq (Hz)",
             "Common Name", "Species Code", "Confidence", "Begin Path", "File Offset (s)"]
        ),
        f"""concat_ws('\t', {_NUMBER}, 'Spectrogram 1', 1, {_START}, {_END}, 150, 15000, replace(common_name, ' ', '_'),
            lower(substr(split_part(common_name, ' ', 1), 1, 3) || substr(split_part(common_name, ' ', -1), 1, 3)),
            {_CONF}, file, {_START})""",
    ),
)
def per_recording_raven(t: Tables) -> DataFrame:
    folder, _ = _written(t, "raven")
    return _lines(t, folder)


@check(
    "per_recording_audacity",
    _lines_sql(".BirdNET.results.txt", None, f"concat_ws('\t', {_START}, {_END}, replace(common_name, '_', ', '), {_CONF})"),
)
def per_recording_audacity(t: Tables) -> DataFrame:
    folder, _ = _written(t, "audacity")
    return _lines(t, folder)


@check(
    "per_recording_kaleidoscope",
    _lines_sql(
        ".BirdNET.results.kaleidoscope.csv",
        "INDIR,FOLDER,IN FILE,OFFSET,DURATION,TOP1MATCH,TOP1DIST",
        f"""concat_ws(',', '', '', file, {_START}, '3.0', replace(common_name, ' ', '_'), {_CONF})""",
    ),
)
def per_recording_kaleidoscope(t: Tables) -> DataFrame:
    folder, _ = _written(t, "kaleidoscope")
    return _lines(t, folder)


@check(
    "per_recording_json",
    with_views(
        """SELECT file, CAST("start" AS FLOAT) AS start_s, CAST("end" AS FLOAT) AS end_s, scientific_name, common_name, confidence
           FROM det_ev UNION ALL SELECT 'silent.wav', NULL, NULL, 'm1', 'documents', 1""",
        "det_ev",
    ),
)
def per_recording_json(t: Tables) -> DataFrame:
    """Detections of all documents, and of the silent recording its count of documents."""
    folder, _ = _written(t, "json")
    documents = read_result_documents(t.spark, folder)
    found = document_detections(documents).select("file", "start_s", "end_s", "scientific_name", "common_name", "confidence")
    quiet = documents.where("size(detections) = 0 AND summary.total_detections = 0").groupBy("source_file", "model").count()
    null = F.lit(None).cast("float")
    return found.unionByName(
        quiet.select(
            F.col("source_file").alias("file"), null.alias("start_s"), null.alias("end_s"), F.col("model").alias("scientific_name"),
            F.lit("documents").alias("common_name"), F.col("count").cast("float").alias("confidence"),
        )
    )


@check(
    "per_recording_parquet",
    with_views(
        """SELECT CAST("start" AS FLOAT) AS start_s, CAST("end" AS FLOAT) AS end_s, scientific_name, common_name, confidence, file
           FROM det_ev""",
        "det_ev",
    ),
)
def per_recording_parquet(t: Tables) -> DataFrame:
    folder, _ = _written(t, "parquet")
    return read_detections_parquet(t.spark, folder)


@check(
    "per_recording_pending",
    with_views(
        f"""SELECT f.file, count(d.file) AS rows, 0 AS pending, 3 AS files
            FROM {_FILES} f LEFT JOIN det_ev d ON d.file = f.file GROUP BY f.file""",
        "det_ev",
    ),
)
def per_recording_pending(t: Tables) -> DataFrame:
    """Rows written of every recording, and what is still pending by a listing of the folder."""
    formats = ["csv", "raven", "parquet"]
    folder, manifest = _written(t, *formats)
    listing = t.spark.read.format("binaryFile").load(f"{folder}/*").select(
        F.concat(F.lit(folder + "/"), base_name(decoded_path(F.col("path")))).alias("path")
    )
    recordings = _recordings(t)
    pending = pending_recordings(recordings, outputs_of(listing, recordings, formats, folder), formats).select("file", F.lit(1).alias("p"))
    done = manifest.where("error IS NULL").groupBy("file").agg(F.max("rows").alias("rows"), F.count(F.lit(1)).cast("int").alias("files"))
    return done.join(pending, "file", "left").select("file", "rows", F.coalesce("p", F.lit(0)).alias("pending"), "files")
