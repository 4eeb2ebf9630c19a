"""One result file per recording and format, written by tasks."""

from __future__ import annotations

import contextlib
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.paths import base_name, parent_path, suffixed_path
from dawnchorus.operators.ordering import selection_number
from dawnchorus.operators.summaries import recording_summary
from dawnchorus.scale import grouped_slices, kept
from dawnchorus.sinks import tables
from dawnchorus.storage import Store, copy_into, draft, folder_of, open_store, publish

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Parts of a file in their order.
_OPENING, _ROWS, _CLOSING = 0, 1, 2
# Column of a detection's place in its recording, which every projection carries along.
_PLACE = "_place"
_PART = (
    "file string, format string, path string, rows bigint, bytes bigint, "
    "draft string, part int, opens boolean, closes boolean, error string"
)


@dataclass(frozen=True)
class ResultOptions:
    """Settings of a run that its files show."""

    include: Sequence[str] = ()
    bom: bool = True
    model: str = ""
    min_confidence: float = K.DEFAULT_MIN_CONFIDENCE
    overlap: float = K.DEFAULT_OVERLAP_S
    analysed_at: Column | None = field(default=None, compare=False)


@dataclass(frozen=True)
class RecordingFormat:
    """How the file of one recording is made.

    ``rows`` projects detections and carries ``_place`` along. In a text format it gives ``text``, what each
    adds to the file; ``opening`` and ``closing`` turn the table of recordings (with their summary) into the text
    before and after. A Parquet format has typed columns instead.
    """

    suffix: str
    rows: Callable[[DataFrame, ResultOptions], DataFrame]
    opening: Callable[[ResultOptions], Column] = lambda options: F.lit("")
    closing: Callable[[ResultOptions], Column] = lambda options: F.lit("")
    parquet: bool = False


def _text_format(name: str) -> RecordingFormat:
    """A format of ``tables``, its header in every file."""
    fmt = tables.TEXT_FORMATS[name]

    def projected(det: DataFrame, options: ResultOptions) -> DataFrame:
        extra = {"include": options.include} if name == "csv" else {}
        return fmt.rows(det, carry=[_PLACE], **extra)

    def rows(det: DataFrame, options: ResultOptions) -> DataFrame:
        cells = projected(det, options)
        line = tables.to_lines(cells, fmt.sep, fmt.quote, [_PLACE])
        return cells.select(_PLACE, F.concat(line, F.lit("\n")).alias("text"))

    def opening(options: ResultOptions) -> Column:
        titles = {"csv": [*K.CSV_HEADER, *options.include], "raven": K.RAVEN_HEADER, "kaleidoscope": K.KALEIDOSCOPE_HEADER}
        title = fmt.sep.join(titles[name]) + "\n" if fmt.header else ""
        return F.lit(("﻿" if name == "csv" and options.bom else "") + title)

    return RecordingFormat(K.OUTPUT_SUFFIXES[name], rows, opening)


def _json_rows(det: DataFrame, options: ResultOptions) -> DataFrame:
    item = F.struct(
        F.col("start_s").cast("float").alias("start_time"),
        F.col("end_s").cast("float").alias("end_time"),
        "scientific_name",
        "common_name",
        F.col("confidence").cast("float").alias("confidence"),
    )
    comma = F.when(F.col("_number") > 1, F.lit(",")).otherwise(F.lit(""))
    numbered = selection_number(det, "_number")
    return numbered.select(_PLACE, F.concat(comma, F.lit("\n"), F.to_json(item)).alias("text"))


def _json_opening(options: ResultOptions) -> Column:
    settings = F.struct(
        F.lit(options.min_confidence).cast("float").alias("min_confidence"),
        F.lit(options.overlap).cast("float").alias("overlap"),
        "lat",
        "lon",
        "week",
    )
    at = F.current_timestamp() if options.analysed_at is None else options.analysed_at
    head = F.to_json(
        F.struct(
            base_name(F.col("file")).alias("source_file"),
            at.alias("analysis_date"),
            F.lit(options.model).alias("model"),
            settings.alias("settings"),
        )
    )
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"detections":['))


def _json_closing(options: ResultOptions) -> Column:
    summary = F.struct("total_detections", "unique_species", "audio_duration_seconds")
    return F.concat(F.lit('\n],"summary":'), F.to_json(summary), F.lit("}\n"))


# Formats register here; adding one makes it available to write_recordings.
RECORDING_FORMATS: dict[str, RecordingFormat] = {
    **{name: _text_format(name) for name in ("csv", "raven", "audacity", "kaleidoscope")},
    "json": RecordingFormat(K.OUTPUT_SUFFIXES["json"], _json_rows, _json_opening, _json_closing),
    "parquet": RecordingFormat(
        K.OUTPUT_SUFFIXES["parquet"],
        lambda det, options: tables.to_parquet_rows(det, options.include, [_PLACE]),
        parquet=True,
    ),
}


def register_recording_format(name: str, fmt: RecordingFormat) -> None:
    RECORDING_FORMATS[name] = fmt


def _with_place(det: DataFrame) -> DataFrame:
    """Adds the recording and the sort keys of detection order, apart from the columns that a projection may change."""
    place = F.struct(
        "file",
        F.col("start_s").cast("double").alias("start_s"),
        (-F.col("confidence").cast("double")).alias("confidence"),
        "scientific_name",
        "common_name",
        F.col("end_s").cast("double").alias("end_s"),
    )
    return det.withColumn(_PLACE, place)


def _summarised(det: DataFrame, recordings: DataFrame, needed: bool) -> DataFrame:
    """Recordings with what openings and closings show of them."""
    facts = [
        (F.col(c) if c in recordings.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in (("lat", "double"), ("lon", "double"), ("week", "smallint"), ("duration_s", "double"))
    ]
    listed = recordings.where(F.col("file").isNotNull()).select("file", *facts).dropDuplicates(["file"])
    if not needed:
        return listed
    summary = recording_summary(det, listed.select("file", "duration_s"))
    return listed.drop("duration_s").join(summary, "file")


def _pieces(det: DataFrame, recordings: DataFrame, name: str, folder: str | None, options: ResultOptions) -> DataFrame:
    """(path, format, section, place, *content*) of all files of a format."""
    fmt = RECORDING_FORMATS[name]
    target = None if folder is None else F.lit(folder)

    def path(file: Column) -> Column:
        return suffixed_path(file, F.lit(fmt.suffix), target)

    # Recordings that share a path cannot share a file: it belongs to the first.
    owners = recordings.withColumn("path", path(F.col("file")))
    owners = owners.groupBy("path").agg(F.min_by(F.struct(*recordings.columns), "file").alias("r")).select("path", "r.*")
    rows = fmt.rows(_with_place(det), options)
    content = [c for c in rows.columns if c != _PLACE]
    body = rows.select(
        path(F.col(f"{_PLACE}.file")).alias("path"), F.lit(name).alias("format"), F.lit(_ROWS).alias("section"), _PLACE, *content
    )
    kinds = dict(zip(body.columns, [f.dataType for f in body.schema.fields]))

    def around(section: int, text: Column) -> DataFrame:
        place = F.struct("file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds[_PLACE].fields[1:]])
        cells = [(text if c == "text" else F.lit(None)).cast(kinds[c]).alias(c) for c in content]
        return owners.select("path", F.lit(name).alias("format"), F.lit(section).alias("section"), place.alias(_PLACE), *cells)

    empty = F.lit("")
    opening = empty if fmt.parquet else fmt.opening(options)
    closing = empty if fmt.parquet else fmt.closing(options)
    return body.unionByName(around(_OPENING, opening)).unionByName(around(_CLOSING, closing))


class _TextFile:
    """Appends the texts of consecutive rows."""

    def __init__(self, out: pa.NativeFile, content: pa.Schema):
        self.out = out

    def add(self, rows: pa.RecordBatch, sections: np.ndarray) -> None:
        text = rows.column(0).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        # Texts lie one behind the other, so any number of rows is one piece of memory.
        if offsets[-1] > offsets[0]:
            self.out.write(text.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])))

    def close(self) -> None:
        pass


class _ParquetFile:
    """Appends typed rows; opening and closing rows hold none."""

    def __init__(self, out: pa.NativeFile, content: pa.Schema):
        self.writer = pq.ParquetWriter(out, content, compression="snappy")

    def add(self, rows: pa.RecordBatch, sections: np.ndarray) -> None:
        kept_rows = rows.filter(pa.array(sections == _ROWS))
        if kept_rows.num_rows:
            self.writer.write_batch(kept_rows)

    def close(self) -> None:
        self.writer.close()


def _part_writer(store: Store, run: str, parquet: bool) -> Callable:
    """Writes the files of sorted pieces; a file that lies in one range takes its name here, others leave drafts."""
    made = _ParquetFile if parquet else _TextFile

    def write(pieces: Iterator[pa.RecordBatch]) -> dict:
        """One file's pieces; stops quietly at an error, which the row tells."""
        first = next(pieces)
        path, owner, fmt = (first.column(c)[0].as_py() for c in range(3))
        row = {"file": owner, "format": fmt, "path": path, "rows": 0, "bytes": 0, "part": TaskContext.get().partitionId()}
        row |= {"draft": None, "opens": first.column(3)[0].as_py() == _OPENING, "closes": False, "error": None}
        content = first.schema.names[4:]
        try:
            system, target = store(path)
            with draft(system, f"{folder_of(target)}/_drafts-{run}") as (out, name):
                file = made(out, first.select(content).schema)
                for piece in _and(first, pieces):
                    sections = piece.column(3).to_numpy(zero_copy_only=False)
                    file.add(piece.select(content), sections)
                    row["rows"] += int(np.count_nonzero(sections == _ROWS))
                    row["closes"] = bool(sections[-1] == _CLOSING)
                file.close()
                row["bytes"] = out.tell()
            if row["opens"] and row["closes"]:
                publish(system, name, target)
            else:
                row["draft"] = name
        except (OSError, pa.ArrowException) as error:
            row["error"] = f"{type(error).__name__}: {error}"
        return row

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in grouped_slices(batches, ["path", "_owner"]):
            yield _part_rows([write(pieces)])

    return run_task


def _and(first, others: Iterator) -> Iterator:
    yield first
    yield from others


_ARROW_PART = pa.schema(
    [("file", pa.string()), ("format", pa.string()), ("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()),
     ("draft", pa.string()), ("part", pa.int32()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("error", pa.string())]
)


def _part_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW_PART)


def _joiner(store: Store, run: str, parquet: bool) -> Callable:
    """Joins the drafts of a file that lay in several ranges, in their order, and names it."""

    def join(row: dict) -> dict:
        parts = row.pop("parts")
        done = {"rows": sum(p["rows"] for p in parts), "bytes": 0, "draft": None, "part": 0, "error": None}
        done |= row | {"opens": parts[0]["opens"], "closes": parts[-1]["closes"]}
        if not (done["opens"] and done["closes"]):
            return done | {"error": "not among the recordings, or the path is another recording's"}
        try:
            system, target = store(row["path"])
            with draft(system, f"{folder_of(target)}/_drafts-{run}") as (out, name):
                if parquet:
                    writer = None
                    for part in parts:
                        with system.open_input_file(part["draft"]) as source:
                            held = pq.ParquetFile(source)
                            writer = writer or pq.ParquetWriter(out, held.schema_arrow, compression="snappy")
                            for batch in held.iter_batches():
                                writer.write_batch(batch)
                    writer.close()
                else:
                    for part in parts:
                        copy_into(system, part["draft"], out)
                done["bytes"] = out.tell()
            publish(system, name, target)
        except (OSError, pa.ArrowException) as error:
            done["error"] = f"{type(error).__name__}: {error}"
        return done

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _part_rows([join(row)])

    return run_task


def _cleaner(store: Store, run: str) -> Callable:
    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, path = store(folder)
                with contextlib.suppress(OSError):
                    system.delete_dir(f"{path}/_drafts-{run}")
            yield batch

    return run_task


def write_recordings(
    det: DataFrame,
    recordings: DataFrame,
    formats: Sequence[str],
    folder: str | None = None,
    options: ResultOptions | None = None,
    store: Store = open_store,
) -> DataFrame:
    """Write one result file per recording and format; returns the manifest (file, format, path, rows, bytes, error).

    ``recordings`` lists every recording (file, and optionally duration_s, lat, lon, week); one without detections gets a file
    without rows. Files lie next to their recording or in ``folder``, a mounted path or an address that ``store``
    opens (pyarrow file systems by default), and have the names that ``outputs_of`` looks for.

    Pieces of files are shuffled into sorted ranges of (path, detection order), so a recording with a large share of all
    detections is written by several tasks. A file whose pieces all lie in one range is written to a draft that
    takes its name when complete; the drafts of one that goes over a range's edge are joined by one task, as bytes. So a
    lost or repeated task leaves one complete file or none.

    An unwritable file is a row with the reason in ``error``; others go on. Detections of a recording that is not listed, or whose
    path belongs to a smaller recording, give such a row and no file. Rows with a null file are left out; equal rows count each.
    """
    options = options or ResultOptions()
    unknown = sorted(set(formats) - set(RECORDING_FORMATS))
    if unknown:
        raise ValueError(f"unknown formats: {unknown}")
    if not formats:
        raise ValueError("no format asked for")
    named = det.where(F.col("file").isNotNull())
    run = uuid.uuid4().hex
    results = []
    texts = sorted({f for f in formats if not RECORDING_FORMATS[f].parquet})
    groups = [texts] if texts else []
    groups += [[f] for f in sorted({f for f in formats if RECORDING_FORMATS[f].parquet})]
    for group in groups:
        parquet = RECORDING_FORMATS[group[0]].parquet
        listed = _summarised(named, recordings, needed=not parquet)
        pieces = None
        for name in group:
            made = _pieces(named, listed, name, folder, options)
            pieces = made if pieces is None else pieces.unionByName(made)
        content = [c for c in pieces.columns if c not in ("path", "format", "section", _PLACE)]
        place = [F.col(f"{_PLACE}.{f.name}") for f in pieces.schema[_PLACE].dataType.fields]
        order = [F.col("path"), place[0], F.col("section"), *place[1:]]
        columns = ["path", place[0].alias("_owner"), "format", "section", *content]
        spread = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
        # Kept, so that reading the manifest again writes nothing again.
        parts = kept(spread.mapInArrow(_part_writer(store, run, parquet), _PART))
        whole = (F.col("opens") & F.col("closes")) | F.col("error").isNotNull()
        split = parts.where(~whole).groupBy("file", "format", "path").agg(
            F.array_sort(F.collect_list(F.struct("part", "draft", "rows", "opens", "closes"))).alias("parts")
        )
        joined = kept(split.mapInArrow(_joiner(store, run, parquet), _PART))
        results.append(parts.where(whole).unionByName(joined))
        used = parts.select(parent_path(F.col("path")).alias("folder")).distinct()
        used.mapInArrow(_cleaner(store, run), "folder string").write.format("noop").mode("overwrite").save()
    manifest = results[0]
    for more in results[1:]:
        manifest = manifest.unionByName(more)
    return manifest.select("file", "format", "path", "rows", "bytes", "error")
