"""Detection results: CSV, Parquet and JSON documents."""

from __future__ import annotations

import csv
import itertools
import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dawnchorus import schemas
from dawnchorus.constants import CSV_HEADER
from dawnchorus.scale import grouped_slices, is_small, kept

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of one output batch, and lines of a block's beginning that are kept to end a record of the block before.
ROWS_AT_ONCE, MOST_HEAD_LINES = 10_000, 1000

_REQUIRED = CSV_HEADER[:5]
_TEXT = ["start", "end", "scientific_name", "common_name", "confidence"]


def _typed(raw: DataFrame, on_bad: str, also: Sequence[str] = ()) -> DataFrame:
    """Text columns to numbers; an unreadable number is an error or marks the row."""

    def number(name: str, kind: str) -> Column:
        return F.col(name).try_cast(kind)

    parsed = raw.select(
        "file",
        number("start", "double").alias("start"),
        number("end", "double").alias("end"),
        F.coalesce("scientific_name", F.lit("")).alias("scientific_name"),
        F.coalesce("common_name", F.lit("")).alias("common_name"),
        number("confidence", "float").alias("confidence"),
        *also,
    )
    unreadable = F.col("start").isNull() | F.col("end").isNull() | F.col("confidence").isNull()
    if on_bad == "flag":
        return parsed.withColumn("malformed", unreadable)
    failed = F.raise_error(F.concat(F.lit("unreadable number in "), F.col("file")))
    checked = F.when(unreadable, failed.cast("double")).otherwise(F.col("start"))
    return parsed.withColumn("start", checked)


def decoded_path(path: Column) -> Column:
    """A file's path as it is named, from the form in which file metadata escapes it."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_detections_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    on_bad: str = "fail",
    headers: str = "same",
    multiline: bool = True,
) -> DataFrame:
    """Result CSVs as parsed detections, columns found by name, extra columns ignored.

    ``headers="same"``: all files share one header; a file whose header differs is an error. ``headers="mixed"``: each file
    is read by its own. ``on_bad``: ``fail``, or ``flag`` to add ``malformed``, ``line`` (where the row begins, the header
    being line 1) and ``error``. A file, or a block of a large one, that can't be read to its end gives its rows so far and one row
    with null ``line`` and the reason in ``error``; one that lacks a required column, or whose header differs, gives that
    row alone. Other files go on.

    Quoted fields may hold line ends, also in large files, which many tasks read. Only with ``headers="same"`` and
    ``on_bad="fail"`` is a file with such fields read by one task; ``multiline=False`` says that there are none.
    """
    if on_bad not in ("fail", "flag"):
        raise ValueError(f"unknown policy {on_bad!r}")
    if headers not in ("same", "mixed"):
        raise ValueError(f"unknown header mode {headers!r}")
    if headers == "mixed" or on_bad == "flag":
        expected = None
        if headers == "same":
            expected = _first_header(spark, paths)
        raw = _read_by_header(spark, paths, on_bad == "fail", expected)
        if on_bad == "fail":
            return _typed(raw, on_bad)
        placed = _typed(raw, on_bad, ["line", "error"])
        return placed.withColumn("malformed", F.col("malformed") | F.col("error").isNotNull())
    raw = spark.read.csv(
        paths,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        enforceSchema=False,
        multiLine=multiline,
        recursiveFileLookup=True,
    )
    if not raw.columns:
        return spark.createDataFrame([], schemas.PARSED)
    named = {c.strip().lstrip("﻿"): c for c in raw.columns}
    missing = [c for c in _REQUIRED if c not in named]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    picked = [
        F.trim(F.col(f"`{named[source]}`")).alias(target)
        for source, target in zip(_REQUIRED, _TEXT)
    ]
    return _typed(raw.select(decoded_path(F.col("_metadata.file_path")).alias("file"), *picked), on_bad)


def _files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, length) of the files, from their listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")


def _first_header(spark: SparkSession, paths: str | Sequence[str]) -> list[str] | None:
    """Column names of the first file by path that holds anything."""
    first = _files(spark, paths).where("length > 0").agg(F.min("path")).first()[0]
    if first is None:
        return None
    named = spark.read.csv(re.sub(r"([\\{}\[\]*?])", r"\\\1", first), header=True).columns
    return [c.strip().lstrip("﻿") for c in named]


_BOM = b"\xef\xbb\xbf"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[pa.Array]]]:
    """(facts, arrays of lines) of each block of a file, as the text reader cut it."""
    for slices in grouped_slices(batches, ["file", "block"]):
        begin = next(slices)
        facts = begin.drop_columns(["value"]).slice(0, 1).to_pylist()[0]
        values = begin.column("value")
        if facts["block"] == 0 and values[0].as_py().startswith(_BOM):
            first = pa.array([values[0].as_py().removeprefix(_BOM)], values.type)
            values = pa.concat_arrays([first, values.slice(1)])
        yield facts, itertools.chain([values], (piece.column("value") for piece in slices))


def _block_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of a file that may have several: its quotes, its lines, and how it begins.

    ``head`` are the lines up to the first with an odd number of quotes: what ends a record that an earlier block left open.
    """
    for first, arrays in _blocks(batches):
        if not first["large"]:
            continue
        quotes = count = 0
        head, closed = [], False
        for values in arrays:
            found = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
            if not closed and len(head) <= MOST_HEAD_LINES:
                odd = np.flatnonzero(found % 2)
                closed = len(odd) > 0 and len(head) + int(odd[0]) <= MOST_HEAD_LINES
                most = int(odd[0]) + 1 if closed else MOST_HEAD_LINES + 1 - len(head)
                head += values.slice(0, most).to_pylist()
            quotes += int(found.sum())
            count += len(values)
        if not closed and len(head) > MOST_HEAD_LINES:
            head = head[:1]
        opening = head[0] if first["block"] == 0 and head else None
        yield pa.RecordBatch.from_pydict(
            {
                "file": pa.array([first["file"]], pa.string()),
                "block": pa.array([first["block"]], pa.int64()),
                "quotes": pa.array([quotes], pa.int64()),
                "lines": pa.array([count], pa.int64()),
                "head": pa.array([b"\n".join(head)], pa.binary()),
                "closed": pa.array([closed]),
                "opening": pa.array([opening], pa.binary()),
            }
        )


# What the second pass knows of a block.
_KNOWN = {"odd": "boolean", "lines_before": "bigint", "opening": "binary", "tail": "binary", "tail_lost": "boolean"}


def _text(line: bytes) -> str:
    return line.decode("utf-8")


class _Header:
    """Where the required columns are in the rows of a file."""

    def __init__(self, cells: list[str], expected: list[str] | None):
        names = [c.strip().lstrip("﻿") for c in cells]
        missing = [c for c in _REQUIRED if c not in names]
        if names and missing:
            raise ValueError(f"missing required columns {missing}")
        if names and expected is not None and names != expected:
            raise ValueError(f"header differs: {names}")
        self.at = [names.index(c) for c in _REQUIRED] if names else []


# Line ends, control characters, quotes and white space that is no blank or tab: lines with any are left to ``csv``.
_SPECIAL = '[\x00-\x08\n-\x1f"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]'


def _plain_cells(values: pa.Array, at: list[int]) -> list[pa.Array] | None:
    """The wanted cells of lines without quotes, which are what is between commas; None if a line may need more than that."""
    try:
        text = values.cast(pa.string())
    except pa.ArrowInvalid:
        return None
    # The longest cell that ``csv`` takes.
    if (pc.max(pc.binary_length(values)).as_py() or 0) > csv.field_size_limit():
        return None
    if pc.any(pc.match_substring_regex(text, _SPECIAL)).as_py():
        return None
    cells = pc.split_pattern(text, ",")
    if pc.min(pc.list_value_length(cells)).as_py() <= max(at):
        return None
    return [pc.utf8_trim(pc.list_element(cells, i), " \t") for i in at]


def _parser(strict: bool, expected: list[str] | None):
    """Rows (file, line, error, cells…) of the lines of blocks."""

    def rows_of(header: _Header | None, before: int, lines: Iterator[bytes]) -> Iterator[tuple]:
        reader = csv.reader(_text(line) + "\n" for line in lines)
        line = before + 1
        for row in reader:
            if header is None:
                header = _Header(row, expected)
                if not header.at:
                    return
            elif row:
                short = None if len(row) > max(header.at) else f"line {line}: {len(row)} fields"
                if short and strict:
                    raise ValueError(short)
                yield line, short, *[row[i].strip() if i < len(row) else None for i in header.at]
            line = before + reader.line_num + 1

    def read(first: dict, arrays: Iterator[pa.Array]) -> Iterator[tuple | pa.RecordBatch]:
        before, header = 0, None
        if first["block"] > 0:
            if first["opening"] is None:
                raise RuntimeError(f"{first['file']}: the file changed while it was read")
            header = _Header(next(csv.reader([_text(first["opening"])]), []), expected)
            before = first["lines_before"]
        if first["tail_lost"]:
            raise ValueError("a quoted field goes on over more than a block")
        # Up to the first lines that need ``csv``, whole arrays are cut at once.
        for values in arrays if not first["odd"] else ():
            rest = values
            if header is None and _plain_cells(values.slice(0, 1), [0]) is not None:
                header = _Header(next(csv.reader([_text(values[0].as_py())]), []), expected)
                if not header.at:
                    return
                before, rest = 1, values.slice(1)
            cells = _plain_cells(rest, header.at) if header is not None and len(rest) else None
            if cells is None and len(rest):
                arrays = itertools.chain([rest], arrays)
                break
            if cells is not None:
                path = pa.array([first["file"]], pa.string()).take(pa.array(np.zeros(len(rest), np.int64)))
                line = pa.array(np.arange(before + 1, before + 1 + len(rest)), pa.int64())
                columns = [path, line, pa.nulls(len(rest), pa.string()), *cells]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "line", "error", *_TEXT])
                before += len(rest)
        lines = (line for values in arrays for line in values.to_pylist())
        if first["odd"]:
            # The end of a record that belongs to the block before.
            for line in lines:
                before += 1
                if line.count(b'"') % 2:
                    break
        if first["tail"] is not None:
            lines = itertools.chain(lines, first["tail"].split(b"\n"))
        yield from rows_of(header, before, lines)

    def frame(path: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        arrays = [pa.array([path] * len(rows), pa.string()), pa.array(columns[0], pa.int64())]
        arrays += [pa.array(c, pa.string()) for c in columns[1:]]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "line", "error", *_TEXT])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, arrays in _blocks(batches):
            held, path = [], first["file"]
            try:
                for row in read(first, arrays):
                    if isinstance(row, pa.RecordBatch):
                        yield row
                        continue
                    held.append(row)
                    if len(held) >= ROWS_AT_ONCE:
                        yield frame(path, held)
                        held = []
            except (ValueError, csv.Error) as error:
                if strict:
                    raise ValueError(f"{path}: {error}") from error
                # A file that cannot be used says so once, not in each of its blocks.
                if first["block"] == 0 or not str(error).startswith(("missing", "header")):
                    held.append((None, str(error), *[None] * len(_TEXT)))
            if held:
                yield frame(path, held)

    return parse


def _read_by_header(spark: SparkSession, paths: str | Sequence[str], strict: bool, expected: list[str] | None) -> DataFrame:
    """Rows of CSV files, each by its own header, large files in several tasks.

    Spark's text reader cuts files into blocks of whole lines, in any store it reads. A file of one block needs nothing
    else. Of those that may have several, a first pass counts each block's quotes and lines, so that the second knows whether
    a block begins inside a quoted field, which line it begins with, and how its last record ends.
    """
    cells = ", ".join(f"{c} string" for c in _TEXT)
    schema = f"file string, line bigint, error string, {cells}"
    columns = ["file", "block", *_KNOWN, "value"]
    conf = spark.conf
    sizes = [conf.get(f"spark.sql.files.{name}") for name in ("maxPartitionBytes", "openCostInBytes")]
    uncut = min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(s) for s in sizes)
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths)
    lines = text.select(
        decoded_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.col("_metadata.file_size") > uncut).alias("large"),
        F.col("value").cast("binary").alias("value"),
    )
    if _files(spark, paths).where(F.col("length") > uncut).isEmpty():
        none = {c: F.lit(None).cast(kind) for c, kind in _KNOWN.items()}
        return lines.withColumns(none).select(*columns).mapInArrow(_parser(strict, expected), schema)
    facts = lines.mapInArrow(
        _block_facts, "file string, block bigint, quotes bigint, lines bigint, head binary, closed boolean, opening binary"
    )
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    open_at_end = F.sum("quotes").over(upto) % 2 == 1
    known = facts.select(
        "file",
        "block",
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"),
        F.sum("lines").over(before).alias("lines_before"),
        F.first("opening", ignorenulls=True).over(upto).alias("opening"),
        F.when(open_at_end, F.lead("head").over(along)).alias("tail"),
        (open_at_end & (F.lead("closed").over(along) == F.lit(False))).alias("tail_lost"),
        F.lead("block").over(along).alias("_next"),
    )
    # Files of one block need none of it.
    several = kept(known.where("block > 0 OR _next IS NOT NULL").drop("_next"))
    if is_small(several, selective=True):
        placed = lines.join(F.broadcast(several), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("_at", F.monotonically_increasing_id())
        joined = numbered.join(several, ["file", "block"], "left")
        placed = joined.repartition("file", "block").sortWithinPartitions("file", "block", "_at").drop("_at")
    return placed.select(*columns).mapInArrow(_parser(strict, expected), schema)


def read_detections_parquet(
    spark: SparkSession, paths: str | Sequence[str], include: Sequence[str] = ()
) -> DataFrame:
    """Result Parquet files with the core columns and any of the metadata columns."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schemas.detections_with(list(include))).parquet(*listed)


def read_result_documents(
    spark: SparkSession, paths: str | Sequence[str], lines: bool = False
) -> DataFrame:
    """Result documents, one row each, nested.

    A file holds one document over many lines or, with ``lines``, one document per line.
    """
    return spark.read.schema(schemas.RESULT_DOCUMENT).json(
        paths, multiLine=not lines, recursiveFileLookup=True
    )


def document_detections(documents: DataFrame) -> DataFrame:
    """Flat detections of result documents, with each document's settings."""
    return documents.select(
        F.col("source_file").alias("file"),
        "model",
        F.col("settings.min_confidence").alias("min_conf"),
        F.col("settings.overlap").alias("overlap"),
        F.col("settings.lat").alias("lat"),
        F.col("settings.lon").alias("lon"),
        F.col("settings.week").alias("week"),
        F.inline("detections"),
    ).withColumnsRenamed({"start_time": "start_s", "end_time": "end_s"})


def document_summaries(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("source_file").alias("file"), "model", "summary.*").distinct()
