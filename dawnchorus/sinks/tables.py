"""Detections as CSV, Parquet, selection tables, label tracks and folder-based tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus import schemas
from dawnchorus.functions.labels import comma_separated, species_code, underscored
from dawnchorus.functions.numbers import fixed, plain
from dawnchorus.functions.paths import base_name, grandparent_path, parent_name
from dawnchorus.operators.ordering import selection_number

_BOM = "﻿"


def _time(name: str) -> Column:
    return fixed(F.col(name), K.TIME_DECIMALS)


def _confidence() -> Column:
    return fixed(F.col("confidence"), K.CONFIDENCE_DECIMALS)


def _metadata_text(df: DataFrame, name: str) -> Column:
    """Cell text of an optional column; empty for null, absent or unknown columns."""
    if name not in schemas.METADATA_TYPES or name not in df.columns:
        return F.lit("")
    text = name in ("model", "species_list")
    value = F.col(name) if text else plain(F.col(name))
    return F.coalesce(value.cast("string"), F.lit(""))


def to_csv_rows(det: DataFrame, include: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Text cells of the CSV table, with the asked-for metadata columns behind the core ones, then those to ``carry``."""
    names = ["scientific_name", "common_name", "file"]
    sci, common, file = (F.col(n) for n in names)
    cells = [_time("start_s"), _time("end_s"), sci, common, _confidence(), file]
    core = [cell.alias(title) for cell, title in zip(cells, K.CSV_HEADER)]
    extra = [_metadata_text(det, c).alias(c) for c in include]
    return det.select(*core, *extra, *carry)


def to_parquet_rows(
    det: DataFrame, include: Sequence[str] = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Typed rows of the Parquet table; the file column keeps the base name only.

    Columns to ``carry`` follow as they are, unless the table has them already.
    """
    wanted = schemas.detections_with(list(include))
    name = F.nullif(base_name(F.col("file")), F.lit(""))
    base = det.withColumn("file", F.coalesce(name, F.col("file")))
    return base.select(
        *[
            (F.col(f.name) if f.name in det.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ],
        *[c for c in carry if c not in wanted.names],
    )


def to_raven_rows(det: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Selection table, numbered per recording in detection order; columns to ``carry`` follow."""
    numbered = selection_number(det)
    cells = [
        F.col("selection"),
        F.lit(K.RAVEN_VIEW),
        F.lit(K.RAVEN_CHANNEL),
        _time("start_s"),
        _time("end_s"),
        F.lit(K.RAVEN_LOW_HZ),
        F.lit(K.RAVEN_HIGH_HZ),
        underscored(F.col("common_name")),
        species_code(F.col("common_name")),
        _confidence(),
        F.col("file"),
        _time("start_s"),
    ]
    return numbered.select(*[c.alias(t) for c, t in zip(cells, K.RAVEN_HEADER)], *carry)


def to_audacity_rows(det: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Label track: start, end, name, confidence; columns to ``carry``, such as the recording, follow."""
    return det.select(
        _time("start_s").alias("start"),
        _time("end_s").alias("end"),
        comma_separated(F.col("common_name")).alias("label"),
        _confidence().alias("confidence"),
        *carry,
    )


def to_kaleidoscope_rows(det: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Folder-based table with offset and duration; columns to ``carry`` follow."""
    file = F.col("file")
    length = F.col("end_s").cast("float") - F.col("start_s").cast("float")
    cells = [
        grandparent_path(file),
        parent_name(file),
        base_name(file),
        _time("start_s"),
        fixed(length, K.TIME_DECIMALS),
        underscored(F.col("common_name")),
        _confidence(),
    ]
    return det.select(*[c.alias(t) for c, t in zip(cells, K.KALEIDOSCOPE_HEADER)], *carry)


def _quoted(cell: Column) -> Column:
    special = F.lit(False)
    for mark in (",", '"', "\n"):
        special = special | F.contains(cell, F.lit(mark))
    doubled = F.replace(cell, F.lit('"'), F.lit('""'))
    return F.when(special, F.concat(F.lit('"'), doubled, F.lit('"'))).otherwise(cell)


def to_lines(rows: DataFrame, sep: str, quote: bool = False, carry: Sequence[str] = ()) -> Column:
    """One text line per row; with ``quote``, cells holding separators are quoted. Carried columns are no cells."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns if c not in carry]
    return F.concat_ws(sep, *[_quoted(c) if quote else c for c in cells])


@dataclass(frozen=True)
class TextFormat:
    """A text format: projection, cell separator, and whether it has quoting and a header."""

    rows: Callable[..., DataFrame]
    sep: str
    quote: bool = False
    header: bool = True


# Formats register here; adding one makes it available to write_results.
TEXT_FORMATS: dict[str, TextFormat] = {
    "csv": TextFormat(to_csv_rows, ",", quote=True),
    "raven": TextFormat(to_raven_rows, "\t"),
    "audacity": TextFormat(to_audacity_rows, "\t", header=False),
    "kaleidoscope": TextFormat(to_kaleidoscope_rows, ","),
}


def register_format(name: str, fmt: TextFormat) -> None:
    TEXT_FORMATS[name] = fmt


def write_text(rows: DataFrame, fmt: TextFormat, target: str, bom: bool = False) -> None:
    """Write projected rows as lines; each part file starts with the header if there is one."""
    title = fmt.sep.join(rows.columns)
    lines = rows.select(to_lines(rows, fmt.sep, fmt.quote).alias((_BOM if bom else "") + title))
    # One column per line: the writer's own separator and quoting must never apply.
    lines.write.csv(
        target,
        header=fmt.header,
        sep="\x01",
        quote="\x00",
        escape="\x00",
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_results(
    det: DataFrame, fmt: str, target: str, include: Sequence[str] = (), bom: bool = True
) -> None:
    """Write detections in a registered text format or as Parquet."""
    if fmt == "parquet":
        write_detections_parquet(det, target, include)
        return
    chosen = TEXT_FORMATS[fmt]
    rows = chosen.rows(det, include) if fmt == "csv" else chosen.rows(det)
    write_text(rows, chosen, target, bom=bom and fmt == "csv")


def write_detections_parquet(
    det: DataFrame, target: str, include: Sequence[str] = (), partition_by: Sequence[str] = ()
) -> None:
    """Snappy Parquet, optionally partitioned by columns such as site and date."""
    rows = to_parquet_rows(det, include, partition_by)
    rows.write.option("compression", "snappy").partitionBy(*partition_by).parquet(target)


def write_species_list(listed: DataFrame, target: str) -> None:
    """One label per line, in the order of the table."""
    listed.select("label").write.text(target)
