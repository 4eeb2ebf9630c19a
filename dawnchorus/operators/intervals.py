"""Interval work: merging detections into clips and joining by overlap."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.scale import opens_group, same_range, sorted_ranges, time_block

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEY = ["file", "scientific_name"]
# A shuffled side may be hashed in place of sorting both where none of its partitions was measured above this.
HASHED_PARTITION_BYTES = 64 << 20


def _check_padding(*values: float) -> None:
    for value in values:
        if not 0.0 <= value <= K.MAX_PADDING_S:
            raise ValueError(f"padding must be between 0 and {K.MAX_PADDING_S:g}: {value}")


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted padded detections.

    Columns are the keys, the group's first common name, ``_s``, ``_e``, ``_c``, ``_n`` (rows merged) and ``_head`` (of the group that
    the range begins with). The latest run stays open and goes in front of the next batch, as a row that stands for
    those it holds.
    """
    held, head = None, 1
    for batch in batches:
        if not batch.num_rows:
            continue
        ones = pa.array(np.ones(batch.num_rows, np.int64))
        rows = batch.select([*_KEY, "common_name", "_s", "_e", "_c"]).append_column("_n", ones)
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
        start, end, confidence, count = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "_e", "_c", "_n"))
        opens = opens_group(rows, _KEY, None)
        group = np.cumsum(opens) - 1
        reach = pd.Series(end).groupby(group).cummax().to_numpy()
        new = opens.copy()
        new[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(new)
        names = rows.column("common_name").take(pa.array(np.flatnonzero(opens)[group[at]]))
        merged = [np.maximum.reduceat(end, at), np.fmax.reduceat(confidence, at), np.add.reduceat(count, at)]
        keys = [rows.column(k).take(pa.array(at)) for k in _KEY]
        # A run without any confidence has none.
        columns = [*keys, names, pa.array(start[at]), *[pa.array(m, from_pandas=True) for m in merged]]
        runs = pa.RecordBatch.from_arrays(columns, schema=rows.schema)
        heads = np.where(group[at] == 0, head, 0)
        if group[-1] > 0:
            head = 0
        held = runs.slice(runs.num_rows - 1)
        if runs.num_rows > 1:
            yield runs.slice(0, runs.num_rows - 1).append_column("_head", pa.array(heads[:-1], pa.int64()))
    if held is not None:
        yield held.append_column("_head", pa.array([head], pa.int64()))


def _noting_first(batches: Iterator[pa.RecordBatch], first: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows and not first:
            first.extend(batch.column(c)[0].as_py() for c in ("_range", "_row"))
        yield batch


def _runs_of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged runs with their range and its first row."""
    first: list[int] = []
    for runs in _merged_runs(_noting_first(batches, first)):
        for name, value in zip(("_range", "_first"), first):
            runs = runs.append_column(name, pa.array(np.full(runs.num_rows, value, np.int64)))
        yield runs


def _edges_of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows: the range's first group, and its last with that one's latest run."""
    first: list[int] = []
    begins = ends = None
    for runs in _merged_runs(_noting_first(batches, first)):
        begins = runs.slice(0, 1) if begins is None else begins
        ends = runs.slice(runs.num_rows - 1)
    names = [field.split()[0] for field in _EDGE.split(", ")]
    for row, head in ((begins, 1), (ends, 0)) if first else ():
        times = [pa.nulls(1, pa.float64()) if head else row.column(c) for c in ("_s", "_e")]
        facts = [pa.array([v], pa.int64()) for v in (*first, head)]
        yield pa.RecordBatch.from_arrays([*[row.column(c) for c in [*_KEY, "common_name"]], *times, *facts], names=names)


_NAMES = "file string, scientific_name string, common_name string, _s double, _e double"
_RUN = f"{_NAMES}, _c float, _n bigint, _head bigint, _range bigint, _first bigint"
_EDGE = f"{_NAMES}, _range bigint, _first bigint, _head bigint"


def _carried(edges: DataFrame) -> DataFrame:
    """For every range: how far the ranges before it reach into its first group, and where their last run began."""
    along = Window.partitionBy(*_KEY).orderBy("_range", F.desc("_head"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("_reach")
    return (
        edges.withColumn("_reach", F.max("_e").over(before))
        .withColumn("_first_name", F.first(F.struct("common_name")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_open", F.when(reach.isNull() | (F.col("_s") > reach), F.col("_s")))
        .withColumn("_from", F.max("_open").over(before))
        .where("_head = 1")
        .select("_range", F.col("_first").alias("_expected"), "_reach", "_from", "_first_name")
    )


def merge_detections(det: DataFrame, pre: float = K.DEFAULT_PADDING_S, post: float = K.DEFAULT_PADDING_S) -> DataFrame:
    """Merge padded detections of a species in a recording into clips.

    Ranges are ``[max(0, start - pre), end + post]``; ranges that overlap or touch merge. A
    clip has the least start, greatest end, greatest confidence and the number of merged
    detections; its common name is that of the species' earliest detection in the recording. Detections without a
    recording or species are groups of their own, apart from those with an empty one.

    Expects finite times (see ``finite_rows``). Detections are shuffled once, into sorted ranges of (file, species,
    start), so a recording or species that holds a large share of all rows is spread over many tasks. A task merges the
    runs of its range; one row per range tells the next ones how far it reaches, and a second shuffle joins
    the runs that go on.
    """
    _check_padding(pre, post)
    padded = det.select(
        *_KEY,
        "common_name",
        (F.col("start").cast("double") - pre).alias("_s"),
        (F.col("end").cast("double") + post).alias("_e"),
        F.col("confidence").cast("float").alias("_c"),
    ).where("_s IS NOT NULL AND _e IS NOT NULL")
    keys = [*_KEY, "_s", "common_name", "_e", "_c"]
    spread = sorted_ranges(padded, [F.col(k) for k in keys])
    runs = spread.mapInArrow(_runs_of_range, _RUN)
    # One row per range, however many rows there are.
    carried = F.broadcast(_carried(spread.mapInArrow(_edges_of_range, _EDGE)))
    joined = runs.join(carried, "_range", "left")
    goes_on = (F.col("_head") == 1) & F.col("_reach").isNotNull()
    start = F.when(goes_on & (F.col("_s") <= F.col("_reach")), F.col("_from")).otherwise(F.col("_s"))
    name = F.when(goes_on, F.col("_first_name.common_name")).otherwise(F.col("common_name"))
    return (
        joined.select(*_KEY, name.alias("_name"), start.alias("_start"), "_e", "_c", same_range(F.col("_n")).alias("_n"))
        .groupBy(*_KEY, "_name", "_start")
        .agg(F.max("_e").alias("end"), F.max("_c").alias("conf"), F.sum("_n").alias("n"))
        .select(
            "file",
            "scientific_name",
            F.col("_name").alias("common_name"),
            F.greatest(F.lit(0.0), F.col("_start")).alias("start"),
            "end",
            F.col("conf").alias("max_confidence"),
            F.col("n").alias("detection_count"),
        )
    )


def clip_common_names(det: DataFrame) -> DataFrame:
    """Common name of each species' earliest detection in each recording."""
    firsts = det.groupBy(*_KEY, "common_name").agg(F.min("start").alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy("_first", "common_name"))
    return firsts.withColumn("_rank", rank).filter("_rank = 1").select(*_KEY, "common_name")


def clip_order(clips: DataFrame) -> DataFrame:
    """Range-partitioned by (file, start) and sorted, so long recordings stay split."""
    order = ["file", "start", "scientific_name"]
    return clips.repartitionByRange(*order).sortWithinPartitions(*order)


def direct_clip(audio: str, start: float, end: float, pre: float, post: float) -> dict:
    """Clip row for a range named by hand; raises on an unusable range."""
    _check_padding(pre, post)
    if not (0.0 <= start < end < float("inf")):
        raise ValueError(f"invalid time range: {start} to {end}")
    return {
        "file": audio,
        "scientific_name": f"detection_{start:.0f}-{end:.0f}",
        "common_name": "",
        "start": max(start - pre, 0.0),
        "end": end + post,
        "max_confidence": 1.0,
        "detection_count": 1,
    }


def _buckets(start, end, width: float):
    return F.sequence(time_block(start, width), time_block(end, width))


def detections_in_clips(det: DataFrame, clips: DataFrame, width: float = 60.0) -> DataFrame:
    """Each detection with the clip of its recording and species that contains it.

    Clip columns other than the keys come prefixed with ``clip_``.

    A detection has one time bucket, a clip one row per bucket it spans, so the join is an
    equi-join on (file, species, bucket) with a small residual test.
    """
    left = det.withColumn("_bucket", time_block(F.col("start"), width))
    right = clips.select(
        *[F.col(k).alias(f"_{k}") for k in _KEY],
        *[F.col(c).alias(f"clip_{c}") for c in clips.columns if c not in _KEY],
        F.explode(_buckets(F.col("start"), F.col("end"), width)).alias("_clip_bucket"),
    )
    inside = (F.col("start") >= F.col("clip_start")) & (F.col("end") <= F.col("clip_end"))
    same = F.col("_bucket") == F.col("_clip_bucket")
    for key in _KEY:
        # A null key is one of its own here, too.
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return left.join(right, same & inside).drop("_bucket", "_clip_bucket", *[f"_{k}" for k in _KEY])


def segments_for_clips(
    segments: DataFrame, clips: DataFrame, width: float = 60.0
) -> DataFrame:
    """Segments that overlap a clip (half-open), with the shared range.

    Both sides are spread over the buckets they span; a pair is kept only in the first bucket
    the two have in common, which keeps every pair exactly once.

    Sets ``spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold`` of the session: clips are hashed where their
    measured partitions are small, so that the segments, far more rows, need no sort; else both sides are sorted.
    """
    segments.sparkSession.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(HASHED_PARTITION_BYTES))
    s0, s1 = F.col("start_s").cast("double"), F.col("end_s").cast("double")
    left = segments.withColumn("_sb", time_block(s0, width)).withColumn(
        "_bucket", F.explode(_buckets(s0, s1, width))
    )
    right = clips.select(
        "file",
        "scientific_name",
        F.col("start").alias("clip_start"),
        F.col("end").alias("clip_end"),
        time_block(F.col("start"), width).alias("_cb"),
        F.explode(_buckets(F.col("start"), F.col("end"), width)).alias("_bucket"),
    )
    overlap = (s1 > F.col("clip_start")) & (s0 < F.col("clip_end"))
    once = F.col("_bucket") == F.greatest("_sb", "_cb")
    return (
        left.join(right, ["file", "_bucket"])
        .filter(once & overlap)
        .withColumn("from_s", F.greatest(s0, F.col("clip_start")))
        .withColumn("to_s", F.least(s1, F.col("clip_end")))
        .drop("_bucket", "_sb", "_cb")
    )
