"""Building blocks that keep hot groups and growing dimensions safe at scale."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.session import checkpoint_root

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A side is broadcast only after its rows and bytes were measured below these.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 << 20
# Measuring is skipped for sides estimated at more than this many times the byte bound.
MEASURE_FACTOR = 256
# Bits of one row of a bitmap, and the logarithm of the most bits of all its rows.
BITMAP_BITS = 1 << 15
LARGEST_BITMAP = 28


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def _width(name: str, kind: T.DataType) -> Column:
    """Approximate bytes of a value, without turning it into text where that can be avoided."""
    column = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(8)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of a DataFrame, from one distributed aggregate."""
    width = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return row["n"], row["b"] or 0


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, from file sizes; costs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    rows, size = measured(df)
    return rows <= max_rows and size <= max_bytes


def is_small(
    df: DataFrame,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
    selective: bool = False,
) -> bool:
    """Whether the measured size allows a broadcast.

    A side read from far more data than may be broadcast is not even measured, unless it is
    ``selective``: expected to keep few rows of much data, where a scan of some columns costs
    less than shuffling the other side.
    """
    if not selective and estimated_bytes(df) > MEASURE_FACTOR * max_bytes:
        return False
    return fits_broadcast(df, max_rows, max_bytes)


def _left_to_spark(df: DataFrame) -> bool:
    """Whether Spark broadcasts this side by its own size rule, hint or not."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(df) <= int(conf.autoBroadcastJoinThreshold())


def broadcast_if_bounded(df: DataFrame, selective: bool = False) -> DataFrame:
    """Hint a broadcast only when the measured size allows it.

    Beyond the bound the DataFrame is returned without a hint: the join then shuffles
    and AQE splits its skewed partitions. Sides below Spark's own broadcast threshold need no
    hint, so they are not measured.
    """
    if _left_to_spark(df):
        return df
    return F.broadcast(df) if is_small(df, selective=selective) else df


def _bitmap(keys: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """A bitmap of the keys' hashes, 32 MB at most however many keys there are, and whether the names of a row joined to it are in it."""
    bits = 1 << min(max(16 * keys.count(), BITMAP_BITS).bit_length(), LARGEST_BITMAP)
    place = F.xxhash64(*[f"`{n}`" for n in names]).bitwiseAND(F.lit(bits - 1))
    block = F.shiftrightunsigned(place, BITMAP_BITS.bit_length() - 1)
    bit = place.bitwiseAND(F.lit(BITMAP_BITS - 1))
    known = keys.where(_filled(names)).select(block.alias("_block"), bit.alias("_bit"))
    maps = known.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As numbers, which are read without making a value of each row's byte.
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (BITMAP_BITS // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, words)], names=["_block", "_words"])

    maps = maps.mapInArrow(run, "_block long, _words array<long>")
    word = F.get("_words", F.shiftrightunsigned(bit, 6).cast("int"))
    is_set = F.call_function("getbit", word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.broadcast(maps), (block == F.col("_block")) & is_set


def _filled(names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"`{n}`").isNotNull() for n in names])


def possibly_among(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """All rows whose ``name`` is among the keys, and a few others (one in 16 at most, up to 16 million keys).

    A bitmap of the keys' hashes is broadcast, 32 MB at most however many keys there are, so a later join by key shuffles few rows in
    vain. Both columns must be of one type; rows without a key are dropped.
    """
    return df.where(_filled([name])).join(*_bitmap(keys, [name]), "left_semi")


def without(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose values in the columns of ``keys`` are none of the keys, nulls alike.

    Only rows that may be among them (``possibly_among``) and those with nulls are shuffled. ``df`` and the keys are read more than once.
    """
    names = keys.columns
    maps, among = _bitmap(keys, names)
    filled = df.where(_filled(names))
    perhaps = filled.join(maps, among, "left_semi").unionAll(df.where(~_filled(names)))
    gone = keys.toDF(*[f"__gone{i}__" for i in range(len(names))])
    same = [F.col(f"`{n}`").eqNullSafe(F.col(f"__gone{i}__")) for i, n in enumerate(names)]
    return filled.join(maps, among, "left_anti").unionAll(perhaps.join(gone, reduce(and_, same), "left_anti"))


def parameter_blocks(df: DataFrame) -> list[DataFrame]:
    """A parameter table in parts that each may be broadcast; one part if all of it may.

    The number of parts comes from the measured rows and bytes; rows go to parts by their hash.
    """
    rows, size = measured(df)
    parts = max(1, -(-rows // BROADCAST_MAX_ROWS), -(-size // BROADCAST_MAX_BYTES))
    if parts == 1:
        return [df]
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    return [df.filter(part == i) for i in range(parts)]


def unfolded(rows: DataFrame, parameters: DataFrame, item: Column, order: Sequence[str]) -> DataFrame:
    """Every row with the fields of every parameter: the full output, without a join.

    Each part of the parameter table is evaluated once, as an array that a scalar subquery attaches;
    a larger table makes more parts, never an error.
    """
    out = None
    for part in parameter_blocks(parameters):
        keyed = F.struct(*[F.col(c) for c in order], item.alias("item"))
        listed = F.transform(F.array_sort(F.collect_list(keyed)), lambda r: r["item"])
        array = part.agg(listed.alias("rows")).scalar()
        found = rows.select("*", F.inline(array))
        out = found if out is None else out.unionByName(found)
    return out


def evaluated_once(value: Column) -> Column:
    """The value, as a generator of one row: what reads or filters it above does not compute it again, as it would in a projection."""
    return F.explode(F.array(value))


def time_block(seconds: Column, width: float) -> Column:
    return F.floor(seconds / F.lit(float(width)))


def sorted_ranges(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows in sorted ranges of the keys, equal ones spread as well; adds ``_row``, a number of each row, and ``_range``.

    With a number of partitions of its own the shuffle is read as it was written, so all readers of one plan
    see the same ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = [*keys, F.col("_row")]
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    spread = numbered.repartitionByRange(ranges, *placed)
    # As a column: a task's own number is another one where its stage has further inputs.
    return spread.withColumn("_range", F.spark_partition_id().cast("long")).sortWithinPartitions(*placed)


def same_range(value: Column) -> Column:
    """The value, after a check that both readers of the ranges saw the same first row (``_expected``, ``_first``)."""
    same = F.col("_expected").eqNullSafe(F.col("_first"))
    return F.when(same, value).otherwise(F.raise_error(F.lit("row ranges changed while they were read")).cast("long"))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based row number inside ``group``, without putting a whole group into one task.

    Rows are shuffled once, into sorted ranges of (group, order), so a group or a pile of equal rows
    that holds a large share of all rows spreads over several tasks. Each task numbers the rows of its range from its
    first row of the group on; the first group of a range goes on from the ranges before it, and what those hold of
    it is one small row per range. Columns not in ``order`` break its ties, so a repeated task numbers its rows as
    before. A null key is a group of its own, apart from empty text.
    """
    ties = [F.col(f"`{c}`") for c in df.columns if c not in group]
    spread = sorted_ranges(df, [*[F.col(f"`{c}`") for c in group], *order, *ties])
    width = df.schema
    local = T.StructType([*width.fields, *[T.StructField(n, T.LongType()) for n in ("_n", "_range", "_first", "_head")]])
    numbered = spread.mapInArrow(_numbering(len(width), list(group)), local)
    edge = [T.StructField(f"_g{i}", width[g].dataType) for i, g in enumerate(group)]
    kinds = [T.StructField(n, T.LongType()) for n in ("_range", "_first", "_head", "_rows")]
    # The sort needs every column, so the narrower reader shares the shuffle and the sort order.
    narrow = spread.select(*[F.col(f"`{c}`") for c in group], "_range", "_row")
    edges = narrow.mapInArrow(_range_edges(list(group)), T.StructType([*edge, *kinds]))
    along = Window.partitionBy(*[f.name for f in edge]).orderBy("_range", F.desc("_head"))
    before = F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1))
    # One row per range, however many rows there are.
    carried = edges.withColumn("_before", F.coalesce(before, F.lit(0))).where("_head = 1")
    carried = carried.select("_range", F.col("_first").alias("_expected"), "_before")
    joined = numbered.join(F.broadcast(carried), "_range", "left")
    number = F.col("_n") + F.when(F.col("_head") == 1, F.col("_before")).otherwise(F.lit(0))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], same_range(number).alias(name))


def opens_group(table: pa.RecordBatch, group: Sequence[str], last: tuple | None) -> np.ndarray:
    """Whether each row's group is another one than that of the row before; ``last`` is that before the batch."""
    opens = np.zeros(table.num_rows, bool)
    for name in group:
        column = table.column(name)
        # Nulls are equal to each other and to nothing else.
        differ = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        null = column.is_null().to_numpy(zero_copy_only=False)
        opens[1:] |= pc.fill_null(differ, False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    opens[0] = last is None or last != group_at(table, group, 0)
    return opens


def grouped_slices(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[Iterator[pa.RecordBatch]]:
    """For each group of consecutive rows with equal keys, its rows as slices of batches; a group may go over many."""

    def pieces() -> Iterator[tuple[bool, pa.RecordBatch]]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = opens_group(batch, keys, last)
            last = group_at(batch, keys, batch.num_rows - 1)
            cuts = np.unique(np.append(np.flatnonzero(opens), [0, len(opens)]))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield bool(opens[low]), batch.slice(low, high - low)

    stream = pieces()
    ahead = next(stream, None)

    def group() -> Iterator[pa.RecordBatch]:
        nonlocal ahead
        yield ahead[1]
        ahead = next(stream, None)
        while ahead is not None and not ahead[0]:
            yield ahead[1]
            ahead = next(stream, None)

    while ahead is not None:
        rows = group()
        yield rows
        # What was not asked for is passed over.
        for _ in rows:
            pass


def group_at(table: pa.RecordBatch, group: Sequence[str], row: int) -> tuple:
    return tuple(table.column(name)[row].as_py() for name in group)


def _numbering(width: int, group: list[str]):
    """Adds to sorted rows their number in their group and range, the range, its first row, and if the group is its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, held, head = None, None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            opens = opens_group(batch, group, last)
            if first is None:
                first, opens[0] = batch.column("_row")[0].as_py(), False
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(opens, place, -1))
            number = np.where(begin >= 0, place - begin + 1, held + place + 1)
            # Only rows before the first opening belong to the group that the range begins with.
            heads = (begin < 0) & head
            head = bool(heads[-1])
            last, held = group_at(batch, group, n - 1), int(number[-1])
            begins = pa.array(np.full(n, first), pa.int64())
            made = [pa.array(number, pa.int64()), batch.column("_range"), begins, pa.array(heads.astype(np.int64))]
            names = [*batch.schema.names[:width], "_n", "_range", "_first", "_head"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)

    return run


def _range_edges(group: list[str]):
    """Two rows per range of sorted rows: its first group, and its last group with the rows it has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        rows = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begin = np.flatnonzero(opens_group(batch, group, last))
            rows = n - int(begin[-1]) if len(begin) else rows + n
            keys = [batch.column(g) for g in group]
            if first is None:
                at, row = (batch.column(c)[0].as_py() for c in ("_range", "_row"))
                first = [k.slice(0, 1) for k in keys]
            last, ends = group_at(batch, group, n - 1), [k.slice(n - 1, 1) for k in keys]
        if first is not None:
            names = [*[f"_g{i}" for i in range(len(group))], "_range", "_first", "_head", "_rows"]
            for columns, head, count in ((first, 1, 0), (ends, 0, rows)):
                facts = [pa.array([v], pa.int64()) for v in (at, row, head, count)]
                yield pa.RecordBatch.from_arrays([*columns, *facts], names=names)

    return run
