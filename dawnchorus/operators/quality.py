"""Filters, data-quality splits and parameter rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.numbers import at_least, is_finite
from dawnchorus.scale import broadcast_if_bounded


def min_confidence(df: DataFrame, threshold: float = K.DEFAULT_MIN_CONFIDENCE) -> DataFrame:
    """Keep rows whose single-precision confidence reaches the threshold."""
    return df.filter(at_least(F.col("confidence"), threshold))


def finite_flag(*columns: str) -> Column:
    flag = F.lit(True)
    for name in columns:
        flag = flag & is_finite(F.col(name))
    return flag


def finite_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rejected rows have a non-finite start, end or confidence."""
    flag = finite_flag("start", "end", "confidence")
    return df.filter(flag), df.filter(~flag)


def usable_range(start: Column, end: Column) -> Column:
    """Finite, not negative and increasing."""
    return is_finite(start) & is_finite(end) & (start >= 0) & (end > start)


def valid_ranges(df: DataFrame, on_bad: str = "file") -> DataFrame:
    """Apply the time-range rule.

    ``file``: one finite row with ``end <= start`` (or an unreadable number) drops all rows of
    its file, as an unreadable result file. ``row``: drop the row. ``raise``: fail the query.
    """
    if on_bad == "row":
        return df.filter(usable_range(F.col("start"), F.col("end")))
    if on_bad == "raise":
        checked = F.when(
            usable_range(F.col("start"), F.col("end")), F.col("start")
        ).otherwise(F.raise_error(F.lit("invalid time range")).cast("double"))
        return df.withColumn("start", checked)
    if on_bad != "file":
        raise ValueError(f"unknown policy {on_bad!r}")
    return df.join(broadcast_if_bounded(unordered_files(df), selective=True), "file", "left_anti")


def unordered_files(df: DataFrame) -> DataFrame:
    """Files that hold a finite row with ``end <= start``, or an unreadable number.

    Rows that are not finite are rejected on their own and never condemn their file.
    """
    bad = finite_flag("start", "end", "confidence") & (F.col("end") <= F.col("start"))
    if "malformed" in df.columns:
        bad = bad | F.col("malformed")
    return df.filter(bad).select("file").distinct()


def _outside(name: str, low: float, high: float) -> Column:
    value = F.col(name)
    return value.isNotNull() & (F.isnan(value.cast("double")) | ~value.between(low, high))


# (field, message) in the order the rules are checked.
_RULES: list[tuple[str, str]] = [
    ("min_confidence", "must be between 0 and 1"),
    ("overlap", "must be a finite non-negative number"),
    ("batch_size", "must be between 1 and 512"),
    ("day_of_year", "must be between 1 and 366"),
    ("formats", "must list at least one output format"),
    ("csv_columns", "has an unknown column"),
    ("latitude", "must be between -90 and 90"),
    ("longitude", "must be between -180 and 180"),
    ("range_threshold", "must be between 0 and 1"),
]


def _broken(field: str) -> Column:
    value = F.col(field)
    if field in ("min_confidence", "range_threshold"):
        return _outside(field, *K.CONFIDENCE_RANGE)
    if field == "overlap":
        return value.isNotNull() & (~is_finite(value) | (value < 0))
    if field == "batch_size":
        return _outside(field, K.MIN_BATCH_SIZE, K.MAX_BATCH_SIZE)
    if field == "day_of_year":
        return _outside(field, *K.DAY_OF_YEAR_RANGE)
    if field == "formats":
        return value.isNotNull() & (F.size(value) == 0)
    if field == "csv_columns":
        known = F.array(*[F.lit(c) for c in K.METADATA_COLUMNS])
        return value.isNotNull() & (F.size(F.array_except(value, known)) > 0)
    if field == "latitude":
        return _outside(field, *K.LATITUDE_RANGE)
    return _outside(field, *K.LONGITUDE_RANGE)


def rule_violations(
    params: DataFrame, key: str, models: DataFrame | None = None
) -> DataFrame:
    """One row (key, field, message) for every rule a parameter set breaks.

    Rules whose column is absent from ``params`` are skipped. With ``models`` (column
    ``model``) a named model that does not exist is a violation too.
    """
    present = [(f, m) for f, m in _RULES if f in params.columns]
    found = F.array(
        *[
            F.when(_broken(field), F.struct(F.lit(field).alias("field"), F.lit(m).alias("message")))
            for field, m in present
        ]
    )
    rows = params.select(key, F.inline(F.array_compact(found)))
    if models is None or "model" not in params.columns:
        return rows
    unknown = (
        params.filter(F.col("model").isNotNull())
        .join(broadcast_if_bounded(models.select("model").distinct()), "model", "left_anti")
        .select(key, F.lit("model").alias("field"), F.lit("does not exist").alias("message"))
    )
    return rows.unionByName(unknown)


def supports_range_filter(model_type: Column, bat_mode: Column) -> Column:
    return ~bat_mode & model_type.isin(*K.RANGE_FILTER_MODEL_TYPES)


def wants_range_filter(
    lat: Column, lon: Column, week: Column, month: Column, day: Column, supported: Column
) -> Column:
    """Both coordinates, a time (week, or month and day) and a supporting model."""
    timed = week.isNotNull() | (month.isNotNull() & day.isNotNull())
    return lat.isNotNull() & lon.isNotNull() & timed & supported
