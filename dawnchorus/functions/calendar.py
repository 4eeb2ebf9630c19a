"""The 48-week model year on a non-leap calendar, and day-of-year resolution."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnchorus.constants import DAYS_IN_MONTH, DAYS_PER_WEEK, WEEKS_PER_YEAR

_MONTH_ENDS = list(accumulate(DAYS_IN_MONTH))
_DAYS_BEFORE = [0] + _MONTH_ENDS[:-1]


def _lookup(values: list[int], index: Column) -> Column:
    # Null beyond the list, such as for month 13.
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int") - 1)


def model_week(month: Column, day: Column) -> Column:
    """Week 1-48 of a calendar date; the leap day is ignored."""
    elapsed = _lookup(_DAYS_BEFORE, month) + day - 1
    week = F.floor(elapsed / F.lit(DAYS_PER_WEEK)) + 1
    # Not least(): that would turn an unknown week into the last one.
    return F.when(week > WEEKS_PER_YEAR, WEEKS_PER_YEAR).otherwise(week).cast("int")


def week_start_day(week: Column) -> Column:
    """First day of year of a model week."""
    return ((week - 1) * F.lit(DAYS_PER_WEEK) + F.lit(1.0)).cast("int")


def day_to_month_day(day_of_year: Column) -> Column:
    """struct(month, day); days past the year become December 31, day 0 stays (1, 0)."""
    passed = sum((day_of_year > end).cast("int") for end in _MONTH_ENDS[:-1])
    month = F.lit(1) + passed
    inside = F.struct(
        month.cast("int").alias("month"),
        (day_of_year - _lookup(_DAYS_BEFORE, month)).cast("int").alias("day"),
    )
    overflow = F.struct(F.lit(12).alias("month"), F.lit(31).alias("day"))
    return F.when(day_of_year > _MONTH_ENDS[-1], overflow).otherwise(inside)


def analysis_week(requested_week: Column) -> Column:
    """Week an analysis reports after snapping the request to that week's first day."""
    date = day_to_month_day(week_start_day(requested_week))
    return model_week(date["month"], date["day"])


def recording_day_of_year(given: Column, modified: Column) -> Column:
    """Explicit day of year if there is one, else that of the modification time."""
    return F.coalesce(given.cast("int"), F.dayofyear(modified))
