"""Species expected at sites and dates, in a classifier's own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.calendar import day_to_month_day, model_week, week_start_day
from dawnchorus.operators.scoring import occurrence_scores
from dawnchorus.operators.species import species_list, species_map


def with_query_week(sites: DataFrame) -> DataFrame:
    """Week to score at: a requested week snaps to its first day, a date is used as it is.

    Needs (week, month, day), each nullable; rows with neither a week nor a date drop out.
    Adds ``reported_week``: the requested week, else the date's.
    """
    snapped = day_to_month_day(week_start_day(F.col("week")))
    month = F.coalesce(snapped["month"], F.col("month"))
    day = F.coalesce(snapped["day"], F.col("day"))
    return (
        sites.withColumn("_scored", model_week(month, day))
        .withColumn("reported_week", F.coalesce(F.col("week"), F.col("_scored")))
        .filter(F.col("_scored").isNotNull())
        .drop("week")
        .withColumnRenamed("_scored", "week")
    )


def site_species_lists(
    sites: DataFrame,
    weights: DataFrame,
    classifier_labels: DataFrame,
    threshold: float = K.DEFAULT_SPECIES_LIST_THRESHOLD,
    sort: str | None = "freq",
) -> DataFrame:
    """Species list of every distinct (lat, lon, week)."""
    known = weights.select(F.col("species").alias("label"))
    mapping = species_map(known, classifier_labels)
    scores = occurrence_scores(sites, weights)
    return species_list(scores, mapping, threshold, sort, by=["lat", "lon", "week"])
