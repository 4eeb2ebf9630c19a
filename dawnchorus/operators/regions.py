"""Choosing a regional model variant for each recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.scale import broadcast_if_bounded


def region_coverage(regions: DataFrame) -> DataFrame:
    """(country, region, coverage, rank): wholly covered countries rank before partial ones."""

    def level(name: str, rank: int) -> DataFrame:
        return regions.select(
            F.explode(f"countries.{name}").alias("country"),
            "region",
            "group_order",
            F.lit(name).alias("coverage"),
            F.lit(rank).alias("rank"),
        )

    return level("core", 0).unionByName(level("partial", 1))


def assign_region(recordings: DataFrame, regions: DataFrame) -> DataFrame:
    """Best region of each recording's country; null where no region covers it.

    The choice is made once per country, so the recordings need only one lookup join.
    """
    order = Window.partitionBy("country").orderBy("rank", "group_order", "region")
    best = (
        region_coverage(regions)
        .withColumn("_place", F.row_number().over(order))
        .filter("_place = 1")
        .select("country", "region", "coverage")
    )
    return recordings.join(broadcast_if_bounded(best), "country", "left")
