"""Detection order and running numbers inside a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.scale import number_rows


def _order():
    return [
        F.col("start_s"),
        F.col("confidence").desc(),
        F.col("scientific_name"),
        F.col("common_name"),
        F.col("end_s"),
    ]


def detection_order(det: DataFrame) -> DataFrame:
    """Sorted by file, start and falling confidence; partitions are (file, start) ranges."""
    keys = [F.col("file"), *_order()]
    return det.repartitionByRange(*keys).sortWithinPartitions(*keys)


def selection_number(det: DataFrame, name: str = "selection") -> DataFrame:
    """1-based number of each detection inside its recording's table."""
    return number_rows(det, ["file"], _order(), name)
