"""Label files, species lists and region manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus import schemas


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, label) of the non-blank lines of one file, trimmed, in file order.

    The file is read whole because the order of its lines carries meaning; label files are
    small (tens of thousands of lines at most).
    """
    whole = spark.read.text(path, wholetext=True)
    trimmed = F.transform(
        F.split("value", r"\r?\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    )
    kept = F.filter(trimmed, lambda line: line != "")
    return whole.select(F.posexplode(kept).alias("class_index", "label"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Class labels; the line order is the class index. A file without labels is an error."""
    labels = _lines(spark, path)
    if labels.isEmpty():
        raise ValueError(f"{path} contains no labels")
    return labels


def read_species_list(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of a species list, trimmed; their order means nothing, so any number of tasks reads them."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("label"))
    return lines.where("label <> ''")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region coverage, one row per region of a manifest keyed by region slug."""
    kind = T.MapType(T.StringType(), schemas.REGION)
    entries = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", kind)).alias("slug", "entry")
    )
    return entries.select("entry.*", "slug").withColumn(
        "region", F.coalesce("region", "slug")
    ).drop("slug")
