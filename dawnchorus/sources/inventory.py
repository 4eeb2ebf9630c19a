"""Recording inventory: audio files below some roots, without reading their content."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.constants import AUDIO_EXTENSIONS
from dawnchorus.functions.paths import extension

_LOG = logging.getLogger(__name__)

COLUMNS = "file string, length bigint, modified timestamp"


def existing_roots(spark: SparkSession, roots: Sequence[str]) -> list[str]:
    """Roots that exist; the others are skipped with a warning."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(conf).exists(path):
            found.append(root)
        else:
            _LOG.warning("skipping non-existent path: %s", root)
    return found


def audio_files(files: DataFrame) -> DataFrame:
    """Inventory rows from a file listing: audio extensions only, content pruned."""
    return files.filter(extension(F.col("path")).isin(*AUDIO_EXTENSIONS)).select(
        F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified")
    )


def recording_inventory(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    found = existing_roots(spark, roots)
    if not found:
        return spark.createDataFrame([], COLUMNS)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(found)
    return audio_files(listing)
