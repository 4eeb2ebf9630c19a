"""Appending per-recording result tables."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.constants import COMBINED_NAMES
from dawnchorus.storage import open_store

# Helpers of this module travel with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def combine_results(tables: Sequence[DataFrame]) -> DataFrame:
    """Append tables of identical schema; an empty list or a differing schema is an error."""
    if not tables:
        raise ValueError("no input tables to combine")
    expected = tables[0].dtypes
    for position, table in enumerate(tables[1:], start=1):
        if table.dtypes != expected:
            raise ValueError(f"schema mismatch in table {position}")
    return reduce(DataFrame.unionAll, tables)


def parquet_schemas(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, schema, error): the column names and types of every Parquet file under the paths, from its footer.

    Footers are read by tasks, through the file system of each path; only the listing is the driver's.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    files = listed.load(list(paths)).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"path": batch.column(0).to_pylist(), "schema": [], "error": []}
            for path in rows["path"]:
                schema = error = None
                try:
                    system, name = open_store(path)
                    with system.open_input_file(name) as file:
                        schema = ", ".join(f"{f.name} {f.type}" for f in pq.read_schema(file))
                except (OSError, pa.ArrowException) as failure:
                    error = str(failure)
                rows["schema"].append(schema)
                rows["error"].append(error)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, pa.string()) for c in rows]))

    # Many paths lie in one input partition, which is a listing and no data.
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(read, "path string, schema string, error string")


def combine_parquet(spark: SparkSession, paths: Sequence[str], target: str) -> None:
    """Combine Parquet result files into one table, as a single multi-path scan.

    All files must have the columns and types of the first by path; footers are compared in a job over the files.
    """
    if not paths:
        raise ValueError("no input files to combine")
    found = parquet_schemas(spark, paths)
    odd = found.groupBy("schema").agg(F.min("path").alias("path"), F.max("error").alias("error"))
    # One row per different schema.
    kinds = odd.orderBy("path").limit(2).collect()
    broken = [r for r in kinds if r["error"]]
    if broken:
        raise ValueError(f"unreadable file {broken[0]['path']}: {broken[0]['error']}")
    if len(kinds) > 1:
        raise ValueError(f"schema mismatch in {kinds[1]['path']}")
    whole = spark.read.parquet(*paths)
    whole.write.option("compression", "snappy").parquet(target)


def combined_path(folder: str, fmt: str) -> str:
    """Where the combined table of a format goes."""
    return f"{folder.rstrip('/')}/{COMBINED_NAMES[fmt]}"
