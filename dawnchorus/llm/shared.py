"""What several text operators share: durable intermediate results and bounded slices of long texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.session import checkpoint_root

# Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20

_SPACE = re.compile(r"\s")


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder.

    Reading them again needs no executor that took part in computing them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def mapped(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes: whole texts make rows far wider than most.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session; a larger row is a batch of its own.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text cut before white space into slices of about ``size`` characters; nothing is lost."""
    at = 0
    while len(text) - at > size:
        found = _SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (u, v) that reaches a smaller one; the root is the smallest.

    Alternates the large-star and small-star steps on (u, v) with u > v until nothing changes, which
    takes a number of rounds that grows with the logarithm of the longest chain. Every round is an
    aggregate with map-side combine and a join by node, so that a node with very many links is
    combined before the shuffle and its join partition can be split. Each round is kept durably.
    """
    pairs = durable(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = durable(small)
        state = pairs.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
