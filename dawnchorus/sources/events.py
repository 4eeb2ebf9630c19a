"""The event log: newline-delimited JSON envelopes with one payload shape per kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus import schemas
from dawnchorus.constants import EVENT_KINDS
from dawnchorus.scale import evaluated_once


def read_event_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Envelopes with the payload kept as text until a kind is chosen."""
    return spark.read.schema(schemas.EVENT_ENVELOPE).json(paths)


def payloads(envelopes: DataFrame, kind: str) -> DataFrame:
    """Envelopes of one kind with ``payload`` parsed by that kind's schema.

    Works on batch and streaming input alike.
    """
    if kind not in EVENT_KINDS:
        raise ValueError(f"unknown event kind {kind!r}")
    chosen = envelopes.filter(F.col("event") == kind)
    if kind not in schemas.PAYLOADS:
        return chosen
    parsed = evaluated_once(F.from_json("payload", schemas.PAYLOADS[kind])).alias("payload")
    return chosen.select(*[parsed if c == "payload" else F.col(f"`{c}`") for c in chosen.columns])


def event_detections(envelopes: DataFrame) -> DataFrame:
    """Detections carried by ``detections`` events, one row each."""
    return payloads(envelopes, "detections").select(
        "timestamp", F.col("payload.file").alias("file"), F.inline("payload.detections")
    ).withColumnsRenamed({"start_time": "start_s", "end_time": "end_s"})
