"""From scored predictions to ordered detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.labels import label_common, label_scientific
from dawnchorus.operators.ordering import detection_order
from dawnchorus.operators.quality import min_confidence
from dawnchorus.operators.scoring import classify_embeddings
from dawnchorus.operators.species import (
    filter_species_list,
    range_filter,
    range_filter_by_site,
    top_k,
)


@dataclass(frozen=True)
class AnalysisSettings:
    """Run parameters; metadata columns of the detections come from here."""

    min_confidence: float = K.DEFAULT_MIN_CONFIDENCE
    top_k: int = K.DEFAULT_TOP_K
    range_threshold: float = K.DEFAULT_RANGE_THRESHOLD
    unmatched: str = "keep"
    rerank: bool = False
    model: str | None = None
    overlap: float | None = None
    species_list_name: str | None = None
    ordered: bool = True


@dataclass(frozen=True)
class SiteRange:
    """Tables for range filtering with each recording's own site and week."""

    recordings: DataFrame
    scores: DataFrame
    mapping: DataFrame


@dataclass(frozen=True)
class EmbeddingHead:
    """Second-stage classifier replacing the first-stage predictions."""

    embeddings: DataFrame
    head: DataFrame


def to_detections(pred: DataFrame, settings: AnalysisSettings | None = None) -> DataFrame:
    """Split labels and attach run metadata."""
    settings = settings or AnalysisSettings()
    return pred.select(
        F.col("start_s").cast("float").alias("start_s"),
        F.col("end_s").cast("float").alias("end_s"),
        label_scientific(F.col("label")).alias("scientific_name"),
        label_common(F.col("label")).alias("common_name"),
        F.col("confidence").cast("float").alias("confidence"),
        "file",
        F.lit(settings.model).cast("string").alias("model"),
        F.lit(settings.overlap).cast("float").alias("overlap"),
        F.lit(settings.min_confidence).cast("float").alias("min_conf"),
        F.lit(settings.species_list_name).cast("string").alias("species_list"),
    )


def analyze(
    pred: DataFrame,
    settings: AnalysisSettings | None = None,
    projected: DataFrame | None = None,
    sites: SiteRange | None = None,
    species: DataFrame | None = None,
    second_stage: EmbeddingHead | None = None,
) -> DataFrame:
    """Ordered detections from per-segment predictions.

    The order is fixed: best k per segment, then range filtering (or, only when that is off,
    the species list), then the confidence threshold again, label split and sort. Top-k comes
    first, so out-of-range species can crowd out others, as intended. With a second stage the
    earlier filters have no effect, because its predictions replace the first ones.
    """
    settings = settings or AnalysisSettings()
    if second_stage is not None:
        scored = classify_embeddings(
            second_stage.embeddings,
            second_stage.head,
            k=None,
            carry=["file", "seg_idx", "start_s", "end_s"],
            min_score=settings.min_confidence,
        )
        kept = scored.withColumn("confidence", F.col("score").cast("float"))
    else:
        kept = top_k(min_confidence(pred, settings.min_confidence), settings.top_k)
        rules = (settings.range_threshold, settings.unmatched, settings.rerank)
        if sites is not None:
            kept = range_filter_by_site(
                kept, sites.recordings, sites.scores, sites.mapping, *rules
            )
        elif projected is not None:
            kept = range_filter(kept, projected, *rules)
        elif species is not None:
            kept = filter_species_list(kept, species)
    detections = to_detections(min_confidence(kept, settings.min_confidence), settings)
    return detection_order(detections) if settings.ordered else detections
