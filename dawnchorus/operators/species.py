"""Top-k, species lists, label mapping and occurrence-based range filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.labels import species_key
from dawnchorus.functions.numbers import at_least
from dawnchorus.scale import broadcast_if_bounded, unfolded

_SEGMENT = ["file", "seg_idx"]
# Keys among which rows without a species are dealt out.
SPREAD = 4096


def top_k(pred: DataFrame, k: int = K.DEFAULT_TOP_K) -> DataFrame:
    """Best ``k`` predictions of every segment, ties by class index.

    The row-number limit reaches the map side, so each task sends at most ``k`` rows of a
    segment through the shuffle.
    """
    order = [F.col("confidence").desc(), F.col("class_index"), F.col("label")]
    rank = F.row_number().over(Window.partitionBy(*_SEGMENT).orderBy(*order))
    return pred.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def rerank_order(pred: DataFrame, name: str = "position") -> DataFrame:
    """Position of each prediction inside its segment, most confident first."""
    order = [F.col("confidence").desc(), F.col("class_index"), F.col("label")]
    # A segment has at most as many predictions as there are classes.
    place = F.row_number().over(Window.partitionBy(*_SEGMENT).orderBy(*order))
    return pred.withColumn(name, place.cast("long"))


def filter_species_list(pred: DataFrame, species: DataFrame) -> DataFrame:
    """Keep predictions whose exact label is listed."""
    return pred.join(broadcast_if_bounded(species.select("label")), "label", "left_semi")


def label_winners(labels: DataFrame) -> DataFrame:
    """First label, in file order, of every species key."""
    return (
        labels.withColumn("species_key", species_key(F.col("label")))
        .groupBy("species_key")
        .agg(
            F.min_by("label", "class_index").alias("classifier_label"),
            F.count(F.lit(1)).alias("labels"),
        )
    )


def species_map(geo_labels: DataFrame, classifier_labels: DataFrame) -> DataFrame:
    """(species_key, classifier_label) for species known to both label sets."""
    known = geo_labels.select(species_key(F.col("label")).alias("species_key")).distinct()
    return label_winners(classifier_labels).drop("labels").join(
        known, "species_key", "left_semi"
    )


def label_collisions(labels: DataFrame) -> DataFrame:
    """(species_key, winner, loser): labels whose species key an earlier label took."""
    winners = label_winners(labels).filter("labels > 1")
    keyed = labels.withColumn("species_key", species_key(F.col("label")))
    return (
        keyed.join(broadcast_if_bounded(winners), "species_key")
        .filter(F.col("label") != F.col("classifier_label"))
        .select(
            "species_key",
            F.col("classifier_label").alias("winner"),
            F.col("label").alias("loser"),
        )
    )


def uncovered_labels(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Classifier labels without occurrence data."""
    covered = mapping.select(F.col("classifier_label").alias("label"))
    return labels.join(broadcast_if_bounded(covered), "label", "left_anti")


def _latest_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """One score per (by, species key): the last reported one wins."""
    keyed = scores.withColumn("species_key", species_key(F.col("species")))
    return keyed.groupBy(*by, "species_key").agg(
        F.max_by("score", "class_index").cast("float").alias("score")
    )


def project_scores(
    scores: DataFrame, mapping: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """A score for every mapped classifier label, 0 where none was reported.

    ``by`` names location/time columns; each distinct combination gets the full label set.
    """
    latest = _latest_scores(scores, by)
    if by:
        pair = F.struct("species_key", "classifier_label")
        wanted = scores.select(*by).distinct()
        seeds = unfolded(wanted, mapping, pair, ["species_key"])
    else:
        seeds = mapping
    score = F.coalesce(F.col("score"), F.lit(0.0).cast("float"))
    return (
        seeds.join(latest, [*by, "species_key"], "left")
        .withColumn("score", score)
        .select(*by, "species_key", "classifier_label", "score")
    )


def _check_policy(policy: str) -> None:
    if policy not in K.UNMATCHED_POLICIES:
        raise ValueError(f"unknown policy {policy!r}")


def range_filter(
    pred: DataFrame,
    projected: DataFrame,
    threshold: float = K.DEFAULT_RANGE_THRESHOLD,
    policy: str = "keep",
    rerank: bool = False,
) -> DataFrame:
    """Keep predictions of species that occur at the place and time.

    Species without occurrence data stay only under policy ``keep`` and without reranking,
    which multiplies confidence by the occurrence score.
    """
    _check_policy(policy)
    side = projected.select(F.col("classifier_label").alias("label"), F.col("score"))
    joined = pred.join(broadcast_if_bounded(side), "label", "left")
    unmapped = F.lit(policy == "keep" and not rerank)
    kept = joined.filter(
        F.when(F.col("score").isNull(), unmapped).otherwise(at_least(F.col("score"), threshold))
    )
    if rerank:
        kept = kept.withColumn("confidence", F.col("confidence") * F.col("score"))
    return kept.select(*pred.columns)


def range_filter_by_site(
    pred: DataFrame,
    recordings: DataFrame,
    scores: DataFrame,
    mapping: DataFrame,
    threshold: float = K.DEFAULT_RANGE_THRESHOLD,
    policy: str = "keep",
    rerank: bool = False,
) -> DataFrame:
    """Range filter with every recording's own site and week.

    ``recordings`` has (file, site, week, active); recordings that are unknown or not active
    pass unfiltered. ``scores`` has (site, week, species, class_index, score). Small sides are
    broadcast after being measured; otherwise the joins shuffle and AQE splits hot keys.
    """
    _check_policy(policy)
    where = recordings.select("file", "site", "week", "active")
    mapped = mapping.select(F.col("classifier_label").alias("label"), "species_key")
    latest = _latest_scores(scores, ["site", "week"]).withColumnRenamed("species_key", "_scored")
    # Rows that need no score get keys that no species has, many different ones, so that they make no hot key.
    needs = F.coalesce(F.col("active"), F.lit(False)) & F.col("species_key").isNotNull()
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("file", "seg_idx"), F.lit(SPREAD)).cast("string"))
    located = (
        pred.join(broadcast_if_bounded(where), "file", "left")
        .join(broadcast_if_bounded(mapped), "label", "left")
        .withColumn("_scored", F.when(needs, F.col("species_key")).otherwise(spread))
    )
    joined = located.join(broadcast_if_bounded(latest), ["site", "week", "_scored"], "left")
    active = F.coalesce(F.col("active"), F.lit(False))
    score = F.coalesce(F.col("score"), F.lit(0.0).cast("float"))
    unmapped = F.lit(policy == "keep" and not rerank)
    kept = joined.filter(
        F.when(~active, F.lit(True))
        .when(F.col("species_key").isNull(), unmapped)
        .otherwise(at_least(score, threshold))
    )
    if rerank:
        scaled = F.when(active, F.col("confidence") * score).otherwise(F.col("confidence"))
        kept = kept.withColumn("confidence", scaled)
    return kept.select(*pred.columns)


def species_list(
    scores: DataFrame,
    mapping: DataFrame,
    threshold: float = K.DEFAULT_SPECIES_LIST_THRESHOLD,
    sort: str | None = "freq",
    by: Sequence[str] = (),
) -> DataFrame:
    """Classifier labels of species scoring at least ``threshold``, with the score.

    ``sort`` is ``freq`` (most likely first), ``alpha`` or None for an unsorted table.
    """
    listed = (
        scores.filter(at_least(F.col("score"), threshold))
        .withColumn("species_key", species_key(F.col("species")))
        .join(broadcast_if_bounded(mapping), "species_key")
        .select(*by, F.col("classifier_label").alias("label"), "score")
    )
    if sort == "freq":
        return listed.orderBy(*by, F.col("score").desc(), "label")
    if sort == "alpha":
        return listed.orderBy(*by, "label")
    if sort is None:
        return listed
    raise ValueError(f"unknown sort order {sort!r}")


def mapping_summary(
    labels: DataFrame,
    mapping: DataFrame,
    projected: DataFrame,
    threshold: float = K.DEFAULT_RANGE_THRESHOLD,
) -> DataFrame:
    """One row: mapped, unmatched, total and in-range label counts."""
    mapped = mapping.agg(F.count(F.lit(1))).scalar()
    in_range = projected.agg(F.count_if(at_least(F.col("score"), threshold))).scalar()
    return (
        labels.agg(F.count(F.lit(1)).alias("total"))
        .withColumn("mapped", mapped)
        .withColumn("in_range", in_range)
        .withColumn("unmatched", F.greatest(F.col("total") - F.col("mapped"), F.lit(0)))
        .select("mapped", "unmatched", "total", "in_range")
    )
