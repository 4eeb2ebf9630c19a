"""Scoring jobs: segment scoring, embedding heads, occurrence scores, provenance flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.scale import parameter_blocks, unfolded

# A model factory runs once per task; the model maps a (batch, samples) array to a
# (batch, classes) array of confidences.
Model = Callable[[np.ndarray], np.ndarray]
ModelFactory = Callable[[], Model]

_PREDICTION = (
    "file string, seg_idx bigint, start_s float, end_s float, "
    "label string, confidence float, class_index int"
)


def score_segments(
    segments: DataFrame,
    factory: ModelFactory,
    labels: Sequence[str],
    batch_size: int = K.DEFAULT_BATCH_SIZE,
    k: int | None = K.DEFAULT_TOP_K,
    min_confidence: float = 0.0,
) -> DataFrame:
    """Predictions of a pluggable model for segments with a ``samples`` array.

    The model is built once per task and fed batches of segments. Keeping the best ``k``
    happens in the task, so only those rows leave it. Segments that could not be decoded (null
    samples) have no predictions.
    """
    if not K.MIN_BATCH_SIZE <= batch_size <= K.MAX_BATCH_SIZE:
        raise ValueError(f"batch size must be between 1 and {K.MAX_BATCH_SIZE}")
    names = np.asarray(list(labels), dtype=object)
    kept = len(names) if k is None else min(k, len(names))
    floor = np.float32(min_confidence)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for rows in batches:
            for at in range(0, len(rows), batch_size):
                part = rows.iloc[at : at + batch_size]
                scores = np.asarray(model(np.stack(part["samples"].to_numpy())), dtype=np.float32)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :kept]
                confidence = np.take_along_axis(scores, best, axis=1)
                use = confidence >= floor
                seg, slot = np.nonzero(use)
                classes = best[seg, slot]
                yield pd.DataFrame(
                    {
                        "file": part["file"].to_numpy()[seg],
                        "seg_idx": part["seg_idx"].to_numpy()[seg],
                        "start_s": part["start_s"].to_numpy()[seg],
                        "end_s": part["end_s"].to_numpy()[seg],
                        "label": names[classes],
                        "confidence": confidence[seg, slot],
                        "class_index": classes.astype(np.int32),
                    }
                )

    columns = segments.select("file", "seg_idx", "start_s", "end_s", "samples")
    return columns.where(F.col("samples").isNotNull()).mapInPandas(run, _PREDICTION)


def classify_embeddings(
    embeddings: DataFrame,
    head: DataFrame,
    k: int | None = 1,
    carry: Sequence[str] = ("file", "seg_idx"),
    min_score: float | None = None,
) -> DataFrame:
    """Second-stage scores ``w . embedding + b`` of every head label, best ``k`` kept (ties by class; None: all).

    With ``min_score`` only scores that reach it in single precision are kept, before anything leaves the task.
    ``head`` has (class_index, label, weights, bias). Its parts go to the tasks as matrices, one product
    per Arrow batch and part, and the best so far travel along, so there is no join and no shuffle; a head
    beyond the broadcast bound makes more parts. A segment without an embedding, or with one of another
    length than the weights, is an error.
    """
    spark = embeddings.sparkSession
    best_type = "array<struct<score: double, class_index: int, label: string>>"
    scored = embeddings.select(*carry, "embedding").withColumn("_best", F.array().cast(best_type))
    for part in parameter_blocks(head.select("class_index", "label", "weights", "bias")):
        rows = sorted(part.collect(), key=lambda r: r["class_index"])
        if rows:
            matrix = np.array([r["weights"] for r in rows], dtype=np.float64)
            bias = np.array([r["bias"] for r in rows], dtype=np.float64)
            classes = np.array([r["class_index"] for r in rows], dtype=np.int32)
            shared = spark.sparkContext.broadcast((matrix, bias, classes, [r["label"] for r in rows]))
            scored = scored.mapInArrow(_scorer(shared, k, min_score), scored.schema)
    return scored.select(*carry, F.inline("_best")).select(*carry, "label", "score", "class_index")


def _scorer(shared, k: int | None, min_score: float | None):
    """Adds the scores of one part of a head to the best so far of each row."""

    def vectors(column: pa.Array, width: int) -> np.ndarray:
        if column.null_count:
            raise ValueError("segment without an embedding")
        if (pc.list_value_length(column).to_numpy(zero_copy_only=False) != width).any():
            raise ValueError("embedding of another length than the head's weights")
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, bias, classes, names = shared.value
        labels = pa.array(names, pa.string())
        for batch in batches:
            n = batch.num_rows
            scores = vectors(batch.column("embedding"), matrix.shape[1]) @ matrix.T + bias
            wanted = np.ones(scores.shape, bool)
            if min_score is not None:
                wanted &= scores.astype(np.float32) >= np.float32(min_score)
            if k is not None and k < scores.shape[1]:
                # Nothing below a row's k-th score is among its best; ties at it are told apart below.
                wanted &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
            row, which = np.nonzero(wanted)
            best = batch.column("_best")
            before = best.flatten()
            held = np.repeat(np.arange(n), pc.list_value_length(best).to_numpy(zero_copy_only=False))
            row = np.concatenate([held, row])
            score = np.concatenate([before.field("score").to_numpy(zero_copy_only=False), scores[wanted]])
            kind = np.concatenate([before.field("class_index").to_numpy(zero_copy_only=False), classes[which]])
            label = pa.concat_arrays([before.field("label"), labels.take(pa.array(which))])
            order = np.lexsort((kind, -score, row))
            if k is not None:
                sizes = np.bincount(row, minlength=n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                order = order[place < k]
            ends = np.append(0, np.cumsum(np.bincount(row[order], minlength=n)))
            fields = [pa.array(score[order]), pa.array(kind[order], pa.int32()), label.take(pa.array(order))]
            kept = pa.StructArray.from_arrays(fields, ["score", "class_index", "label"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept)
            at = batch.schema.get_field_index("_best")
            yield batch.set_column(at, "_best", lists)

    return run


def occurrence_scores(sites: DataFrame, weights: DataFrame) -> DataFrame:
    """Score of every species at each distinct (lat, lon, week): sigmoid(w . inputs + b).

    ``weights`` has (class_index, species, w_lat, w_lon, w_week, bias) and may have any size;
    its rows are unfolded at each site, which is the full output and needs no join.
    """
    item = F.struct("class_index", "species", "w_lat", "w_lon", "w_week", "bias")
    z = (
        F.col("lat") * F.col("w_lat")
        + F.col("lon") * F.col("w_lon")
        + F.col("week") * F.col("w_week")
        + F.col("bias")
    )
    places = sites.select("lat", "lon", "week").distinct()
    return (
        unfolded(places, weights, item, ["class_index"])
        .withColumn("score", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).cast("float"))
        .select("lat", "lon", "week", "species", "class_index", "score")
    )


def postprocess_flags(recordings: DataFrame, model_type: str) -> DataFrame:
    """Which post-processing each recording got.

    Calibration always runs for the calibrated model family; the distribution model only where
    latitude, longitude and day of year are all known.
    """
    calibrated = F.lit(model_type == K.CALIBRATED_MODEL_TYPE)
    known = (
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("day_of_year").isNotNull()
    )
    applied = calibrated & known
    located = calibrated & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return (
        recordings.withColumn("calibration_applied", calibrated)
        .withColumn("sdm_applied", applied)
        .withColumn("sdm_latitude", F.when(located, F.col("lat").cast("float")))
        .withColumn("sdm_longitude", F.when(located, F.col("lon").cast("float")))
        .withColumn("sdm_day_of_year", F.when(located, F.col("day_of_year").cast("int")))
    )
