"""Incremental work: recordings still to process, and the audio behind result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus import constants as K
from dawnchorus.functions.paths import base_name, join_path, output_path, parent_path, stem
from dawnchorus.scale import is_small


def pending_recordings(
    inventory: DataFrame, outputs: DataFrame, formats: Sequence[str], force: bool = False
) -> DataFrame:
    """Recordings lacking an output in at least one requested format.

    ``outputs`` has (file, format). With no format asked for, or ``force``, all are pending.
    """
    wanted = sorted(set(formats))
    if force or not wanted:
        return inventory
    done = (
        outputs.filter(F.col("format").isin(*wanted))
        .groupBy("file")
        .agg(F.count_distinct("format").alias("_found"))
        .filter(F.col("_found") == len(wanted))
        .select("file")
    )
    return inventory.join(done, "file", "left_anti")


def outputs_of(
    listing: DataFrame, inventory: DataFrame, formats: Sequence[str], folder: str | None = None
) -> DataFrame:
    """(file, format) of every requested result of a recording that is there, for ``pending_recordings``.

    ``listing`` has the ``path`` of each existing file; a result is there if the path that the recording has in that
    format (beside it, or in ``folder``) is listed. Paths of both tables have to be written alike.
    """
    unknown = sorted(set(formats) - set(K.OUTPUT_SUFFIXES))
    if unknown:
        raise ValueError(f"unknown formats: {unknown}")
    wanted = F.array(*[F.lit(f) for f in sorted(set(formats))]).cast("array<string>")
    target = None if folder is None else F.lit(folder)
    expected = inventory.select("file", F.explode(wanted).alias("format"))
    expected = expected.withColumn("path", output_path(F.col("file"), F.col("format"), target))
    return expected.join(listing.select("path"), "path", "left_semi").select("file", "format")


def _strip(text: Column, suffix: str) -> Column:
    """Text without the suffix; null when it does not end with it."""
    kept = F.substr(text, F.lit(1), F.length(text) - len(suffix))
    return F.when(F.endswith(text, F.lit(suffix)), kept)


def _search_terms(results: DataFrame, explicit: str | None, folder: str | None) -> DataFrame:
    """Add ``_exact``, a path to look for as it is, and ``_stem``, a path less its extension.

    ``_exact`` is the explicit path or the name without a known result suffix. ``_stem`` is the
    cleaned name; it is absent beside an explicit path and for names that leave the folder.
    """
    result = F.col("file")
    parent = parent_path(result)
    search = parent if folder is None else F.coalesce(F.col(folder), parent)
    named = [_strip(F.col("_name"), suffix) for suffix in K.OUTPUT_SUFFIXES.values()]
    clean = [_strip(F.col("_bare"), suffix) for suffix in K.RESULT_STEM_SUFFIXES]
    base = [_strip(F.col("_clean"), f".{ext}") for ext in K.AUDIO_EXTENSIONS]
    # One step per column, so that no expression is repeated inside the next.
    terms = (
        results.withColumn("_name", base_name(result))
        .withColumn("_search", join_path(search, F.lit("")))
        .withColumn("_bare", stem(F.col("_name")))
        .withColumn("_clean", F.coalesce(*clean, "_bare"))
        .withColumn("_base", F.coalesce(*base, "_clean"))
        .withColumn("_exact", F.concat("_search", F.coalesce(*named)))
    )
    allowed = F.lit(True)
    for mark in ("..", "/", "\\"):
        allowed = allowed & ~F.contains("_base", F.lit(mark))
    if explicit is not None:
        allowed = allowed & F.col(explicit).isNull()
        terms = terms.withColumn("_exact", F.coalesce(explicit, "_exact"))
    return terms.withColumn("_stem", F.when(allowed, F.concat("_search", "_base"))).drop(
        "_name", "_search", "_bare", "_clean", "_base"
    )


def _by_stem(inventory: DataFrame) -> DataFrame:
    """(_stem, _rank): the preferred extension among the audio files of one stem."""
    file, rank, cut = F.col("file"), None, None
    for place, ext in enumerate(K.AUDIO_EXTENSIONS):
        ends = F.endswith(file, F.lit(f".{ext}"))
        kept = F.substr(file, F.lit(1), F.length(file) - len(ext) - 1)
        rank = F.when(ends, place) if rank is None else rank.when(ends, place)
        cut = F.when(ends, kept) if cut is None else cut.when(ends, kept)
    stems = inventory.select(cut.alias("_stem"), rank.alias("_rank"))
    return stems.filter(F.col("_rank").isNotNull()).groupBy("_stem").agg(
        F.min("_rank").alias("_rank")
    )


def resolve_audio(
    results: DataFrame,
    inventory: DataFrame,
    explicit: str | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Audio path of each result file, null where the inventory has none.

    Tried in order: the explicit path (then nothing else), the name without its result suffix,
    and the cleaned stem with each audio extension. The inventory is reduced to one row per
    stem with its preferred extension, so results join twice by equality and never multiply.
    """
    terms = _search_terms(results, explicit, folder)
    # Absent terms become keys of their own that match nothing, or all would meet in one task.
    for term in ("_exact", "_stem"):
        unmatched = F.concat(F.lit("\x00"), F.col("file"))
        terms = terms.withColumn(term, F.coalesce(F.col(term), unmatched))
    exact = inventory.select(F.col("file").alias("_exact"), F.lit(True).alias("_there")).distinct()
    stems = _by_stem(inventory)
    if is_small(inventory.select("file")):  # bounds both of the tables made from it
        exact, stems = F.broadcast(exact), F.broadcast(stems)
    extensions = F.array(*[F.lit(f".{ext}") for ext in K.AUDIO_EXTENSIONS])
    guessed = F.concat("_stem", F.get(extensions, F.col("_rank")))
    return (
        terms.join(exact, "_exact", "left")
        .join(stems, "_stem", "left")
        .select("file", F.when(F.col("_there"), F.col("_exact")).otherwise(guessed).alias("audio_path"))
    )
