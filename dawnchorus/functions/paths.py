"""Path pieces and output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnchorus.constants import OUTPUT_SUFFIXES
from dawnchorus.functions.numbers import fixed

# Plain string functions throughout: these run once per row of the largest tables, where
# regular expressions would cost several times as much.


def base_name(file: Column) -> Column:
    """Text after the last separator."""
    return F.substring_index(F.translate(file, "\\", "/"), "/", -1)


def parent_path(file: Column) -> Column:
    """Everything before the base name, '/' for a file in the root, '' for a bare name."""
    cut = F.length(file) - F.length(base_name(file)) - 1
    return F.when(cut < 0, F.lit("")).when(cut == 0, F.lit("/")).otherwise(
        F.substr(file, F.lit(1), cut)
    )


def parent_name(file: Column) -> Column:
    return base_name(parent_path(file))


def grandparent_path(file: Column) -> Column:
    parent = parent_path(file)
    return F.when(parent == "/", F.lit("")).otherwise(parent_path(parent))


def path_parts(file: Column) -> Column:
    """struct(base, folder, indir)."""
    return F.struct(
        base_name(file).alias("base"),
        parent_name(file).alias("folder"),
        grandparent_path(file).alias("indir"),
    )


def _stem_length(name: Column) -> Column:
    """Characters before the last dot; not positive without one or with a leading one only."""
    return F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1


def extension(file: Column) -> Column:
    """Lower-cased text after the last dot of the base name, '' when there is none."""
    name = base_name(file)
    ending = F.lower(F.substring_index(name, ".", -1))
    return F.when(_stem_length(name) > 0, ending).otherwise(F.lit(""))


def stem(file: Column) -> Column:
    """Base name without its last extension; a leading dot does not start one."""
    name = base_name(file)
    length = _stem_length(name)
    return F.when(length > 0, F.substr(name, F.lit(1), length)).otherwise(name)


def join_path(folder: Column, name: Column) -> Column:
    """Folder and name with one slash between them; an empty folder adds none."""
    slash = F.when((folder == "") | F.endswith(folder, F.lit("/")), F.lit("")).otherwise(
        F.lit("/")
    )
    return F.concat(folder, slash, name)


def output_suffix(fmt: Column) -> Column:
    """File-name suffix of an output format; null for an unknown one."""
    pairs = [F.lit(text) for item in OUTPUT_SUFFIXES.items() for text in item]
    return F.try_element_at(F.create_map(*pairs), fmt)


def output_path(file: Column, fmt: Column, folder: Column | None = None) -> Column:
    """Result path of a recording in one format, next to it unless a folder is given."""
    return suffixed_path(file, output_suffix(fmt), folder)


def suffixed_path(file: Column, suffix: Column, folder: Column | None = None) -> Column:
    """Path of a file made from a recording: its stem with a suffix, next to it unless a folder is given."""
    safe = F.translate(stem(file), "/\\", "__")
    target = parent_path(file) if folder is None else F.coalesce(folder, parent_path(file))
    return join_path(target, F.concat(safe, suffix))


# fixed values: characters replaced in clip names
_FORBIDDEN = '/\\:*?"<>|'


def safe_name(name: Column) -> Column:
    cleaned = F.translate(name, _FORBIDDEN, "_" * len(_FORBIDDEN))
    return F.replace(cleaned, F.lit(".."), F.lit("__"))


def clip_path(species: Column, confidence: Column, start: Column, end: Column) -> Column:
    """Relative clip path: species folder, then species, percent and time range."""
    name = safe_name(species)
    percent = F.round(confidence.cast("float") * F.lit(100.0).cast("float")).cast("int")
    return F.concat(
        name,
        F.lit("/"),
        name,
        F.lit("_"),
        percent.cast("string"),
        F.lit("p_"),
        fixed(start, 1),
        F.lit("-"),
        fixed(end, 1),
        F.lit(".wav"),
    )
