"""Species labels: splitting, keys, codes and export spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_scientific(label: Column) -> Column:
    """Text before the first underscore, or the whole label."""
    return F.substring_index(label, "_", 1)


def label_common(label: Column) -> Column:
    """Text after the first underscore, or the whole label when there is none."""
    at = F.instr(label, "_")
    return F.when(at == 0, label).otherwise(F.substr(label, at + 1))


def species_name(label: Column) -> Column:
    """Binomial part of a label.

    The prefix counts only when it holds a space, so sound-class labels such as
    ``Dog_barking_loud`` stay whole.
    """
    prefix = F.substring_index(label, "_", 1)
    binomial = (F.instr(label, "_") > 0) & (F.instr(prefix, " ") > 0)
    return F.when(binomial, prefix).otherwise(label)


def species_key(label: Column) -> Column:
    """Case-folded binomial: the key that links differently localised label sets."""
    return F.lower(species_name(label))


def species_label(scientific: Column, common: Column) -> Column:
    return F.concat(scientific, F.lit("_"), common)


def species_code(common_name: Column) -> Column:
    """Short code: four letters of a single word, else three of the first and last word."""
    text = F.regexp_replace(common_name, r"(?U)^\s+|\s+$", "")
    words = F.split(text, r"(?U)\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    return (
        F.when(text == "", F.lit("unkn"))
        .when(F.size(words) == 1, F.lower(F.substring(first, 1, 4)))
        .otherwise(F.lower(F.concat(F.substring(first, 1, 3), F.substring(last, 1, 3))))
    )


def underscored(common_name: Column) -> Column:
    """Spelling used by the selection-table and folder-based exports."""
    return F.replace(common_name, F.lit(" "), F.lit("_"))


def comma_separated(common_name: Column) -> Column:
    """Spelling used by the label-track export."""
    return F.replace(common_name, F.lit("_"), F.lit(", "))
