"""From raw documents to encoded training text, in five stages that each call one operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.llm.decontaminate import find_test_items
from dawnchorus.llm.language import UNDETERMINED, identify_language
from dawnchorus.llm.line_dedup import remove_repeated_lines
from dawnchorus.llm.piece_codec import piece_round_trip
from dawnchorus.llm.queries import PIECE_MODEL, language_model, test_items
from dawnchorus.llm.similar import keep_first_similar
from dawnchorus.session import checkpoint_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told, and set ``lang`` to it.

    Rejected are those without any letter, so null and empty texts, too; every other text has a language, however sure.
    Whole texts count, however long; equal rows are kept each; null keys stay; an empty table gives an empty one; columns beyond
    those of documents are dropped, whatever their names.
    """
    model = language_model(docs)
    found = identify_language(docs.select(*COLUMNS), model, "doc_id", "text", keep=True)
    found = found.where(F.col("language") != UNDETERMINED)
    return found.withColumn("lang", F.col("language")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds; ``n_chars`` follows the text.

    No document is dropped. Null texts stay null, and empty ones empty; of equal texts the one with the smallest key keeps its passages;
    texts of any length are cut whole; an empty table gives an empty one; columns beyond those of documents are dropped.
    """
    cut = remove_repeated_lines(docs, "doc_id", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every class that links of SimHash, or of similarity 0.8 and more, join.

    SimHash classes count whole; prefix filtering finds the similar texts that they miss, confirmed on the words.
    The first is the one with the smallest key; rows that repeat it stay. Texts without words, null ones too, are alike; those of fewer
    than five words are alike if their words are equal; texts of any length are compared whole; an empty table gives an empty
    one; columns beyond those of documents are dropped.
    """
    return keep_first_similar(docs, "doc_id", "text").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none and stay; texts of any length are searched whole; equal rows are judged alike; an empty table, or an empty
    benchmark, drops nothing; columns beyond those of documents are dropped.
    """
    found = find_test_items(docs.select(*COLUMNS), test_items(spark, sf_dir))
    return found.where(F.size("test_items") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text.

    Null texts count as empty and have the end id alone; texts of any length are encoded whole; equal rows are encoded each; an empty
    table gives an empty one; columns beyond key and text are dropped.
    """
    path = public_tokenizers.path(PIECE_MODEL)
    return piece_round_trip(docs, path, "doc_id", "text", keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]
# SQL can express none of the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes Parquet to the shared folder, which the next one reads."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
