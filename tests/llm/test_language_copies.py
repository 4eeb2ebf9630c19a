"""Languages are learned from the different texts of a table, however many copies it holds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dawnchorus.llm import language
from dawnchorus.llm.language import identify_language, train_languages

FRENCH = "le merle noir chante dans les arbres de la forêt et les oiseaux de la rivière sont partis vers le sud pour l'hiver"
ENGLISH = "the blackbird sings in the trees of the forest and the birds of the river have gone to the south for the winter"


def texts(line: str, count: int) -> list[str]:
    words = line.split()
    return [" ".join(words[i % 7 :] + words[: i % 7 + i // 7]) for i in range(count)]


@pytest.mark.parametrize("copies", [1, 3000])
def test_two_languages_of_ten_texts(spark, copies):
    rows = [(t, "fr") for t in texts(FRENCH, 10)] + [(t, "en") for t in texts(ENGLISH, 10)]
    table = spark.createDataFrame(rows, "label string, language string")
    many = table.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    model = train_languages(many)
    asked = spark.createDataFrame([(1, FRENCH), (2, ENGLISH)], "doc_id long, label string")
    got = {r["doc_id"]: r["language"] for r in identify_language(asked, model, "doc_id", "label").collect()}
    assert got == {1: "fr", 2: "en"}


def test_the_sample_is_full_in_a_table_of_copies(spark, monkeypatch):
    """99 of 100 rows are copies of one text; the others still fill the sample."""
    seen = []
    monkeypatch.setattr(language, "durable", lambda df: seen.append(df.groupBy("language").count().collect()) or df)
    different = spark.range(3000).select(F.concat(F.lit("text "), F.col("id")).alias("label"), F.lit("en").alias("language"))
    copies = spark.range(297_000).select(F.lit("same text").alias("label"), F.lit("en").alias("language"))
    train_languages(different.unionByName(copies))
    assert [(r["language"], r["count"]) for r in seen[0]] == [("en", language.SAMPLE_PER_LANGUAGE)]
