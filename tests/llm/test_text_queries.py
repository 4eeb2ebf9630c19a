"""The registered text queries and the pipeline at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from dawnchorus.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_revisits_equal_sql(spark):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    table = base.sql(SQL["op3_revisits"]).to_arrow_table()
    rows = QUERIES["op3_revisits"](spark, FOLDER)
    want = sorted(str(tuple(r[c] for c in rows.columns)) for r in table.to_pylist())
    assert sorted(str(tuple(r)) for r in rows.collect()) == want


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = {r[0] for r in docs.select("doc_id").collect()}
        if name != "pieces":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert seen["pieces"] == seen["decontamination"] <= seen["near_duplicates"] <= seen["line_dedup"]
    assert seen["line_dedup"] == seen["language"]
    found = {r[0] for r in QUERIES["op2_decontaminate"](spark, FOLDER).select("doc_id").collect()}
    assert not seen["pieces"] & found and len(seen["pieces"]) > 100
