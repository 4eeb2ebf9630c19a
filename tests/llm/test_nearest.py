"""Largest inner products against all pairs, the query against SQL, and the defined edge cases."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from dawnchorus.llm import nearest
from dawnchorus.llm.nearest import similar_segments
from dawnchorus.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "file string, seg_idx int, embedding array<double>, rank string, score string"


def plain(segments, queries, k, scale=1024):
    """All pairs in Python integers."""

    def usable(rows):
        kept = {}
        for file, seg, v in rows:
            if file is not None and seg is not None and v is not None:
                if all(x is not None and math.isfinite(x) for x in v):
                    kept[(file, seg), tuple(max(min(math.floor(x * scale), 1 << 62), -(1 << 62)) for x in v)] = None
        return list(kept)

    out = []
    for mine, v in usable(queries):
        scored = []
        for other, w in usable(segments):
            if other != mine:
                score = sum(a * b for a, b in zip(v, w))
                scored.append((-max(min(score, (1 << 63) - 1), -(1 << 63)), other))
        out += [(*mine, i + 1, *other, -s) for i, (s, other) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def check(spark, rows, asked, k=10):
    table = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA).repartition(5)
    queries = spark.createDataFrame([(*r, "x", "x") for r in asked], SCHEMA)
    got = similar_segments(table, queries, k)
    assert got.columns == ["query_file", "query_seg_idx", "rank", "file", "seg_idx", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, asked, k)


def clustered(seed, n, width, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.2, (7, width))
    sizes = draw.lognormal(0, spread, n)
    return [
        (f"{i % 9}.wav", i, (sizes[i] * (centres[i % 7] + draw.normal(0, 0.05, width))).tolist()) for i in range(n)
    ]


@pytest.mark.parametrize(("block", "sample"), [(4096, 16_384), (16, 10)])
def test_equals_all_pairs(spark, monkeypatch, block, sample):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    monkeypatch.setattr(nearest, "SAMPLE_VECTORS", sample)
    rows = clustered(3, 400, 24)
    check(spark, rows, rows[::9])


def test_copies_and_ties(spark):
    rows = [("a.wav", i, [0.5, -0.25, 0.125]) for i in range(60)] + [("b.wav", i, [0.0, 0.0, 0.0]) for i in range(30)]
    rows += clustered(5, 60, 3) + rows[:20]
    check(spark, rows, [*rows[:3], *rows[60:64], rows[100], rows[100]])


def test_odd_vectors(spark):
    rows = clustered(6, 40, 4)
    rows += [
        ("n.wav", 1, None), ("n.wav", 2, [1.0, None, 0.0, 0.0]), ("n.wav", 3, [math.nan] * 4), ("n.wav", 4, [math.inf, 0.0, 0.0, 0.0]),
        (None, 5, [1.0] * 4), ("n.wav", None, [1.0] * 4), ("s.wav", 6, []), ("s.wav", 7, [2.0]), ("s.wav", 8, [0.1] * 9),
        ("h.wav", 9, [1e300, -1e300, 0.0, 0.0]), ("h.wav", 10, [1e15, 3e14, 1.0, 0.0]), ("h.wav", 11, [-1e15, 3e14, 1.0, 7.0]),
    ]
    check(spark, rows, rows[::3] + rows[-9:], k=5)


def test_few_candidates_and_empty_tables(spark):
    rows = clustered(7, 3, 4)
    check(spark, rows, rows[:2])
    check(spark, rows[:1], rows[:1])
    check(spark, [], rows)
    check(spark, rows, [])


def test_query_equals_sql(spark):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    rows = QUERIES["op13_nearest"](spark, FOLDER)
    table = base.sql(SQL["op13_nearest"]).to_arrow_table()
    want = sorted(tuple(r[c] for c in rows.columns) for r in table.to_pylist())
    assert sorted(tuple(r) for r in rows.collect()) == want and len(want) == 50
