"""Repeated phrases: runs against a plain search, digests against plain Python, and the defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dawnchorus.llm import repeats as repeats_module
from dawnchorus.llm.queries import QUERIES
from dawnchorus.llm.repeats import find_runs, label_tracks, repeated_phrases

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) by walking along every period."""
    found = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_labels_at_once_are_bounded_and_none_is_lost(monkeypatch):
    monkeypatch.setattr(repeats_module, "LABELS_AT_ONCE", 10)
    tracks = [list("abc"), list("defghij"), None, list("k" * 25), [], list("l" * 6), list("m" * 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(tracks, pa.list_(pa.string()))], names=["file", "labels"])
    got = list(repeats_module._portions(iter([batch, batch.slice(0, 0)])))
    assert [p.column(0).to_pylist() for p in got] == [[0, 1, 2], [3], [4, 5], [6]]
    assert [t for p in got for t in p.column(1).to_pylist()] == tracks


def random_track(rng):
    kinds, n = rng.choice([1, 2, 3, 50]), rng.choice([0, 1, 23, 24, 25, 60, 200, 400])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            for i in range(a, min(n, a + rng.randint(1, 5) * p)):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_a_plain_search():
    rng = random.Random(11)
    for _ in range(150):
        tracks = [random_track(rng) for _ in range(rng.randint(1, 6))]
        sizes = np.array([len(t) for t in tracks])
        flat = np.array([w for t in tracks for w in t], dtype=np.int32)
        start, end, period = find_runs(flat, sizes)
        begin = np.cumsum(sizes) - sizes
        want = [(s + b, s + b + n, q) for t, b in zip(tracks, begin) for s, n, q in plain_runs(t)]
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == sorted((s, e, q) for s, e, q in want)


def test_query_equals_plain_python(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_repeats"](spark, FOLDER).collect()}
    assert len(got) == len(texts)
    seen = 0
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 4000:
            # The plain search is quadratic.
            continue
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        row = got[doc_id]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (best or (None, None, None))
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def test_recordings_that_repeat_a_song(spark):
    song = ["Wren", "Wren", "Robin"]
    rows = [("a.wav", float(i), float(i + 3), 0.9, "Genus x", song[i % 3]) for i in range(31)]
    rows += [("b.wav", float(i), float(i + 3), 0.9, "Genus x", song[i % 3]) for i in range(23)]
    rows += [(None, 0.0, 3.0, 0.9, None, None)]
    det = spark.createDataFrame(
        rows, "file string, start_s double, end_s double, confidence double, scientific_name string, common_name string"
    )
    tracks = label_tracks(det.repartition(5)).withColumn("labels_", F.lit(1))
    got = {r["file"]: r for r in repeated_phrases(tracks).collect()}
    assert [tuple(r) for r in got["a.wav"]["runs"]] == [(0, 31, 3)]
    assert got["a.wav"]["collapsed"] == ["Genus x_Wren", "Genus x_Wren", "Genus x_Robin"]
    assert got["b.wav"]["runs"] == [] and len(got["b.wav"]["collapsed"]) == 23
    assert got[None]["n_labels"] == 1


def test_edge_cases(spark):
    schema = "file string, labels array<string>, runs string"
    rows = [("null", None, "x"), ("empty", [], "x"), ("nulls", [None] * 24, "x"), (None, ["a"] * 30, "x")]
    rows += [("twice", ["a"] * 24, "x")] * 2 + [("long", [str(i % 7) for i in range(200_000)], "x")]
    got = repeated_phrases(spark.createDataFrame(rows, schema)).collect()
    runs = sorted(((r["file"] or ""), [tuple(x) for x in r["runs"]], len(r["collapsed"])) for r in got)
    assert runs == [
        ("", [(0, 30, 1)], 1),
        ("empty", [], 0),
        ("long", [(0, 200_000, 7)], 7),
        ("null", [], 0),
        ("nulls", [(0, 24, 1)], 1),
        ("twice", [(0, 24, 1)], 1),
        ("twice", [(0, 24, 1)], 1),
    ]
    assert repeated_phrases(spark.createDataFrame([], schema)).collect() == []
