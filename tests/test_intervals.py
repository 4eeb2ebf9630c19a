import contextlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from dawnchorus.operators import intervals
from dawnchorus.schemas import PARSED


def det(spark, rows):
    full = [("f", s, e, sp, f"{sp} common", c) for s, e, sp, c in rows]
    return spark.createDataFrame(full, PARSED)


PARSED_COLUMNS = "file string, start double, end double, scientific_name string, common_name string, confidence float"


@contextlib.contextmanager
def in_ranges(spark, count):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(count))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def simulate(rows, pre, post):
    """Clips by walking sorted ranges; rows are (file, start, end, species, common, conf)."""
    clips = []
    for key in sorted({(r[0], r[3]) for r in rows}):
        mine = sorted((r for r in rows if (r[0], r[3]) == key), key=lambda r: (r[1], r[4]))
        name, current = mine[0][4], None
        for r in mine:
            s, e = max(0.0, r[1] - pre), r[2] + post
            if current and s <= current[1]:
                current = [current[0], max(current[1], e), max(current[2], r[5]), current[3] + 1]
            else:
                if current:
                    clips.append((*key, name, *current))
                current = [s, e, r[5], 1]
        clips.append((*key, name, *current))
    return sorted(clips, key=repr)


COLUMNS = ["file", "scientific_name", "common_name", "start", "end", "max_confidence", "detection_count"]


def test_overlapping_merge(spark):
    got = intervals.merge_detections(det(spark, [(0.0, 3.0, "a", 0.8), (2.0, 5.0, "a", 0.9), (4.0, 7.0, "a", 0.7)]), 0, 0)
    row = got.collect()[0]
    assert got.count() == 1 and (row.start, row.end, row.detection_count) == (0.0, 7.0, 3)
    assert abs(row.max_confidence - 0.9) < 1e-6


def test_padding_merges_and_clamps(spark):
    got = intervals.merge_detections(det(spark, [(0.0, 3.0, "a", 0.8), (5.0, 8.0, "a", 0.9)]), 3, 3)
    assert rows_of(got, "start", "end") == [(0.0, 11.0)]


def test_distant_and_other_species_stay_apart(spark):
    got = intervals.merge_detections(
        det(spark, [(0.0, 3.0, "a", 0.8), (10.0, 13.0, "a", 0.9), (1.0, 2.0, "b", 0.5)]), 0, 0
    )
    assert rows_of(got, "scientific_name", "start", "end") == [
        ("a", 0.0, 3.0), ("a", 10.0, 13.0), ("b", 1.0, 2.0),
    ]


def test_touching_and_contained(spark):
    touching = intervals.merge_detections(det(spark, [(0.0, 3.0, "a", 0.8), (3.0, 6.0, "a", 0.9)]), 0, 0)
    assert rows_of(touching, "start", "end") == [(0.0, 6.0)]
    inside = intervals.merge_detections(
        det(spark, [(0.0, 100.0, "a", 0.8), (3.0, 6.0, "a", 0.9), (50.0, 60.0, "a", 0.1), (101.0, 102.0, "a", 0.1)]), 0, 0
    )
    assert rows_of(inside, "start", "end", "detection_count") == [(0.0, 100.0, 3), (101.0, 102.0, 1)]


def test_padding_limits(spark):
    empty = spark.createDataFrame([], PARSED)
    for pre in (-1.0, 301.0, float("nan")):
        with pytest.raises(ValueError):
            intervals.merge_detections(empty, pre, 0)
    assert intervals.merge_detections(empty, 1, 1).count() == 0


def _random_rows(seed, count, long_share):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        file = "hot" if rng.random() < 0.4 else f"f{rng.randrange(4)}"
        species = "hot species" if rng.random() < 0.4 else f"s{rng.randrange(3)}"
        start = rng.randrange(0, 4000) / 4
        length = rng.choice([0.25, 3.0, 3.0, 9.5]) if rng.random() > long_share else rng.randrange(100, 400) + 0.5
        rows.append((file, start, start + length, species, f"{species} {rng.randrange(3)}", rng.randrange(1, 100) / 128))
    return rows


@pytest.mark.parametrize("pre,post", [(0, 0), (5, 5), (0.5, 2), (30, 0)])
@pytest.mark.parametrize("ranges", [1, 3, 8, 40])
def test_ranges_give_the_same_clips(spark, pre, post, ranges):
    rows = _random_rows(int(pre * 10 + ranges), 400, 0.03)
    df = spark.createDataFrame(rows, "file string, start double, end double, scientific_name string, common_name string, confidence float")
    with in_ranges(spark, ranges):
        got = intervals.merge_detections(df, pre, post)
        assert rows_of(got, *COLUMNS) == simulate(rows, pre, post)


def test_null_and_empty_keys_stay_apart(spark):
    rows = [(f, 1.0, 2.0, s, "c", 0.5) for f in (None, "", "a") for s in (None, "", "x")] * 2
    df = spark.createDataFrame(rows, PARSED_COLUMNS)
    for ranges in (1, 5):
        with in_ranges(spark, ranges):
            clips = intervals.merge_detections(df, 1, 1)
            assert [r["detection_count"] for r in clips.collect()] == [2] * 9
            assert intervals.detections_in_clips(df, clips).count() == len(rows)


def test_rows_without_times_and_no_rows(spark):
    rows = [("a", None, 2.0, "s", "c", 0.5), ("a", 1.0, None, "s", "c", 0.5), ("a", 1.0, 2.0, "s", None, None)]
    got = intervals.merge_detections(spark.createDataFrame(rows, PARSED_COLUMNS), 1, 1)
    assert rows_of(got, *COLUMNS) == [("a", "s", None, 0.0, 3.0, None, 1)]
    assert intervals.merge_detections(spark.createDataFrame([], PARSED_COLUMNS), 1, 1).collect() == []


def test_rows_are_shuffled_once_and_runs_once(spark):
    df = spark.createDataFrame(_random_rows(1, 50, 0.0), PARSED_COLUMNS)
    got = intervals.merge_detections(df, 1, 1)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Full rows go by range, once for both readers; the other shuffles hold runs, and a row per range.
    assert plan.count("rangepartitioning") == 2 and "ReusedExchange" in plan


def test_copies_and_one_huge_group(spark):
    """Two thirds of all rows in one species of one recording, a third of them copies."""
    base = spark.range(0, 60000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("f"), F.col("id") % 50)).alias("file"),
        F.when(F.col("id") % 3 == 0, F.lit(12.0)).otherwise((F.col("id") % 9000) * 10.0).alias("start"),
    )
    df = base.select(
        "file", "start", (F.col("start") + 3).alias("end"), F.lit("s").alias("scientific_name"),
        F.lit("c").alias("common_name"), F.lit(0.5).cast("float").alias("confidence"),
    )
    rows = [tuple(r) for r in df.collect()]
    assert rows_of(intervals.merge_detections(df, 3, 3), *COLUMNS) == simulate(rows, 3, 3)


def test_every_detection_is_in_one_clip(spark):
    rows = _random_rows(7, 500, 0.05)
    df = spark.createDataFrame(rows, "file string, start double, end double, scientific_name string, common_name string, confidence float")
    clips = intervals.merge_detections(df, 2, 2)
    inside = intervals.detections_in_clips(df, clips, width=20.0)
    assert inside.count() == len(rows)
    counted = inside.groupBy("file", "scientific_name", "clip_start").count()
    again = clips.select("file", "scientific_name", F.col("start").alias("clip_start"), F.col("detection_count").alias("count"))
    assert rows_of(counted) == rows_of(again)


def test_segments_overlap_half_open(spark):
    segments = spark.createDataFrame(
        [("f", i, float(i * 3), float(i * 3 + 3)) for i in range(200)], "file string, seg_idx int, start_s float, end_s float"
    )
    clips = spark.createDataFrame([("f", "a", 3.0, 6.0), ("f", "b", 4.0, 400.0), ("g", "a", 0.0, 9.0)], "file string, scientific_name string, start double, end double")
    got = intervals.segments_for_clips(segments, clips, width=10.0)
    assert rows_of(got.filter("scientific_name = 'a'"), "seg_idx", "from_s", "to_s") == [(1, 3.0, 6.0)]
    assert got.filter("scientific_name = 'b'").count() == len([i for i in range(200) if i * 3 + 3 > 4 and i * 3 < 400])


def test_direct_clip():
    clip = intervals.direct_clip("a.wav", 2.0, 4.0, 5.0, 1.0)
    assert (clip["start"], clip["end"], clip["scientific_name"]) == (0.0, 5.0, "detection_2-4")
    for start, end in ((-1.0, 2.0), (3.0, 3.0), (0.0, float("inf")), (float("nan"), 1.0)):
        with pytest.raises(ValueError):
            intervals.direct_clip("a.wav", start, end, 0, 0)


def test_segments_are_not_sorted_to_meet_small_clips(spark):
    grid = spark.range(4000).selectExpr("concat('f', id % 40) AS file", "id DIV 40 AS seg_idx", "id DIV 40 * 3.0D AS start_s", "id DIV 40 * 3.0D + 3 AS end_s")
    clips = spark.range(80).selectExpr("concat('f', id % 45) AS file", "'s' AS scientific_name", "id * 1.5D AS start", "id * 1.5D + 70 AS end")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = intervals.segments_for_clips(grid, clips)
        got = {(r["file"], r["seg_idx"], r["clip_start"]) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
    ends = {(f"f{i % 45}", i * 1.5): i * 1.5 + 70 for i in range(80) if i % 45 < 40}
    assert got == {(f, s, a) for (f, a), b in ends.items() for s in range(100) if s * 3 + 3 > a and s * 3 < b}
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
