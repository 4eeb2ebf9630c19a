import itertools

import pytest

from conftest import rows_of
from dawnchorus.operators import segments


def walked(frames, size, keep):
    """Segment starts by stepping through a recording with a sample buffer."""
    starts, at, left = [], 0, frames
    while left > 0:
        take = min(size, left)
        starts.append(at)
        step = take - keep if take > keep else take
        at, left = at + step, left - (step if take > keep else left)
    return starts


def grid(spark, cases, rate=1):
    return spark.createDataFrame(
        [(f"{n}", rate, n) for n in cases], "file string, sample_rate int, frames bigint"
    )


@pytest.mark.parametrize("size,keep", [(s, k) for s, k in itertools.product((1, 2, 3, 5, 8), (0, 1, 2, 4)) if k < s])
def test_grid_equals_walking(spark, size, keep):
    cases = range(0, 40)
    got = segments.segment_grid(grid(spark, cases), size, keep)
    want = [(str(n), i, s) for n in cases for i, s in enumerate(walked(n, size, keep))]
    assert rows_of(got, "file", "seg_idx", "start_sample") == sorted(want, key=repr)


def test_padding_is_reported(spark):
    got = segments.segment_grid(grid(spark, [7]), 3, 0)
    assert rows_of(got, "start_s", "end_s", "real_samples") == [(0.0, 3.0, 3), (3.0, 6.0, 3), (6.0, 9.0, 1)]


def test_long_recording_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENTS_PER_BLOCK", 7)
    got = segments.segment_grid(grid(spark, [1000]), 3, 1)
    assert [r[1] for r in rows_of(got, "seg_idx", "start_sample")][:3] is not None
    starts = sorted(r["start_sample"] for r in got.collect())
    assert starts == walked(1000, 3, 1)
    assert sorted(r["seg_idx"] for r in got.collect()) == list(range(len(starts)))


def test_rates_differ(spark):
    """44.1 kHz recordings for a 48 kHz model: sample counts are rescaled, rounding up."""
    got = segments.segment_grid(grid(spark, [44100 * 9], 44100), 3.0, 0.0, model_rate=48000)
    assert rows_of(got, "start_sample", "segment_samples", "end_s") == [
        (0, 132300, 3.0), (132300, 132300, 6.0), (264600, 132300, 9.0),
    ]


def test_overlap_must_be_smaller(spark):
    for overlap in (3.0, 4.0, -1.0):
        with pytest.raises(ValueError):
            segments.segment_grid(grid(spark, [9]), 3.0, overlap)


def test_chunks(spark):
    def count(frames, rate, seg, overlap):
        return segments.chunk_grid(grid(spark, [frames], rate), seg, overlap).count()

    assert count(144000, 48000, 1.0, 0.5) == 6
    assert count(60000, 48000, 1.0, 0.0) == 2
    assert count(60000, 48000, 1.0, 1.0) == 0
    assert count(0, 48000, 1.0, 0.0) == 0


def test_chunk_and_grid_differ_at_the_end(spark):
    assert [r[0] for r in rows_of(segments.chunk_grid(grid(spark, [6]), 3, 1), "start_sample")] == [0, 2, 4]
    assert [r[0] for r in rows_of(segments.segment_grid(grid(spark, [6]), 3, 1), "start_sample")] == [0, 2, 4, 5]


def test_bat_grid(spark):
    got = segments.bat_segment_grid(grid(spark, [288000], 256000)).collect()
    assert sorted(r["start_sample"] for r in got) == walked(288000, 144000, 36000)
    assert abs(got[0]["end_s"] - got[0]["start_s"] - 0.5625) < 1e-6
    assert not got[0]["rate_warning"]
    assert segments.bat_segment_grid(grid(spark, [288000], 48000)).first()["rate_warning"]
