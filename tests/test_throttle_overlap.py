"""The throttle query loses no rows where the table's files overlap in time."""

from __future__ import annotations

from dawnchorus.testbed.checks_streams import throttle_progress
from dawnchorus.testbed.tables import Tables


def test_files_that_overlap_in_time(spark, tmp_path):
    rows = [(k, f"2024-01-{1 + k % 25:02d} 10:00:00", 500.0) for k in range(100)]
    # The last update of all only moves the watermark on, and waits for more.
    rows.append((100, "2024-01-28 10:00:00", 500.0))
    table = spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr(
        "user_id", "CAST(ts AS timestamp) AS ts", "value"
    )
    # Every file holds all days; each user's only update is shown.
    table.repartition(4, "user_id").write.parquet(str(tmp_path / "events.parquet"))
    got = throttle_progress(Tables(spark, str(tmp_path))).select("file").collect()
    assert {r["file"] for r in got} == {f"f{k}" for k in range(100)}
