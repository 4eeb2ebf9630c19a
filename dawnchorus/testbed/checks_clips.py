"""Checks of clip merging, overlap joins, segmentation, summaries and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.operators import combine, intervals, ordering, quality, regions, segments, summaries, work
from dawnchorus.plans import clips as clip_plans
from dawnchorus.testbed.registry import check
from dawnchorus.testbed.sql import merged, with_views
from dawnchorus.testbed.tables import Tables

_CLIP = 'file, scientific_name, common_name, "start", "end", max_confidence, detection_count'


def _confident(det: DataFrame) -> DataFrame:
    return quality.min_confidence(det, 0.1)


def _clips_ev(t: Tables) -> DataFrame:
    return intervals.merge_detections(_confident(t.det_ev()), 300, 300)


@check("merge_detections", with_views(f"WITH {merged('det_ev', 300, 300)} SELECT {_CLIP} FROM clips", "det_ev"))
def merge_detections(t: Tables) -> DataFrame:
    return _clips_ev(t)


@check("merge_detections_default", with_views(f"WITH {merged('det_li', 5, 5)} SELECT {_CLIP} FROM clips", "det_li"))
def merge_detections_default(t: Tables) -> DataFrame:
    return intervals.merge_detections(_confident(t.det_li()))


@check("merge_detections_touching", with_views(f"WITH {merged('det_li', 0, 0)} SELECT {_CLIP} FROM clips", "det_li"))
def merge_detections_touching(t: Tables) -> DataFrame:
    return intervals.merge_detections(_confident(t.det_li()), 0, 0)


@check(
    "clip_common_names",
    with_views(f"WITH {merged('det_ev', 0, 0)} SELECT file, scientific_name, common_name FROM names", "det_ev"),
)
def clip_common_names(t: Tables) -> DataFrame:
    return intervals.clip_common_names(_confident(t.det_ev()))


@check("clip_order", with_views(f"WITH {merged('det_ev', 60, 60)} SELECT {_CLIP} FROM clips", "det_ev"))
def clip_order(t: Tables) -> DataFrame:
    return intervals.clip_order(intervals.merge_detections(_confident(t.det_ev()), 60, 60))


@check(
    "detections_in_clips",
    with_views(
        f"""WITH {merged('det_ev', 300, 300)}
            SELECT n.file, n.line, n.scientific_name, c."start" AS clip_start, c."end" AS clip_end,
                   c.detection_count
            FROM (SELECT file, scientific_name, island, min(s) AS "start", max(e) AS "end",
                         count(*) AS detection_count FROM numbered GROUP BY ALL) c
            JOIN numbered n USING (file, scientific_name, island)""",
        "det_ev",
    ),
)
def detections_in_clips(t: Tables) -> DataFrame:
    inside = intervals.detections_in_clips(_confident(t.det_ev()), _clips_ev(t))
    return inside.select(
        "file",
        "line",
        "scientific_name",
        "clip_start",
        "clip_end",
        F.col("clip_detection_count").alias("detection_count"),
    )


@check(
    "segments_for_clips",
    with_views(
        f"""WITH {merged('det_li', 1, 1)},
            grid AS (SELECT file, unnest(generate_series(0, CAST(ceil(duration_s / 3) AS BIGINT) - 1)) AS seg_idx
                     FROM recordings WHERE duration_s > 0)
            SELECT g.file, g.seg_idx, c.scientific_name, c."start" AS clip_start, c."end" AS clip_end,
                   greatest(g.seg_idx * 3::DOUBLE, c."start") AS from_s,
                   least(g.seg_idx * 3::DOUBLE + 3, c."end") AS to_s
            FROM grid g JOIN clips c ON g.file = c.file
             AND g.seg_idx * 3 + 3 > c."start" AND g.seg_idx * 3 < c."end" """,
        "det_li",
        "recordings",
    ),
)
def segments_for_clips(t: Tables) -> DataFrame:
    grid = segments.segment_grid(t.recordings(), 3.0).select("file", "seg_idx", "start_s", "end_s")
    clips = intervals.merge_detections(_confident(t.det_li()), 1, 1)
    return intervals.segments_for_clips(grid, clips).select(
        "file", "seg_idx", "scientific_name", "clip_start", "clip_end", "from_s", "to_s"
    )


def _grid_sql(size: str, keep: str, end: str, extra: str = "") -> str:
    """Segment starts by the definition: full steps, then what is left over."""
    return with_views(
        f"""WITH n AS (SELECT file, CAST(duration_s * sample_rate AS BIGINT) AS frames,
                      CAST({size} AS BIGINT) AS size, CAST({keep} AS BIGINT) AS keep FROM recordings),
            f AS (SELECT *, CASE WHEN frames >= size THEN (frames - size) // (size - keep) + 1
                            ELSE 0 END AS full_count FROM n),
            r AS (SELECT *, frames - full_count * (size - keep) AS rest FROM f),
            starts AS (
              SELECT file, size, frames, i AS seg_idx, i * (size - keep) AS start_sample
                FROM r, unnest(generate_series(0, full_count - 1)) u(i)
              UNION ALL SELECT file, size, frames, full_count, full_count * (size - keep)
                FROM r WHERE rest > 0
              UNION ALL SELECT file, size, frames, full_count + 1, frames - keep
                FROM r WHERE rest > keep AND keep > 0)
            SELECT file, seg_idx, start_sample,
                   CAST(start_sample / 48000.0::DOUBLE AS FLOAT) AS start_s,
                   CAST(start_sample / 48000.0::DOUBLE AS FLOAT) + {end} AS end_s,
                   least(size, frames - start_sample) AS real_samples{extra}
            FROM starts""",
        "recordings",
    )


_GRID = ["file", "seg_idx", "start_sample", "start_s", "end_s", "real_samples"]


@check("segment_grid", _grid_sql("144000", "0", "3::FLOAT"))
def segment_grid(t: Tables) -> DataFrame:
    return segments.segment_grid(t.recordings(), 3.0).select(*_GRID)


@check("segment_grid_overlap", _grid_sql("144000", "48000", "3::FLOAT"))
def segment_grid_overlap(t: Tables) -> DataFrame:
    return segments.segment_grid(t.recordings(), 3.0, 1.0).select(*_GRID)


@check("segment_grid_resampled", _grid_sql("240000", "72000", "5::FLOAT"))
def segment_grid_resampled(t: Tables) -> DataFrame:
    return segments.segment_grid(t.recordings(), 5.0, 1.5, model_rate=32000).select(*_GRID)


@check(
    "chunk_grid",
    with_views(
        """WITH n AS (SELECT file, CAST(duration_s * sample_rate AS BIGINT) AS frames FROM recordings)
           SELECT file, i AS seg_idx, i * 120000 AS start_sample,
                  CAST(i * 120000 / 48000.0::DOUBLE AS FLOAT) AS start_s,
                  CAST(i * 120000 / 48000.0::DOUBLE AS FLOAT) + 3::FLOAT AS end_s
           FROM n, unnest(generate_series(0, CAST(ceil(frames / 120000.0::DOUBLE) AS BIGINT) - 1)) u(i)""",
        "recordings",
    ),
)
def chunk_grid(t: Tables) -> DataFrame:
    return segments.chunk_grid(t.recordings(), 3.0, 0.5).select(*_GRID[:5])


@check("bat_segment_grid", _grid_sql("144000", "36000", "3::FLOAT", ", TRUE AS rate_warning"))
def bat_segment_grid(t: Tables) -> DataFrame:
    return segments.bat_segment_grid(t.recordings()).select(*_GRID, "rate_warning")


@check(
    "recording_summary",
    with_views(
        """SELECT r.file, count(d.file) AS total_detections,
                  count(DISTINCT d.scientific_name) AS unique_species,
                  CAST(any_value(r.duration_s) AS FLOAT) AS audio_duration_seconds
           FROM recordings r LEFT JOIN detections d ON r.file = d.file GROUP BY r.file""",
        "recordings",
        "detections",
    ),
)
def recording_summary(t: Tables) -> DataFrame:
    return summaries.recording_summary(t.detections(), t.recordings())


@check(
    "species_summary",
    with_views(
        """SELECT scientific_name, count(*) AS detections, max(confidence) AS max_confidence,
                  round(avg(confidence::DOUBLE), 6) AS mean_confidence
           FROM detections GROUP BY 1""",
        "detections",
    ),
)
def species_summary(t: Tables) -> DataFrame:
    summary = summaries.species_summary(t.detections())
    return summary.withColumn("mean_confidence", F.round("mean_confidence", 6))


@check(
    "species_summary_daily",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS scientific_name,
              count(*) AS detections, max(CAST(least(value / 100.0, 1.0) AS FLOAT)) AS max_confidence,
              round(avg(CAST(least(value / 100.0, 1.0) AS FLOAT)::DOUBLE), 6) AS mean_confidence
       FROM events GROUP BY 1, 2""",
)
def species_summary_daily(t: Tables) -> DataFrame:
    det = t.raw("events").select(
        F.col("ts").cast("timestamp").alias("recorded_at"),
        F.col("event_type").alias("scientific_name"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).cast("float").alias("confidence"),
    )
    daily = summaries.species_summary(det, window="1 day", sort=False)
    return daily.select(
        F.date_format("period_start", "yyyy-MM-dd").alias("day"),
        "scientific_name",
        "detections",
        "max_confidence",
        F.round("mean_confidence", 6).alias("mean_confidence"),
    )


@check(
    "run_summary",
    with_views(
        """WITH s AS (SELECT run, count(*) FILTER (status = 'processed') AS files_processed,
                  count(*) FILTER (status = 'failed') AS files_failed,
                  count(*) FILTER (status IN ('skipped', 'locked')) AS files_skipped,
                  CAST(sum(detections) FILTER (status = 'processed') AS BIGINT) AS total_detections,
                  CAST(sum(segments) FILTER (status = 'processed') AS BIGINT) AS total_segments,
                  sum(audio_s) FILTER (status = 'processed') AS audio_s, sum(wall_s) AS wall_s
                  FROM file_status GROUP BY run)
           SELECT *, CASE WHEN files_failed = 0 THEN 'success' WHEN files_processed > 0
                     THEN 'partial_success' ELSE 'failed' END AS status,
                  total_segments / wall_s AS segments_per_second, audio_s / wall_s AS realtime_factor
           FROM s""",
        "file_status",
    ),
)
def run_summary(t: Tables) -> DataFrame:
    return summaries.run_summary(t.file_status())


_BATCH_FILES = """files AS (SELECT batch, file, count(*) FILTER (outcome = 'written') AS clips,
      count(*) FILTER (outcome = 'file_failed') > 0
      OR (count(*) FILTER (outcome = 'clip_failed') > 0
          AND count(*) FILTER (outcome = 'written') = 0) AS failed
      FROM clip_results GROUP BY 1, 2)"""


@check("clip_file_results", with_views(f"WITH {_BATCH_FILES} SELECT * FROM files", "clip_results"))
def clip_file_results(t: Tables) -> DataFrame:
    return summaries.clip_file_results(t.clip_results())


@check(
    "clip_batch_summary",
    with_views(
        f"""WITH {_BATCH_FILES}, b AS (SELECT batch,
                CAST(sum(CASE WHEN failed THEN 0 ELSE clips END) AS BIGINT) AS total_clips,
                count(*) FILTER (NOT failed) AS total_files, count(*) FILTER (failed) AS failed_files
                FROM files GROUP BY batch)
            SELECT *, total_files = 0 AND failed_files > 0 AS batch_failed FROM b""",
        "clip_results",
    ),
)
def clip_batch_summary(t: Tables) -> DataFrame:
    return summaries.clip_batch_summary(t.clip_results())


@check(
    "rejected_report",
    with_views(
        """WITH bad AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS rn FROM det_dirty
                WHERE NOT (isfinite("start") AND isfinite("end") AND isfinite(confidence)))
           SELECT file, count(*) AS skipped,
                  string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (rn <= 10) AS sample_lines
           FROM bad GROUP BY file""",
        "det_dirty",
    ),
)
def rejected_report(t: Tables) -> DataFrame:
    _, rejected = quality.finite_rows(t.det_dirty())
    report = summaries.rejected_report(rejected)
    return report.withColumn(
        "sample_lines", F.concat_ws(",", F.col("sample_lines").cast("array<string>"))
    )


@check(
    "pending_recordings",
    with_views(
        """SELECT file, duration_s FROM recordings WHERE file NOT IN (
               SELECT file FROM outputs WHERE format IN ('A', 'R') GROUP BY file
               HAVING count(DISTINCT format) = 2)""",
        "recordings",
        "outputs",
    ),
)
def pending_recordings(t: Tables) -> DataFrame:
    inventory = t.recordings().select("file", "duration_s")
    return work.pending_recordings(inventory, t.outputs(), ["A", "R"])


@check(
    "resolve_audio",
    with_views(
        """WITH tries AS (
             SELECT file, base || '.flac' AS path, 0 AS pos FROM result_files WHERE style = 1
             UNION ALL SELECT file, base || e.ext, e.pos FROM result_files,
               (VALUES ('.wav', 1), ('.flac', 2), ('.mp3', 3), ('.m4a', 4), ('.aac', 5)) e(ext, pos)),
           found AS (SELECT t.file, arg_min(path, pos) AS audio_path FROM tries t
                     JOIN audio_inventory a ON a.file = t.path GROUP BY t.file)
           SELECT r.file, f.audio_path FROM result_files r LEFT JOIN found f ON r.file = f.file""",
        "result_files",
        "audio_inventory",
    ),
)
def resolve_audio(t: Tables) -> DataFrame:
    return work.resolve_audio(t.result_files(), t.audio_inventory())


@check(
    "plan_clips",
    with_views(
        f"""WITH clean AS (SELECT * FROM det_dirty
                  WHERE isfinite("start") AND isfinite("end") AND isfinite(confidence)
                  AND file NOT IN (SELECT file FROM det_dirty
             WHERE isfinite("start") AND isfinite("end") AND isfinite(confidence) AND "end" <= "start")),
            {merged('clean', 30, 30, 0.2)},
            audio AS (SELECT DISTINCT file AS path FROM det_ev)
            SELECT {_CLIP}, path AS audio_path,
                   scientific_name || '/' || scientific_name || '_' ||
                   CAST(round(max_confidence * 100::FLOAT) AS INTEGER) || 'p_' ||
                   printf('%.1f', "start") || '-' || printf('%.1f', "end") || '.wav' AS clip_path
            FROM clips LEFT JOIN audio ON path = file""",
        "det_dirty",
    ),
)
def plan_clips(t: Tables) -> DataFrame:
    inventory = t.det_ev().select("file").distinct()
    return clip_plans.plan_clips(t.det_dirty(), inventory, 0.2, 30, 30, layout="shared")


@check(
    "assign_region",
    with_views(
        """WITH best AS (SELECT country, region, coverage FROM (SELECT *, row_number() OVER (
                PARTITION BY country ORDER BY coverage, group_order, region) AS rn FROM coverage) WHERE rn = 1)
           SELECT r.file, r.country, b.region, b.coverage
           FROM recordings r LEFT JOIN best b ON r.country = b.country""",
        "recordings",
        "coverage",
    ),
)
def assign_region(t: Tables) -> DataFrame:
    recordings = t.recordings().select("file", "country")
    return regions.assign_region(recordings, t.regions())


@check(
    "detection_order",
    with_views("SELECT start_s, end_s, scientific_name, common_name, confidence, file FROM detections", "detections"),
)
def detection_order(t: Tables) -> DataFrame:
    return ordering.detection_order(t.detections())


_ORDER = "start_s, confidence DESC, scientific_name, common_name, end_s"


@check(
    "selection_number",
    with_views(
        f"""SELECT *, row_number() OVER (PARTITION BY file ORDER BY {_ORDER}) AS selection
            FROM detections""",
        "detections",
    ),
)
def selection_number(t: Tables) -> DataFrame:
    return ordering.selection_number(t.detections())


@check(
    "combine_results",
    with_views(
        """SELECT start_s, end_s, scientific_name, common_name, confidence, file FROM detections
           UNION ALL SELECT CAST("start" AS FLOAT), CAST("end" AS FLOAT), scientific_name, common_name,
                  confidence, file FROM det_ev""",
        "detections",
        "det_ev",
    ),
)
def combine_results(t: Tables) -> DataFrame:
    events = t.det_ev().select(
        F.col("start").cast("float").alias("start_s"),
        F.col("end").cast("float").alias("end_s"),
        "scientific_name",
        "common_name",
        "confidence",
        "file",
    )
    return combine.combine_results([t.detections(), events])
