"""Checks of scalar functions, filters and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.functions import calendar, labels, paths, timing
from dawnchorus.operators import quality, scoring
from dawnchorus.testbed.registry import check
from dawnchorus.testbed.sql import species_key, week_of, with_views
from dawnchorus.testbed.tables import Tables


@check(
    "split_label",
    with_views(
        """SELECT label, count(*) AS n, split_part(label, '_', 1) AS scientific_name,
                  CASE WHEN instr(label, '_') = 0 THEN label
                       ELSE substr(label, instr(label, '_') + 1) END AS common_name
           FROM pred GROUP BY label""",
        "pred",
    ),
)
def split_label(t: Tables) -> DataFrame:
    label = F.col("label")
    return (
        t.pred()
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("scientific_name", labels.label_scientific(label))
        .withColumn("common_name", labels.label_common(label))
    )


_MIXED_LABEL = "CASE WHEN doc_id % 3 = 0 THEN replace(text,' ','_') ELSE text || '_' || lang END"


@check(
    "species_names",
    f"""WITH l AS (SELECT doc_id, {_MIXED_LABEL} AS label FROM documents)
        SELECT doc_id, label,
               CASE WHEN instr(label,'_') > 0 AND instr(split_part(label,'_',1),' ') > 0
                    THEN split_part(label,'_',1) ELSE label END AS species,
               {species_key('label')} AS species_key
        FROM l""",
)
def species_names(t: Tables) -> DataFrame:
    head = F.col("text")
    mixed = F.when(F.col("doc_id") % 3 == 0, F.replace(head, F.lit(" "), F.lit("_"))).otherwise(
        F.concat(head, F.lit("_"), F.col("lang"))
    )
    label = F.col("label")
    return (
        t.raw("documents")
        .select("doc_id", mixed.alias("label"))
        .withColumn("species", labels.species_name(label))
        .withColumn("species_key", labels.species_key(label))
    )


@check(
    "species_codes",
    """WITH w AS (SELECT p_partkey, p_name,
                         list_filter(regexp_split_to_array(trim(p_name), '\\s+'), lambda x: x <> '') AS ws
                  FROM part)
       SELECT p_partkey, p_name,
              CASE WHEN len(ws) = 0 THEN 'unkn'
                   WHEN len(ws) = 1 THEN lower(substr(ws[1], 1, 4))
                   ELSE lower(substr(ws[1], 1, 3) || substr(ws[len(ws)], 1, 3)) END AS code,
              replace(p_name, ' ', '_') AS underscored,
              replace(p_name || '_' || p_brand, '_', ', ') AS comma_separated
       FROM w JOIN part USING (p_partkey, p_name)""",
)
def species_codes(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.raw("part").select(
        "p_partkey",
        "p_name",
        labels.species_code(name).alias("code"),
        labels.underscored(name).alias("underscored"),
        labels.comma_separated(F.concat_ws("_", "p_name", "p_brand")).alias("comma_separated"),
    )


@check(
    "model_weeks",
    f"""SELECT o_orderkey, {week_of('o_orderdate')} AS week,
               CAST(floor(({week_of('o_orderdate')} - 1) * 7.6 + 1) AS INTEGER) AS week_day,
               CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year
        FROM orders""",
)
def model_weeks(t: Tables) -> DataFrame:
    date = F.col("o_orderdate")
    week = calendar.model_week(F.month(date), F.dayofmonth(date))
    return t.raw("orders").select(
        "o_orderkey",
        week.alias("week"),
        calendar.week_start_day(week).alias("week_day"),
        calendar.recording_day_of_year(F.lit(None), date).alias("day_of_year"),
    )


@check(
    "month_days",
    """WITH d AS (SELECT c_custkey, c_custkey % 420 AS doy FROM customer),
            m AS (SELECT *, CASE WHEN doy > 365 THEN NULL ELSE
                    date '2023-01-01' + CAST(greatest(doy, 1) - 1 AS INTEGER) END AS dt FROM d)
       SELECT c_custkey, doy,
              CAST(CASE WHEN doy > 365 THEN 12 ELSE month(dt) END AS INTEGER) AS month,
              CAST(CASE WHEN doy > 365 THEN 31 WHEN doy = 0 THEN 0 ELSE day(dt) END AS INTEGER) AS day
       FROM m""",
)
def month_days(t: Tables) -> DataFrame:
    doy = F.col("c_custkey") % 420
    date = calendar.day_to_month_day(doy)
    return t.raw("customer").select(
        "c_custkey", doy.alias("doy"), date["month"].alias("month"), date["day"].alias("day")
    )


@check(
    "analysis_weeks",
    f"""WITH w AS (SELECT c_custkey, CAST(c_custkey % 48 + 1 AS INTEGER) AS requested FROM customer),
             d AS (SELECT *, date '2023-01-01' + CAST(floor((requested - 1) * 7.6) AS INTEGER) AS dt FROM w)
        SELECT c_custkey, requested, {week_of('dt')} AS reported FROM d""",
)
def analysis_weeks(t: Tables) -> DataFrame:
    requested = (F.col("c_custkey") % 48 + 1).cast("int")
    return t.raw("customer").select(
        "c_custkey", requested.alias("requested"), calendar.analysis_week(requested).alias("reported")
    )


@check(
    "path_parts",
    with_views(
        """SELECT page_id, file, regexp_extract(file, '([^/]*)$', 1) AS base,
                  regexp_extract(file, '([^/]+)/[^/]*$', 1) AS folder,
                  CASE WHEN regexp_matches(file, '^/[^/]*/[^/]*$') THEN '/'
                       ELSE regexp_extract(file, '^(.*)/[^/]*/[^/]*$', 1) END AS indir
           FROM paths""",
        "paths",
    ),
)
def path_parts(t: Tables) -> DataFrame:
    parts = paths.path_parts(F.col("file"))
    return t.paths().select("page_id", "file", parts["base"].alias("base"), parts["folder"].alias("folder"), parts["indir"].alias("indir"))


@check(
    "output_paths",
    with_views(
        """SELECT page_id, f.format, regexp_extract(file, '^(.*)/[^/]*$', 1) || '/' ||
                  CASE WHEN regexp_matches(regexp_extract(file, '([^/]*)$', 1), '^.+\\.[^.]*$')
                       THEN regexp_extract(regexp_extract(file, '([^/]*)$', 1), '^(.+)\\.[^.]*$', 1)
                       ELSE regexp_extract(file, '([^/]*)$', 1) END || f.suffix AS target
           FROM paths, (VALUES ('csv', '.BirdNET.results.csv'),
                ('raven', '.BirdNET.selection.table.txt'), ('audacity', '.BirdNET.results.txt'),
                ('kaleidoscope', '.BirdNET.results.kaleidoscope.csv'), ('json', '.BirdNET.json'),
                ('parquet', '.BirdNET.results.parquet')) f(format, suffix)""",
        "paths",
    ),
)
def output_paths(t: Tables) -> DataFrame:
    formats = F.array(*[F.lit(f) for f in paths.OUTPUT_SUFFIXES])
    return (
        t.paths()
        .withColumn("format", F.explode(formats))
        .select("page_id", "format", paths.output_path(F.col("file"), F.col("format")).alias("target"))
    )


@check(
    "clip_paths",
    with_views(
        """WITH s AS (SELECT line, replace(translate(scientific_name || ':' || common_name || '..',
                         '/\\:*?"<>|', '_________'), '..', '__') AS name, confidence, "start", "end"
                      FROM det_ev)
           SELECT line, name || '/' || name || '_' || CAST(round(confidence * 100::FLOAT) AS INTEGER)
                  || 'p_' || printf('%.1f', "start") || '-' || printf('%.1f', "end") || '.wav' AS target
           FROM s""",
        "det_ev",
    ),
)
def clip_paths(t: Tables) -> DataFrame:
    name = F.concat("scientific_name", F.lit(":"), "common_name", F.lit(".."))
    target = paths.clip_path(name, F.col("confidence"), F.col("start"), F.col("end"))
    return t.det_ev().select("line", target.alias("target"))


@check(
    "durations",
    with_views(
        """SELECT file, printf('%02d:%02d:%02d', CAST(duration_s * 37 AS BIGINT) // 3600,
                  CAST(duration_s * 37 AS BIGINT) % 3600 // 60, CAST(duration_s * 37 AS BIGINT) % 60) AS shown,
                  CAST(ceil(duration_s / 2.5) AS BIGINT) AS estimated_segments,
                  CASE WHEN active THEN duration_s
                       WHEN site > 0 THEN (site - 1) * 2.5::DOUBLE + 3.0 ELSE 0.0 END AS estimated_duration
           FROM recordings""",
        "recordings",
    ),
)
def durations(t: Tables) -> DataFrame:
    seg, overlap = F.lit(3.0), F.lit(0.5)
    hint = F.when(F.col("active"), F.col("duration_s"))
    return t.recordings().select(
        "file",
        timing.format_duration(F.col("duration_s") * 37).alias("shown"),
        timing.estimated_segments(F.col("duration_s"), seg, overlap).alias("estimated_segments"),
        timing.estimated_duration(hint, F.col("site"), seg, overlap).alias("estimated_duration"),
    )


@check(
    "throughput",
    with_views(
        """SELECT file, CASE WHEN detections > 0 AND segments > 0
                       THEN segments / CAST(detections AS DOUBLE) ELSE 0.0 END AS segments_per_second,
                  CASE WHEN detections > 0 AND audio_s > 0
                       THEN audio_s / detections ELSE 0.0 END AS realtime_factor
           FROM file_status""",
        "file_status",
    ),
)
def throughput(t: Tables) -> DataFrame:
    wall = F.col("detections").cast("double")
    return t.file_status().select(
        "file",
        timing.segments_per_second(F.col("segments"), wall).alias("segments_per_second"),
        timing.realtime_factor(F.col("audio_s"), wall).alias("realtime_factor"),
    )


@check(
    "min_confidence",
    with_views(
        """SELECT file, line, "start", scientific_name, confidence FROM det_dirty
           WHERE NOT isnan(confidence) AND confidence >= CAST(0.1 AS FLOAT)""",
        "det_dirty",
    ),
)
def min_confidence(t: Tables) -> DataFrame:
    kept = quality.min_confidence(t.det_dirty(), 0.1)
    return kept.select("file", "line", "start", "scientific_name", "confidence")


_FINITE = 'isfinite("start") AND isfinite("end") AND isfinite(confidence)'


@check(
    "finite_rows_good",
    with_views(f'SELECT file, line, "start", "end", confidence FROM det_dirty WHERE {_FINITE}', "det_dirty"),
)
def finite_rows_good(t: Tables) -> DataFrame:
    good, _ = quality.finite_rows(t.det_dirty())
    return good.select("file", "line", "start", "end", "confidence")


@check(
    "finite_rows_rejected",
    with_views(f"SELECT file, line, scientific_name FROM det_dirty WHERE NOT ({_FINITE})", "det_dirty"),
)
def finite_rows_rejected(t: Tables) -> DataFrame:
    _, rejected = quality.finite_rows(t.det_dirty())
    return rejected.select("file", "line", "scientific_name")


@check(
    "valid_ranges",
    with_views(
        """SELECT file, line, "start", "end" FROM det_dirty
           WHERE file NOT IN (SELECT file FROM det_dirty
             WHERE isfinite("start") AND isfinite("end") AND isfinite(confidence) AND "end" <= "start")""",
        "det_dirty",
    ),
)
def valid_ranges(t: Tables) -> DataFrame:
    return quality.valid_ranges(t.det_dirty()).select("file", "line", "start", "end")


@check(
    "valid_range_rows",
    with_views(
        """SELECT file, line, "start", "end" FROM det_dirty
           WHERE isfinite("start") AND isfinite("end") AND "start" >= 0 AND "end" > "start" """,
        "det_dirty",
    ),
)
def valid_range_rows(t: Tables) -> DataFrame:
    return quality.valid_ranges(t.det_dirty(), on_bad="row").select("file", "line", "start", "end")


_VIOLATIONS = """
    SELECT c_custkey, 'min_confidence' AS field, 'must be between 0 and 1' AS message FROM params
      WHERE NOT min_confidence BETWEEN 0 AND 1
    UNION ALL SELECT c_custkey, 'overlap', 'must be a finite non-negative number' FROM params
      WHERE isnan(overlap) OR overlap < 0
    UNION ALL SELECT c_custkey, 'batch_size', 'must be between 1 and 512' FROM params
      WHERE NOT batch_size BETWEEN 1 AND 512
    UNION ALL SELECT c_custkey, 'day_of_year', 'must be between 1 and 366' FROM params
      WHERE NOT day_of_year BETWEEN 1 AND 366
    UNION ALL SELECT c_custkey, 'formats', 'must list at least one output format' FROM params
      WHERE n_formats = 0
    UNION ALL SELECT c_custkey, 'csv_columns', 'has an unknown column' FROM params
      WHERE csv_column <> 'lat'
    UNION ALL SELECT c_custkey, 'latitude', 'must be between -90 and 90' FROM params
      WHERE NOT latitude BETWEEN -90 AND 90
    UNION ALL SELECT c_custkey, 'longitude', 'must be between -180 and 180' FROM params
      WHERE NOT longitude BETWEEN -180 AND 180
    UNION ALL SELECT c_custkey, 'range_threshold', 'must be between 0 and 1' FROM params
      WHERE NOT range_threshold BETWEEN 0 AND 1
    UNION ALL SELECT c_custkey, 'model', 'does not exist' FROM params
      WHERE model NOT IN (SELECT 'm' || n_nationkey FROM nation)"""


@check("rule_violations", with_views(_VIOLATIONS, "params"))
def rule_violations(t: Tables) -> DataFrame:
    return quality.rule_violations(t.params(), "c_custkey", t.models())


@check(
    "wants_range_filter",
    with_views(
        """SELECT c_custkey, NOT bat_mode AND model_type <> 'bsg-finland' AS supported,
                  NOT bat_mode AND model_type <> 'bsg-finland' AND longitude IS NOT NULL
                  AND (week IS NOT NULL OR (month IS NOT NULL AND day IS NOT NULL)) AS wanted
           FROM params""",
        "params",
    ),
)
def wants_range_filter(t: Tables) -> DataFrame:
    supported = quality.supports_range_filter(F.col("model_type"), F.col("bat_mode"))
    wanted = quality.wants_range_filter(
        *[F.col(c) for c in ("latitude", "longitude", "week", "month", "day")], supported
    )
    return t.params().select("c_custkey", supported.alias("supported"), wanted.alias("wanted"))


@check(
    "postprocess_flags",
    with_views(
        """SELECT file, TRUE AS calibration_applied, active AS sdm_applied,
                  CAST(lat AS FLOAT) AS sdm_latitude, CAST(lon AS FLOAT) AS sdm_longitude,
                  CASE WHEN active THEN CAST(dayofyear(modified) AS INTEGER) END AS sdm_day_of_year
           FROM recordings""",
        "recordings",
    ),
)
def postprocess_flags(t: Tables) -> DataFrame:
    day = F.when(F.col("active"), F.dayofyear("modified"))
    flagged = scoring.postprocess_flags(t.recordings().withColumn("day_of_year", day), "bsg-finland")
    return flagged.select(
        "file", "calibration_applied", "sdm_applied", "sdm_latitude", "sdm_longitude", "sdm_day_of_year"
    )
