"""The same views as portable SQL, for comparing results with another engine."""

from __future__ import annotations

_WEEK = """CAST(least(floor((({days}) + day({d}) - 1) / 7.6) + 1, 48) AS INTEGER)"""
_DAYS = "[0,31,59,90,120,151,181,212,243,273,304,334][CAST(month({d}) AS INTEGER)]"


def week_of(date: str) -> str:
    return _WEEK.format(days=_DAYS.format(d=date), d=date)


def species_key(label: str) -> str:
    prefix = f"split_part({label}, '_', 1)"
    return (
        f"lower(CASE WHEN instr({label}, '_') > 0 AND instr({prefix}, ' ') > 0 "
        f"THEN {prefix} ELSE {label} END)"
    )


VIEWS: dict[str, str] = {
    "det_ev": """
        SELECT 'rec_' || strftime(ts, '%Y-%m-%d') || '.wav' AS file,
               CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS "start",
               CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 3 AS DOUBLE) AS "end",
               event_type AS scientific_name,
               event_type || ' ' || CAST(user_id % 3 AS VARCHAR) AS common_name,
               CAST(least(value / 100.0, 1.0) AS FLOAT) AS confidence, event_id AS line
        FROM events""",
    "det_li": """
        SELECT 'ord_' || l_orderkey || '.wav' AS file,
               CAST((l_linenumber - 1) * 3 AS DOUBLE) AS "start",
               CAST((l_linenumber - 1) * 3 + 3 AS DOUBLE) AS "end",
               p_type AS scientific_name, p_name AS common_name,
               CAST(l_quantity / 50 AS FLOAT) AS confidence
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "detections": """
        SELECT CAST("start" AS FLOAT) AS start_s, CAST("end" AS FLOAT) AS end_s,
               scientific_name, common_name, confidence, file
        FROM det_li""",
    "det_dirty": """
        SELECT file, line, "start",
               CASE WHEN line % 89 = 0 THEN CAST('inf' AS DOUBLE)
                    WHEN line % 1009 = 0 THEN "start" - 1 ELSE "end" END AS "end",
               scientific_name, common_name,
               CASE WHEN line % 97 = 0 THEN CAST('nan' AS FLOAT)
                    WHEN line % 83 = 0 THEN CAST('inf' AS FLOAT) ELSE confidence END AS confidence
        FROM det_ev""",
    "pred": """
        SELECT 'ord_' || l_orderkey || '.wav' AS file, l_orderkey % 1000 AS seg_idx,
               CAST(l_orderkey % 1000 * 3 AS FLOAT) AS start_s,
               CAST(l_orderkey % 1000 * 3 + 3 AS FLOAT) AS end_s,
               p_name || '_' || p_brand AS label,
               CAST(l_quantity / 50 AS FLOAT) AS confidence,
               CAST(l_partkey AS INTEGER) AS class_index
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "clf_labels": """
        SELECT p_name || '_' || p_brand AS label, CAST(min(p_partkey) AS INTEGER) AS class_index
        FROM part GROUP BY 1""",
    "geo_labels": """
        SELECT DISTINCT upper(CASE WHEN p_name LIKE '%bolt' THEN 'other ' || p_name ELSE p_name END) || '_X' AS label
        FROM part""",
    "listed": """
        SELECT DISTINCT p_name || '_' || p_brand AS label FROM part WHERE p_size > 25""",
    "visits": f"""
        SELECT c_nationkey AS site, {week_of('o_orderdate')} AS week, p_name
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "occ": """
        SELECT DISTINCT CASE WHEN p_name LIKE '%ring' THEN 'other ' || p_name ELSE p_name END || '_occ' AS species,
               length(p_name) AS class_index,
               CAST((length(p_name) * 13 % 101) / 100.0 AS FLOAT) AS score
        FROM part""",
    "occ_sites": """
        SELECT DISTINCT site, week,
               CASE WHEN p_name LIKE '%ring' THEN 'other ' || p_name ELSE p_name END || '_occ' AS species,
               length(p_name) AS class_index,
               CAST(((length(p_name) * 13 + site * 7 + week * 3) % 101) / 100.0 AS FLOAT) AS score
        FROM visits""",
    "weights": """
        SELECT DISTINCT p_name AS species,
               (length(p_name) * 7 % 11 - 5) / 100.0::DOUBLE AS w_lat,
               (length(p_name) * 5 % 13 - 6) / 100.0::DOUBLE AS w_lon,
               (length(p_name) * 3 % 7 - 3) / 100.0::DOUBLE AS w_week,
               (length(p_name) * 11 % 17 - 8) / 10.0::DOUBLE AS bias
        FROM part""",
    "recordings": f"""
        SELECT 'ord_' || o_orderkey || '.wav' AS file,
               CAST(floor(o_totalprice / 1000) AS DOUBLE) AS duration_s, 48000 AS sample_rate,
               o_orderdate AS modified, c_nationkey AS site,
               c_nationkey * 7 - 90.0::DOUBLE AS lat, c_nationkey * 14 - 180.0::DOUBLE AS lon,
               {week_of('o_orderdate')} AS week, o_orderkey % 10 <> 0 AS active,
               'NATION_' || c_nationkey AS country
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "outputs": """
        SELECT DISTINCT 'ord_' || l_orderkey || '.wav' AS file, l_returnflag AS format
        FROM lineitem""",
    "file_status": """
        SELECT user_id % 10 AS run, 'ev_' || event_id AS file,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped'
                    WHEN 'view' THEN 'locked' ELSE 'processed' END AS status,
               CAST(floor(value) AS BIGINT) AS detections, event_id % 50 AS segments,
               CAST(event_id % 50 * 3 AS DOUBLE) AS audio_s, 0.5::DOUBLE AS wall_s
        FROM events""",
    "clip_results": """
        SELECT CAST(day(ts) AS INTEGER) AS batch, 'f' || user_id AS file,
               CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 'file_failed'
                    WHEN event_type = 'error' THEN 'clip_failed'
                    WHEN event_type = 'signup' THEN 'no_detections' ELSE 'written' END AS outcome
        FROM events""",
    "params": """
        SELECT c_custkey, c_acctbal / 5000 AS min_confidence,
               CASE WHEN c_custkey % 11 = 0 THEN CAST('nan' AS DOUBLE)
                    ELSE c_custkey % 5 - 1.0::DOUBLE END AS overlap,
               c_custkey % 700 AS batch_size, c_custkey % 400 AS day_of_year,
               CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END AS n_formats,
               CASE WHEN c_custkey % 17 = 0 THEN 'latt' ELSE 'lat' END AS csv_column,
               'm' || (c_custkey % 30) AS model, c_acctbal / 50 AS latitude,
               CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 30 END AS longitude,
               c_acctbal / 7000 AS range_threshold,
               CASE WHEN c_custkey % 60 <> 0 THEN CAST(c_custkey % 60 AS INTEGER) END AS week,
               CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 12 + 1 AS INTEGER) END AS month,
               CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 28 + 1 AS INTEGER) END AS day,
               (['birdnet-v24','birdnet-v30','perch-v2','bsg-finland'])[c_custkey % 4 + 1]
                   AS model_type,
               c_custkey % 6 = 0 AS bat_mode
        FROM customer""",
    "coverage": """
        SELECT n_name AS country, 'region-' || n_regionkey AS region, n_regionkey AS group_order,
               CASE WHEN n_nationkey % 4 = 3 THEN 'partial' ELSE 'core' END AS coverage
        FROM nation WHERE NOT (n_nationkey % 4 = 3 AND n_nationkey >= 20)""",
    "result_files": """
        SELECT '/data/rec' || o_orderkey ||
               CASE o_orderkey % 3 WHEN 0 THEN '.BirdNET.results.csv'
                    WHEN 1 THEN '.flac.BirdNET.results.csv' ELSE '.txt' END AS file,
               '/data/rec' || o_orderkey AS base, o_orderkey % 3 AS style
        FROM orders""",
    "audio_inventory": """
        SELECT DISTINCT '/data/rec' || l_orderkey || '.' ||
               CASE l_returnflag WHEN 'A' THEN 'wav' WHEN 'N' THEN 'mp3' ELSE 'flac' END AS file
        FROM lineitem""",
    "paths": """
        SELECT page_id, regexp_replace(url, '^https?:/', '') AS file FROM pages""",
    # Derived tables shared by several checks.
    "winners": f"""
        SELECT {species_key('label')} AS species_key, arg_min(label, class_index) AS classifier_label,
               count(*) AS labels
        FROM clf_labels GROUP BY 1""",
    "mapping": f"""
        SELECT species_key, classifier_label FROM winners
        WHERE species_key IN (SELECT {species_key('label')} FROM geo_labels)""",
    "projected": f"""
        SELECT m.species_key, m.classifier_label, coalesce(o.score, 0::FLOAT) AS score
        FROM mapping m LEFT JOIN occ o ON {species_key('o.species')} = m.species_key""",
    "top5": """
        SELECT file, seg_idx, start_s, end_s, label, confidence, class_index FROM (
            SELECT *, row_number() OVER (PARTITION BY file, seg_idx
                ORDER BY confidence DESC, class_index, label) AS rn FROM pred) WHERE rn <= 5""",
}

_NEEDS: dict[str, list[str]] = {
    "detections": ["det_li"],
    "det_dirty": ["det_ev"],
    "occ_sites": ["visits"],
    "winners": ["clf_labels"],
    "mapping": ["winners", "geo_labels"],
    "projected": ["mapping", "occ"],
    "top5": ["pred"],
}


def _ordered(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _ordered(tuple(_NEEDS.get(name, [])), seen)
            seen.append(name)
    return seen


def with_views(body: str, *names: str) -> str:
    """A query over some of the views, as one statement."""
    views = [f"{name} AS ({VIEWS[name]})" for name in _ordered(names, [])]
    extra = body.lstrip()
    if extra.upper().startswith("WITH "):
        return "WITH " + ",\n".join(views) + ",\n" + extra[5:]
    return "WITH " + ",\n".join(views) + "\n" + body


def merged(source: str, pre: float, post: float, threshold: float = 0.1) -> str:
    """CTEs ``numbered`` and ``clips``: interval merging by running maximum."""
    return f"""
        padded AS (SELECT *, greatest("start" - {pre}, 0) AS s, "end" + {post} AS e,
                          row_number() OVER () AS rid FROM {source}
                   WHERE NOT isnan(confidence) AND confidence >= CAST({threshold} AS FLOAT)),
        reach AS (SELECT *, max(e) OVER (PARTITION BY file, scientific_name ORDER BY s, e, rid
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM padded),
        numbered AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (
                      PARTITION BY file, scientific_name ORDER BY s, e, rid
                      ROWS UNBOUNDED PRECEDING) AS island FROM reach),
        names AS (SELECT file, scientific_name, common_name FROM (
                      SELECT *, row_number() OVER (PARTITION BY file, scientific_name
                          ORDER BY "start", common_name) AS rn FROM padded) WHERE rn = 1),
        clips AS (SELECT n.file, n.scientific_name, any_value(c.common_name) AS common_name,
                      min(s) AS "start", max(e) AS "end", max(confidence) AS max_confidence,
                      count(*) AS detection_count
                  FROM numbered n JOIN names c
                    ON n.file = c.file AND n.scientific_name = c.scientific_name
                  GROUP BY n.file, n.scientific_name, island)"""
