"""Checks of top-k, label mapping, range filtering, species lists and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.operators import sites as operator_sites
from dawnchorus.operators import scoring, species
from dawnchorus.plans import analysis, species_lists
from dawnchorus.testbed.registry import check
from dawnchorus.testbed.sql import species_key, with_views
from dawnchorus.testbed.tables import Tables

_PRED = "file, seg_idx, start_s, end_s, label, confidence, class_index"


def _mapping(t: Tables) -> DataFrame:
    return species.species_map(t.geo_labels(), t.clf_labels())


def _projected(t: Tables) -> DataFrame:
    return species.project_scores(t.occ(), _mapping(t))


@check("top_k", with_views(f"SELECT {_PRED} FROM top5", "top5"))
def top_k(t: Tables) -> DataFrame:
    return species.top_k(t.pred(), 5)


@check(
    "rerank_order",
    with_views(
        """SELECT file, seg_idx, label, confidence, class_index, row_number() OVER (
               PARTITION BY file, seg_idx ORDER BY confidence DESC, class_index, label) AS position
           FROM pred""",
        "pred",
    ),
)
def rerank_order(t: Tables) -> DataFrame:
    wanted = t.pred().select("file", "seg_idx", "label", "confidence", "class_index")
    return species.rerank_order(wanted)


@check(
    "filter_species_list",
    with_views(f"SELECT {_PRED} FROM pred WHERE label IN (SELECT label FROM listed)", "pred", "listed"),
)
def filter_species_list(t: Tables) -> DataFrame:
    return species.filter_species_list(t.pred(), t.listed())


@check("species_map", with_views("SELECT species_key, classifier_label FROM mapping", "mapping"))
def species_map(t: Tables) -> DataFrame:
    return _mapping(t)


@check(
    "label_collisions",
    with_views(
        f"""SELECT w.species_key, w.classifier_label AS winner, c.label AS loser
            FROM winners w JOIN clf_labels c ON {species_key('c.label')} = w.species_key
            WHERE c.label <> w.classifier_label""",
        "winners",
    ),
)
def label_collisions(t: Tables) -> DataFrame:
    return species.label_collisions(t.clf_labels())


@check(
    "uncovered_labels",
    with_views(
        """SELECT label, class_index FROM clf_labels
           WHERE label NOT IN (SELECT classifier_label FROM mapping)""",
        "mapping",
    ),
)
def uncovered_labels(t: Tables) -> DataFrame:
    return species.uncovered_labels(t.clf_labels(), _mapping(t)).select("label", "class_index")


@check("project_scores", with_views("SELECT * FROM projected", "projected"))
def project_scores(t: Tables) -> DataFrame:
    return _projected(t)


@check(
    "project_scores_by_site",
    with_views(
        f"""WITH places AS (SELECT DISTINCT site, week FROM occ_sites),
                 keyed AS (SELECT site, week, {species_key('species')} AS species_key, score FROM occ_sites)
            SELECT p.site, p.week, m.species_key, m.classifier_label,
                   coalesce(k.score, 0::FLOAT) AS score
            FROM places p CROSS JOIN mapping m
            LEFT JOIN keyed k ON k.site = p.site AND k.week = p.week AND k.species_key = m.species_key""",
        "occ_sites",
        "mapping",
    ),
)
def project_scores_by_site(t: Tables) -> DataFrame:
    return species.project_scores(t.occ_sites(), _mapping(t), by=["site", "week"])


def _range_sql(policy_keep: bool, rerank: bool) -> str:
    confidence = "p.confidence * s.score" if rerank else "p.confidence"
    unmapped = "OR s.score IS NULL" if policy_keep and not rerank else ""
    return with_views(
        f"""SELECT p.file, p.seg_idx, p.start_s, p.end_s, p.label, {confidence} AS confidence,
                   p.class_index
            FROM pred p LEFT JOIN projected s ON p.label = s.classifier_label
            WHERE s.score >= CAST(0.3 AS FLOAT) {unmapped}""",
        "pred",
        "projected",
    )


@check("range_filter_keep", _range_sql(True, False))
def range_filter_keep(t: Tables) -> DataFrame:
    return species.range_filter(t.pred(), _projected(t), 0.3, "keep")


@check("range_filter_drop", _range_sql(False, False))
def range_filter_drop(t: Tables) -> DataFrame:
    return species.range_filter(t.pred(), _projected(t), 0.3, "drop")


@check("range_filter_rerank", _range_sql(True, True))
def range_filter_rerank(t: Tables) -> DataFrame:
    return species.range_filter(t.pred(), _projected(t), 0.3, "keep", rerank=True)


_BY_SITE = f"""
    WITH keyed AS (SELECT site, week, {species_key('species')} AS species_key, score FROM occ_sites),
    joined AS (
        SELECT p.*, coalesce(r.active, FALSE) AS active, m.species_key AS mapped,
               coalesce(k.score, 0::FLOAT) AS score
        FROM {{pred}} p LEFT JOIN recordings r ON p.file = r.file
        LEFT JOIN mapping m ON p.label = m.classifier_label
        LEFT JOIN keyed k ON k.site = r.site AND k.week = r.week AND k.species_key = m.species_key)"""


@check(
    "range_filter_by_site",
    with_views(
        _BY_SITE.format(pred="pred")
        + f"""SELECT {_PRED} FROM joined
              WHERE NOT active OR mapped IS NULL OR score >= CAST(0.3 AS FLOAT)""",
        "pred",
        "occ_sites",
        "recordings",
        "mapping",
    ),
)
def range_filter_by_site(t: Tables) -> DataFrame:
    return species.range_filter_by_site(
        t.pred(), t.recordings(), t.occ_sites(), _mapping(t), 0.3, "keep"
    )


@check(
    "range_filter_by_site_rerank",
    with_views(
        _BY_SITE.format(pred="pred")
        + """SELECT file, seg_idx, start_s, end_s, label,
                    CASE WHEN active THEN confidence * score ELSE confidence END AS confidence,
                    class_index FROM joined
             WHERE NOT active OR (mapped IS NOT NULL AND score >= CAST(0.3 AS FLOAT))""",
        "pred",
        "occ_sites",
        "recordings",
        "mapping",
    ),
)
def range_filter_by_site_rerank(t: Tables) -> DataFrame:
    return species.range_filter_by_site(
        t.pred(), t.recordings(), t.occ_sites(), _mapping(t), 0.3, "keep", rerank=True
    )


@check(
    "mapping_summary",
    with_views(
        """SELECT (SELECT count(*) FROM mapping) AS mapped,
                  greatest(count(*) - (SELECT count(*) FROM mapping), 0) AS unmatched,
                  count(*) AS total,
                  (SELECT count(*) FROM projected WHERE score >= CAST(0.3 AS FLOAT)) AS in_range
           FROM clf_labels""",
        "projected",
    ),
)
def mapping_summary(t: Tables) -> DataFrame:
    mapping = _mapping(t)
    projected = species.project_scores(t.occ(), mapping)
    return species.mapping_summary(t.clf_labels(), mapping, projected, 0.3)


@check(
    "species_list",
    with_views(
        f"""SELECT m.classifier_label AS label, o.score
            FROM occ o JOIN mapping m ON m.species_key = {species_key('o.species')}
            WHERE o.score >= CAST(0.03 AS FLOAT)""",
        "occ",
        "mapping",
    ),
)
def species_list(t: Tables) -> DataFrame:
    return species.species_list(t.occ(), _mapping(t))


_SIGMOID = """CAST(1 / (1 + exp(-(lat * w_lat + lon * w_lon + week * w_week + bias))) AS FLOAT)"""


@check(
    "occurrence_scores",
    with_views(
        f"""WITH cells AS (SELECT DISTINCT lat, lon, week FROM recordings)
            SELECT lat, lon, week, species, round({_SIGMOID}::DOUBLE, 5) AS score
            FROM cells CROSS JOIN weights""",
        "recordings",
        "weights",
    ),
)
def occurrence_scores(t: Tables) -> DataFrame:
    scores = scoring.occurrence_scores(t.recordings(), t.weights())
    rounded = F.round(F.col("score").cast("double"), 5)
    return scores.select("lat", "lon", "week", "species", rounded.alias("score"))


@check(
    "site_species_lists",
    with_views(
        f"""WITH cells AS (SELECT DISTINCT lat, lon, week FROM recordings),
                 scored AS (SELECT lat, lon, week, species, {_SIGMOID} AS score
                            FROM cells CROSS JOIN weights)
            SELECT lat, lon, week, w.classifier_label AS label, round(score::DOUBLE, 5) AS score
            FROM scored JOIN winners w ON w.species_key = {species_key('species')}
            WHERE score >= CAST(0.03 AS FLOAT)""",
        "recordings",
        "weights",
        "winners",
    ),
)
def site_species_lists(t: Tables) -> DataFrame:
    listed = species_lists.site_species_lists(
        t.recordings(), t.weights(), t.clf_labels(), sort=None
    )
    return listed.withColumn("score", F.round(F.col("score").cast("double"), 5))


@check(
    "query_weeks",
    with_views(
        """WITH d AS (SELECT c_custkey, week, month, day,
                  CASE WHEN week IS NOT NULL THEN date '2023-01-01' + CAST(least(floor((week - 1) * 7.6), 364) AS INTEGER)
                       ELSE make_date(2023, month, day) END AS dt
                  FROM params WHERE week IS NOT NULL OR (month IS NOT NULL AND day IS NOT NULL)),
                s AS (SELECT *, CAST(least(floor((dayofyear(dt) - 1) / 7.6) + 1, 48) AS INTEGER) AS scored FROM d)
           SELECT c_custkey, scored AS week, coalesce(week, scored) AS reported_week FROM s""",
        "params",
    ),
)
def query_weeks(t: Tables) -> DataFrame:
    return species_lists.with_query_week(t.params()).select("c_custkey", "week", "reported_week")


_HEAD = """
    dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
                    generate_subscripts(embedding, 1) AS dim FROM embeddings),
    head AS (SELECT label, dim, avg(x) AS w FROM dims GROUP BY 1, 2),
    scored AS (SELECT d.vec_id, h.label AS class_index, sum(d.x * h.w) AS score
               FROM dims d JOIN head h ON d.dim = h.dim GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id
                   ORDER BY score DESC, class_index) AS rn FROM scored)"""


@check(
    "classify_embeddings",
    f"""WITH {_HEAD}
        SELECT 'vec_' || vec_id AS file, 'class_' || class_index AS label,
               round(score, 6) AS score, CAST(class_index AS INTEGER) AS class_index
        FROM ranked WHERE rn <= 3""",
)
def classify_embeddings(t: Tables) -> DataFrame:
    best = scoring.classify_embeddings(t.emb(), t.head(), k=3)
    return best.select("file", "label", F.round("score", 6).alias("score"), "class_index")


_DETECTION = """start_s, end_s, split_part(label, '_', 1) AS scientific_name,
    substr(label, instr(label, '_') + 1) AS common_name, confidence, file"""


def _detections(df: DataFrame) -> DataFrame:
    return df.select("start_s", "end_s", "scientific_name", "common_name", "confidence", "file")


@check(
    "analyze_by_site",
    with_views(
        _BY_SITE.format(pred="kept").replace(
            "WITH ",
            """WITH kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, seg_idx
                   ORDER BY confidence DESC, class_index, label) AS rn
                   FROM pred WHERE confidence >= CAST(0.1 AS FLOAT)) WHERE rn <= 5),
               """,
            1,
        )
        + f""", final AS (SELECT file, start_s, end_s, label, CASE WHEN active THEN confidence * score
                   ELSE confidence END AS confidence FROM joined
                 WHERE NOT active OR (mapped IS NOT NULL AND score >= CAST(0.3 AS FLOAT)))
              SELECT {_DETECTION} FROM final WHERE confidence >= CAST(0.1 AS FLOAT)""",
        "pred",
        "occ_sites",
        "recordings",
        "mapping",
    ),
)
def analyze_by_site(t: Tables) -> DataFrame:
    sites = analysis.SiteRange(t.recordings(), t.occ_sites(), _mapping(t))
    settings = analysis.AnalysisSettings(range_threshold=0.3, rerank=True)
    return _detections(analysis.analyze(t.pred(), settings, sites=sites))


_PLACES = """r AS (SELECT o_orderkey, (o_orderkey * 7919 % 18001) / 100.0 - 90.0 AS lat, (o_orderkey * 104729 % 36001) / 100.0 - 180.0 AS lon
                   FROM orders),
             s AS (SELECT s_suppkey AS site, (s_suppkey * 6151 % 17989) / 100.0 - 89.9 AS lat, (s_suppkey * 3079 % 35981) / 100.0 - 179.9 AS lon
                   FROM supplier)"""


def _places(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as recordings and suppliers as sites, all over the globe."""

    def place(key: str, a: tuple, b: tuple):
        return [(F.col(key) * m % n / 100.0 - shift).alias(c) for c, (m, n, shift) in (("lat", a), ("lon", b))]

    recordings = t.raw("orders").select("o_orderkey", *place("o_orderkey", (7919, 18001, 90.0), (104729, 36001, 180.0)))
    sites = t.raw("supplier").select(F.col("s_suppkey").alias("site"), *place("s_suppkey", (6151, 17989, 89.9), (3079, 35981, 179.9)))
    return recordings, sites


@check(
    "nearest_sites",
    f"""WITH {_PLACES},
         xyz AS (SELECT o_orderkey, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM r),
         pts AS (SELECT site, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM s)
        SELECT o_orderkey, arg_min(site, d) AS site, round(2 * 6371.0088 * asin(min(d) / 2), 3) AS distance_km
        FROM (SELECT o_orderkey, site, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
              FROM xyz a, pts b) GROUP BY o_orderkey""",
)
def nearest_sites(t: Tables) -> DataFrame:
    recordings, found = _places(t)
    return operator_sites.nearest_sites(recordings, found).select("o_orderkey", "site", F.round("distance_km", 3).alias("distance_km"))


@check(
    "analyze_with_list",
    with_views(
        f"""WITH kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, seg_idx
                   ORDER BY confidence DESC, class_index, label) AS rn
                   FROM pred WHERE confidence >= CAST(0.5 AS FLOAT)) WHERE rn <= 3)
            SELECT {_DETECTION} FROM kept WHERE label IN (SELECT label FROM listed)""",
        "pred",
        "listed",
    ),
)
def analyze_with_list(t: Tables) -> DataFrame:
    settings = analysis.AnalysisSettings(min_confidence=0.5, top_k=3)
    return _detections(analysis.analyze(t.pred(), settings, species=t.listed()))


@check(
    "analyze_second_stage",
    f"""WITH {_HEAD}
        SELECT 0::FLOAT AS start_s, 3::FLOAT AS end_s, 'class' AS scientific_name,
               CAST(class_index AS VARCHAR) AS common_name,
               round(score, 5) AS confidence, 'vec_' || vec_id AS file
        FROM scored WHERE CAST(score AS FLOAT) >= CAST(0.01 AS FLOAT)""",
)
def analyze_second_stage(t: Tables) -> DataFrame:
    embedded = t.emb().select(
        "file",
        "seg_idx",
        F.lit(0.0).cast("float").alias("start_s"),
        F.lit(3.0).cast("float").alias("end_s"),
        "embedding",
    )
    stage = analysis.EmbeddingHead(embedded, t.head())
    found = _detections(analysis.analyze(t.pred(), analysis.AnalysisSettings(min_confidence=0.01), second_stage=stage))
    return found.withColumn("confidence", F.round(F.col("confidence").cast("double"), 5))
