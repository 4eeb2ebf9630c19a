import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from conftest import FOLDER, rows_of
from dawnchorus.operators import scoring, species
from dawnchorus.plans import analysis, species_lists
from dawnchorus.testbed.catalog import QUERIES, SQL

GEO = ["Parus major_Great Tit", "Cyanistes caeruleus_Blue Tit", "Sturnus vulgaris_Common Starling", "Turdus merula_Common Blackbird", "Corvus corone_Carrion Crow"]
CLASSIFIER = ["Parus major_Talitiainen", "Cyanistes caeruleus_Sinitiainen", "Dog_Dog", "Turdus merula_Mustarastas"]


def labels(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "class_index int, label string")


def scores(spark, pairs):
    return spark.createDataFrame([(s, i, v) for i, (s, v) in enumerate(pairs)], "species string, class_index int, score float")


def pred(spark, rows):
    return spark.createDataFrame(
        [("f", 0, 0.0, 3.0, label, conf, i) for i, (label, conf) in enumerate(rows)],
        "file string, seg_idx bigint, start_s float, end_s float, label string, confidence float, class_index int",
    )


def test_localised_labels_map(spark):
    got = species.species_map(labels(spark, GEO), labels(spark, CLASSIFIER))
    assert rows_of(got, "classifier_label") == [("Cyanistes caeruleus_Sinitiainen",), ("Parus major_Talitiainen",), ("Turdus merula_Mustarastas",)]


def test_first_label_wins(spark):
    clf = labels(spark, ["Parus major_B", "Parus major_A", "parus MAJOR_C"])
    got = species.species_map(labels(spark, GEO), clf)
    assert rows_of(got, "classifier_label") == [("Parus major_B",)]
    assert rows_of(species.label_collisions(clf)) == [("parus major", "Parus major_B", "Parus major_A"), ("parus major", "Parus major_B", "parus MAJOR_C")]


def test_projection_fills_zero_and_last_score_wins(spark):
    mapping = species.species_map(labels(spark, GEO), labels(spark, CLASSIFIER))
    raw = scores(spark, [("Parus major_x", 0.2), ("PARUS MAJOR_y", 0.6), ("Corvus corone_z", 0.9)])
    got = {r["classifier_label"]: r["score"] for r in species.project_scores(raw, mapping).collect()}
    assert got.keys() == {"Parus major_Talitiainen", "Cyanistes caeruleus_Sinitiainen", "Turdus merula_Mustarastas"}
    assert abs(got["Parus major_Talitiainen"] - 0.6) < 1e-6 and got["Turdus merula_Mustarastas"] == 0.0


@pytest.mark.parametrize(
    "policy,rerank,kept",
    [("keep", False, {"in", "edge", "none"}), ("drop", False, {"in", "edge"}), ("keep", True, {"in", "edge"}), ("drop", True, {"in", "edge"})],
)
def test_range_filter_table(spark, policy, rerank, kept):
    projected = spark.createDataFrame([("in", 0.5), ("edge", 0.01), ("out", 0.005)], "classifier_label string, score float")
    rows = pred(spark, [("in", 0.8), ("edge", 0.7), ("out", 0.9), ("none", 0.6)])
    got = {r["label"]: r["confidence"] for r in species.range_filter(rows, projected, 0.01, policy, rerank).collect()}
    assert set(got) == kept
    assert abs(got["in"] - (0.4 if rerank else 0.8)) < 1e-6


def test_policy_is_checked(spark):
    with pytest.raises(ValueError):
        species.range_filter(pred(spark, []), spark.createDataFrame([], "classifier_label string, score float"), 0.1, "maybe")


def test_by_site_bypasses_inactive(spark):
    mapping = spark.createDataFrame([("parus major", "Parus major_T"), ("turdus merula", "Turdus merula_M")], "species_key string, classifier_label string")
    site_scores = spark.createDataFrame([(1, 10, "Parus major_x", 0, 0.5)], "site int, week int, species string, class_index int, score float")
    recordings = spark.createDataFrame([("f", 1, 10, True), ("g", 1, 10, False)], "file string, site int, week int, active boolean")
    rows = pred(spark, [("Parus major_T", 0.8), ("Turdus merula_M", 0.9), ("Dog_Dog", 0.5)])
    both = rows.unionByName(rows.withColumn("file", F.lit("g"))).unionByName(rows.withColumn("file", F.lit("unknown")))
    got = species.range_filter_by_site(both, recordings, site_scores, mapping, 0.1, "keep")
    assert rows_of(got.filter("file = 'f'"), "label") == [("Dog_Dog",), ("Parus major_T",)]
    assert got.filter("file = 'g'").count() == 3 and got.filter("file = 'unknown'").count() == 3


@pytest.fixture
def shuffled(spark, monkeypatch):
    """No side is small enough to broadcast, for this package or for Spark."""
    monkeypatch.setattr("dawnchorus.scale.fits_broadcast", lambda *a, **k: False)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", ["range_filter_keep", "range_filter_by_site", "filter_species_list", "resolve_audio", "valid_ranges", "label_collisions", "assign_region"])
def test_shuffled_joins_give_the_same(spark, shuffled, name):
    """Beyond the broadcast bound the same rows come out of shuffled joins."""
    df = QUERIES[name](spark, FOLDER)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert differences(df.toPandas(), connect(FOLDER).sql(SQL[name]).df()) == []


def test_top_k_and_ties(spark):
    rows = pred(spark, [("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.1)])
    assert rows_of(species.top_k(rows, 2), "label") == [("a",), ("b",)]
    order = species.rerank_order(rows).orderBy("position").collect()
    assert [r["label"] for r in order] == ["b", "a", "c", "d"]


def test_top_k_limits_before_the_shuffle(spark):
    plan = species.top_k(pred(spark, [("a", 0.5)]), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_species_list_orders(spark):
    mapping = species.species_map(labels(spark, GEO), labels(spark, CLASSIFIER))
    raw = scores(spark, [("Parus major_x", 0.2), ("Turdus merula_y", 0.6), ("Cyanistes caeruleus_z", 0.02), ("Corvus corone_z", 0.9)])
    by_score = [r["label"] for r in species.species_list(raw, mapping).collect()]
    assert by_score == ["Turdus merula_Mustarastas", "Parus major_Talitiainen"]
    by_name = [r["label"] for r in species.species_list(raw, mapping, 0.0, "alpha").collect()]
    assert by_name == sorted(by_name) and len(by_name) == 3


def test_mapping_summary(spark):
    clf = labels(spark, CLASSIFIER)
    mapping = species.species_map(labels(spark, GEO), clf)
    projected = species.project_scores(scores(spark, [("Parus major_x", 0.5)]), mapping)
    assert species.mapping_summary(clf, mapping, projected, 0.01).collect()[0].asDict() == {"mapped": 3, "unmatched": 1, "total": 4, "in_range": 1}


def test_occurrence_scores_are_sigmoids(spark):
    weights = spark.createDataFrame([(0, "a", 0.01, 0.005, 0.1, 0.5), (1, "b", 0.0, 0.0, 0.0, -9.0)], "class_index int, species string, w_lat double, w_lon double, w_week double, bias double")
    sites = spark.createDataFrame([(60.0, 25.0, 24), (60.0, 25.0, 24)], "lat double, lon double, week int")
    got = {r["species"]: r["score"] for r in scoring.occurrence_scores(sites, weights).collect()}
    z = 60 * 0.01 + 25 * 0.005 + 24 * 0.1 + 0.5
    assert abs(got["a"] - 1 / (1 + 2.718281828459045 ** -z)) < 1e-6 and got["b"] < 0.001 and len(got) == 2


def test_query_weeks(spark):
    sites = spark.createDataFrame([(24, None, None), (None, 6, 15), (None, None, None)], "week int, month int, day int")
    assert rows_of(species_lists.with_query_week(sites), "week", "reported_week") == [(22, 22), (23, 24)]


def test_embedding_head_replaces_predictions(spark):
    head = spark.createDataFrame([(0, "Myotis a_A", [1.0, 0.0], 0.0), (1, "Myotis b_B", [0.0, 1.0], 0.1)], "class_index int, label string, weights array<double>, bias double")
    emb = spark.createDataFrame([("f", 0, 0.0, 0.5, [0.9, 0.2]), ("f", 1, 0.4, 0.9, [0.0, 0.05])], "file string, seg_idx bigint, start_s float, end_s float, embedding array<float>")
    found = analysis.analyze(pred(spark, [("in", 0.9)]), analysis.AnalysisSettings(min_confidence=0.2), second_stage=analysis.EmbeddingHead(emb, head))
    assert rows_of(found, "scientific_name", "common_name") == [("Myotis a", "A"), ("Myotis b", "B")]


def test_missing_embedding_is_an_error(spark):
    head = spark.createDataFrame([(0, "a", [1.0], 0.0)], "class_index int, label string, weights array<double>, bias double")
    emb = spark.createDataFrame([("f", 0, None)], "file string, seg_idx bigint, embedding array<float>")
    with pytest.raises(Exception, match="without an embedding"):
        scoring.classify_embeddings(emb, head).collect()


def test_analysis_order(spark):
    """Top-k comes before the list, and a range filter switches the list off."""
    rows = pred(spark, [("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.05)])
    listed = spark.createDataFrame([("c",), ("b",)], "label string")
    two = analysis.AnalysisSettings(top_k=2)
    assert rows_of(analysis.analyze(rows, two, species=listed), "scientific_name") == [("b",)]
    projected = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "classifier_label string, score float")
    assert rows_of(analysis.analyze(rows, two, projected=projected, species=listed), "scientific_name") == [("a",)]
    weak = analysis.AnalysisSettings(top_k=2, rerank=True, min_confidence=0.5)
    assert analysis.analyze(rows, weak, projected=projected).count() == 0


def test_flags(spark):
    recs = spark.createDataFrame([("a", 60.0, 25.0, 100), ("b", 60.0, 25.0, None), ("c", None, 25.0, 100)], "file string, lat double, lon double, day_of_year int")
    got = {r["file"]: (r["calibration_applied"], r["sdm_applied"]) for r in scoring.postprocess_flags(recs, "bsg-finland").collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (True, False)}
    assert scoring.postprocess_flags(recs, "birdnet-v24").filter("calibration_applied").count() == 0
