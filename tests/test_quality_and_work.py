import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from dawnchorus import scale
from dawnchorus.functions.paths import output_path
from dawnchorus.operators import combine, ordering, quality, regions, summaries, work

NAN, INF = float("nan"), float("inf")


def parsed(spark, rows):
    return spark.createDataFrame(rows, "file string, start double, end double, confidence float")


def test_finite_split(spark):
    rows = [("f", 0.0, 3.0, 0.5), ("f", 0.0, INF, 0.5), ("f", 0.0, -INF, 0.5), ("f", NAN, 3.0, 0.5), ("f", 0.0, NAN, 0.5), ("f", INF, INF, 0.5), ("f", 0.0, 3.0, NAN), ("f", 0.0, 3.0, INF)]
    good, rejected = quality.finite_rows(parsed(spark, rows))
    assert good.count() == 1 and rejected.count() == 7


def test_bad_order_drops_its_file(spark):
    df = parsed(spark, [("a", 0.0, 3.0, 0.5), ("a", 5.0, 3.0, 0.5), ("b", 0.0, 3.0, 0.5), ("b", 0.0, INF, 0.5)])
    assert {r["file"] for r in quality.valid_ranges(df).collect()} == {"b"}
    assert quality.valid_ranges(df, "row").count() == 2
    with pytest.raises(Exception, match="invalid time range"):
        quality.valid_ranges(df, "raise").collect()
    with pytest.raises(ValueError):
        quality.valid_ranges(df, "other")


def test_rules(spark):
    fields = "k int, min_confidence double, overlap double, batch_size int, day_of_year int, formats array<string>, csv_columns array<string>, model string, latitude double, longitude double, range_threshold double"
    good = (0, 0.1, 0.0, 8, 366, ["csv"], ["lat", "week"], "m", 90.0, -180.0, 0.01)
    bad = (1, NAN, INF, 513, 0, [], ["lat", "latt"], "x", 90.1, NAN, -0.1)
    empty = (2, None, None, None, None, None, None, None, None, None, None)
    df = spark.createDataFrame([good, bad, empty], fields)
    models = spark.createDataFrame([("m",)], "model string")
    got = quality.rule_violations(df, "k", models)
    assert {r["k"] for r in got.collect()} == {1}
    assert {r["field"] for r in got.collect()} == {"min_confidence", "overlap", "batch_size", "day_of_year", "formats", "csv_columns", "model", "latitude", "longitude", "range_threshold"}


def test_pending(spark):
    inventory = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    outputs = spark.createDataFrame([("a", "csv"), ("a", "json"), ("b", "csv"), ("c", "raven")], "file string, format string")
    assert rows_of(work.pending_recordings(inventory, outputs, ["csv", "json"])) == [("b",), ("c",)]
    assert work.pending_recordings(inventory, outputs, []).count() == 3
    assert work.pending_recordings(inventory, outputs, ["csv"], force=True).count() == 3


def test_outputs_of_listed_files(spark):
    inventory = spark.createDataFrame([("d/a.wav",), ("d/b.flac",), (None,)], "file string")
    path = output_path(F.col("file"), F.lit("csv"))
    listing = inventory.filter("file = 'd/a.wav'").select(path.alias("path")).union(spark.createDataFrame([("d/c.txt",), (None,)], "path string"))
    done = work.outputs_of(listing.union(listing), inventory, ["csv", "json"])
    assert rows_of(done) == [("d/a.wav", "csv")]
    assert work.pending_recordings(inventory, done, ["csv"]).count() == 2
    assert work.pending_recordings(inventory, done, ["csv", "json"]).count() == 3
    assert work.outputs_of(listing, inventory, []).count() == 0
    with pytest.raises(ValueError):
        work.outputs_of(listing, inventory, ["nothing"])



def test_audio_resolution(spark):
    files = ["/d/a.wav", "/d/b.flac", "/d/b.mp3", "/d/c.m4a", "/x/e.wav", "/d/f.flac"]
    inventory = spark.createDataFrame([(f,) for f in files], "file string")
    results = spark.createDataFrame(
        [("/d/a.wav.BirdNET.results.csv", None), ("/d/b.BirdNET.results.csv", None), ("/d/c.BirdNET.json", None), ("/d/none.BirdNET.results.csv", None), ("/d/q..r.BirdNET.results.csv", None), ("/d/f.wav.BirdNET.results.csv", None), ("/d/z.csv", "/x/e.wav"), ("/d/y.csv", "/x/missing.wav")],
        "file string, audio string",
    )
    got = dict(rows_of(work.resolve_audio(results, inventory, explicit="audio"), "file", "audio_path"))
    assert got == {
        "/d/a.wav.BirdNET.results.csv": "/d/a.wav",
        "/d/b.BirdNET.results.csv": "/d/b.flac",
        "/d/c.BirdNET.json": "/d/c.m4a",
        "/d/none.BirdNET.results.csv": None,
        "/d/q..r.BirdNET.results.csv": None,
        "/d/f.wav.BirdNET.results.csv": "/d/f.flac",
        "/d/z.csv": "/x/e.wav",
        "/d/y.csv": None,
    }


def test_audio_in_another_folder(spark):
    inventory = spark.createDataFrame([("/base/a.wav",)], "file string")
    results = spark.createDataFrame([("/d/a.BirdNET.results.csv", "/base")], "file string, folder string")
    assert work.resolve_audio(results, inventory, folder="folder").first()["audio_path"] == "/base/a.wav"


def test_run_statuses(spark):
    rows = [("ok", "processed", 3), ("ok", "locked", None), ("mixed", "processed", 2), ("mixed", "failed", None), ("bad", "failed", None), ("bad", "skipped", None)]
    df = spark.createDataFrame(rows, "run string, status string, detections bigint").withColumns({"segments": F.lit(10), "audio_s": F.lit(30.0), "wall_s": F.lit(2.0)})
    got = {r["run"]: (r["status"], r["files_processed"], r["files_skipped"], r["total_detections"]) for r in summaries.run_summary(df).collect()}
    assert got == {"ok": ("success", 1, 1, 3), "mixed": ("partial_success", 1, 0, 2), "bad": ("failed", 0, 1, 0)}


def test_clip_batches(spark):
    rows = [("a", "f1", "written"), ("a", "f1", "clip_failed"), ("a", "f2", "clip_failed"), ("a", "f3", "no_detections"), ("b", "f4", "file_failed"), ("c", "f5", "no_detections")]
    got = {r["batch"]: tuple(r)[1:] for r in summaries.clip_batch_summary(spark.createDataFrame(rows, "batch string, file string, outcome string")).collect()}
    assert got == {"a": (1, 2, 1, False), "b": (0, 0, 1, True), "c": (0, 1, 0, False)}


def test_rejected_samples_are_few(spark):
    df = spark.range(100).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    row = summaries.rejected_report(df).first()
    assert row["skipped"] == 100 and row["sample_lines"] == list(range(10))


def test_summary_of_empty_recording(spark):
    det = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "file string, scientific_name string")
    recs = spark.createDataFrame([("a", 60.0), ("b", 30.0)], "file string, duration_s double")
    assert rows_of(summaries.recording_summary(det, recs)) == [("a", 3, 2, 60.0), ("b", 0, 0, 30.0)]


def test_region_prefers_core(spark):
    regions_df = spark.createDataFrame([("r1", 1, (["A"], ["B"])), ("r2", 2, (["B"], ["A"])), ("r3", 0, ([], ["C"]))], "region string, group_order int, countries struct<core array<string>, partial array<string>>")
    recs = spark.createDataFrame([("f1", "A"), ("f2", "B"), ("f3", "C"), ("f4", "D")], "file string, country string")
    assert rows_of(regions.assign_region(recs, regions_df), "file", "region", "coverage") == [("f1", "r1", "core"), ("f2", "r2", "core"), ("f3", "r3", "partial"), ("f4", None, None)]


def test_combine_is_strict(spark):
    a, b = spark.range(2), spark.range(3)
    assert combine.combine_results([a, b]).count() == 5
    with pytest.raises(ValueError):
        combine.combine_results([])
    with pytest.raises(ValueError):
        combine.combine_results([a, b.withColumnRenamed("id", "x")])


def test_combine_files(spark, tmp_path):
    for name, df in (("a", spark.range(2)), ("b", spark.range(3)), ("c", spark.range(1).selectExpr("id as x"))):
        df.write.parquet(str(tmp_path / name))
    combine.combine_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 5
    with pytest.raises(ValueError):
        combine.combine_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "c")], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        combine.combine_parquet(spark, [], str(tmp_path / "x"))
    assert combine.combined_path("/out/", "csv") == "/out/BirdNET_CombinedTable.csv"


@pytest.mark.parametrize("ranges", [1, 3, 8, 60])
def test_numbers_over_ranges_with_copies(spark, ranges):
    """A hot recording with many copies, and null and empty keys: numbers are complete and follow the order."""
    det = spark.range(5000).select(
        F.when(F.col("id") % 5 < 4, F.lit("hot")).when(F.col("id") % 10 == 4, F.lit("")).when(F.col("id") % 20 == 9, F.lit("cold")).alias("file"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") % 997) * 31.0).cast("float").alias("start_s"),
        F.lit(1.0).cast("float").alias("end_s"), F.lit("s").alias("scientific_name"), F.lit("c").alias("common_name"), F.lit(0.5).cast("float").alias("confidence"),
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = ordering.selection_number(det)
        found = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 5000
    for file in ("hot", "cold", "", None):
        rows = sorted((r["selection"], r["start_s"]) for r in found if r["file"] == file)
        assert rows and [n for n, _ in rows] == list(range(1, len(rows) + 1))
        assert [s for _, s in rows] == sorted(s for _, s in rows)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Full rows are shuffled once, for both readers; the other shuffles hold a row per range.
    kind = "rangepartitioning" if ranges > 1 else "SinglePartition, REPARTITION_BY_NUM"
    assert plan.count(kind) == 2 and "ReusedExchange" in plan


def test_order_splits_a_hot_recording(spark):
    det = spark.range(20000).select(F.lit("hot").alias("file"), F.col("id").cast("float").alias("start_s"), F.lit(1.0).alias("end_s"), F.lit("s").alias("scientific_name"), F.lit("c").alias("common_name"), F.lit(0.5).alias("confidence"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = ordering.detection_order(det).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1


def test_broadcast_is_measured(spark):
    df = spark.range(1000)
    rows, size = scale.measured(df)
    assert rows == 1000 and size == 8000
    assert not scale.fits_broadcast(df, 999, 1 << 20) and not scale.fits_broadcast(df, 1000, 1000)


def test_large_parameter_tables_give_the_same_rows(spark, monkeypatch):
    from dawnchorus.operators import scoring, species

    sites = spark.createDataFrame([(1.0, 2.0, 3), (1.0, 2.0, 3), (-5.0, 0.5, 40)], "lat double, lon double, week int")
    weights = spark.createDataFrame([(i, f"s{i}", i / 9, -i / 7, 0.01 * i, 0.1) for i in range(7)], "class_index int, species string, w_lat double, w_lon double, w_week double, bias double")
    scores = spark.createDataFrame([("a", f"k{i}", i, i / 5) for i in range(4)] + [("b", "k1", 1, 0.5)], "site string, species string, class_index int, score double")
    mapping = spark.createDataFrame([(f"k{i}", f"K{i}") for i in range(6)], "species_key string, classifier_label string")
    embeddings = spark.createDataFrame([("f", i, [float(i), 1.0, -2.0]) for i in range(5)], "file string, seg_idx long, embedding array<float>")
    head = spark.createDataFrame([(i, f"h{i}", [0.5 * (i % 3), float(i), 0.25], 0.1) for i in range(6)], "class_index int, label string, weights array<float>, bias float")

    def all_rows():
        made = [
            scoring.occurrence_scores(sites, weights),
            species.project_scores(scores, mapping, ["site"]),
            scoring.classify_embeddings(embeddings, head, 2),
            scoring.classify_embeddings(embeddings, head, None),
        ]
        return [sorted(map(str, df.collect())) for df in made]

    before = all_rows()
    assert [len(rows) for rows in before] == [14, 12, 10, 30]
    monkeypatch.setattr(scale, "BROADCAST_MAX_ROWS", 1)
    assert all_rows() == before
    for bad in ([1.0], None):
        broken = spark.createDataFrame([("f", 0, bad)], "file string, seg_idx long, embedding array<float>")
        with pytest.raises(Exception, match="embedding"):
            scoring.classify_embeddings(broken, head).collect()


def test_big_sides_are_not_measured(spark, monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("measured")

    monkeypatch.setattr(scale, "measured", fail)
    assert scale.broadcast_if_bounded(spark.range(1 << 40)) is not None
    with pytest.raises(AssertionError):
        scale.broadcast_if_bounded(spark.range(1 << 40), selective=True)
