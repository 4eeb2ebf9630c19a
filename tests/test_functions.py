from pyspark.sql import functions as F

from dawnchorus.functions import calendar, labels, numbers, paths, timing


def one(spark, value, column, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column(F.col("v")).alias("r")).first()["r"]


def test_label_split(spark):
    assert one(spark, "Parus major_Great Tit", labels.label_scientific) == "Parus major"
    assert one(spark, "Parus major_Great_Tit", labels.label_common) == "Great_Tit"
    assert one(spark, "Noise", labels.label_scientific) == "Noise"
    assert one(spark, "Noise", labels.label_common) == "Noise"


def test_species_name_needs_a_binomial(spark):
    whole = "Accelerating_and_revving_and_vroom"
    assert one(spark, whole, labels.species_name) == whole
    assert one(spark, "Parus major_Great_Tit", labels.species_name) == "Parus major"
    assert one(spark, "Parus major", labels.species_name) == "Parus major"
    assert one(spark, "PARUS Major_X", labels.species_key) == "parus major"


def test_species_codes(spark):
    cases = {
        "House Sparrow": "houspa",
        "Robin": "robi",
        "European Robin": "eurrob",
        "": "unkn",
        "  ": "unkn",
        "Great  Spotted Woodpecker ": "grewoo",
        "Ox": "ox",
    }
    for name, code in cases.items():
        assert one(spark, name, labels.species_code) == code


def test_weeks(spark):
    df = spark.createDataFrame(
        [(1, 1), (6, 15), (7, 1), (12, 26), (12, 31), (1, 8), (1, 9)], "m int, d int"
    )
    got = [r[0] for r in df.select(calendar.model_week(F.col("m"), F.col("d"))).collect()]
    assert got == [1, 22, 24, 48, 48, 1, 2]
    days = {1: 1, 2: 8, 24: 175, 48: 358}
    for week, day in days.items():
        assert one(spark, week, calendar.week_start_day, "int") == day


def test_month_day(spark):
    cases = {1: (1, 1), 31: (1, 31), 32: (2, 1), 166: (6, 15), 365: (12, 31), 366: (12, 31), 400: (12, 31), 0: (1, 0)}
    for doy, date in cases.items():
        assert tuple(one(spark, doy, calendar.day_to_month_day, "int")) == date


def test_week_round_trip_is_lossy(spark):
    weeks = spark.range(1, 49).select(F.col("id").cast("int").alias("w"))
    changed = weeks.filter(calendar.analysis_week(F.col("w")) != F.col("w")).count()
    assert changed == 38


def test_paths(spark):
    cases = {
        "/a/b/c.wav": ("c.wav", "b", "/a"),
        "/b/c.wav": ("c.wav", "b", "/"),
        "/c.wav": ("c.wav", "", ""),
        "b/c.wav": ("c.wav", "b", ""),
        "c.wav": ("c.wav", "", ""),
    }
    for file, parts in cases.items():
        assert tuple(one(spark, file, paths.path_parts)) == parts


def test_output_paths(spark):
    def csv(file):
        return one(spark, file, lambda c: paths.output_path(c, F.lit("csv")))

    assert csv("/d/rec.wav") == "/d/rec.BirdNET.results.csv"
    assert csv("/d/rec.one.flac") == "/d/rec.one.BirdNET.results.csv"
    assert csv("/d/.hidden") == "/d/.hidden.BirdNET.results.csv"
    assert csv("rec.wav") == "rec.BirdNET.results.csv"
    given = one(spark, "/d/rec.wav", lambda c: paths.output_path(c, F.lit("json"), F.lit("/out")))
    assert given == "/out/rec.BirdNET.json"


def test_extension(spark):
    for file, ext in {"/x/A.WAV": "wav", "a.b.Flac": "flac", "/x/wav": "", "/x.wav/a": ""}.items():
        assert one(spark, file, paths.extension) == ext


def test_clip_path(spark):
    def path(name, conf, start, end):
        df = spark.createDataFrame([(name, conf, start, end)], "n string, c float, s double, e double")
        return df.select(paths.clip_path(*[F.col(c) for c in "ncse"]).alias("p")).first()["p"]

    assert path("Parus major", 0.85, 10.5, 13.5) == "Parus major/Parus major_85p_10.5-13.5.wav"
    assert path("a/b..c", 0.999, 0.0, 3.0) == "a_b__c/a_b__c_100p_0.0-3.0.wav"


def test_number_text(spark):
    for value in (0.15, 0.35, 1.05, 0.95, 0.25, 0.45, 2.5, 7.05, 1e-20, 0.04, 123456.65, 3599.95, 98765432.25):
        for places in (1, 4):
            shown = one(spark, value, lambda c: numbers.fixed(c, places), "double")
            assert shown == f"{value:.{places}f}", (value, places)
    for value in (0.00005, 0.00015, 0.12345, 0.99995, 5.0000000000000004e-05):
        assert one(spark, value, lambda c: numbers.fixed(c, 4), "double") == f"{value:.4f}"
    assert one(spark, float("nan"), lambda c: numbers.fixed(c, 1), "double") == "NaN"
    assert one(spark, float("nan"), numbers.plain, "double") == "NaN"
    assert one(spark, 0.25, lambda c: numbers.fixed(c, 1), "double") == "0.2"
    assert one(spark, 0.75, lambda c: numbers.fixed(c, 1), "double") == "0.8"
    assert one(spark, 0.35, lambda c: numbers.fixed(c, 1), "float") == "0.3"
    assert one(spark, 0.85, lambda c: numbers.fixed(c, 4), "float") == "0.8500"
    for value, text in {60.17: "60.17", 24.0: "24", 0.0001: "0.0001", 100.0: "100", -3.5: "-3.5"}.items():
        assert one(spark, value, numbers.plain, "double") == text
    assert one(spark, 0.7, numbers.plain, "float") == "0.7"


def test_finite_and_threshold(spark):
    df = spark.createDataFrame(
        [(0.7,), (float("nan"),), (float("inf"),), (None,), (0.69,)], "c float"
    )
    assert df.filter(numbers.is_finite(F.col("c"))).count() == 2
    assert df.filter(numbers.at_least(F.col("c"), 0.7)).count() == 2


def test_durations(spark):
    for seconds, text in {59.9: "00:00:59", 44589.0: "12:23:09", 86400.0: "24:00:00", 360000.0: "100:00:00"}.items():
        assert one(spark, seconds, timing.format_duration, "double") == text


def test_segment_estimates(spark):
    def estimate(duration, overlap):
        return one(
            spark, duration, lambda c: timing.estimated_segments(c, F.lit(3.0), F.lit(overlap)), "double"
        )

    assert estimate(10.0, 0.0) == 4
    assert estimate(10.0, 1.0) == 5
    assert estimate(10.0, 3.0) is None
    assert estimate(None, 0.0) is None


def test_estimated_duration(spark):
    df = spark.createDataFrame([(12.0, 9), (None, 3), (None, 0)], "h double, n int")
    got = df.select(timing.estimated_duration(F.col("h"), F.col("n"), F.lit(3.0), F.lit(1.0))).collect()
    assert [r[0] for r in got] == [12.0, 7.0, 0.0]
