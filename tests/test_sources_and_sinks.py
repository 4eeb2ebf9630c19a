import csv as python_csv
import io
import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from dawnchorus import schemas
from dawnchorus.operators import summaries
from dawnchorus.plans.clips import clean_detections
from dawnchorus.sinks import documents, tables
from dawnchorus.sources import events, inventory, lists, results

HEADER = "Start (s),End (s),Scientific name,Common name,Confidence"


def csv(tmp_path, text, name="r.csv"):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode("utf-8"))
    return str(folder)


def detections(spark, rows):
    return spark.createDataFrame(rows, schemas.DETECTIONS)


ROWS = [
    (0.0, 3.0, "Turdus merula", "Eurasian Blackbird", 0.85, "/a/b/r1.wav"),
    (3.0, 6.0, "Tyto alba", 'Owl, "Barn"', 0.5, "/a/b/r1.wav"),
    (0.0, 3.0, "Parus major", "Great Tit", 0.25, "/a/b/r2.wav"),
]


@pytest.mark.parametrize("headers", ["same", "mixed"])
def test_csv_with_extras_quotes_and_bom(spark, tmp_path, headers):
    text = f'﻿{HEADER},Lat,Week\n 0.0 ,3.0, Tyto alba ,"Owl, ""Barn""",0.8542,60.1,15\n3.0,6.0,a,b,0.5,,\n'
    got = results.read_detections_csv(spark, csv(tmp_path, text), headers=headers)
    assert got.columns == schemas.PARSED.names
    assert [r[1:3] for r in rows_of(got, "file", "scientific_name", "common_name")] == [("Tyto alba", 'Owl, "Barn"'), ("a", "b")]


@pytest.mark.parametrize("headers", ["same", "mixed"])
def test_csv_header_only_and_missing_column(spark, tmp_path, headers):
    assert results.read_detections_csv(spark, csv(tmp_path, HEADER + "\n"), headers=headers).count() == 0
    with pytest.raises(Exception, match="missing required columns"):
        results.read_detections_csv(spark, csv(tmp_path, "Start (s),End (s)\n1,2\n"), headers=headers).collect()


def test_csv_broken_files_stand_alone(spark, tmp_path):
    csv(tmp_path, f'{HEADER}\n0,3,a,"A\nA",0.5\n\n3,x,a,A,0.5\n6,9,a\n', "good.csv")
    csv(tmp_path, "Start (s),End (s)\n1,2\n", "lacking.csv")
    folder = csv(tmp_path, "", "empty.csv")
    (tmp_path / "in" / "bytes.csv").write_bytes(HEADER.encode() + b"\n0,3,\xff,A,0.5\n")
    got = results.read_detections_csv(spark, folder, on_bad="flag", headers="mixed")
    rows = {(r["file"].rsplit("/", 1)[1], r["line"], r["malformed"], r["error"] is None) for r in got.collect()}
    assert rows == {
        ("good.csv", 2, False, True), ("good.csv", 5, True, True), ("good.csv", 6, True, False),
        ("lacking.csv", None, True, False), ("bytes.csv", None, True, False),
    }
    report = summaries.rejected_report(got.filter("malformed"))
    found = {r["file"].rsplit("/", 1)[1]: (r["skipped"], r["sample_lines"]) for r in report.collect()}
    assert found == {"good.csv": (2, [5, 6]), "lacking.csv": (1, []), "bytes.csv": (1, [])}
    with pytest.raises(Exception, match="good.csv: line 6: 3 fields|bytes.csv|missing required"):
        results.read_detections_csv(spark, folder, headers="mixed").collect()
    with pytest.raises(ValueError):
        results.read_detections_csv(spark, folder, on_bad="other", headers="mixed")


def test_csv_one_other_header_is_one_row(spark, tmp_path):
    for i in range(5):
        csv(tmp_path, f"{HEADER}\n{i},{i + 3},a,A,0.5\n", f"a{i}.csv")
    folder = csv(tmp_path, "Confidence,Common name,Scientific name,End (s),Start (s)\n0.25,B,b,6,3\n", "z.csv")
    got = results.read_detections_csv(spark, folder, on_bad="flag").collect()
    assert len(got) == 6 and [r["file"].rsplit("/", 1)[1] for r in got if r["malformed"]] == ["z.csv"]


def test_csv_large_files_are_read_by_many_tasks(spark, tmp_path):
    """Blocks that begin in quoted fields, with the line numbers of a plain reader."""
    rng = random.Random(4)
    names = ["Owl, Barn", 'the "big" one', "plain", "two\nlines", "a\n\n\nb", 'q"\n"q', "three\nlines\n,here"]

    def text(header, rows):
        out = io.StringIO()
        writer = python_csv.writer(out, lineterminator="\n")
        writer.writerow(header)
        writer.writerows(rows)
        return out.getvalue()

    head = HEADER.split(",")
    rows = [[i, i + 3, f"s{i}", rng.choice(names), 0.5] for i in range(4000)]
    csv(tmp_path, text(head, rows), "one.csv")
    csv(tmp_path, text(head[::-1], [r[::-1] for r in rows[:1500]]), "two.csv")
    csv(tmp_path, text(head, rows[:3]), "small.csv")
    folder = csv(tmp_path, text(["x", "y"], [[1, 2]] * 3000), "bad.csv")
    want = set()
    for name in ("one.csv", "two.csv", "small.csv"):
        reader = python_csv.DictReader(io.StringIO((tmp_path / "in" / name).read_text(), newline=""))
        line = 2
        for r in reader:
            want.add((name, line, r["Scientific name"], r["Common name"]))
            line = reader.line_num + 1
    before = {k: spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes")}
    for k in before:
        spark.conf.set(f"spark.sql.files.{k}", "2000")
    try:
        got = results.read_detections_csv(spark, folder, on_bad="flag", headers="mixed")
        assert got.rdd.getNumPartitions() > 40
        rows = [(r["file"].rsplit("/", 1)[1], r["line"], r["scientific_name"], r["common_name"], r["error"]) for r in got.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.files.{k}", v)
    assert {r[:4] for r in rows if not r[4]} == want and len([r for r in rows if not r[4]]) == len(want)
    assert [(r[0], r[1]) for r in rows if r[4]] == [("bad.csv", None)]


def test_csv_line_ends_in_fields_and_odd_paths(spark, tmp_path):
    folder = tmp_path / "my data+x"
    folder.mkdir()
    (folder / "rec one%41.csv").write_text(f'{HEADER}\n0.0,3.0,a,"two\nlines, ""q""",0.5\n')
    got = results.read_detections_csv(spark, str(folder)).collect()
    assert [r["common_name"] for r in got] == ['two\nlines, "q"']
    assert got[0]["file"].endswith("/my data+x/rec one%41.csv")


def test_partitioned_parquet_with_absent_columns(spark, tmp_path):
    det = detections(spark, ROWS).withColumn("site", F.lit("s")).withColumn("week", F.lit(3))
    tables.write_detections_parquet(det, str(tmp_path / "p"), ["week", "lat"], ["site"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert dict(back.dtypes)["week"] == "smallint" and back.filter("site = 's' AND lat IS NULL").count() == len(ROWS)


def test_csv_columns_in_another_order(spark, tmp_path):
    csv(tmp_path, f"{HEADER}\n0,3,a,A,0.5\n", "one.csv")
    folder = csv(tmp_path, "Confidence,Common name,Scientific name,End (s),Start (s)\n0.25,B,b,6,3\n", "two.csv")
    got = results.read_detections_csv(spark, folder, headers="mixed")
    assert rows_of(got, "start", "end", "scientific_name", "confidence") == [(0.0, 3.0, "a", 0.5), (3.0, 6.0, "b", 0.25)]
    with pytest.raises(Exception):
        results.read_detections_csv(spark, folder).collect()


def test_csv_bad_rows(spark, tmp_path):
    csv(tmp_path, f"{HEADER}\n0.0,inf,a,A,0.5\nnan,3.0,a,A,0.5\n0.0,3.0,a,A,1e40\n0.0,3.0,a,A,0.5\n", "good.csv")
    csv(tmp_path, f"{HEADER}\n5.0,3.0,a,A,0.5\n0.0,3.0,a,A,0.5\n", "order.csv")
    folder = csv(tmp_path, f"{HEADER}\nabc,3.0,a,A,0.5\n0.0,3.0,a,A,0.5\n", "text.csv")
    flagged = results.read_detections_csv(spark, folder, on_bad="flag")
    kept = clean_detections(flagged).collect()
    assert len(kept) == 1 and kept[0]["file"].endswith("good.csv")
    with pytest.raises(Exception, match="unreadable number"):
        results.read_detections_csv(spark, folder).select("start").collect()


def lines(folder):
    return [line for f in sorted(Path(folder).glob("part-*")) for line in f.read_text("utf-8").splitlines()]


def test_csv_output(spark, tmp_path):
    target = str(tmp_path / "out")
    tables.write_results(detections(spark, ROWS).coalesce(1), "csv", target, bom=True)
    got = lines(target)
    assert got[0] == "﻿" + HEADER + ",File"
    assert got[1] == "0.0,3.0,Turdus merula,Eurasian Blackbird,0.8500,/a/b/r1.wav"
    assert got[2] == '3.0,6.0,Tyto alba,"Owl, ""Barn""",0.5000,/a/b/r1.wav'


def test_csv_round_trip(spark, tmp_path):
    target = str(tmp_path / "out")
    tables.write_results(detections(spark, ROWS), "csv", target)
    back = results.read_detections_csv(spark, target)
    want = sorted((r[0], r[1], r[2], r[3], r[4]) for r in ROWS)
    assert [r for r in rows_of(back, "start", "end", "scientific_name", "common_name", "confidence")] == [
        (s, e, n, c, pytest.approx(v)) for s, e, n, c, v in sorted(want, key=repr)
    ]


def test_csv_metadata_columns(spark):
    det = detections(spark, ROWS[:1]).withColumns({"lat": F.lit(60.0), "week": F.lit(None).cast("int"), "model": F.lit("a,b")})
    rows = tables.to_csv_rows(det, ["lat", "week", "model", "typo"])
    assert rows.columns[6:] == ["lat", "week", "model", "typo"]
    line = rows.select(tables.to_lines(rows, ",", quote=True)).first()[0]
    assert line.endswith('/a/b/r1.wav,60,,"a,b",')


def test_raven_output(spark, tmp_path):
    target = str(tmp_path / "out")
    tables.write_results(detections(spark, ROWS[:2]).coalesce(1), "raven", target)
    # Numbered rows come in ranges, and every part file starts with the header.
    found = lines(target)
    assert found[0].split("\t")[:3] == ["Selection", "View", "Channel"]
    got = [found[0], *[line for line in found if line != found[0]]]
    assert got[1] == "1\tSpectrogram 1\t1\t0.0\t3.0\t150\t15000\tEurasian_Blackbird\teurbla\t0.8500\t/a/b/r1.wav\t0.0"
    assert got[2].startswith("2\t") and 'Owl,_"Barn"' in got[2]


def test_audacity_and_kaleidoscope_output(spark, tmp_path):
    det = detections(spark, ROWS[:1]).withColumn("common_name", F.lit("Black_bird one")).coalesce(1)
    tables.write_results(det, "audacity", str(tmp_path / "a"))
    assert lines(tmp_path / "a") == ["0.0\t3.0\tBlack, bird one\t0.8500"]
    tables.write_results(det, "kaleidoscope", str(tmp_path / "k"))
    assert lines(tmp_path / "k") == ["INDIR,FOLDER,IN FILE,OFFSET,DURATION,TOP1MATCH,TOP1DIST", "/a,b,r1.wav,0.0,3.0,Black_bird_one,0.8500"]


def test_own_format(spark, tmp_path):
    tables.register_format("names", tables.TextFormat(lambda d: d.select("common_name"), ",", header=False))
    tables.write_results(detections(spark, ROWS[:1]), "names", str(tmp_path / "n"))
    assert lines(tmp_path / "n") == ["Eurasian Blackbird"]


def test_parquet_round_trip(spark, tmp_path):
    det = detections(spark, ROWS).withColumn("week", F.lit(12))
    tables.write_results(det, "parquet", str(tmp_path / "p"), include=["week", "nonsense"])
    back = results.read_detections_parquet(spark, str(tmp_path / "p"), ["week"])
    assert dict(back.dtypes)["week"] == "smallint" and back.columns == schemas.DETECTIONS.names + ["week"]
    assert {r["file"] for r in back.collect()} == {"r1.wav", "r2.wav"}


def test_partitioned_parquet(spark, tmp_path):
    det = detections(spark, ROWS).withColumn("site", F.lit("s1"))
    tables.write_detections_parquet(det, str(tmp_path / "p"), partition_by=["site"])
    assert (tmp_path / "p" / "site=s1").is_dir()
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def recordings(spark):
    return spark.createDataFrame([("/a/b/r1.wav", 60.0, 60.5, 25.0, 24), ("/a/b/r2.wav", 30.0, None, None, None), ("/a/b/quiet.wav", 10.0, None, None, None)], "file string, duration_s double, lat double, lon double, week int")


def test_documents(spark, tmp_path):
    docs = documents.to_result_documents(detections(spark, ROWS), recordings(spark), "m1", 0.1, 0.0, F.lit("2024-05-01 12:00:00").cast("timestamp"))
    documents.write_result_documents(docs.coalesce(1), str(tmp_path / "d"))
    found = {d["source_file"]: d for d in map(json.loads, lines(tmp_path / "d"))}
    assert found["r1.wav"]["summary"] == {"total_detections": 2, "unique_species": 2, "audio_duration_seconds": 60.0}
    assert found["r1.wav"]["settings"]["week"] == 24 and "week" not in found["r2.wav"]["settings"]
    assert [d["start_time"] for d in found["r1.wav"]["detections"]] == [0.0, 3.0]
    assert found["quiet.wav"]["detections"] == [] and (found["r1.wav"]["part"], found["r1.wav"]["parts"]) == (0, 1)
    back = results.read_result_documents(spark, str(tmp_path / "d"))
    # One JSON object per line also reads line by line.
    by_line = spark.read.schema(schemas.RESULT_DOCUMENT).json(str(tmp_path / "d"))
    assert back.count() >= 1 and results.document_detections(by_line).count() == 3
    assert results.document_summaries(by_line).count() == 3


def test_pretty_document(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    doc = {"source_file": "x.wav", "analysis_date": "2025-01-11T12:34:56.789Z", "model": "m", "settings": {"min_confidence": 0.1, "overlap": 0.0}, "detections": [{"start_time": 0.0, "end_time": 3.0, "scientific_name": "a", "common_name": "A", "confidence": 0.9}], "summary": {"total_detections": 1, "unique_species": 1, "audio_duration_seconds": 9.0}}
    (folder / "x.BirdNET.json").write_text(json.dumps(doc, indent=2))
    back = results.read_result_documents(spark, str(folder))
    assert rows_of(results.document_detections(back), "file", "start_s", "common_name") == [("x.wav", 0.0, "A")]


def test_long_recording_makes_several_documents(spark):
    many = spark.range(25).select(F.col("id").cast("float").alias("start_s"), (F.col("id") + 3).cast("float").alias("end_s"), F.lit("s").alias("scientific_name"), F.lit("c").alias("common_name"), F.lit(0.5).cast("float").alias("confidence"), F.lit("/a/b/r1.wav").alias("file"))
    docs = documents.to_result_documents(many, recordings(spark), "m1", 0.1, 0.0, per_part=10)
    parts = docs.filter("source_file = 'r1.wav'").orderBy("part").collect()
    assert [(p["part"], p["parts"], len(p["detections"])) for p in parts] == [(0, 3, 10), (1, 3, 10), (2, 3, 5)]
    assert [d["start_time"] for p in parts for d in p["detections"]] == [float(i) for i in range(25)]
    assert all(p["summary"]["total_detections"] == 25 for p in parts)


def test_event_log(spark, tmp_path):
    det = detections(spark, ROWS)
    flags = spark.createDataFrame([("/a/b/r1.wav", True, True, 60.5, 25.0, 100)], "file string, calibration_applied boolean, sdm_applied boolean, sdm_latitude float, sdm_longitude float, sdm_day_of_year int")
    sent = documents.to_detection_events(det, flags, F.lit("2024-05-01 12:00:00").cast("timestamp"))
    other = spark.createDataFrame([('{"spec_version":"1.1","timestamp":"2024-05-01T12:00:00Z","event":"file_completed","payload":{"file":"r1.wav","status":"processed","detections":2}}',)], "value string")
    sent.select("value").unionByName(other).write.text(str(tmp_path / "log"))
    log = events.read_event_log(spark, str(tmp_path / "log"))
    found = events.event_detections(log)
    assert found.count() == 3 and {r["species"] for r in found.collect()} >= {"Parus major_Great Tit"}
    done = events.payloads(log, "file_completed").first()
    assert done["payload"]["status"] == "processed" and done["spec_version"] == "1.1"
    with_flags = events.payloads(log, "detections").filter("payload.bsg is not null").collect()
    assert len(with_flags) == 1 and with_flags[0]["payload"]["bsg"]["day_of_year"] == 100
    with pytest.raises(ValueError):
        events.payloads(log, "unknown")


def test_label_files(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_bytes(b" b_B \r\n\r\n  \na_A\n")
    assert rows_of(lists.read_labels(spark, str(path))) == [(0, "b_B"), (1, "a_A")]
    assert rows_of(lists.read_species_list(spark, str(path))) == [("a_A",), ("b_B",)]
    path.write_text("\n \n")
    with pytest.raises(ValueError):
        lists.read_labels(spark, str(path))


def test_species_list_file(spark, tmp_path):
    listed = spark.createDataFrame([("b_B", 0.9), ("a_A", 0.5)], "label string, score float").orderBy(F.desc("score"))
    tables.write_species_list(listed.coalesce(1), str(tmp_path / "s"))
    assert lines(tmp_path / "s") == ["b_B", "a_A"]


def test_regions(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"amazonia": {"classes": 809, "countries": {"core": ["Brazil"], "partial": ["Bolivia"]}, "group": "south-america", "group_order": 3, "name": "Amazonia", "region": "amazonia"}, "bare": {"classes": 1}}, indent=1))
    got = {r["region"]: r for r in lists.read_regions(spark, str(path)).collect()}
    assert got["amazonia"]["countries"]["core"] == ["Brazil"] and got["amazonia"]["classes"] == 809 and "bare" in got


def test_inventory(spark, tmp_path):
    for name in ("a.WAV", "sub/b.flac", "sub/deep/c.mp3", "d.txt", "wav"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    got = inventory.recording_inventory(spark, [str(tmp_path / "in"), str(tmp_path / "missing")])
    assert sorted(r["file"].rsplit("/", 1)[1] for r in got.collect()) == ["a.WAV", "b.flac", "c.mp3"]
    assert {r["length"] for r in got.collect()} == {5}
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert inventory.recording_inventory(spark, [str(tmp_path / "missing")]).count() == 0


def test_plain_csv_lines_are_cut_as_the_csv_module_cuts_them():
    lines = [" 0.0,3.0 ,Turdus merula,\tAmsel,0.5,x", "1,2,Ö,,0.1", "a,b,c,d,e,,,"]
    at = [0, 1, 2, 3, 4]
    cells = results._plain_cells(pa.array([x.encode() for x in lines], pa.binary()), at)
    want = [[row[i].strip() for i in at] for row in python_csv.reader(lines)]
    assert [list(row) for row in zip(*[c.to_pylist() for c in cells])] == want
    for odd in (b'1,2,"a,b",c,0.5', b"1,2,a,b", b"", b"1,2,a\r,b,0.5", b"1,2,a,\xc2\xa0b,0.5", b"1,2,\xff,b,0.5", b"1,2,a\x1c,b,0.5", b"1,2,a,b,0.5" + b"0" * 200_000):
        assert results._plain_cells(pa.array([odd, b"1,2,a,b,0.5"], pa.binary()), at) is None


@pytest.mark.parametrize("query", ["detection_events", "result_document_round_trip"])
def test_json_is_made_and_parsed_once_a_row(spark, tmp_path, query):
    from dawnchorus.testbed.catalog import QUERIES

    made = {
        "lineitem": ([(1, 7, 1, 25.0), (1, 7, 2, 30.0)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"),
        "part": ([(7, "red bolt", "TYPE A")], "p_partkey long, p_name string, p_type string"),
        "orders": ([(1, 3, 9000.0, "2024-01-02"), (2, 3, 9000.0, "2024-01-02")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string"),
        "customer": ([(3, 5)], "c_custkey long, c_nationkey int"),
    }
    for name, (rows, schema) in made.items():
        table = spark.createDataFrame(rows, schema)
        if name == "orders":
            table = table.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    found = QUERIES[query](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith(("Filter", "Join"))]
    assert conditions and not any("json" in line.lower() for line in conditions)
    assert sorted(r["start_s"] for r in found.collect()) == [0.0, 3.0]
