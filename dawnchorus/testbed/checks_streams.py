"""Checks of the streaming operators and of writing and reading back.

Streams read the given tables as files, run until these are used up, and write each batch to
the session's shared folder; the result is read from there, never gathered at the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.operators import quality, species
from dawnchorus.sinks import documents, tables
from dawnchorus.sources import events as event_source
from dawnchorus.sources import lists, results
from dawnchorus.streaming import detections as live
from dawnchorus.streaming import events as live_events
from dawnchorus.testbed.registry import check
from dawnchorus.testbed.sql import merged, with_views
from dawnchorus.testbed.tables import Tables


def drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all files there are and return what it wrote."""
    folder = t.scratch()

    def store(batch: DataFrame, epoch: int) -> None:
        # A complete batch replaces the one before; append batches stand side by side, and a
        # repeated one replaces itself.
        target = f"{folder}/out/{epoch if mode == 'append' else 0}"
        batch.write.mode("overwrite").parquet(target)

    query = (
        stream.writeStream.foreachBatch(store)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


def _live_events(t: Tables) -> DataFrame:
    """The events table as a stream, in the shape of det_ev."""
    start = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return t.stream("events").select(
        F.concat(F.lit("rec_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".wav")).alias("file"),
        start.cast("double").alias("start"),
        (start + 3).cast("double").alias("end"),
        F.col("event_type").alias("scientific_name"),
        F.col("event_type").alias("common_name"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).cast("float").alias("confidence"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("recorded_at"),
    )


@check(
    "stream_merge_clips",
    with_views(
        f"""WITH {merged('det_ev', 300, 300)}
            SELECT file, scientific_name, "start", "end", max_confidence, detection_count
            FROM clips""",
        "det_ev",
    ),
)
def stream_merge_clips(t: Tables) -> DataFrame:
    confident = quality.min_confidence(_live_events(t), 0.1)
    clips = live.stream_merge_clips(confident, 300, 300, watermark="1 day")
    return drained(t, clips, "complete").drop("common_name")


@check(
    "stream_detections",
    with_views(
        """SELECT file, "start", scientific_name AS label, confidence FROM det_ev
           WHERE confidence >= CAST(0.1 AS FLOAT) AND scientific_name IN (
               SELECT scientific_name FROM det_ev WHERE scientific_name LIKE '%i%')""",
        "det_ev",
    ),
)
def stream_detections(t: Tables) -> DataFrame:
    stream = _live_events(t).withColumnRenamed("scientific_name", "label")
    listed = t.det_ev().select(F.col("scientific_name").alias("label")).filter("label like '%i%'")
    kept = live.stream_detections(stream, 0.1, species=listed)
    return drained(t, kept.select("file", "start", "label", "confidence"))


@check(
    "stream_range_filter",
    with_views(
        """WITH s AS (SELECT scientific_name AS label, CAST(length(scientific_name) / 8.0 AS FLOAT) AS score
                      FROM det_ev WHERE scientific_name <> 'view' GROUP BY 1)
           SELECT file, "start", label, confidence * score AS confidence
           FROM det_ev JOIN s ON scientific_name = label
           WHERE confidence >= CAST(0.1 AS FLOAT) AND score >= CAST(0.7 AS FLOAT)
             AND confidence * score >= CAST(0.1 AS FLOAT)""",
        "det_ev",
    ),
)
def stream_range_filter(t: Tables) -> DataFrame:
    names = t.det_ev().select("scientific_name").distinct().filter("scientific_name <> 'view'")
    score = (F.length("scientific_name") / 8.0).cast("float").alias("score")
    projected = names.select(F.col("scientific_name").alias("classifier_label"), score)
    stream = _live_events(t).withColumnRenamed("scientific_name", "label")
    kept = live.stream_detections(stream, 0.1, projected, range_threshold=0.7, rerank=True)
    return drained(t, kept.select("file", "start", "label", "confidence"))


def _completions(t: Tables) -> DataFrame:
    """The events table as a stream of file completions, one per user and type."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "failed")
        .when(kind == "signup", "skipped")
        .when(kind == "view", "locked")
        .otherwise("processed")
    )
    return t.stream("events").select(
        (F.col("user_id") % 10).cast("string").alias("run"),
        F.concat_ws("_", kind, F.col("user_id").cast("string")).alias("file"),
        status.alias("status"),
        F.floor("value").alias("detections"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


@check(
    "stream_run_status",
    with_views(
        """WITH s AS (SELECT CAST(run AS VARCHAR) AS run,
                  count(*) FILTER (status = 'processed') AS files_processed,
                  count(*) FILTER (status = 'failed') AS files_failed,
                  count(*) FILTER (status IN ('skipped', 'locked')) AS files_skipped,
                  CAST(sum(detections) AS BIGINT) AS total_detections
                  FROM file_status GROUP BY run)
           SELECT *, CASE WHEN files_failed = 0 THEN 'success' WHEN files_processed > 0
                     THEN 'partial_success' ELSE 'failed' END AS status FROM s""",
        "file_status",
    ),
)
def stream_run_status(t: Tables) -> DataFrame:
    return drained(t, live_events.stream_run_status(_completions(t)), "complete")


@check(
    "dedupe_completed",
    """SELECT DISTINCT CAST(user_id % 10 AS VARCHAR) AS run,
              event_type || '_' || user_id AS file FROM events""",
)
def dedupe_completed(t: Tables) -> DataFrame:
    once = live_events.dedupe_completed(_completions(t), watermark="40 days")
    return drained(t, once.select("run", "file"))


@check(
    "throttle_progress",
    """WITH RECURSIVE u AS (
         SELECT 'f' || user_id AS file, CAST(least(value / 5, 99.0) AS FLOAT) AS percent,
                ts AS timestamp, epoch_us(ts) // 1000 AS ms,
                CAST(floor(CAST(least(value / 5, 99.0) AS FLOAT)) AS INTEGER) AS whole,
                row_number() OVER (PARTITION BY user_id
                                   ORDER BY ts, CAST(least(value / 5, 99.0) AS FLOAT)) AS n
         FROM events
         -- Updates wait for the watermark, an hour before the latest one, to pass their ten seconds.
         WHERE (epoch_ms(ts) // 10000 + 1) * 10000 <= (SELECT max(epoch_ms(ts)) FROM events) - 3600000),
       s AS (
         SELECT *, whole IN (0, 100) OR whole >= 10 AS shown,
                CASE WHEN whole IN (0, 100) OR whole >= 10 THEN whole ELSE 0 END AS last_percent,
                ms AS last_ms
         FROM u WHERE n = 1
         UNION ALL
         SELECT file, percent, timestamp, ms, whole, n, pass,
                CASE WHEN pass THEN whole ELSE from_percent END,
                CASE WHEN pass THEN ms ELSE from_ms END
         FROM (SELECT f.*, whole IN (0, 100) OR whole - from_percent >= 10 OR ms - from_ms >= 500 AS pass
               FROM (SELECT u.*,
                            -- After an hour without an update a file begins anew.
                            CASE WHEN u.ms - s.ms >= 3600000 THEN 0 ELSE s.last_percent END AS from_percent,
                            CASE WHEN u.ms - s.ms >= 3600000 THEN u.ms ELSE s.last_ms END AS from_ms
                     FROM s JOIN u ON u.file = s.file AND u.n = s.n + 1) f))
       SELECT file, percent, ms AS at_ms FROM s WHERE shown""",
)
def throttle_progress(t: Tables) -> DataFrame:
    # One trigger takes all files, which may overlap in time, so that none is late.
    updates = t.stream("events", 1 << 20).select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"),
        F.least(F.col("value") / 5, F.lit(99.0)).cast("float").alias("percent"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    shown = live_events.throttle_progress(updates)
    return drained(t, shown.select("file", "percent", F.unix_millis("timestamp").alias("at_ms")))


@check(
    "event_log_stream",
    with_views("SELECT file, status, detections FROM file_status", "file_status"),
)
def event_log_stream(t: Tables) -> DataFrame:
    """Completion events written as a log, then taken in as a stream."""
    folder = t.scratch()
    payload = F.struct("file", "status", "detections")
    log = t.file_status().select(documents.envelope("file_completed", payload).alias("value"))
    log.write.text(folder)
    envelopes = live_events.stream_event_log(t.spark, folder)
    done = live_events.completed_files(envelopes)
    return drained(t, done.select("file", "status", "detections"))


_FLAT = "start_s, end_s, scientific_name, common_name, confidence, file"


@check(
    "csv_round_trip",
    with_views(
        """SELECT start_s::DOUBLE AS "start", end_s::DOUBLE AS "end", scientific_name, common_name,
                  CAST(round(confidence::DOUBLE, 4) AS FLOAT) AS confidence FROM detections""",
        "detections",
    ),
)
def csv_round_trip(t: Tables) -> DataFrame:
    """Detections written as result CSV and read back, to the printed precision."""
    folder = t.scratch()
    tables.write_results(t.detections(), "csv", folder)
    return results.read_detections_csv(t.spark, folder).drop("file")


@check(
    "csv_mixed_headers",
    with_views(
        """WITH r AS (SELECT start_s::DOUBLE AS "start", end_s::DOUBLE AS "end", scientific_name, common_name,
                             CAST(round(confidence::DOUBLE, 4) AS FLOAT) AS confidence, false AS malformed FROM detections)
           SELECT * FROM r UNION ALL SELECT * FROM r
           UNION ALL SELECT NULL, NULL, '', '', NULL, true""",
        "detections",
    ),
)
def csv_mixed_headers(t: Tables) -> DataFrame:
    """Result CSVs with and without metadata columns, and one that lacks columns, read together."""
    folder = t.scratch()
    det = t.detections()
    tables.write_results(det, "csv", f"{folder}/plain")
    tables.write_results(det.withColumn("week", F.lit(7)), "csv", f"{folder}/weeks", include=["week", "model"])
    t.spark.range(1).select(F.lit("Start (s),x").alias("value")).write.text(f"{folder}/lacking")
    found = results.read_detections_csv(t.spark, [f"{folder}/plain", f"{folder}/weeks", f"{folder}/lacking"], on_bad="flag", headers="mixed")
    return found.select("start", "end", "scientific_name", "common_name", "confidence", "malformed")


@check(
    "read_labels",
    with_views(
        """SELECT CAST(row_number() OVER (ORDER BY class_index) - 1 AS INTEGER) AS class_index, label FROM clf_labels""",
        "clf_labels",
    ),
)
def read_labels(t: Tables) -> DataFrame:
    """The classifier's labels written as one file, whose line order is the class index, and read back."""
    folder = t.scratch()
    t.clf_labels().coalesce(1).sortWithinPartitions("class_index").select("label").write.text(folder)
    return lists.read_labels(t.spark, folder)


@check(
    "read_regions",
    """SELECT lower(r_name) AS region, r_name AS name, CAST(r_regionkey AS INTEGER) AS group_order,
              CAST(count(n_nationkey) AS INTEGER) AS classes,
              string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 2 = 0) AS core,
              string_agg(n_name, ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 2 = 1) AS partial
       FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def read_regions(t: Tables) -> DataFrame:
    """A manifest of the regions and their nations, written as one JSON object and read back."""
    folder = t.scratch()
    even = F.col("n_nationkey") % 2 == 0
    countries = [F.array_sort(F.collect_list(F.when(c, F.col("n_name")))).alias(n) for c, n in ((even, "core"), (~even, "partial"))]
    nations = t.raw("nation").groupBy("n_regionkey").agg(*countries, F.count(F.lit(1)).cast("int").alias("classes"))
    regions = t.raw("region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    entry = F.struct(
        F.col("r_name").alias("name"),
        F.col("r_regionkey").cast("int").alias("group_order"),
        "classes",
        F.struct("core", "partial").alias("countries"),
    )
    manifest = F.map_from_entries(F.collect_list(F.struct(F.lower("r_name"), entry)))
    regions.agg(F.to_json(manifest).alias("value")).write.text(folder)
    found = lists.read_regions(t.spark, folder)
    joined = [F.array_join(F.col(f"countries.{n}"), ",").alias(n) for n in ("core", "partial")]
    return found.select("region", "name", "group_order", "classes", *[F.nullif(c, F.lit("")).alias(n) for c, n in zip(joined, ("core", "partial"))])


@check("parquet_round_trip", with_views(f"SELECT {_FLAT} FROM detections", "detections"))
def parquet_round_trip(t: Tables) -> DataFrame:
    folder = t.scratch()
    tables.write_results(t.detections(), "parquet", folder)
    return results.read_detections_parquet(t.spark, folder)


@check("json_round_trip", with_views(f"SELECT {_FLAT} FROM detections", "detections"))
def json_round_trip(t: Tables) -> DataFrame:
    """Result documents written one per line and read back."""
    folder = t.scratch()
    docs = documents.to_result_documents(t.detections(), t.recordings(), "m1", 0.1, 0.0)
    documents.write_result_documents(docs, folder)
    back = results.document_detections(results.read_result_documents(t.spark, folder, lines=True))
    return back.select(*[c.strip() for c in _FLAT.split(",")])


@check(
    "event_log_round_trip",
    with_views(
        f"SELECT {_FLAT}, scientific_name || '_' || common_name AS species FROM detections",
        "detections",
    ),
)
def event_log_round_trip(t: Tables) -> DataFrame:
    folder = t.scratch()
    documents.to_detection_events(t.detections()).select("value").write.text(folder)
    envelopes = event_source.read_event_log(t.spark, folder)
    return event_source.event_detections(envelopes).drop("timestamp")


@check(
    "species_list_round_trip",
    with_views(
        """SELECT file, label, confidence FROM pred WHERE label IN (
               SELECT classifier_label FROM mapping JOIN occ
               ON species_key = lower(split_part(species, '_', 1)) WHERE score >= CAST(0.03 AS FLOAT))""",
        "pred",
        "mapping",
        "occ",
    ),
)
def species_list_round_trip(t: Tables) -> DataFrame:
    """A species list written to a file, read back and used as a filter."""
    folder = t.scratch()
    mapping = species.species_map(t.geo_labels(), t.clf_labels())
    tables.write_species_list(species.species_list(t.occ(), mapping), folder)
    listed = lists.read_species_list(t.spark, folder)
    return species.filter_species_list(t.pred(), listed).select("file", "label", "confidence")
