"""Views of the check tables in this package's schemas; whole tables, nothing sampled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.functions.calendar import model_week
from dawnchorus.session import checkpoint_root, tune


class Tables:
    """Lazy access to one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str, files_per_trigger: int = 1) -> DataFrame:
        """One table as a stream of files."""
        reader = self.spark.readStream.schema(self.raw(name).schema)
        # A pattern, because a stream's plain path has to be a folder.
        return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(
            f"{self.folder}/{name}.parque[t]"
        )

    def scratch(self) -> str:
        """A new folder in the session's shared checkpoint folder."""
        return f"{checkpoint_root(self.spark)}/{uuid.uuid4().hex}"

    # --- detections ---------------------------------------------------------
    def det_ev(self) -> DataFrame:
        """Events as three-second detections, one recording per day."""
        start = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        return self.raw("events").select(
            F.concat(F.lit("rec_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".wav")).alias("file"),
            start.cast("double").alias("start"),
            (start + 3).cast("double").alias("end"),
            F.col("event_type").alias("scientific_name"),
            F.concat_ws(" ", "event_type", (F.col("user_id") % 3).cast("string")).alias(
                "common_name"
            ),
            F.least(F.col("value") / 100.0, F.lit(1.0)).cast("float").alias("confidence"),
            F.col("event_id").alias("line"),
        )

    def det_li(self) -> DataFrame:
        """Order lines as detections that touch, one recording per order."""
        start = (F.col("l_linenumber") - 1) * 3
        parts = self.raw("part").select("p_partkey", "p_name", "p_type")
        return (
            self.raw("lineitem")
            .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                self._order_file("l_orderkey"),
                start.cast("double").alias("start"),
                (start + 3).cast("double").alias("end"),
                F.col("p_type").alias("scientific_name"),
                F.col("p_name").alias("common_name"),
                (F.col("l_quantity") / 50).cast("float").alias("confidence"),
            )
        )

    @staticmethod
    def _order_file(column: str):
        return F.concat(F.lit("ord_"), F.col(column).cast("string"), F.lit(".wav")).alias("file")

    def detections(self) -> DataFrame:
        """det_li in the output schema (single-precision times)."""
        return self.det_li().select(
            F.col("start").cast("float").alias("start_s"),
            F.col("end").cast("float").alias("end_s"),
            "scientific_name",
            "common_name",
            "confidence",
            "file",
        )

    def det_dirty(self) -> DataFrame:
        """det_ev as text read from files, with some unusable values."""
        line = F.col("line")

        def text(name: str):
            return F.col(name).cast("string")

        dirty_end = (
            F.when(line % 89 == 0, F.lit("inf"))
            .when(line % 1009 == 0, (F.col("start") - 1).cast("string"))
            .otherwise(text("end"))
        )
        dirty_conf = (
            F.when(line % 97 == 0, F.lit("NaN"))
            .when(line % 83 == 0, F.lit("1e40"))
            .otherwise(text("confidence"))
        )
        return self.det_ev().select(
            "file",
            "line",
            text("start").try_cast("double").alias("start"),
            dirty_end.try_cast("double").alias("end"),
            "scientific_name",
            "common_name",
            dirty_conf.try_cast("float").alias("confidence"),
        )

    # --- predictions and labels --------------------------------------------------
    def pred(self) -> DataFrame:
        """Order lines as predictions; all lines of an order form one segment."""
        parts = self.raw("part").select("p_partkey", self._label())
        return (
            self.raw("lineitem")
            .select("l_orderkey", "l_partkey", "l_quantity")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                self._order_file("l_orderkey"),
                (F.col("l_orderkey") % 1000).cast("bigint").alias("seg_idx"),
                (F.col("l_orderkey") % 1000 * 3).cast("float").alias("start_s"),
                (F.col("l_orderkey") % 1000 * 3 + 3).cast("float").alias("end_s"),
                "label",
                (F.col("l_quantity") / 50).cast("float").alias("confidence"),
                F.col("l_partkey").cast("int").alias("class_index"),
            )
        )

    @staticmethod
    def _label():
        return F.concat_ws("_", "p_name", "p_brand").alias("label")

    def clf_labels(self) -> DataFrame:
        return (
            self.raw("part")
            .select("p_partkey", self._label())
            .groupBy("label")
            .agg(F.min("p_partkey").cast("int").alias("class_index"))
        )

    def geo_labels(self) -> DataFrame:
        """All part names; bolts go by a name that no classifier label has."""
        names = self.raw("part").select("p_name").distinct()
        return names.select(
            F.concat(F.upper(self._renamed("bolt")), F.lit("_X")).alias("label")
        )

    @staticmethod
    def _renamed(kind: str):
        """The part name, or another name for parts of one kind."""
        other = F.concat(F.lit("other "), F.col("p_name"))
        return F.when(F.endswith(F.col("p_name"), F.lit(kind)), other).otherwise(F.col("p_name"))

    def listed(self) -> DataFrame:
        """A species list: labels of the larger parts."""
        return self.raw("part").filter("p_size > 25").select(self._label()).distinct()

    @staticmethod
    def _occurrence(*place: str):
        total = F.length("p_name") * 13
        for weight, name in zip((7, 3), place):
            total = total + F.col(name) * weight
        return ((total % 101) / 100.0).cast("float").alias("score")

    def _visits(self) -> DataFrame:
        """Every (site, week, part name) seen in the order lines."""
        orders = (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                "o_orderkey",
                F.col("c_nationkey").alias("site"),
                model_week(F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("week"),
            )
        )
        parts = self.raw("part").select("p_partkey", "p_name")
        return (
            self.raw("lineitem")
            .select("l_orderkey", "l_partkey")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select("site", "week", "p_name")
        )

    def occ(self) -> DataFrame:
        """Occurrence scores of one place for all part names; rings are listed by another name."""
        names = self.raw("part").select("p_name").distinct()
        return names.select(
            F.concat(self._renamed("ring"), F.lit("_occ")).alias("species"),
            F.length("p_name").alias("class_index"),
            self._occurrence(),
        )

    def occ_sites(self) -> DataFrame:
        """Occurrence scores per site and week."""
        seen = self._visits().distinct()
        return seen.select(
            "site",
            "week",
            F.concat(self._renamed("ring"), F.lit("_occ")).alias("species"),
            F.length("p_name").alias("class_index"),
            self._occurrence("site", "week"),
        )

    def weights(self) -> DataFrame:
        names = self.raw("part").select("p_name").distinct()
        size = F.length("p_name")
        return names.select(
            F.crc32(F.col("p_name")).alias("class_index"),
            F.col("p_name").alias("species"),
            ((size * 7 % 11 - 5) / 100.0).alias("w_lat"),
            ((size * 5 % 13 - 6) / 100.0).alias("w_lon"),
            ((size * 3 % 7 - 3) / 100.0).alias("w_week"),
            ((size * 11 % 17 - 8) / 10.0).alias("bias"),
        )

    # --- recordings and work --------------------------------------------------------
    def recordings(self) -> DataFrame:
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                self._order_file("o_orderkey"),
                F.floor(F.col("o_totalprice") / 1000).cast("double").alias("duration_s"),
                F.lit(48000).alias("sample_rate"),
                F.col("o_orderdate").alias("modified"),
                F.col("c_nationkey").alias("site"),
                (F.col("c_nationkey") * 7 - 90.0).alias("lat"),
                (F.col("c_nationkey") * 14 - 180.0).alias("lon"),
                model_week(F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("week"),
                (F.col("o_orderkey") % 10 != 0).alias("active"),
                F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("country"),
            )
        )

    def outputs(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .select(self._order_file("l_orderkey"), F.col("l_returnflag").alias("format"))
            .distinct()
        )

    def file_status(self) -> DataFrame:
        kind = F.col("event_type")
        status = (
            F.when(kind == "error", "failed")
            .when(kind == "signup", "skipped")
            .when(kind == "view", "locked")
            .otherwise("processed")
        )
        return self.raw("events").select(
            (F.col("user_id") % 10).alias("run"),
            F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("file"),
            status.alias("status"),
            F.floor("value").alias("detections"),
            (F.col("event_id") % 50).alias("segments"),
            (F.col("event_id") % 50 * 3).cast("double").alias("audio_s"),
            F.lit(0.5).alias("wall_s"),
        )

    def clip_results(self) -> DataFrame:
        kind = F.col("event_type")
        outcome = (
            F.when((kind == "error") & (F.col("user_id") % 4 == 0), "file_failed")
            .when(kind == "error", "clip_failed")
            .when(kind == "signup", "no_detections")
            .otherwise("written")
        )
        return self.raw("events").select(
            F.dayofmonth("ts").alias("batch"),
            F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"),
            outcome.alias("outcome"),
        )

    def params(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key,
            (F.col("c_acctbal") / 5000).alias("min_confidence"),
            F.when(key % 11 == 0, F.lit(float("nan"))).otherwise(key % 5 - 1.0).alias("overlap"),
            (key % 700).alias("batch_size"),
            (key % 400).alias("day_of_year"),
            F.when(key % 13 == 0, F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("csv")))
            .alias("formats"),
            F.when(key % 17 == 0, F.array(F.lit("latt"))).otherwise(F.array(F.lit("lat"))).alias(
                "csv_columns"
            ),
            F.concat(F.lit("m"), (key % 30).cast("string")).alias("model"),
            (F.col("c_acctbal") / 50).alias("latitude"),
            F.when(key % 3 != 0, F.col("c_acctbal") / 30).alias("longitude"),
            (F.col("c_acctbal") / 7000).alias("range_threshold"),
            F.when(key % 60 != 0, key % 60).cast("int").alias("week"),
            F.when(key % 4 == 0, key % 12 + 1).cast("int").alias("month"),
            F.when(key % 4 == 0, key % 28 + 1).cast("int").alias("day"),
            F.element_at(
                F.array(*[F.lit(m) for m in ("birdnet-v24", "birdnet-v30", "perch-v2", "bsg-finland")]),
                (key % 4 + 1).cast("int"),
            ).alias("model_type"),
            (key % 6 == 0).alias("bat_mode"),
        )

    def models(self) -> DataFrame:
        return self.raw("nation").select(
            F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("model")
        )

    def regions(self) -> DataFrame:
        """World regions as model variants covering nations wholly or partly."""
        nations = self.raw("nation").withColumn(
            "_partly", F.col("n_nationkey") % 4 == 3
        )
        return (
            nations.groupBy("n_regionkey")
            .agg(
                F.collect_list(F.when(~F.col("_partly"), F.col("n_name"))).alias("core"),
                F.collect_list(F.when(F.col("_partly") & (F.col("n_nationkey") < 20), F.col("n_name"))).alias("partial"),
            )
            .select(
                F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("region"),
                F.col("n_regionkey").alias("group_order"),
                F.struct("core", "partial").alias("countries"),
            )
        )

    def result_files(self) -> DataFrame:
        """Result paths of orders, in two naming styles."""
        key = F.col("o_orderkey").cast("string")
        name = (
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("rec"), key, F.lit(".BirdNET.results.csv")))
            .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("rec"), key, F.lit(".flac.BirdNET.results.csv")))
            .otherwise(F.concat(F.lit("rec"), key, F.lit(".txt")))
        )
        return self.raw("orders").select(F.concat(F.lit("/data/"), name).alias("file"))

    def audio_inventory(self) -> DataFrame:
        """Audio files: the ordered lines, one of three extensions."""
        ext = (
            F.when(F.col("l_returnflag") == "A", "wav")
            .when(F.col("l_returnflag") == "N", "mp3")
            .otherwise("flac")
        )
        path = F.concat(F.lit("/data/rec"), F.col("l_orderkey").cast("string"), F.lit("."), ext)
        return self.raw("lineitem").select(path.alias("file")).distinct()

    # --- embeddings and paths ----------------------------------------------------------
    def emb(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("file"),
            F.lit(0).alias("seg_idx"),
            "embedding",
            F.col("label").alias("true_label"),
        )

    def head(self) -> DataFrame:
        """Mean embedding per label as a linear head."""
        dims = self.raw("embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
        means = dims.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("w"))
        ordered = F.array_sort(F.collect_list(F.struct("dim", "w")))
        return means.groupBy("label").agg(
            F.transform(ordered, lambda d: d["w"]).alias("weights")
        ).select(
            F.col("label").alias("class_index"),
            F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"),
            "weights",
            F.lit(0.0).alias("bias"),
        )

    def paths(self) -> DataFrame:
        """Page addresses as stand-ins for file paths."""
        return self.raw("pages").select(
            "page_id", F.regexp_replace("url", r"^https?:/", "").alias("file")
        )
