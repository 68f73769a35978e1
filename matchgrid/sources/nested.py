"""Nested unit documents (one JSON file a unit, tracks with crops inside) to flat rows, with loud checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a crop counts as occluded if a closer box covers more than this.
OCCLUDED_ABOVE = 0.3
VISIBLE_FROM = 0.5

SCHEMA = """video_id STRING, site STRING, country STRING, orient STRING, pov STRING, time STRING, fps DOUBLE,
calibration STRUCT<available: BOOLEAN>, crop_params STRUCT<effective_fps: DOUBLE>, quality_params STRING, n_tracks INT, n_crops INT,
tracks ARRAY<STRUCT<track_id: INT, tracklet_id: STRING, identity_id: STRING, label: STRING, n_crops: INT, crops: ARRAY<STRUCT<
  crop_file: STRING, frame: INT, timestamp_s: DOUBLE, bbox_xyxy: ARRAY<DOUBLE>, bbox_wh: ARRAY<DOUBLE>, crop_transform: STRUCT<pad_x: DOUBLE, pad_y: DOUBLE>,
  position_road_m: ARRAY<DOUBLE>, distance_m: DOUBLE, position_reliable: BOOLEAN, view_azimuth_deg: DOUBLE, view_bin: STRING,
  occluded_annot: BOOLEAN, overlap_by_closer_box: DOUBLE, quality: MAP<STRING, STRING>,
  keypoints: STRUCT<schema: STRING, points: ARRAY<ARRAY<DOUBLE>>, visible: ARRAY<BOOLEAN>, visibility_threshold: DOUBLE>>>>>"""


def normal_path(p: Column) -> Column:
    """Forward slashes, none at the start."""
    return F.ltrim(F.translate(p, "\\", "/"), F.lit("/"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path: a glob of unit documents, such as root/videos/*/meta.json. Rejected crops are not in the schema."""
    docs = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return docs.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))


def parse_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """The same from rows with a document's text and its folder; a text that is no such document is an error."""
    return documents.select(F.from_json(F.col(column), SCHEMA, {"mode": "FAILFAST"}).alias("d"), "folder").select("d.*", "folder")


def visible(keypoints: Column) -> Column:
    """Visibility of each keypoint: as given, else from the scores; null where neither is known."""
    least = F.coalesce(keypoints["visibility_threshold"], F.lit(VISIBLE_FROM))
    return F.coalesce(keypoints["visible"], F.transform(keypoints["points"], lambda p: F.element_at(p, 3) >= least))


def crops(documents: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row per kept crop."""
    d = documents.select("video_id", "site", "folder", "n_crops", F.explode("tracks").alias("t"))
    if labels is not None:
        d = d.where(F.col("t.label").isin(labels))
    tracklet = F.coalesce("t.tracklet_id", F.concat_ws("_", "video_id", F.col("t.track_id").cast("string")))
    d = d.select("video_id", "site", "folder", tracklet.alias("tracklet_id"), F.coalesce("t.identity_id", tracklet).alias("identity_id"), F.col("t.label").alias("label"), F.explode("t.crops").alias("c"))
    known = F.col("c.position_reliable") & F.col("c.position_road_m").isNotNull()
    annotated, overlap = F.coalesce("c.occluded_annot", F.lit(False)), F.coalesce(F.col("c.overlap_by_closer_box") > OCCLUDED_ABOVE, F.lit(False))
    return d.select(
        F.concat_ws("/", "video_id", normal_path(F.col("c.crop_file"))).alias("crop_uid"),
        "video_id",
        "site",
        "folder",
        "tracklet_id",
        "identity_id",
        "label",
        F.col("c.frame").alias("frame"),
        F.col("c.timestamp_s").alias("timestamp_s"),
        normal_path(F.col("c.crop_file")).alias("path"),
        F.when(known, F.element_at("c.position_road_m", 1)).alias("pos_x"),
        F.when(known, F.element_at("c.position_road_m", 2)).alias("pos_y"),
        F.when(known, F.col("c.distance_m")).alias("distance_m"),
        F.col("c.view_azimuth_deg").alias("azimuth_deg"),
        (annotated | overlap).alias("occluded"),
        F.when(annotated, "annotated").when(overlap, "overlap").otherwise("none").alias("occlusion_source"),
        visible(F.col("c.keypoints")).alias("keypoints"),
        F.col("c.quality").alias("quality"),
    )


def problems(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """video_id, problem, n: everything that must not be in a data set. Empty where all is well."""
    counts = rows.groupBy("video_id").agg(F.count("*").alias("found"))
    miscounted = documents.select("video_id", "n_crops").join(counts, "video_id", "left").where(~F.coalesce("found", F.lit(0)).eqNullSafe(F.col("n_crops")))
    checks = {
        "folder": documents.where("folder <> video_id").groupBy("video_id").agg(F.count("*").alias("n")),
        "rejected": rows.where(F.col("path").contains("rejected")).groupBy("video_id").agg(F.count("*").alias("n")),
        "crop count": miscounted.groupBy("video_id").agg(F.count("*").alias("n")),
        "duplicate uid": rows.groupBy("video_id", "crop_uid").agg(F.count("*").alias("k")).where("k > 1").groupBy("video_id").agg(F.count("*").alias("n")),
    }
    out = None
    for name, found in checks.items():
        part = found.select("video_id", F.lit(name).alias("problem"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def load(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """Checked rows; a problem is an error. Sort by CANONICAL at the sink where the order matters."""
    documents = read_documents(spark, path)
    rows = crops(documents, labels)
    found = problems(documents, rows) if labels is None else problems(documents, rows).where("problem <> 'crop count'")
    if bad := found.limit(5).collect():
        raise ValueError(f"the data set is damaged: {[tuple(r) for r in bad]}")
    return rows


CANONICAL = ("video_id", "tracklet_id", "frame", "crop_uid")
