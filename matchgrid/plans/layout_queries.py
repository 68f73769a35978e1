"""Queries over layouts of items, names, nested documents and further samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.operators import layouts as L
from matchgrid.operators import sampling as S
from matchgrid.plans.base import CROPS_SQL, crops, table
from matchgrid.plans.data_queries import EVENTS, ITEMS, events, items
from matchgrid.plans.registry import query
from matchgrid.sources import nested
from matchgrid.streaming import metrics as M

CROPS = f"crops AS ({CROPS_SQL.format(embeddings='embeddings')})"


@query("split_path_items", "SELECT printf('set/cam%d/%04d_%d.png', vec_id % 6, label, vec_id) AS path, 'x_' || printf('%04d', label) AS pid, printf('cam%d', vec_id % 6) AS camid FROM embeddings")
def split_path_items(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    path = F.format_string("set/cam%d/%04d_%d.png", F.col("vec_id") % 6, F.col("label"), F.col("vec_id"))
    return L.split_path(v.select(path.alias("path")), (-1, "_", 0), (-2, "_", 0), prefix="x_")


_SUBSET = "CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'gallery' ELSE 'query' END"


@query("split_list_items", f"SELECT 0 AS split, {_SUBSET} AS subset, (row_number() OVER (PARTITION BY o_custkey, {_SUBSET} ORDER BY o_orderkey) - 1)::INT AS place, o_orderkey || '.png' AS path, o_custkey AS pid, o_orderkey % 4 AS camid FROM orders")
def split_list_items(spark, sf_dir):
    """The documents are made here, one for the orders of each customer, and read back."""
    o = table(spark, sf_dir, "orders")
    subset = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "gallery").otherwise("query")
    row = F.struct(F.col("o_orderkey").alias("at"), F.array(F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")), F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 4).cast("string")).alias("i"))
    pick = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("subset") == name, row))), lambda r: r.i).alias(name)
    each = o.withColumn("subset", subset).groupBy("o_custkey").agg(pick("train"), pick("query"), pick("gallery"))
    return L.split_lists(each.select(F.to_json(F.array(F.struct("train", "query", "gallery"))).alias("document")))


@query(
    "offset_identities",
    f"WITH {ITEMS} SELECT item, pid + (SELECT count(DISTINCT pid) FROM items WHERE camid = 'F') AS pid, camid FROM items WHERE camid <> 'F'",
)
def offset_identities(spark, sf_dir):
    i = items(spark, sf_dir)
    return L.offset_identities(i.where("camid = 'F'"), i.where("camid <> 'F'")).select("item", "pid", "camid")


@query(
    "name_slugs",
    r"""WITH n AS (SELECT p_partkey, p_name, regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS s FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM n)
SELECT p_partkey, s || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS slug FROM r""",
)
def name_slugs(spark, sf_dir):
    return L.slugs(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("flatten_metrics", f"""WITH {EVENTS} SELECT name, max(value) AS "value/max", count(*) AS "value/support/n", min(iteration) AS "first" FROM ev GROUP BY name""")
def flatten_metrics(spark, sf_dir):
    """Metrics nested by group, as columns with a path each."""
    e = events(spark, sf_dir).groupBy("name").agg(F.struct(F.max("value").alias("max"), F.struct(F.count("*").alias("n")).alias("support")).alias("value"), F.min("iteration").alias("first"))
    return L.flatten(e)


@query(
    "object_index",
    f"""WITH {CROPS}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY crop_id) AS k FROM crops),
o AS (SELECT video_id, object_id, min(k) AS first, max(k) - min(k) + 1 = count(*) AS grouped FROM n GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first) - 1 AS object_index FROM o)
SELECT video_id, object_id, crop_id, grouped, object_index FROM n JOIN x USING (video_id, object_id)""",
)
def object_index(spark, sf_dir):
    return L.object_index(crops(spark, sf_dir).select("video_id", "object_id", "crop_id"), "video_id", "object_id", "crop_id")


@query("neutral_columns", f"WITH {CROPS} SELECT crop_id, NULL::DOUBLE AS pos_x, NULL::DOUBLE AS azimuth, occ FROM crops")
def neutral_columns(spark, sf_dir):
    return L.neutral(crops(spark, sf_dir), ["pos_x", "azimuth"]).select("crop_id", "pos_x", "azimuth", "occ")


# Nested documents


@query(
    "nested_rows",
    f"""WITH {CROPS} SELECT 'v' || video_id || '/crops/' || crop_id || '.jpg' AS crop_uid, 'v' || video_id AS video_id, 's' || site_id AS site, 'v' || video_id || '_' || object_id AS tracklet_id, crop_id AS frame,
CASE WHEN crop_id % 3 <> 0 THEN pos_x END AS pos_x, CASE WHEN crop_id % 3 <> 0 THEN pos_y END AS pos_y, azimuth AS azimuth_deg, occ = 1 OR crop_id % 10 > 3 AS occluded,
CASE WHEN occ = 1 THEN 'annotated' WHEN crop_id % 10 > 3 THEN 'overlap' ELSE 'none' END AS occlusion_source, (crop_id % 4 >= 2)::VARCHAR || ',' || (crop_id % 5 >= 2)::VARCHAR AS keypoints FROM crops""",
)
def nested_rows(spark, sf_dir):
    """Unit documents are made from the crops and read back through the parser of nested documents."""
    rows = nested.crops(_documents(spark, sf_dir))
    return rows.select("crop_uid", "video_id", "site", "tracklet_id", F.col("frame").cast("long").alias("frame"), "pos_x", "pos_y", "azimuth_deg", "occluded", "occlusion_source", F.concat_ws(",", F.transform("keypoints", lambda k: k.cast("string"))).alias("keypoints"))


def _documents(spark, sf_dir):
    c, k = crops(spark, sf_dir), F.col("crop_id")
    points = F.array(F.array(F.lit(0.0), F.lit(0.0), k % 4 / 4.0), F.array(F.lit(0.0), F.lit(0.0), k % 5 / 4.0))
    crop = F.struct(
        F.concat(F.lit("\\crops\\"), k.cast("string"), F.lit(".jpg")).alias("crop_file"),
        k.alias("frame"),
        F.when(F.col("pos_x").isNotNull(), F.array("pos_x", "pos_y")).alias("position_road_m"),
        (k % 3 != 0).alias("position_reliable"),
        F.col("azimuth").alias("view_azimuth_deg"),
        (F.col("occ") == 1).alias("occluded_annot"),
        (k % 10 / 10.0).alias("overlap_by_closer_box"),
        F.struct(points.alias("points"), F.lit(0.5).alias("visibility_threshold")).alias("keypoints"),
    )
    name = lambda tag, col: F.concat(F.lit(tag), F.col(col).cast("string"))
    tracks = c.groupBy("video_id", "site_id", "object_id").agg(F.collect_list(crop).alias("crops"))
    track = F.struct(F.col("object_id").alias("track_id"), F.lit("car").alias("label"), F.col("crops"))
    units = tracks.groupBy("video_id", "site_id").agg(F.collect_list(track).alias("tracks"), F.sum(F.size("crops")).alias("n_crops"))
    text = F.to_json(F.struct(name("v", "video_id").alias("video_id"), name("s", "site_id").alias("site"), "n_crops", "tracks"))
    return nested.parse_documents(units.select(text.alias("document"), name("v", "video_id").alias("folder")))


@query("nested_problems", "WITH u AS (SELECT DISTINCT vec_id % 8 AS v FROM embeddings) SELECT 'v' || v AS video_id, 'folder' AS problem, 1::BIGINT AS n FROM u WHERE v = 3 UNION ALL SELECT 'v' || v, 'crop count', 1 FROM u WHERE v = 5")
def nested_problems(spark, sf_dir):
    """The checks find a unit in a folder of another name, and one whose stated number of crops is wrong."""
    d = _documents(spark, sf_dir)
    d = d.withColumn("folder", F.when(F.col("video_id") == "v3", "v4").otherwise(F.col("folder"))).withColumn("n_crops", F.col("n_crops") + F.when(F.col("video_id") == "v5", 1).otherwise(0))
    return nested.problems(d, nested.crops(d))


# Samplers


@query("camera_weights", f"WITH {ITEMS}, b AS (SELECT camid, pid, count(*) AS here FROM items GROUP BY ALL), a AS (SELECT pid, count(*) AS n FROM items GROUP BY pid) SELECT camid, pid, here * n / (sum(here * n) OVER (PARTITION BY camid))::BIGINT AS weight FROM b JOIN a USING (pid)")
def camera_weights(spark, sf_dir):
    return L.camera_weights(items(spark, sf_dir))


@query(
    "camera_draw",
    f"""WITH {ITEMS}, b AS (SELECT camid, pid, count(*) AS here FROM items GROUP BY ALL), a AS (SELECT pid, count(*) AS n FROM items GROUP BY pid), w AS (SELECT camid, pid, here * n / (sum(here * n) OVER (PARTITION BY camid))::BIGINT AS weight FROM b JOIN a USING (pid))
SELECT camid, pid, (row_number() OVER o)::INT AS place FROM w WINDOW o AS (PARTITION BY camid ORDER BY -ln((('0x' || substr(md5('5|' || camid || '|' || pid), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0::DOUBLE) / weight, pid) QUALIFY row_number() OVER o <= 16""",
)
def camera_draw(spark, sf_dir):
    return L.camera_draw(L.camera_weights(items(spark, sf_dir)), 16, 5)


@query(
    "identity_rounds",
    f"""WITH {ITEMS}, r AS (SELECT pid, item, row_number() OVER (PARTITION BY pid ORDER BY md5('0|' || item), item) - 1 AS r, count(*) OVER (PARTITION BY pid) AS size FROM items),
b AS (SELECT pid, item, r // 4 AS round, r % 4 AS place FROM r WHERE size >= 4 AND r < size // 4 * 4 UNION ALL SELECT pid, item, 0, r + k * size FROM r, range(4) t(k) WHERE size < 4 AND r + k * size < 4),
g AS (SELECT DISTINCT pid, round FROM b), n AS (SELECT *, (row_number() OVER (PARTITION BY round ORDER BY md5('7|' || pid), pid) - 1) // 8 AS step, count(*) OVER (PARTITION BY round) AS size FROM g)
SELECT pid, round, item, place, step FROM b JOIN n USING (pid, round) WHERE (step + 1) * 8 <= size""",
)
def identity_rounds(spark, sf_dir):
    """Steps of eight identities with four items each."""
    groups = S.identity_batches(items(spark, sf_dir), "pid", "item", 4)
    return L.identity_draws(groups, "pid", "batch", 8, S.draw(7, "pid"))


@query("interleaved_batches", f"WITH {ITEMS}, n AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS pos, count(*) OVER () AS n FROM items) SELECT item, pos, pos - pos % 32 + (pos % 32 % 4) * 8 + pos % 32 // 4 AS place FROM n WHERE pos < n // 32 * 32")
def interleaved_batches(spark, sf_dir):
    return L.interleave(S.numbered(items(spark, sf_dir).select("item"), F.col("item")), "pos", 32, 4)


# Metric events


@query(
    "metric_histogram_sums",
    f"""WITH {EVENTS}, r AS (SELECT *, min(value) OVER (PARTITION BY name) AS lo, max(value) OVER (PARTITION BY name) AS hi FROM ev), b AS (SELECT name, CASE WHEN hi > lo THEN least(9, floor((value - lo) / (hi - lo) * 10)) ELSE 0 END::INT AS bin, CAST(round(value * 1000000) AS BIGINT) AS m FROM r)
SELECT name, bin, count(*) AS n, sum(m)::BIGINT / 1e6 AS sum, sum(m::DECIMAL(38, 0) * m)::DOUBLE / 1e12 AS sum_squares FROM b GROUP BY ALL""",
)
def metric_histogram_sums(spark, sf_dir):
    return M.histogram_sums(events(spark, sf_dir), 10)


@query(
    "metric_eta",
    """WITH d AS (SELECT event_type AS name, event_id AS iteration, value, median(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m FROM events), t AS (SELECT max(event_id) + 1 AS total FROM events)
SELECT name, iteration, round(m * (total - iteration - 1), 6) AS eta FROM d, t""",
)
def metric_eta(spark, sf_dir):
    """Seconds that are left, by the median of the last 100 durations (values stand for durations here)."""
    e = events(spark, sf_dir)
    return M.eta(e, e.agg((F.max("iteration") + 1).alias("total")), 100).withColumn("eta", F.round("eta", 6))
