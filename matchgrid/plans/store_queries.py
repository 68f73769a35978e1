"""Queries of stored tables, catalogs, batches, plug points and of what is left of the result sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid import plugins
from matchgrid.functions import binning as B
from matchgrid.functions.vectors import average
from matchgrid.operators import batches, curves, pairs
from matchgrid.operators import evaluators as E
from matchgrid.operators import sampling as S
from matchgrid.plans.base import CROPS_SQL, PAIRS_SQL, crops, edges_sql, table, thresholds_sql
from matchgrid.plans.data_queries import ATTR_METRICS_SQL, EVENTS, attributes, dataset_stats, events
from matchgrid.plans.pair_queries import TARGETS, TEST, VAL, described, hist
from matchgrid.plans.registry import query
from matchgrid.sources import stores
from matchgrid.streaming import metrics as M

CROPS = f"crops AS ({CROPS_SQL.format(embeddings='embeddings')})"


@query("unit_templates", f"WITH {CROPS} SELECT crop_id, video_id, object_id, list_sum(embedding::DOUBLE[])::DECIMAL(18, 6)::DOUBLE AS total, len(embedding) AS dims FROM crops WHERE site_id <> 0")
def unit_templates(spark, sf_dir):
    """Templates are stored by set and unit, and the test set is read back: folders of the other set are not opened."""
    path = stores.scratch(spark, "templates")
    part = F.when(F.col("site_id") == 0, "validation").otherwise("test")
    stores.write_units(crops(spark, sf_dir).select("crop_id", "video_id", "object_id", "embedding", part.alias("part")), path, "part", "video_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).cast("decimal(18,6)").cast("double")
    return stores.read_units(spark, path, part="test").select("crop_id", F.col("video_id").cast("long").alias("video_id"), "object_id", total.alias("total"), F.size("embedding").cast("long").alias("dims"))


@query(
    "alignment_report",
    f"""WITH {CROPS}, r AS (SELECT video_id, crop_id AS uid, row_number() OVER (PARTITION BY video_id ORDER BY crop_id) AS pos FROM crops),
t AS (SELECT video_id, CASE WHEN video_id = 2 AND crop_id % 19 = 0 THEN -crop_id - 1 ELSE crop_id END AS uid, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN video_id = 5 THEN -crop_id ELSE crop_id END) AS pos,
  video_id = 6 AND crop_id % 23 = 0 AS bad FROM crops WHERE NOT (video_id = 1 AND crop_id % 17 = 0)),
c AS (SELECT coalesce(r.video_id, t.video_id) AS unit, count(*) FILTER (t.uid IS NULL) AS missing, count(*) FILTER (r.uid IS NULL) AS extra, count(*) FILTER (r.pos <> t.pos) AS moved, count(*) FILTER (t.bad) AS nonfinite
  FROM r FULL JOIN t ON r.video_id = t.video_id AND r.uid = t.uid GROUP BY 1)
SELECT *, missing + extra + moved + nonfinite = 0 AS aligned FROM c""",
)
def alignment_report(spark, sf_dir):
    """Templates with faults of each kind: rows left out in unit 1, foreign ones in 2, another order in 5, NaN in 6."""
    c = crops(spark, sf_dir).select(F.col("video_id").alias("unit"), F.col("crop_id").alias("uid"), "embedding")
    foreign, backward, bad = (F.col("unit") == 2) & (F.col("uid") % 19 == 0), F.col("unit") == 5, (F.col("unit") == 6) & (F.col("uid") % 23 == 0)
    t = c.where(~((F.col("unit") == 1) & (F.col("uid") % 17 == 0))).withColumn("embedding", F.when(bad, F.transform("embedding", lambda x: x * float("nan"))).otherwise(F.col("embedding")))
    t = stores.placed(t, "unit", F.when(backward, -F.col("uid")).otherwise(F.col("uid"))).withColumn("uid", F.when(foreign, -F.col("uid") - 1).otherwise(F.col("uid")))
    return stores.alignment(stores.placed(c.drop("embedding"), "unit", F.col("uid")), t)


@query(
    "run_catalog",
    """WITH f AS (SELECT DISTINCT n_nationkey % 7 AS f, 'summary.json' AS file FROM nation UNION SELECT DISTINCT n_nationkey % 7, 'per_site.csv' FROM nation WHERE n_nationkey % 7 % 3 <> 0),
have AS (SELECT 'v1-' || f AS folder FROM f GROUP BY f HAVING count(*) = 2), m AS (SELECT 'm' || k AS method, e, 'v1-' || ((k * 2 + e) % 7) AS folder FROM range(5) a(k), range(2) b(e))
SELECT method, arg_min(folder, e) AS folder FROM m JOIN have USING (folder) GROUP BY method""",
)
def run_catalog(spark, sf_dir):
    k = F.col("n_nationkey") % 7
    n = table(spark, sf_dir, "nation")
    path = lambda rows, name: rows.select(F.concat(F.lit("v1-"), k.cast("string"), F.lit("/" + name)).alias("path"))
    files = path(n, "summary.json").unionByName(path(n.where(k % 3 != 0), "per_site.csv"))
    return stores.runs(files, [(f"m{m}", [f"-{(m * 2 + e) % 7}" for e in range(2)]) for m in range(5)], "v1")


@query("pair_set_items", "WITH i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) SELECT a.pos // 2 AS pair, a.vec_id AS a, b.vec_id AS b, (a.pos // 2) % 3 = 0 AS same FROM i a JOIN i b ON b.pos = a.pos + 1 WHERE a.pos % 2 = 0")
def pair_set_items(spark, sf_dir):
    images = S.numbered(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image")), F.col("image"))
    flags = images.select((F.floor(F.col("pos") / 2)).alias("pair")).distinct().withColumn("same", F.col("pair") % 3 == 0)
    return stores.pair_set(images, flags)


@query("indexed_record_items", "SELECT o_orderkey AS idx, o_custkey AS target, (SELECT count(*) FROM customer)::BIGINT AS classes FROM orders WHERE o_orderkey > 0 AND o_orderkey < (SELECT max(o_orderkey) FROM orders)")
def indexed_record_items(spark, sf_dir):
    """Records made from orders; the header leaves the last one out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("idx"), F.array(F.col("o_custkey").cast("double"), F.lit(0.0)).alias("label")).where("idx > 0")
    ends = o.agg(F.max("idx").cast("double").alias("end")).crossJoin(table(spark, sf_dir, "customer").agg(F.count("*").cast("double").alias("n")))
    return stores.indexed_records(o.unionByName(ends.select(F.lit(0).cast("long").alias("idx"), F.array("end", F.col("end") + F.col("n")).alias("label"))))


# Batches and channels


@query("collated_batches", "WITH i AS (SELECT o_orderkey AS item, o_custkey AS pid, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT pos // 64 AS batch, count(*) AS n, string_agg(item, ',' ORDER BY pos) AS items, string_agg(pid, ',' ORDER BY pos) AS targets FROM i GROUP BY 1")
def collated_batches(spark, sf_dir):
    rows = S.numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("pid")), F.col("item"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return batches.collated(rows, "pos", 64, "item", "pid").select("batch", "n", text("item").alias("items"), text("pid").alias("targets"))


@query(
    "channel_statistics",
    """WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings), x AS (SELECT pos // 64 AS b, i - 1 AS channel, CAST(round(embedding[i]::DOUBLE * 1000000) AS BIGINT) AS m FROM p, range(1, 65) t(i)),
g AS (SELECT b, channel, count(*)::DOUBLE AS n, sum(m)::BIGINT::DOUBLE AS s, sum(m::HUGEINT * m)::DOUBLE AS q FROM x GROUP BY ALL HAVING count(*) > 1), v AS (SELECT channel, s / n / 1e6 AS mean, (q - s * s / n) / (n - 1) / 1e12 AS var FROM g)
SELECT channel::INT AS channel, sum(CAST(round(mean * 1e12) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1e12 AS mean, sum(CAST(round(var * 1e12) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1e12 AS var FROM v GROUP BY channel""",
)
def channel_statistics(spark, sf_dir):
    rows = S.numbered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id"))
    return batches.channel_statistics(rows.withColumn("b", F.floor(F.col("pos") / 64)), "b", "embedding")


@query(
    "pair_probe",
    f"""WITH {CROPS}, s AS (SELECT video_id, object_id FROM crops GROUP BY ALL HAVING count(*) > 1), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY md5('0|' || video_id || '|' || object_id), object_id) AS k FROM s),
r AS (SELECT c.video_id, crop_id, k, row_number() OVER (PARTITION BY c.video_id, c.object_id ORDER BY md5('1|' || crop_id), crop_id) AS r FROM crops c JOIN k USING (video_id, object_id) WHERE k <= 2)
SELECT video_id, max(crop_id) FILTER (k = 1 AND r = 1) AS x, max(crop_id) FILTER (k = 1 AND r = 2) AS y, max(crop_id) FILTER (k = 2 AND r = 1) AS z FROM r GROUP BY video_id HAVING count(*) FILTER (k = 2) > 0 ORDER BY video_id LIMIT 20""",
)
def pair_probe(spark, sf_dir):
    """The probe takes at most twenty units."""
    return batches.pair_probe(crops(spark, sf_dir).select("video_id", "object_id", "crop_id"), 20, "video_id", "object_id", "crop_id")


_ARRIVALS = "SELECT event_id, row_number() OVER (ORDER BY md5('3|' || (event_id // 8)), event_id) - 1 AS arrived FROM events"


@query("reordered_results", f"SELECT event_id, arrived, max(arrived) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS released FROM ({_ARRIVALS})")
def reordered_results(spark, sf_dir):
    """Results arrive in a drawn order of groups of eight, and leave in the order of their ids."""
    e = table(spark, sf_dir, "events").select("event_id").withColumn("g", F.floor(F.col("event_id") / 8))
    return batches.released(S.numbered(e, S.draw(3, "g"), F.col("event_id"), to="arrived").select("event_id", "arrived"), "event_id", "arrived")


@query("flip_average", f"WITH {CROPS} SELECT crop_id, (i - 1)::INT AS pos, (embedding[i]::DOUBLE + embedding[65 - i]::DOUBLE) / 2 AS x FROM crops, range(1, 65) t(i)")
def flip_average(spark, sf_dir):
    """Two views of an item: here its vector and the same from its end."""
    return crops(spark, sf_dir).select("crop_id", F.posexplode(average(F.col("embedding"), F.reverse("embedding"))).alias("pos", "x"))


@query("padded_sizes", f"""WITH {CROPS}, s AS (SELECT crop_id, crop_id % 9 - 1 AS pad_x, crop_id % 7 - 1 AS pad_y, 8 + crop_id % 5 AS w, 6 + crop_id % 11 AS h FROM crops)
SELECT crop_id, CASE WHEN pad_x >= 0 AND w - 2 * pad_x >= 2 THEN w - 2 * pad_x END AS width, CASE WHEN pad_y >= 0 AND h - 2 * pad_y >= 2 THEN h - 2 * pad_y END AS height FROM s""")
def padded_sizes(spark, sf_dir):
    k = F.col("crop_id")
    return crops(spark, sf_dir).select("crop_id", batches.padded_size(k % 9 - 1, 8 + k % 5).alias("width"), batches.padded_size(k % 7 - 1, 6 + k % 11).alias("height"))


# Result sets


@query(
    "dense_cells",
    f"WITH {PAIRS_SQL}, c AS (SELECT unit, same, ((pos_bin * 7 + az_bin) * 3 + occ_bin) * 5 + kp_bin AS cell, count(*) AS n FROM pairs GROUP BY ALL), g AS (SELECT DISTINCT unit, same FROM c) SELECT unit, same, t.cell, coalesce(n, 0) AS n FROM g, range(840) t(cell) LEFT JOIN c ON c.unit = g.unit AND c.same = g.same AND c.cell = t.cell".replace("SELECT unit, same, t.cell", "SELECT g.unit, g.same, t.cell"),
)
def dense_cells(spark, sf_dir):
    """Each unit's histogram over all 840 joint cells, empty ones too."""
    return batches.dense(pairs.cell_counts(crops(spark, sf_dir)), ["unit", "same"], "cell", 840, "n")


_HARD = "row_number() OVER (PARTITION BY mode, unit, same ORDER BY CASE WHEN same THEN s ELSE -s END, a, b)"


@query(
    "unit_hardest",
    f"WITH {PAIRS_SQL}, x AS (SELECT 'plain' AS mode, unit, same, a, b, s FROM pairs UNION ALL SELECT 'near', unit, same, a, b, s FROM pairs WHERE pos_bin <= 1) SELECT mode, unit, same, a, b, s, {_HARD} AS rank FROM x QUALIFY {_HARD} <= 200",
)
def unit_hardest(spark, sf_dir):
    """Of each unit the 200 most alike pairs of different objects and the 200 least alike of one: of all, and of those near each
    other (the second position bin too, as the made positions leave the first one empty)."""
    near = F.when(F.col("pos_bin") <= 1, F.array(F.lit("plain"), F.lit("near"))).otherwise(F.array(F.lit("plain")))
    p = described(spark, sf_dir, True).select(F.explode(near).alias("mode"), "unit", "same", "a", "b", "s")
    w = Window.partitionBy("mode", "unit", "same").orderBy(F.when(F.col("same"), F.col("s")).otherwise(-F.col("s")), "a", "b")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 200")


_POINTS = B.operating_points()


@query("operating_point_names", "SELECT * FROM (VALUES (0, '0.1pct', 0.001::DOUBLE, false), (1, '1pct', 0.01, false), (2, '2pct', 0.02, false), (3, '5pct', 0.05, false), (4, '10pct', 0.1, false), (5, 'th0.5', 0.5, true)) t(place, name, value, fixed)")
def operating_point_names(spark, sf_dir):
    return spark.createDataFrame(_POINTS, "place int, name string, value double, fixed boolean")


@query(
    "operating_points",
    f"""WITH {PAIRS_SQL}, {edges_sql(VAL)}, far AS ({thresholds_sql(TARGETS)}), thr AS (SELECT target, threshold, false AS fixed FROM far UNION ALL SELECT 0.5::DOUBLE, 0.5::DOUBLE, true)
SELECT CASE WHEN fixed THEN 'th0.5' ELSE printf('%g', target * 100) || 'pct' END AS name, threshold, count(*) FILTER (same AND s >= threshold) / count(*) FILTER (same) AS tar, count(*) FILTER (NOT same AND s >= threshold) / count(*) FILTER (NOT same) AS far
FROM pairs, thr WHERE {TEST} GROUP BY ALL""",
)
def operating_points(spark, sf_dir):
    """TAR and FAR at every operating point, those of a target and fixed ones. Thresholds lie side by side: a pair stays one row."""
    thr = curves.far_thresholds(hist(spark, sf_dir, where=VAL), B.FINE, TARGETS)  # one row a target
    points = spark.createDataFrame(_POINTS, "place int, name string, value double, fixed boolean")
    thr = points.join(thr.withColumnRenamed("target", "value").withColumn("fixed", F.lit(False)), ["value", "fixed"], "left").withColumn("threshold", F.when(F.col("fixed"), F.col("value")).otherwise(F.col("threshold")))
    wide = thr.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "threshold"))), lambda t: F.struct(t["name"].alias("name"), t["threshold"].alias("threshold"))).alias("t"))
    p = described(spark, sf_dir, where=TEST).crossJoin(F.broadcast(wide))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit = lambda k: F.col("s") >= F.get("t", k)["threshold"]
    ks, same = range(len(_POINTS)), F.col("same")
    sums = p.agg(F.first("t").alias("t"), n(same).alias("np"), n(~same).alias("nn"), *(n(same & hit(k)).alias(f"tp{k}") for k in ks), *(n(~same & hit(k)).alias(f"fp{k}") for k in ks))
    each = F.explode(F.array(*(F.struct(F.get("t", k).alias("t"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k in ks))).alias("e")
    return sums.select("np", "nn", each).select("e.t.name", "e.t.threshold", (F.col("e.tp") / F.col("np")).alias("tar"), (F.col("e.fp") / F.col("nn")).alias("far"))


_AXES = {"delta_position": B.POSITION_M, "delta_azimuth": B.AZIMUTH_DEG, "keypoint_iou": B.KEYPOINT_IOU, "min_visible_keypoints": B.MIN_KEYPOINTS}


@query(
    "bin_labels",
    "WITH e AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', {k}, {'NULL' if k == 0 else repr(v[k - 1])}, {repr(v[k])})" for a, v in ((a, tuple(x for x in v if x != float("inf"))) for a, v in _AXES.items()) for k in range(len(v)))
    + ") t(axis, k, lo, hi)), inner_ AS (SELECT axis, k - 1 AS bin, printf('[%g,%g', lo, hi) AS head, k = max(k) OVER (PARTITION BY axis) AND axis NOT IN ('delta_position', 'min_visible_keypoints') AS closed FROM e WHERE k > 0)"
    + " SELECT axis, bin::INT AS bin, head || CASE WHEN closed THEN ']' ELSE ')' END AS label FROM inner_"
    + " UNION ALL SELECT axis, max(k)::INT, printf('[%g,inf]', max(hi)) FROM e WHERE axis IN ('delta_position', 'min_visible_keypoints') GROUP BY axis"
    + " UNION ALL SELECT axis, max(k)::INT + CASE WHEN axis IN ('delta_position', 'min_visible_keypoints') THEN 1 ELSE 0 END, 'unknown' FROM e GROUP BY axis",
)
def bin_labels(spark, sf_dir):
    return spark.createDataFrame([(a, k, name) for a, edges in _AXES.items() for k, name in enumerate(B.labels(edges))], "axis string, bin int, label string")


@query(
    "split_assembly",
    f"""WITH {CROPS}, u AS (SELECT DISTINCT video_id AS unit, site_id AS site FROM crops), s AS (SELECT site, row_number() OVER (ORDER BY md5('0|' || site)) AS r FROM u GROUP BY site),
p AS (SELECT unit, site, 'validation' AS part FROM u JOIN s USING (site) WHERE r = 1 UNION ALL (SELECT unit, site, 'test' FROM u JOIN s USING (site) WHERE r > 1 ORDER BY md5('0|' || unit), unit LIMIT 5))
SELECT part, count(DISTINCT unit) AS videos, count(DISTINCT (unit, object_id)) AS tracklets, count(*) AS crops, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT q.site::VARCHAR AS x FROM p q WHERE q.part = p.part)) AS sites,
  NOT EXISTS (SELECT 1 FROM p a JOIN p b ON a.site = b.site WHERE a.part <> b.part) AS site_disjoint FROM p JOIN crops c ON c.video_id = p.unit GROUP BY part""",
)
def split_assembly(spark, sf_dir):
    """The parts of a split with what they hold, and whether no site lies in two. Counts are of units first, so no row is a part's load."""
    c = crops(spark, sf_dir)
    parts = S.site_split(c.select(F.col("video_id").alias("unit"), F.col("site_id").alias("site")).distinct(), 2, 5)
    sizes = c.groupBy(F.col("video_id").alias("unit")).agg(F.countDistinct("object_id").alias("tracklets"), F.count("*").alias("crops"))
    out = parts.join(sizes, "unit").groupBy("part").agg(F.count("*").alias("videos"), F.sum("tracklets").alias("tracklets"), F.sum("crops").alias("crops"), F.array_join(F.array_sort(F.collect_set(F.col("site").cast("string"))), ",").alias("sites"))
    shared = parts.groupBy("site").agg(F.countDistinct("part").alias("n")).agg((F.max("n") == 1).alias("site_disjoint"))
    return out.crossJoin(F.broadcast(shared))


@query("scoped_hints", f"WITH {EVENTS}, h AS (SELECT name, iteration % 3 AS hint FROM ev WHERE name <> 'view') SELECT 'train/' || name AS name, count(DISTINCT hint) AS hints FROM h GROUP BY name HAVING count(DISTINCT hint) > 1")
def scoped_hints(spark, sf_dir):
    """Metrics under a scope that were written with more than one smoothing hint."""
    e = events(spark, sf_dir).where("name <> 'view'").withColumn("hint", F.col("iteration") % 3)
    return M.conflicting_hints(M.scoped(e, "train/"))


# Plug points


@query("encoded_signs", f"WITH {CROPS} SELECT crop_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code FROM crops")
def encoded_signs(spark, sf_dir):
    """Vectors through a registered encoder."""
    out = plugins.export(crops(spark, sf_dir).select("crop_id", "embedding"), "signs", "crop_id", "embedding")
    return out.select("crop_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), "").alias("code"))


class Attributes(plugins.Evaluator):
    def result(self, rows):
        return E.attribute_metrics(rows)


plugins.EVALUATORS.register("attributes")(Attributes)
plugins.LOADERS.register("crops")(lambda spark, sf_dir: crops(spark, sf_dir))


@query(
    "evaluator_metrics",
    f"""WITH a AS ({ATTR_METRICS_SQL}), s AS (SELECT count(DISTINCT o_custkey)::DOUBLE AS ids, count(*)::DOUBLE AS items, count(DISTINCT o_orderstatus)::DOUBLE AS cams FROM orders)
SELECT 'attributes' AS evaluator, metric, value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'stats', metric, value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def evaluator_metrics(spark, sf_dir):
    """Results of several evaluators as one table."""
    evaluator = plugins.EVALUATORS.get("attributes")()
    evaluator.process(attributes(spark, sf_dir))
    return plugins.evaluate_all({"attributes": evaluator.evaluate(), "stats": dataset_stats(spark, sf_dir)})
