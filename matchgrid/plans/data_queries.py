"""Queries over items, splits, samplers, evaluators, resampling and metric events."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchgrid.functions.vectors import cosine, cosine_distance, decimals, squared_distance
from matchgrid.operators import curves, resample
from matchgrid.operators import evaluators as E
from matchgrid.operators import pairs as P
from matchgrid.operators import sampling as S
from matchgrid.plans.base import CROPS_SQL, PAIRS_SQL, crops, table
from matchgrid.plans.registry import query
from matchgrid.sources import listings
from matchgrid.streaming import metrics as M

CROPS = f"crops AS ({CROPS_SQL.format(embeddings='embeddings')})"


def items(spark, sf_dir):
    """Orders as items: pid is the customer, camid the status."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("pid"), F.col("o_orderstatus").alias("camid"))


ITEMS = "items AS (SELECT o_orderkey AS item, o_custkey AS pid, o_orderstatus AS camid FROM orders)"


@query("label_remap", f"WITH {ITEMS} SELECT item, pid, camid, dense_rank() OVER (ORDER BY pid) - 1 AS pid_label, dense_rank() OVER (ORDER BY camid) - 1 AS cam_label FROM items")
def label_remap(spark, sf_dir):
    return listings.relabel(listings.relabel(items(spark, sf_dir), "pid", "pid_label"), "camid", "cam_label")


@query("longtail_filter", f"WITH {ITEMS} SELECT * FROM items QUALIFY count(*) OVER (PARTITION BY pid) > 1")
def longtail_filter(spark, sf_dir):
    i = items(spark, sf_dir)
    return i.join(i.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1"), "pid", "left_semi").select("item", "pid", "camid")


@query("dataset_stats", f"WITH {ITEMS} SELECT count(DISTINCT pid) AS ids, count(*) AS items, count(DISTINCT camid) AS cams FROM items")
def dataset_stats(spark, sf_dir):
    return items(spark, sf_dir).agg(F.countDistinct("pid").alias("ids"), F.count("*").alias("items"), F.countDistinct("camid").alias("cams"))


@query(
    "combine_all",
    f"WITH {CROPS} SELECT 'train' AS subset, crop_id, 'grid_' || object_id AS pid FROM crops WHERE role = 'query' UNION ALL SELECT 'test', crop_id, 'grid_test_' || object_id FROM crops WHERE role = 'gallery' AND object_id NOT IN (0, -1)",
)
def combine_all(spark, sf_dir):
    """Training items, and test items as more identities; junk identities are left out."""
    c = crops(spark, sf_dir)
    one = lambda role, subset, prefix: c.where(F.col("role") == role).select(F.lit(subset).alias("subset"), "crop_id", F.concat(F.lit(prefix), F.col("object_id").cast("string")).alias("pid"), "object_id")
    test = one("gallery", "test", "grid_test_").where(~F.col("object_id").isin(0, -1))
    return one("query", "train", "grid_").unionByName(test).drop("object_id")


@query(
    "file_name_items",
    r"""WITH p AS (SELECT printf('root/img/%s%04d_c%ds1_%06d.jpg', CASE WHEN vec_id % 50 = 0 THEN '-' ELSE '' END, label + 1, vec_id % 6 + 1, vec_id) AS path FROM embeddings),
x AS (SELECT path, regexp_extract(path, '([-\d]+)_c(\d)', 1)::INT AS pid, regexp_extract(path, '([-\d]+)_c(\d)', 2)::INT AS cam FROM p)
SELECT 'train' AS subset, path, 'grid_' || pid AS pid, 'grid_' || (cam - 1) AS camid FROM x WHERE pid <> -1""",
)
def file_name_items(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    path = F.format_string("root/img/%s%04d_c%ds1_%06d.jpg", F.when(F.col("vec_id") % 50 == 0, "-").otherwise(""), F.col("label") + 1, F.col("vec_id") % 6 + 1, F.col("vec_id"))
    return listings.from_names(v.select(path.alias("path")), "pid_cam", "train", "grid_")


@query(
    "eligibility",
    f"""WITH {CROPS}, t AS (SELECT video_id, object_id, count(*) AS n FROM crops GROUP BY ALL),
u AS (SELECT video_id, count(*) FILTER (n >= 2) AS tracks, sum(n)::BIGINT AS crops FROM t GROUP BY video_id)
SELECT *, CASE WHEN video_id = 7 THEN 'no calibration' WHEN tracks < 2 THEN 'too few tracks' WHEN crops < 62 THEN 'too few crops' END AS reason FROM u""",
)
def eligibility(spark, sf_dir):
    """The first rule that a unit breaks; null: eligible."""
    t = crops(spark, sf_dir).groupBy("video_id", "object_id").agg(F.count("*").alias("n"))
    u = t.groupBy("video_id").agg(F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).alias("tracks"), F.sum("n").alias("crops"))
    return u.withColumn("reason", F.when(F.col("video_id") == 7, "no calibration").when(F.col("tracks") < 2, "too few tracks").when(F.col("crops") < 62, "too few crops"))


@query("loader_summary", f"WITH {CROPS} SELECT video_id, count(DISTINCT (video_id, object_id)) AS tracks, count(*) AS crops FROM crops GROUP BY ROLLUP (video_id)")
def loader_summary(spark, sf_dir):
    """Tracks and crops of each unit, and of all (null)."""
    return crops(spark, sf_dir).rollup("video_id").agg(F.countDistinct("video_id", "object_id").alias("tracks"), F.count("*").alias("crops"))


@query("fingerprint", f"WITH {CROPS} SELECT video_id, sha256(string_agg(video_id || '/' || object_id || '/' || crop_id, chr(10) ORDER BY video_id || '/' || object_id || '/' || crop_id)) AS sha FROM crops GROUP BY video_id")
def fingerprint(spark, sf_dir):
    """Hash of each unit's canonical lines in order."""
    line = F.concat_ws("/", "video_id", "object_id", "crop_id")
    return crops(spark, sf_dir).groupBy("video_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha"))


@query(
    "missing_extra_uids",
    f"WITH {CROPS}, have AS (SELECT crop_id + 3 AS uid FROM crops WHERE crop_id % 17 <> 0) SELECT 'missing' AS problem, crop_id AS uid FROM crops WHERE crop_id NOT IN (SELECT uid FROM have) UNION ALL SELECT 'extra', uid FROM have WHERE uid NOT IN (SELECT crop_id FROM crops)",
)
def missing_extra_uids(spark, sf_dir):
    """Rows without a vector, and vectors without a row."""
    c = crops(spark, sf_dir).select(F.col("crop_id").alias("uid"))
    have = c.where("uid % 17 <> 0").select((F.col("uid") + 3).alias("uid"))
    return c.join(have, "uid", "left_anti").select(F.lit("missing").alias("problem"), "uid").unionByName(have.join(c, "uid", "left_anti").select(F.lit("extra").alias("problem"), "uid"))


@query(
    "site_disjoint_split",
    f"""WITH {CROPS}, u AS (SELECT DISTINCT video_id AS unit, site_id AS site FROM crops), s AS (SELECT site, row_number() OVER (ORDER BY md5('0|' || site)) AS r FROM u GROUP BY site)
SELECT unit, site, 'validation' AS part FROM u JOIN s USING (site) WHERE r = 1 UNION ALL
(SELECT unit, site, 'test' FROM u JOIN s USING (site) WHERE r > 1 ORDER BY md5('0|' || unit), unit LIMIT 5)""",
)
def site_disjoint_split(spark, sf_dir):
    units = crops(spark, sf_dir).select(F.col("video_id").alias("unit"), F.col("site_id").alias("site")).distinct()
    return S.site_split(units, 2, 5)


# Samplers


@query("inference_shards", f"WITH {ITEMS}, n AS (SELECT *, row_number() OVER (ORDER BY item) - 1 AS pos, count(*) OVER () AS n FROM items) SELECT item, pos, pos // ((n + 6) // 7) AS shard FROM n")
def inference_shards(spark, sf_dir):
    return S.contiguous_shards(items(spark, sf_dir).select("item"), [F.col("item")], 7)


@query("rank_strided_stream", f"WITH {ITEMS}, n AS (SELECT item, row_number() OVER (ORDER BY md5('3|' || item), item) - 1 AS pos FROM items) SELECT * FROM n WHERE pos % 4 = 1")
def rank_strided_stream(spark, sf_dir):
    return S.strided_stream(items(spark, sf_dir).select("item"), "item", 3, 1, 4)


@query(
    "identity_batches",
    f"""WITH {ITEMS}, r AS (SELECT pid, item, row_number() OVER (PARTITION BY pid ORDER BY md5('0|' || item), item) - 1 AS r, count(*) OVER (PARTITION BY pid) AS size FROM items)
SELECT pid, item, r // 4 AS batch, r % 4 AS place FROM r WHERE size >= 4 AND r < size // 4 * 4 UNION ALL SELECT pid, item, 0, r + k * size FROM r, range(4) t(k) WHERE size < 4 AND r + k * size < 4""",
)
def identity_batches(spark, sf_dir):
    return S.identity_batches(items(spark, sf_dir), "pid", "item", 4)


@query(
    "balanced_identity_batches",
    f"""WITH {ITEMS}, a AS (SELECT pid, item AS anchor, camid AS cam FROM items QUALIFY row_number() OVER (PARTITION BY pid ORDER BY md5('0|' || item), item) = 1),
r AS (SELECT i.pid, i.item, row_number() OVER (PARTITION BY i.pid ORDER BY (i.camid = cam)::INT, md5('1|' || i.item), i.item) AS place FROM items i JOIN a ON a.pid = i.pid WHERE i.item <> anchor),
k AS (SELECT a.pid, a.anchor, count(r.item) FILTER (place < 4) AS n FROM a LEFT JOIN r USING (pid) GROUP BY ALL)
SELECT pid, item, place::INT AS place FROM r WHERE place < 4 UNION ALL SELECT pid, anchor, p::INT FROM k, range(4) t(p) WHERE p = 0 OR p > n""",
)
def balanced_identity_batches(spark, sf_dir):
    return S.balanced_batches(items(spark, sf_dir), "pid", "camid", "item", 4)


@query("imbalance_weights", "SELECT label, count(*) AS n, 1 / count(*) AS weight FROM embeddings GROUP BY label")
def imbalance_weights(spark, sf_dir):
    return S.imbalance_weights(table(spark, sf_dir, "embeddings"), "label")


@query(
    "class_center_sample",
    "WITH p AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k, c_custkey IN (SELECT k FROM p) AS positive FROM customer), n AS (SELECT greatest(100, (SELECT count(*) FROM c WHERE positive)) AS n), t AS (SELECT *, row_number() OVER (ORDER BY NOT positive, md5('0|' || k), k) AS r FROM c) SELECT k, positive, row_number() OVER (ORDER BY k) - 1 AS new_label FROM t, n WHERE r <= n",
)
def class_center_sample(spark, sf_dir):
    """The positives of all orders."""
    classes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return S.class_centres(classes, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k", 100)


# Other evaluators

ATTR = "rows AS (SELECT l.doc_id AS row_id, a AS attr, CASE WHEN a = 0 THEN quality ELSE toxic END AS y, ((n_chars * (a + 3)) % 100) / 100.0::DOUBLE AS score FROM labels l JOIN documents USING (doc_id), range(2) t(a))"


def attributes(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("a", F.explode(F.array(F.lit(0), F.lit(1))))
    return d.select(F.col("doc_id").alias("row_id"), F.col("a").cast("long").alias("attr"), F.when(F.col("a") == 0, F.col("quality")).otherwise(F.col("toxic")).alias("y"), (F.col("n_chars") * (F.col("a") + 3) % 100 / 100).alias("score"))


_MEAN = "sum(CAST(round({} * 1e12) AS BIGINT))::BIGINT / count(*) / 1e12"


ATTR_METRICS_SQL = f"""WITH {ATTR}, x AS (SELECT *, y = 1 AS t, score >= 0.5 AS p FROM rows),
a AS (SELECT attr, (count(*) FILTER (t AND p) / (count(*) FILTER (t) + 1e-20) + count(*) FILTER (NOT t AND NOT p) / (count(*) FILTER (NOT t) + 1e-20)) / 2 AS ma FROM x GROUP BY attr),
r AS (SELECT row_id, count(*) FILTER (t AND p) / (count(*) FILTER (t OR p) + 1e-20) AS acc, count(*) FILTER (t AND p) / (count(*) FILTER (p) + 1e-20) AS prec, count(*) FILTER (t AND p) / (count(*) FILTER (t) + 1e-20) AS rec FROM x GROUP BY row_id),
m AS (SELECT (SELECT {_MEAN.format('ma')} FROM a) AS ma, {_MEAN.format('acc')} AS acc, {_MEAN.format('prec')} AS prec, {_MEAN.format('rec')} AS rec FROM r)
SELECT *, 2 * prec * rec / (prec + rec + 1e-20) AS f1 FROM m"""


@query("attr_metrics", ATTR_METRICS_SQL)
def attr_metrics(spark, sf_dir):
    return E.attribute_metrics(attributes(spark, sf_dir))


@query("attr_prevalence", f"WITH {ATTR} SELECT attr, sum(y)::BIGINT / count(*) AS prevalence FROM rows GROUP BY attr")
def attr_prevalence(spark, sf_dir):
    return attributes(spark, sf_dir).groupBy("attr").agg((F.sum("y") / F.count("*")).alias("prevalence"))


LOGITS = "logits AS (SELECT c_custkey AS row_id, k AS class, ((c_custkey * 37 + k * 53) % 101) / 10.0::DOUBLE AS logit, (c_nationkey % 10)::BIGINT AS target, k % 3 AS shard FROM customer, range(10) t(k))"


def logits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("class", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return c.select(F.col("c_custkey").alias("row_id"), "class", ((F.col("c_custkey") * 37 + F.col("class") * 53) % 101 / 10.0).alias("logit"), (F.col("c_nationkey") % 10).cast("long").alias("target"), (F.col("class") % 3).alias("shard"))


@query("topk_accuracy", f"WITH {LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY logit DESC, class) AS rank FROM logits) SELECT k::INT AS k, count(*) FILTER (rank <= k) / count(*) AS acc FROM r, (VALUES (1), (5)) v(k) WHERE class = target GROUP BY k")
def topk_accuracy(spark, sf_dir):
    return E.topk_accuracy(logits(spark, sf_dir), (1, 5))


@query("sharded_softmax", f"WITH {LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS e FROM logits) SELECT row_id, round(-ln(greatest(sum(e) FILTER (class = target) / sum(e), 1e-30)), 7) AS loss FROM e GROUP BY row_id")
def sharded_softmax(spark, sf_dir):
    return E.sharded_cross_entropy(logits(spark, sf_dir)).withColumn("loss", decimals(F.col("loss"), 7))


VERIFY = f"""{CROPS}, v AS (SELECT a.crop_id AS pair_id, round(2 - 2 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dist, a.object_id = b.object_id AS same, ntile(10) OVER (ORDER BY a.crop_id) - 1 AS fold FROM crops a JOIN crops b ON b.crop_id = a.crop_id + 1),
g AS (SELECT fold, k, k * 0.01::DOUBLE AS threshold, count(*) FILTER (dist < k * 0.01::DOUBLE AND same) AS tp, count(*) FILTER (dist < k * 0.01::DOUBLE AND NOT same) AS fp, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM v, range(400) t(k) GROUP BY ALL),
t AS (SELECT *, tp + n - fp AS right_, p + n AS size FROM g), x AS (SELECT *, ((sum(right_) OVER (PARTITION BY k) - right_)::BIGINT / (sum(size) OVER (PARTITION BY k) - size)::BIGINT) AS train FROM t)"""


@query("kfold_verification", f"WITH {VERIFY} SELECT fold, threshold, right_ / size AS acc, tp / CASE WHEN p > 0 THEN p END AS tpr, fp / CASE WHEN n > 0 THEN n END AS fpr FROM x QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train DESC, k) = 1")
def kfold_verification(spark, sf_dir):
    c = crops(spark, sf_dir)
    a = c.select(F.col("crop_id").alias("pair_id"), F.col("embedding").alias("x"), F.col("object_id").alias("o"))
    b = c.select((F.col("crop_id") - 1).alias("pair_id"), F.col("embedding").alias("y"), F.col("object_id").alias("q"))
    pairs = a.join(b, "pair_id").select("pair_id", decimals(2 - 2 * cosine(F.col("x"), F.col("y")), 9).alias("dist"), (F.col("o") == F.col("q")).alias("same"))
    return E.fold_verification(S.contiguous_folds(pairs, [F.col("pair_id")], 10), 10, 400, 0.01)


BOTH = f"""{CROPS}, m AS (SELECT a.crop_id AS a, b.crop_id AS b, a.object_id = b.object_id AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM crops a JOIN crops b ON a.video_id = b.video_id),
d AS (SELECT a, b, same, CASE WHEN a = b THEN 1 ELSE round(s, 9) END AS s, CASE WHEN a = b THEN 0 ELSE round(sqrt(greatest(2 - 2 * round(s, 9), 1e-12)), 9) END AS d FROM m)"""


def batch_distances(spark, sf_dir):
    """All ordered pairs of a unit, an anchor with itself included."""
    c = crops(spark, sf_dir)
    p = P.with_objects(P.similarities(c), c).select("a", "b", "same", "s")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "same", "s"))
    both = both.withColumn("d", F.round(F.sqrt(F.greatest(2 - 2 * F.col("s"), F.lit(1e-12))), 9))
    return both.unionByName(c.select(F.col("crop_id").alias("a"), F.col("crop_id").alias("b"), F.lit(True).alias("same"), F.lit(1.0).alias("s"), F.lit(0.0).alias("d")))


@query("hard_mining", f"WITH {BOTH} SELECT a, max(d) FILTER (same) AS hard_pos, min(d) FILTER (NOT same) AS hard_neg, greatest(0, max(d) FILTER (same) - min(d) FILTER (NOT same) + 0.3::DOUBLE) AS loss FROM d GROUP BY a")
def hard_mining(spark, sf_dir):
    mined = E.hard_mining(batch_distances(spark, sf_dir))
    return mined.withColumn("loss", E.triplet(mined, 0.3))


@query("weighted_mining", f"WITH {BOTH}, w AS (SELECT a, same, sum(d * exp(CASE WHEN same THEN d ELSE -d END)) / sum(exp(CASE WHEN same THEN d ELSE -d END)) AS w FROM d GROUP BY a, same) SELECT a, round(max(w) FILTER (same), 7) AS pos, round(max(w) FILTER (NOT same), 7) AS neg FROM w GROUP BY a")
def weighted_mining(spark, sf_dir):
    return E.weighted_mining(batch_distances(spark, sf_dir)).select("a", F.round("pos", 7).alias("pos"), F.round("neg", 7).alias("neg"))


@query(
    "circle_logits",
    f"""WITH {BOTH}, x AS (SELECT a, same, CASE WHEN same THEN -64 * (s - 0.75) * greatest(0, 1.25 - s) ELSE 64 * (s - 0.25) * greatest(0, s + 0.25) END AS x FROM d WHERE a <> b),
t AS (SELECT a, same, max(x) AS top FROM x GROUP BY a, same), l AS (SELECT x.a, x.same, top + ln(sum(exp(x.x - top))) AS lse FROM x JOIN t ON t.a = x.a AND t.same = x.same GROUP BY x.a, x.same, top)
SELECT a, round(max(lse) FILTER (same), 6) AS lse_p, round(max(lse) FILTER (NOT same), 6) AS lse_n FROM l GROUP BY a""",
)
def circle_logits(spark, sf_dir):
    return E.pair_logits(batch_distances(spark, sf_dir), 0.25, 64.0).select("a", F.round("lse_p", 6).alias("lse_p"), F.round("lse_n", 6).alias("lse_n"))


# Resampling

UNITS = f"""{PAIRS_SQL}, u AS (SELECT unit, count(*) FILTER (same) AS n_pos, count(*) FILTER (same AND s >= 0.1) AS tp, count(*) FILTER (same AND s >= 0.0) AS tp0 FROM pairs GROUP BY unit),
spots AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS spot, count(*) OVER () AS v FROM u),
boot AS (SELECT b, spots.unit, count(*) AS n FROM range(200) t(b), range(8) r(j), spots WHERE spots.spot = ('0x' || substr(md5('0|' || b || '|' || j), 1, 8))::BIGINT % spots.v GROUP BY ALL),
vals AS (SELECT b, sum(tp * n)::BIGINT / sum(n_pos * n)::BIGINT AS value, sum(tp0 * n)::BIGINT / sum(n_pos * n)::BIGINT AS value0 FROM boot JOIN u USING (unit) GROUP BY b)"""


def unit_counts(spark, sf_dir):
    c = crops(spark, sf_dir)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    p = P.with_objects(P.similarities(c), c).where("same")
    return p.groupBy("unit").agg(F.count("*").alias("n_pos"), n(F.col("s") >= 0.1).alias("tp"), n(F.col("s") >= 0.0).alias("tp0"))


@query("bootstrap_ci", f"WITH {UNITS} SELECT round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi FROM vals")
def bootstrap_ci(spark, sf_dir):
    u = unit_counts(spark, sf_dir)
    i = resample.interval(resample.pooled(u, resample.hashed(u, 200), "tp", "n_pos"), "value", units=u)
    return i.select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("paired_bootstrap", f"WITH {UNITS}, i AS (SELECT quantile_cont(value0 - value, 0.025) AS lo, quantile_cont(value0 - value, 0.975) AS hi FROM vals) SELECT round(lo, 9) AS lo, round(hi, 9) AS hi, lo > 0 OR hi < 0 AS excludes_zero FROM i")
def paired_bootstrap(spark, sf_dir):
    """The same resamples for two operating points; the interval of the difference."""
    u = unit_counts(spark, sf_dir)
    boot = resample.hashed(u, 200)
    i = resample.interval(resample.difference(resample.pooled(u, boot, "tp", "n_pos"), resample.pooled(u, boot, "tp0", "n_pos")), "value")
    return i.select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), resample.excludes_zero(F.col("lo"), F.col("hi")).alias("excludes_zero"))


# Metric events


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("iteration"), "value")


EVENTS = "ev AS (SELECT event_type AS name, event_id AS iteration, value FROM events)"


@query(
    "metric_history",
    f"""WITH {EVENTS}, m AS (SELECT *, CAST(round(value * 1000000) AS BIGINT) AS m FROM ev)
SELECT name, iteration, value, median(value) OVER w AS median, (sum(m) OVER w)::BIGINT / count(*) OVER w / 1e6 AS avg, (sum(m) OVER g)::BIGINT / count(*) OVER g / 1e6 AS global_avg FROM m
WINDOW w AS (PARTITION BY name ORDER BY iteration ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS (PARTITION BY name ORDER BY iteration ROWS UNBOUNDED PRECEDING)""",
)
def metric_history(spark, sf_dir):
    return M.history(events(spark, sf_dir), 20)


@query("latest_metric", f"WITH {EVENTS} SELECT name, max(iteration) AS iteration, arg_max(value, iteration) AS value FROM ev GROUP BY name")
def latest_metric(spark, sf_dir):
    return M.latest(events(spark, sf_dir))


@query("metric_histogram", f"WITH {EVENTS}, r AS (SELECT *, min(value) OVER (PARTITION BY name) AS lo, max(value) OVER (PARTITION BY name) AS hi FROM ev) SELECT name, CASE WHEN hi > lo THEN least(9, floor((value - lo) / (hi - lo) * 10)) ELSE 0 END::INT AS bin, count(*) AS n FROM r GROUP BY ALL")
def metric_histogram(spark, sf_dir):
    return M.histogram(events(spark, sf_dir), 10)


@query("running_best", f"WITH {EVENTS}, b AS (SELECT *, max(value) OVER (PARTITION BY name ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev) SELECT name, iteration, value FROM b WHERE value > greatest(coalesce(m, -1), -1)")
def running_best(spark, sf_dir):
    return M.running_best(events(spark, sf_dir))


@query("first_n_per_key", f"WITH {EVENTS} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY name ORDER BY iteration) <= 3")
def first_n_per_key(spark, sf_dir):
    return M.first_n(events(spark, sf_dir), "name", 3)


@query("every_nth_event", f"WITH {EVENTS} SELECT * FROM ev QUALIFY (row_number() OVER (PARTITION BY name ORDER BY iteration) - 1) % 50 = 0")
def every_nth_event(spark, sf_dir):
    return M.every_n(events(spark, sf_dir), "name", 50)


@query("warm_throughput", f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY iteration) AS r FROM ev) SELECT name, sum(CAST(round(value * 1000000) AS BIGINT))::BIGINT / count(*) / 1e6 AS avg, count(*) AS n FROM r WHERE r > 5 GROUP BY name")
def warm_throughput(spark, sf_dir):
    return M.throughput(events(spark, sf_dir), 5)


@query("circular_queue", f"WITH {EVENTS} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY name ORDER BY iteration DESC) <= 64")
def circular_queue(spark, sf_dir):
    return M.last_k(events(spark, sf_dir), "name", 64)


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = M.sessions(e, "user_id", "30 minutes")
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


# Comparison tables


@query(
    "models_matrix",
    f"""WITH {PAIRS_SQL}, half AS (SELECT unit, same, greatest(-1.0, least(1.0, round(list_cosine_similarity(x.embedding[1:32]::DOUBLE[], y.embedding[1:32]::DOUBLE[]), 9))) AS s FROM pairs JOIN crops x ON x.crop_id = a JOIN crops y ON y.crop_id = b),
al AS (SELECT 'full' AS model, unit, same, s FROM pairs UNION ALL SELECT 'half', unit, same, s FROM half)
SELECT model, count(*) FILTER (same AND s >= 0.1) / count(*) FILTER (same) AS tar_01, count(*) FILTER (same AND s >= 0.2) / count(*) FILTER (same) AS tar_02, count(*) FILTER (NOT same AND s >= 0.1) / count(*) FILTER (NOT same) AS far_01, count(*) FILTER (NOT same AND s >= 0.2) / count(*) FILTER (NOT same) AS far_02 FROM al GROUP BY model""",
)
def models_matrix(spark, sf_dir):
    """Two models, the second with the first half of each vector, at two fixed thresholds, pivoted."""
    c = crops(spark, sf_dir)
    both = None
    for name, vectors in (("full", c), ("half", c.withColumn("embedding", F.slice("embedding", 1, 32)))):
        one = P.with_objects(P.similarities(vectors), c).select(F.lit(name).alias("model"), "same", "s")
        both = one if both is None else both.unionByName(one)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    at = both.crossJoin(F.broadcast(spark.createDataFrame([("01", 0.1), ("02", 0.2)], "point string, t double")))
    same, hit = F.col("same"), F.col("s") >= F.col("t")
    g = at.groupBy("model").pivot("point", ["01", "02"]).agg(curves.ratio(n(same & hit), n(same)).alias("tar"), curves.ratio(n(~same & hit), n(~same)).alias("far"))
    return g.select("model", *(F.col(f"{p}_{m}").alias(f"{m}_{p}") for p in ("01", "02") for m in ("tar", "far")))


@query("distance_metrics", f"WITH {CROPS} SELECT a.crop_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 7) AS cosine, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 7) AS euclidean FROM crops a JOIN crops b ON b.crop_id = a.crop_id + 1")
def distance_metrics(spark, sf_dir):
    c = crops(spark, sf_dir)
    a = c.select("crop_id", F.col("embedding").alias("x")).join(c.select((F.col("crop_id") - 1).alias("crop_id"), F.col("embedding").alias("y")), "crop_id")
    return a.select("crop_id", F.round(cosine_distance(F.col("x"), F.col("y")), 7).alias("cosine"), F.round(squared_distance(F.col("x"), F.col("y")), 7).alias("euclidean"))
