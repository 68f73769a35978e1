"""Queries over all pairs of a unit: histograms, thresholds, curves and the difficulty cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchgrid.functions import binning as B
from matchgrid.operators import curves, pairs
from matchgrid.plans.base import PAIRS_SQL, VALIDATION_SITE, crops, edges_sql, thresholds_sql
from matchgrid.plans.registry import query

VAL, TEST = f"site_id = {VALIDATION_SITE}", f"site_id <> {VALIDATION_SITE}"
TARGETS = B.FAR_TARGETS


def described(spark: SparkSession, sf_dir: str, full: bool = False, where: str = "true") -> DataFrame:
    """Pairs of the units with objects and site; full: with difficulty bins and weights. The condition is on crops, below
    the pairs: a unit lies in one site."""
    c = crops(spark, sf_dir).where(where)
    if not full:
        return same_object(pairs.similarities(c, carry=["object_id", "site_id"]))
    sizes = pairs.object_sizes(c).withColumnRenamed("unit", "video_id")
    p = pairs.similarities(c.join(sizes, ["video_id", "object_id"]), carry=["object_id", "size", *pairs.DESCRIPTORS])
    return pairs.with_weights(pairs.describe(same_object(p)))


def same_object(p: DataFrame) -> DataFrame:
    return p.withColumn("same", F.col("object_id_a") == F.col("object_id_b")).withColumnRenamed("site_id_a", "site_id")


def hist(spark: SparkSession, sf_dir: str, *by: str, where: str = "true") -> DataFrame:
    """The fine histogram by unit, site or neither. Counted in the tasks that have the similarities."""
    c = crops(spark, sf_dir).where(where)
    h = pairs.counts(c, B.FINE)
    if "site_id" in by:
        h = h.join(c.select(F.col("video_id").alias("unit"), "site_id").distinct(), "unit")
    return h.groupBy(*by, "same", "bin").agg(F.sum("n").alias("n"))


def fine(p: DataFrame, *by: str) -> DataFrame:
    return pairs.histogram(p, B.FINE, *by)


@query("pair_fine_hist", f"WITH {PAIRS_SQL} SELECT unit, same, fine AS bin, count(*) AS n FROM pairs GROUP BY ALL")
def pair_fine_hist(spark, sf_dir):
    return hist(spark, sf_dir, "unit")


_THR = f"thr AS ({thresholds_sql(TARGETS)})"


@query("far_thresholds", f"WITH {PAIRS_SQL}, {edges_sql(VAL)} {thresholds_sql(TARGETS)}")
def far_thresholds(spark, sf_dir):
    return curves.far_thresholds(hist(spark, sf_dir, where=VAL), B.FINE, TARGETS)


def counts_at(p: DataFrame, thr: DataFrame, *by: str, on: tuple[str, ...] = (), n: int = len(TARGETS)) -> DataFrame:
    """tp, n_pos, fp, n_neg of the pairs at each of at most n thresholds, by the given columns.

    thr: target, threshold and the columns `on` that pairs find theirs by. A pair stays one row: the thresholds lie side by
    side, and each has its own sums.
    """
    wide = thr.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("target", "threshold"))).alias("t"))  # n to a row
    at = p.join(wide, list(on)) if on else p.crossJoin(F.broadcast(wide))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    same = F.col("same")
    hit = [F.col("s") >= F.get("t", k).getField("threshold") for k in range(n)]
    sums = at.groupBy(*by).agg(
        F.first("t").alias("t"), count(same).alias("n_pos"), count(~same).alias("n_neg"), *(count(same & h).alias(f"tp{k}") for k, h in enumerate(hit)), *(count(~same & h).alias(f"fp{k}") for k, h in enumerate(hit))
    )
    each = F.explode(F.array(*(F.struct(F.get("t", k).alias("t"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k in range(n)))).alias("e")
    out = sums.select(*by, "n_pos", "n_neg", each).where("e.t is not null")
    return out.select(*by, "e.t.target", "e.t.threshold", "e.tp", "n_pos", "e.fp", "n_neg")


_COUNTS = "count(*) FILTER (same AND s >= threshold) AS tp, count(*) FILTER (same) AS n_pos, count(*) FILTER (NOT same AND s >= threshold) AS fp, count(*) FILTER (NOT same) AS n_neg"
RATES_SQL = """CASE WHEN n_pos > 0 THEN tp::DOUBLE / n_pos END AS tar, CASE WHEN n_neg > 0 THEN fp::DOUBLE / n_neg END AS far, 1 - CASE WHEN n_pos > 0 THEN tp::DOUBLE / n_pos END AS frr,
CASE WHEN n_pos + n_neg > 0 THEN (tp + n_neg - fp)::DOUBLE / (n_pos + n_neg) END AS acc,
(CASE WHEN n_pos > 0 THEN tp::DOUBLE / n_pos END + 1 - CASE WHEN n_neg > 0 THEN fp::DOUBLE / n_neg END) / 2 AS bacc, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS prec"""


def _tar_far_sql(by: str = "") -> str:
    return f"WITH {PAIRS_SQL}, {edges_sql(VAL)}, {_THR}, c AS (SELECT {by} target, threshold, {_COUNTS} FROM pairs, thr WHERE {TEST} GROUP BY ALL) SELECT *, {RATES_SQL} FROM c"


def tar_far(spark, sf_dir, *by):
    thr = curves.far_thresholds(hist(spark, sf_dir, where=VAL), B.FINE, TARGETS)
    return curves.rates(counts_at(described(spark, sf_dir, where=TEST), thr, *by))


@query("flagship", _tar_far_sql())
def flagship(spark, sf_dir):
    return tar_far(spark, sf_dir)


@query("per_video", _tar_far_sql("unit,"))
def per_video(spark, sf_dir):
    return tar_far(spark, sf_dir, "unit")


@query("per_site", _tar_far_sql("site_id,"))
def per_site(spark, sf_dir):
    return tar_far(spark, sf_dir, "site_id")


@query("roc_edges", f"WITH {PAIRS_SQL}, {edges_sql(TEST)} SELECT edge::INT AS edge, -1.0::DOUBLE + edge * 2.0::DOUBLE / 2000 AS threshold, far, tar, (pos + neg_total - neg)::DOUBLE / (pos_total + neg_total) AS acc, (tar + 1 - far) / 2 AS bacc FROM roc")
def roc_edges(spark, sf_dir):
    return curves.roc(hist(spark, sf_dir, where=TEST), B.FINE)


_AUC = "SELECT {by} sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (2 * below + n))::DOUBLE / (2.0::DOUBLE * sum(p)::BIGINT * sum(n)::BIGINT) END AS auc FROM (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY fine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sides) {group}"


@query("auc", f"WITH {PAIRS_SQL}, {edges_sql(TEST)} {_AUC.format(by='', part='', group='')}")
def auc(spark, sf_dir):
    return curves.auc(hist(spark, sf_dir, where=TEST))


@query("auc_per_video", f"WITH {PAIRS_SQL}, {edges_sql('true', ('unit',))} {_AUC.format(by='unit,', part='PARTITION BY unit', group='GROUP BY unit')}")
def auc_per_video(spark, sf_dir):
    return curves.auc(hist(spark, sf_dir, "unit"), ["unit"])


def _crossing_sql(level: str, value: str, extra: str = "") -> str:
    return f"""x AS (SELECT *, {level} AS d FROM roc), k AS (SELECT unit, min(edge) AS k FROM x WHERE d <= 0 GROUP BY unit),
c AS (SELECT x.unit, max(CASE WHEN edge = greatest(k - 1, 0) THEN d END) AS d0, max(CASE WHEN edge = k THEN d END) AS d1, max(CASE WHEN edge = greatest(k - 1, 0) THEN far END) AS far0,
      max(CASE WHEN edge = k THEN far END) AS far1, max(CASE WHEN edge = greatest(k - 1, 0) THEN tar END) AS tar0, max(CASE WHEN edge = k THEN tar END) AS tar1 FROM x JOIN k ON k.unit = x.unit GROUP BY x.unit)
SELECT unit, {extra} (1 - w) * {value}0 + w * {value}1 AS """


@query("eer", f"WITH {PAIRS_SQL}, {edges_sql('true', ('unit',))}, {_crossing_sql('far - (1 - tar)', 'far')} eer FROM (SELECT *, greatest(0, least(1, coalesce(CASE WHEN d0 - d1 > 0 THEN d0 / (d0 - d1) END, 0))) AS w FROM c)")
def eer(spark, sf_dir):
    return curves.eer(hist(spark, sf_dir, "unit"), B.FINE, ["unit"])


@query("best_tar_at_far", f"WITH {PAIRS_SQL}, {edges_sql('true', ('unit',))}, {_crossing_sql('far - 0.01::DOUBLE', 'tar', '0.01::DOUBLE AS target,')} best_tar FROM (SELECT *, greatest(0, least(1, coalesce(CASE WHEN far0 - far1 > 0 THEN (far0 - 0.01::DOUBLE) / (far0 - far1) END, 0))) AS w FROM c)")
def best_tar_at_far(spark, sf_dir):
    return curves.best_tar(hist(spark, sf_dir, "unit"), B.FINE, 0.01, ["unit"])


@query(
    "hist_quantiles",
    f"""WITH {PAIRS_SQL}, h AS (SELECT unit, same, fine, count(*) AS n FROM pairs GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY unit, same ORDER BY fine) AS cum, sum(n) OVER (PARTITION BY unit, same) AS total FROM h)
SELECT unit, same, q, -1.0::DOUBLE + (fine + greatest(0::DOUBLE, least(1::DOUBLE, (q * total::BIGINT - (cum - n)::BIGINT) / n))) * (2.0::DOUBLE / 2000) AS value
FROM c, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) v(q) WHERE cum::BIGINT >= q * total::BIGINT QUALIFY row_number() OVER (PARTITION BY unit, same, q ORDER BY fine) = 1""",
)
def hist_quantiles(spark, sf_dir):
    return curves.quantiles(hist(spark, sf_dir, "unit"), B.FINE, (0.05, 0.5, 0.95), ["unit"])


@query(
    "dprime",
    f"""WITH {PAIRS_SQL}, m AS (SELECT unit, same, CAST(round(s * 1000000) AS BIGINT) AS m FROM pairs),
g AS (SELECT unit, count(*) FILTER (same) AS pn, sum(m) FILTER (same)::BIGINT AS ps, sum(m * m) FILTER (same)::BIGINT AS pq, count(*) FILTER (NOT same) AS nn, sum(m) FILTER (NOT same)::BIGINT AS ns, sum(m * m) FILTER (NOT same)::BIGINT AS nq FROM m GROUP BY unit),
v AS (SELECT unit, ps::DOUBLE / pn / 1e6 AS pm, ns::DOUBLE / nn / 1e6 AS nm, pq::DOUBLE / pn / 1e12 AS p2, nq::DOUBLE / nn / 1e12 AS n2 FROM g)
SELECT unit, pm AS pos_mean, nm AS neg_mean, (pm - nm) / sqrt((greatest(p2 - pm * pm, 0) + greatest(n2 - nm * nm, 0)) / 2) AS dprime FROM v""",
)
def dprime(spark, sf_dir):
    return curves.separation(described(spark, sf_dir), ["unit"])


AXES = ("pos_bin", "az_bin", "occ_bin", "kp_bin")
#: All pairs together, each axis, four pairs of axes, and the joint cell.
KEEPS = ((), *((a,) for a in AXES), ("pos_bin", "az_bin"), ("pos_bin", "kp_bin"), ("az_bin", "kp_bin"), ("occ_bin", "kp_bin"), AXES)


def cube(p: DataFrame, *aggregates) -> DataFrame:
    """Aggregates of the cells of the cube and of its marginals, in one pass; null in an axis: all its bins."""
    return p.groupingSets([[F.col(c) for c in k] for k in KEEPS], *(F.col(c) for c in AXES)).agg(F.grouping_id().cast("long").alias("level"), *aggregates)


_SETS = ", ".join("(" + ", ".join(k) + ")" for k in KEEPS)
_LEVEL = "CAST(grouping(pos_bin, az_bin, occ_bin, kp_bin) AS BIGINT) AS level"


@query(
    "cube_counts",
    f"""WITH {PAIRS_SQL} SELECT pos_bin, az_bin, occ_bin, kp_bin, {_LEVEL}, count(*) FILTER (same) AS n_pos, count(*) FILTER (NOT same) AS n_neg, (sum(w) FILTER (same))::BIGINT AS w_pos, (sum(w) FILTER (NOT same))::BIGINT AS w_neg,
    sum(CAST(round(s * 1e9) AS BIGINT))::BIGINT AS sum_s FROM pairs GROUP BY GROUPING SETS ({_SETS})""",
)
def cube_counts(spark, sf_dir):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    w = lambda c: F.sum(F.when(c, F.col("w")))
    same = F.col("same")
    return cube(
        described(spark, sf_dir, True), n(same).alias("n_pos"), n(~same).alias("n_neg"), w(same).alias("w_pos"), w(~same).alias("w_neg"), F.sum(F.round(F.col("s") * 1e9).cast("long")).alias("sum_s")
    )


@query("cube_support", f"WITH {PAIRS_SQL} SELECT pos_bin, az_bin, occ_bin, kp_bin, {_LEVEL}, count(DISTINCT CASE WHEN same THEN (unit, object_id_a) END) AS objects, count(DISTINCT CASE WHEN NOT same THEN (unit, least(object_id_a, object_id_b), greatest(object_id_a, object_id_b)) END) AS object_pairs FROM pairs GROUP BY GROUPING SETS ({_SETS})")
def cube_support(spark, sf_dir):
    """Distinct objects and pairs of objects are not additive: they are counted again for each grouping set."""
    low, high = F.least("object_id_a", "object_id_b"), F.greatest("object_id_a", "object_id_b")
    return cube(
        described(spark, sf_dir, True),
        F.countDistinct(F.when(F.col("same"), F.struct("unit", "object_id_a"))).alias("objects"),
        F.countDistinct(F.when(~F.col("same"), F.struct(F.col("unit"), low, high))).alias("object_pairs"),
    )


@query("cube_hist", f"WITH {PAIRS_SQL} SELECT unit, (((pos_bin * 7 + az_bin) * 3 + occ_bin) * 5 + kp_bin)::BIGINT AS cell, same, coarse AS bin, count(*) AS n, sum(w)::BIGINT AS w FROM pairs GROUP BY ALL")
def cube_hist(spark, sf_dir):
    p = described(spark, sf_dir, True).withColumn("cell", pairs.cell(*(F.col(a) for a in AXES)).cast("long"))
    return p.groupBy("unit", "cell", "same", B.similarity_bin(F.col("s"), B.COARSE).alias("bin")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query("kpmin_bins", f"WITH {PAIRS_SQL}, {edges_sql(VAL)}, {_THR}, c AS (SELECT kpmin_bin, target, threshold, {_COUNTS} FROM pairs, thr WHERE {TEST} GROUP BY ALL) SELECT *, {RATES_SQL} FROM c")
def kpmin_bins(spark, sf_dir):
    thr = curves.far_thresholds(hist(spark, sf_dir, where=VAL), B.FINE, TARGETS)
    return curves.rates(counts_at(described(spark, sf_dir, True, TEST), thr, "kpmin_bin"))


@query(
    "bin_table",
    f"""WITH {PAIRS_SQL}, {edges_sql(VAL)}, {_THR}, c AS (SELECT pos_bin, target, threshold, {_COUNTS}, count(DISTINCT CASE WHEN same THEN (unit, object_id_a) END) AS objects FROM pairs, thr WHERE {TEST} GROUP BY ALL)
SELECT *, {RATES_SQL}, n_pos >= 30 AND objects >= 10 AS supported FROM c""",
)
def bin_table(spark, sf_dir):
    thr = curves.far_thresholds(hist(spark, sf_dir, where=VAL), B.FINE, TARGETS)
    test = described(spark, sf_dir, True, TEST)
    objects = test.where("same").groupBy("pos_bin").agg(F.countDistinct("unit", "object_id_a").alias("objects"))
    out = curves.rates(counts_at(test, thr, "pos_bin")).join(objects, "pos_bin", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))
    return out.withColumn("supported", (F.col("n_pos") >= B.MIN_POSITIVES) & (F.col("objects") >= B.MIN_OBJECTS))


@query(
    "object_pair_stats",
    f"WITH {PAIRS_SQL} SELECT unit, least(object_id_a, object_id_b) AS low, greatest(object_id_a, object_id_b) AS high, count(*) AS n, max(s) AS max_s, median(s) AS median_s FROM pairs WHERE NOT same GROUP BY ALL",
)
def object_pair_stats(spark, sf_dir):
    p = described(spark, sf_dir).where("not same")
    return p.groupBy("unit", F.least("object_id_a", "object_id_b").alias("low"), F.greatest("object_id_a", "object_id_b").alias("high")).agg(
        F.count("*").alias("n"), F.max("s").alias("max_s"), F.median("s").alias("median_s")
    )


@query(
    "lowest_positive",
    f"WITH {PAIRS_SQL} SELECT unit, object_id_a AS object_id, s, a, b FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY unit, object_id_a ORDER BY s, a, b) = 1",
)
def lowest_positive(spark, sf_dir):
    p = described(spark, sf_dir).where("same")
    return p.groupBy("unit", F.col("object_id_a").alias("object_id")).agg(F.min(F.struct("s", "a", "b")).alias("m")).select("unit", "object_id", "m.s", "m.a", "m.b")


def _failures_sql(side: str, order: str) -> str:
    return f"WITH {PAIRS_SQL} SELECT unit, a, b, s, row_number() OVER (ORDER BY s {order}, a, b)::INT AS rank FROM pairs WHERE {side} QUALIFY row_number() OVER (ORDER BY s {order}, a, b) <= 200"


@query("failures_negatives", _failures_sql("NOT same", "DESC"))
def failures_negatives(spark, sf_dir):
    return pairs.top_failures(described(spark, sf_dir), 200, False).select("unit", "a", "b", "s", "rank")


@query("failures_positives", _failures_sql("same", "ASC"))
def failures_positives(spark, sf_dir):
    return pairs.top_failures(described(spark, sf_dir), 200, True).select("unit", "a", "b", "s", "rank")


_THR1 = f"thr AS ({thresholds_sql((0.01,))})"


@query(
    "headline",
    f"""WITH {PAIRS_SQL}, {edges_sql(VAL)}, {_THR1}, t AS (SELECT p.*, threshold FROM pairs p, thr WHERE {TEST}),
u AS (SELECT unit, site_id, count(*) FILTER (same) AS np, count(*) FILTER (NOT same) AS nn, count(*) FILTER (same AND s >= threshold) AS tp, count(*) FILTER (NOT same AND s >= threshold) AS fp FROM t GROUP BY ALL),
st AS (SELECT site_id, sum(np)::BIGINT AS np, sum(nn)::BIGINT AS nn, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp FROM u GROUP BY site_id),
pb AS (SELECT pos_bin, count(*) AS np, count(*) FILTER (s >= threshold) AS tp, count(DISTINCT (unit, object_id_a)) AS objects FROM t WHERE same GROUP BY pos_bin)
SELECT 'pooled' AS version, sum(tp)::DOUBLE / sum(np)::DOUBLE AS tar, sum(fp)::DOUBLE / sum(nn)::DOUBLE AS far FROM u
UNION ALL SELECT 'object_balanced', (sum(w) FILTER (same AND s >= threshold))::BIGINT::DOUBLE / (sum(w) FILTER (same))::BIGINT, (sum(w) FILTER (NOT same AND s >= threshold))::BIGINT::DOUBLE / (sum(w) FILTER (NOT same))::BIGINT FROM t
UNION ALL SELECT 'video_averaged', sum(CAST(round(tp::DOUBLE / np * 1e12) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1e12, sum(CAST(round(fp::DOUBLE / nn * 1e12) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1e12 FROM u WHERE np >= 30 AND nn >= 30
UNION ALL SELECT 'site_averaged', sum(CAST(round(tp::DOUBLE / np * 1e12) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1e12, sum(CAST(round(fp::DOUBLE / nn * 1e12) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1e12 FROM st WHERE np >= 30 AND nn >= 30 HAVING count(*) >= 2
UNION ALL SELECT 'bin_balanced', sum(CAST(round(tp::DOUBLE / np * 1e12) AS BIGINT))::BIGINT::DOUBLE / count(*) / 1e12, NULL FROM pb WHERE pos_bin < 7 AND np >= 30 AND objects >= 10""",
)
def headline(spark, sf_dir):
    """The aggregation versions side by side. Means are over whole multiples of 1e-12."""
    thr = curves.far_thresholds(hist(spark, sf_dir, where=VAL), B.FINE, (0.01,)).drop("target")
    t = described(spark, sf_dir, True, TEST).crossJoin(F.broadcast(thr)).withColumn("hit", F.col("s") >= F.col("threshold"))
    same, hit = F.col("same"), F.col("hit")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    w = lambda c: F.sum(F.when(c, F.col("w"))).cast("double")
    counts = [n(same).alias("np"), n(~same).alias("nn"), n(same & hit).alias("tp"), n(~same & hit).alias("fp")]
    units = t.groupBy("unit", "site_id").agg(*counts)
    part = lambda a, b: F.round(F.col(a).cast("double") / F.col(b) * 1e12).cast("long")
    mean = lambda a, b: F.sum(part(a, b)).cast("double") / F.count("*") / 1e12
    gate = (F.col("np") >= B.MIN_VIDEO_PAIRS) & (F.col("nn") >= B.MIN_VIDEO_PAIRS)
    named = lambda name, df: df.select(F.lit(name).alias("version"), "tar", "far")
    pooled = units.agg((F.sum("tp") / F.sum("np")).alias("tar"), (F.sum("fp") / F.sum("nn")).alias("far"))
    balanced = t.agg((w(same & hit) / w(same)).alias("tar"), (w(~same & hit) / w(~same)).alias("far"))
    videos = units.where(gate).agg(mean("tp", "np").alias("tar"), mean("fp", "nn").alias("far"))
    sites = units.groupBy("site_id").agg(*(F.sum(c).alias(c) for c in ("np", "nn", "tp", "fp"))).where(gate)
    sites = sites.agg(mean("tp", "np").alias("tar"), mean("fp", "nn").alias("far"), F.count("*").alias("k")).where("k >= 2")
    bins = t.where("same").groupBy("pos_bin").agg(F.count("*").alias("np"), n(hit).alias("tp"), F.countDistinct("unit", "object_id_a").alias("objects"))
    bins = bins.where((F.col("pos_bin") < len(B.POSITION_M) - 1) & (F.col("np") >= B.MIN_POSITIVES) & (F.col("objects") >= B.MIN_OBJECTS))
    bins = bins.agg(mean("tp", "np").alias("tar"), F.lit(None).cast("double").alias("far"))
    out = named("pooled", pooled)
    for name, df in (("object_balanced", balanced), ("video_averaged", videos), ("site_averaged", sites), ("bin_balanced", bins)):
        out = out.unionByName(named(name, df))
    return out


@query(
    "per_object",
    f"""WITH {PAIRS_SQL}, {edges_sql(VAL)}, {_THR1}, t AS (SELECT p.*, threshold FROM pairs p, thr WHERE {TEST}),
pos AS (SELECT unit, object_id_a AS object_id, count(*) AS n_pos, count(*) FILTER (s >= threshold) AS tp, min(s) AS lowest FROM t WHERE same GROUP BY ALL),
op AS (SELECT unit, least(object_id_a, object_id_b) AS lo, greatest(object_id_a, object_id_b) AS hi, median(s) > any_value(threshold) AS confused, max(s) >= any_value(threshold) AS matched FROM t WHERE NOT same GROUP BY ALL),
sided AS (SELECT unit, lo AS object_id, confused, matched FROM op UNION ALL SELECT unit, hi, confused, matched FROM op),
neg AS (SELECT unit, object_id, count(*) FILTER (confused) AS confused_with, count(*) FILTER (matched) AS matched_with FROM sided GROUP BY ALL)
SELECT unit, object_id, n_pos, tp, lowest, confused_with, matched_with FROM pos FULL JOIN neg USING (unit, object_id)""",
)
def per_object(spark, sf_dir):
    """Confused: the median over the pair of objects is above the threshold; matched: some pair reaches it."""
    thr = curves.far_thresholds(hist(spark, sf_dir, where=VAL), B.FINE, (0.01,)).drop("target")
    t = described(spark, sf_dir, where=TEST).crossJoin(F.broadcast(thr)).withColumn("hit", F.col("s") >= F.col("threshold"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    pos = t.where("same").groupBy("unit", F.col("object_id_a").alias("object_id")).agg(F.count("*").alias("n_pos"), n(F.col("hit")).alias("tp"), F.min("s").alias("lowest"))
    both = t.where("not same").groupBy("unit", F.least("object_id_a", "object_id_b").alias("lo"), F.greatest("object_id_a", "object_id_b").alias("hi"))
    both = both.agg((F.median("s") > F.first("threshold")).alias("confused"), (F.max("s") >= F.first("threshold")).alias("matched"))
    sided = both.select("unit", F.explode(F.array("lo", "hi")).alias("object_id"), "confused", "matched")
    neg = sided.groupBy("unit", "object_id").agg(n(F.col("confused")).alias("confused_with"), n(F.col("matched")).alias("matched_with"))
    return pos.join(neg, ["unit", "object_id"], "full")


@query(
    "unit_spread",
    f"""WITH {PAIRS_SQL}, {edges_sql('true', ('unit',))}, a AS ({_AUC.format(by='unit,', part='PARTITION BY unit', group='GROUP BY unit')})
SELECT count(auc) AS n, round(avg(auc), 9) AS mean, round(stddev_samp(auc), 9) AS std, median(auc) AS median, min(auc) AS min, max(auc) AS max FROM a""",
)
def unit_spread(spark, sf_dir):
    a = curves.auc(hist(spark, sf_dir, "unit"), ["unit"])
    return a.agg(F.count("auc").alias("n"), F.round(F.avg("auc"), 9).alias("mean"), F.round(F.stddev_samp("auc"), 9).alias("std"), F.median("auc").alias("median"), F.min("auc").alias("min"), F.max("auc").alias("max"))


# Threshold protocols: the key of the histogram that a unit's thresholds come from.

PROTOCOLS = {"global": (), "site": ("site_id",), "video": ("unit",)}


def _oracle_protocol_sql(by: tuple[str, ...]) -> str:
    on = " AND ".join(f"p.{c} = thr.{c}" for c in by) or "true"
    return f"WITH {PAIRS_SQL}, {edges_sql('true', by)}, thr AS ({thresholds_sql(TARGETS, by=by)}), c AS (SELECT p.unit, target, threshold, {_COUNTS} FROM pairs p JOIN thr ON {on} GROUP BY ALL) SELECT *, {RATES_SQL} FROM c"


def own_thresholds(spark, sf_dir, by):
    """Each unit at the thresholds of its own group's negatives: an upper bound for any calibration."""
    c = crops(spark, sf_dir)
    thr = curves.far_thresholds(hist(spark, sf_dir, *by), B.FINE, TARGETS, list(by))
    units = c.select(F.col("video_id").alias("unit"), "site_id").distinct()
    return curves.rates(pairs.counts_at(c, by_unit(units.join(thr, list(by)) if by else units.crossJoin(F.broadcast(thr)))))


def by_unit(thr: DataFrame) -> dict[int, list[tuple[float, float]]]:
    """The (target, threshold) pairs of each unit, a few rows a unit."""
    out: dict[int, list[tuple[float, float]]] = {}
    for r in thr.select(F.col("unit").cast("long"), "target", "threshold").collect():
        out.setdefault(r.unit, []).append((r.target, r.threshold))
    return out


for _name, _by in PROTOCOLS.items():
    query(f"thr_{_name}_oracle", _oracle_protocol_sql(_by))(lambda spark, sf_dir, by=_by: own_thresholds(spark, sf_dir, by))


@query(
    "thr_site_loo",
    f"""WITH {PAIRS_SQL}, {edges_sql('true', ('site_id', 'unit'))},
o AS (SELECT site_id, unit, edge, sum(n) OVER s - n AS n, sum(neg) OVER s - neg AS neg, sum(neg_total) OVER s - neg_total AS neg_total, count(*) OVER s AS k FROM roc WINDOW s AS (PARTITION BY site_id, edge)),
others AS (SELECT unit, edge, n::BIGINT AS n, neg::BIGINT AS neg, neg_total::BIGINT AS neg_total FROM o WHERE k > 1), {thresholds_sql(TARGETS, 'others', ('unit',)).join(('thr AS (', ')'))},
c AS (SELECT p.unit, target, threshold, {_COUNTS} FROM pairs p JOIN thr ON thr.unit = p.unit GROUP BY ALL) SELECT *, {RATES_SQL} FROM c""",
)
def thr_site_loo(spark, sf_dir):
    """Each unit at the thresholds of the other units of its site; the only unit of a site is left out."""
    h = hist(spark, sf_dir, "site_id", "unit").where("not same")
    units = crops(spark, sf_dir).select("site_id", F.col("video_id").alias("unit")).distinct()
    other = units.join(units.withColumnRenamed("unit", "other"), "site_id").where("unit <> other")
    rest = other.join(h.withColumnRenamed("unit", "other"), ["site_id", "other"]).groupBy("unit", "same", "bin").agg(F.sum("n").alias("n"))
    thr = curves.far_thresholds(rest, B.FINE, TARGETS, ["unit"])
    return curves.rates(counts_at(described(spark, sf_dir), thr, "unit", on=("unit",)))


@query(
    "fold_assignment",
    f"WITH {PAIRS_SQL} SELECT video_id AS unit, object_id, (row_number() OVER (PARTITION BY video_id ORDER BY md5('0|' || object_id))  - 1) % 2 AS fold FROM sizes",
)
def fold_assignment(spark, sf_dir):
    return folds(crops(spark, sf_dir))


def folds(c: DataFrame, seed: int = 0) -> DataFrame:
    """Two folds of each unit's objects, in the order of a hash."""
    objects = c.select(F.col("video_id").alias("unit"), "object_id").distinct()
    w = Window.partitionBy("unit").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("object_id").cast("string"))))
    return objects.withColumn("fold", (F.row_number().over(w) - 1).cast("long") % 2)


@query(
    "thr_video_heldout",
    f"""WITH {PAIRS_SQL}, f AS (SELECT video_id AS u, object_id AS o, (row_number() OVER (PARTITION BY video_id ORDER BY md5('0|' || object_id)) - 1) % 2 AS fold FROM sizes),
inside AS (SELECT p.*, x.fold FROM pairs p JOIN f x ON x.u = p.unit AND x.o = p.object_id_a JOIN f y ON y.u = p.unit AND y.o = p.object_id_b WHERE x.fold = y.fold),
{edges_sql('true', ('unit', 'fold')).replace('FROM pairs', 'FROM inside')}, thr AS ({thresholds_sql(TARGETS, by=('unit', 'fold'))}),
c AS (SELECT i.unit, target, i.fold, threshold, {_COUNTS} FROM inside i JOIN thr ON thr.unit = i.unit AND thr.fold = 1 - i.fold GROUP BY ALL)
SELECT *, {RATES_SQL} FROM c""",
)
def thr_video_heldout(spark, sf_dir):
    """Each fold of a unit's objects at the thresholds of the other fold; pairs across folds are left out."""
    f = folds(crops(spark, sf_dir))
    c = crops(spark, sf_dir).join(f.withColumnRenamed("unit", "video_id"), ["video_id", "object_id"])
    inside = same_object(pairs.similarities(c, carry=["object_id", "site_id", "fold"])).where("fold_a = fold_b").withColumnRenamed("fold_a", "fold")
    thr = curves.far_thresholds(fine(inside, "unit", "fold"), B.FINE, TARGETS, ["unit", "fold"]).withColumn("fold", 1 - F.col("fold"))
    return curves.rates(counts_at(inside, thr, "unit", "fold", on=("unit", "fold")))
