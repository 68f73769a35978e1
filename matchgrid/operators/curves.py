"""Metrics of a pair of histograms over equal bins of [-1, 1]: rows (group..., same, bin, n).

Histograms are sparse; empty bins never change a cumulative sum, but edges are reported at every bin. A ratio whose
denominator is not positive is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _sides(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group and bin that has pairs: p, n."""
    return hist.groupBy(*by, "bin").agg(
        F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("same"), 0).otherwise(F.col("n"))).alias("neg")
    )


def edges(hist: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Tail counts at every one of the bins + 1 edges: pos and neg at or above the edge, and the totals."""
    spark = hist.sparkSession
    sides = _sides(hist, by)
    groups = sides.groupBy(*by).agg(F.sum("p").alias("pos_total"), F.sum("neg").alias("neg_total"))
    grid = groups.crossJoin(F.broadcast(spark.range(bins + 1).select(F.col("id").cast("int").alias("edge"))))
    full = grid.join(sides.withColumnRenamed("bin", "edge"), [*by, "edge"], "left").fillna(0, ["p", "neg"])
    w = Window.partitionBy(*by).orderBy(F.desc("edge")).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*by, "edge", "pos_total", "neg_total", F.sum("p").over(w).alias("pos"), F.sum("neg").over(w).alias("neg"), "p", F.col("neg").alias("n"))


def roc(hist: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """FAR, TAR, accuracy and balanced accuracy at every edge."""
    e = edges(hist, bins, by)
    far, tar = ratio(F.col("neg"), F.col("neg_total")), ratio(F.col("pos"), F.col("pos_total"))
    right = F.col("pos") + F.col("neg_total") - F.col("neg")
    return e.select(
        *by,
        "edge",
        (F.lit(-1.0) + F.col("edge") * F.lit(2.0) / bins).alias("threshold"),
        far.alias("far"),
        tar.alias("tar"),
        ratio(right, F.col("pos_total") + F.col("neg_total")).alias("acc"),
        ((tar + 1 - far) / 2).alias("bacc"),
    )


def auc(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties inside a bin as one half."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    s = _sides(hist, by).withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    area = s.groupBy(*by).agg(F.sum(F.col("p") * (2 * F.col("below") + F.col("neg"))).alias("a"), F.sum("p").alias("pos"), F.sum("neg").alias("negs"))
    return area.select(*by, F.col("pos").alias("n_pos"), F.col("negs").alias("n_neg"), ratio(F.col("a").cast("double"), 2.0 * F.col("pos") * F.col("negs")).alias("auc"))


def _crossing(hist: DataFrame, bins: int, by: Sequence[str], level: Column) -> DataFrame:
    """The first edge at which level(far, tar) <= 0, with the edge before it (itself at the first)."""
    e = roc(hist, bins, by).withColumn("d", level)
    first = e.where("d <= 0").groupBy(*by).agg(F.min("edge").alias("k"))
    at = e.join(first, list(by)) if by else e.crossJoin(F.broadcast(first))
    pick = lambda name, k: F.max(F.when(F.col("edge") == k, F.col(name)))
    k0 = F.greatest(F.col("k") - 1, F.lit(0))
    return at.groupBy(*by).agg(*(pick(n, k).alias(f"{n}{j}") for n in ("d", "far", "tar") for j, k in ((0, k0), (1, F.col("k")))))


def _mix(name: str, w: Column) -> Column:
    return (1 - w) * F.col(f"{name}0") + w * F.col(f"{name}1")


def _clipped(w: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(w, F.lit(0.0))))


def eer(hist: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """The rate at which false accepts equal false rejects, between the two edges around it."""
    c = _crossing(hist, bins, by, F.col("far") - (1 - F.col("tar")))
    w = _clipped(ratio(F.col("d0"), F.col("d0") - F.col("d1")))
    return c.select(*by, _mix("far", w).alias("eer"))


def best_tar(hist: DataFrame, bins: int, target: float, by: Sequence[str] = ()) -> DataFrame:
    """TAR where FAR is exactly the target, between the two edges around it."""
    c = _crossing(hist, bins, by, F.col("far") - F.lit(target))
    w = _clipped(ratio(F.col("far0") - F.lit(target), F.col("far0") - F.col("far1")))
    return c.select(*by, F.lit(target).alias("target"), _mix("tar", w).alias("best_tar"))


def far_thresholds(hist: DataFrame, bins: int, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each target the similarity with that share of negatives at or above it, linear inside its bin; groups
    without negatives have no row."""
    spark = hist.sparkSession
    goal = spark.createDataFrame([(float(t),) for t in targets], "target double")
    e = edges(hist, bins, by).where("neg_total > 0")
    before = Window.partitionBy(*by).orderBy("edge")
    e = e.withColumn("in_bin", F.lag("n").over(before)).crossJoin(F.broadcast(goal)).withColumn("want", F.col("target") * F.col("neg_total"))
    first = Window.partitionBy(*by, "target").orderBy("edge")
    e = e.where("neg <= want").withColumn("r", F.row_number().over(first)).where("r = 1")
    inside = F.when(F.col("in_bin") > 0, (F.col("want") - F.col("neg")) / F.col("in_bin")).otherwise(0.0)
    width = F.lit(2.0 / bins)
    t = F.when(F.col("edge") == 0, F.lit(-1.0)).otherwise(F.lit(-1.0) + F.col("edge") * width - inside * width)
    return e.select(*by, "target", t.alias("threshold"))


def quantiles(hist: DataFrame, bins: int, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of the similarities of each group and side, uniform inside a bin."""
    spark = hist.sparkSession
    keys = [*by, "same"]
    h = hist.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    h = h.crossJoin(F.broadcast(spark.createDataFrame([(float(q),) for q in qs], "q double"))).withColumn("want", F.col("q") * F.col("total"))
    first = Window.partitionBy(*keys, "q").orderBy("bin")
    h = h.where("cum >= want").withColumn("r", F.row_number().over(first)).where("r = 1")
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("want") - (F.col("cum") - F.col("n"))) / F.col("n")))
    return h.select(*keys, "q", (F.lit(-1.0) + (F.col("bin") + inside) * F.lit(2.0) / bins).alias("value"))


def rates(counts: DataFrame) -> DataFrame:
    """tar, far, frr, acc, bacc, prec from columns tp, n_pos, fp, n_neg."""
    tar, far = ratio(F.col("tp"), F.col("n_pos")), ratio(F.col("fp"), F.col("n_neg"))
    return counts.withColumns(
        {
            "tar": tar,
            "far": far,
            "frr": 1 - tar,
            "acc": ratio(F.col("tp") + F.col("n_neg") - F.col("fp"), F.col("n_pos") + F.col("n_neg")),
            "bacc": (tar + 1 - far) / 2,
            "prec": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        }
    )


def separation(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """d' and means of the two sides, from sums of similarities in whole millionths."""
    m = F.round(F.col("s") * 1_000_000).cast("long")
    side = lambda name, same: [
        F.sum(F.when(F.col("same") == same, F.lit(1)).otherwise(0)).alias(f"{name}_n"),
        F.sum(F.when(F.col("same") == same, m)).alias(f"{name}_s"),
        F.sum(F.when(F.col("same") == same, m * m)).alias(f"{name}_q"),
    ]
    g = pairs.groupBy(*by).agg(*side("p", True), *side("n", False))
    mean = lambda x: ratio(F.col(f"{x}_s").cast("double"), F.col(f"{x}_n")) / 1e6
    var = lambda x: F.greatest(ratio(F.col(f"{x}_q").cast("double"), F.col(f"{x}_n")) / 1e12 - mean(x) * mean(x), F.lit(0.0))
    return g.select(*by, mean("p").alias("pos_mean"), mean("n").alias("neg_mean"), ((mean("p") - mean("n")) / F.sqrt((var("p") + var("n")) / 2)).alias("dprime"))
