"""Other evaluators: attributes, classification, pair verification by folds, mining and pair losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-20
#: Means are taken over whole multiples of 1e-12, so that they do not depend on the order of summation.
SCALE = 10**12


def whole(c: Column) -> Column:
    return F.round(c * SCALE).cast("long")


def mean(c: Column) -> Column:
    return F.sum(whole(c)).cast("double") / F.count("*") / float(SCALE)


def attribute_metrics(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows: row_id, attr, y (0/1), score. Mean accuracy by label, and accuracy, precision, recall and F1 by row.

    F1 comes from the mean precision and recall.
    """
    x = rows.withColumn("p", (F.col("score") >= threshold).cast("int"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    y, p = F.col("y") == 1, F.col("p") == 1
    by_attr = x.groupBy("attr").agg((n(y & p) / (n(y) + EPS)).alias("tpr"), (n(~y & ~p) / (n(~y) + EPS)).alias("tnr"))
    label = by_attr.agg(mean((F.col("tpr") + F.col("tnr")) / 2).alias("ma"))
    by_row = x.groupBy("row_id").agg(
        (n(y & p) / (n(y | p) + EPS)).alias("acc"), (n(y & p) / (n(p) + EPS)).alias("prec"), (n(y & p) / (n(y) + EPS)).alias("rec")
    )
    inst = by_row.agg(mean(F.col("acc")).alias("acc"), mean(F.col("prec")).alias("prec"), mean(F.col("rec")).alias("rec"))
    return label.crossJoin(inst).withColumn("f1", 2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec") + EPS))


def topk_accuracy(rows: DataFrame, ks: Sequence[int]) -> DataFrame:
    """rows: row_id, class, logit, target. Share of rows whose target is among the k largest logits (ties by class)."""
    w = Window.partitionBy("row_id").orderBy(F.desc("logit"), "class")
    hit = rows.withColumn("rank", F.row_number().over(w)).where("class = target").select("row_id", "rank")
    total = rows.select("row_id").distinct().agg(F.count("*").alias("n"))
    at = hit.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in ks], "k int"))).groupBy("k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("hits"))
    return at.crossJoin(F.broadcast(total)).select("k", (F.col("hits") / F.col("n")).alias("acc"))


def _fold_grid(pairs: DataFrame, steps: int, width: float) -> DataFrame:
    """fold, k, threshold, tp, fp, p, neg at thresholds k * width: a pair is counted once, at the first step above its
    distance, and the counts are summed up along the steps."""
    spark = pairs.sparkSession
    at = F.greatest(F.floor(F.col("dist") / F.lit(width)), F.lit(0))
    below = lambda k: F.col("dist") < k * F.lit(width)
    first = F.when(below(at), at).when(below(at + 1), at + 1).otherwise(at + 2)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    by = pairs.groupBy("fold", F.least(first, F.lit(steps)).alias("k")).agg(n(F.col("same")).alias("s"), n(~F.col("same")).alias("d"))
    size = by.groupBy("fold").agg(F.sum("s").alias("p"), F.sum("d").alias("neg"))
    grid = size.crossJoin(F.broadcast(spark.range(steps).select(F.col("id").alias("k"))))
    w = Window.partitionBy("fold").orderBy("k")
    return grid.join(by, ["fold", "k"], "left").fillna(0, ["s", "d"]).select(
        "fold", "k", (F.col("k") * F.lit(width)).alias("threshold"), F.sum("s").over(w).alias("tp"), F.sum("d").over(w).alias("fp"), "p", "neg"
    )


def fold_verification(pairs: DataFrame, folds: int, steps: int, width: float) -> DataFrame:
    """pairs: pair_id, dist, same, fold. For each fold the first threshold with the best accuracy on the others, and its
    accuracy, TPR and FPR on the fold. Same means a distance below the threshold, strictly."""
    by = _fold_grid(pairs, steps, width)
    w = Window.partitionBy("k")
    by = by.withColumn("right", F.col("tp") + F.col("neg") - F.col("fp")).withColumn("size", F.col("p") + F.col("neg"))
    train = by.withColumn("train", (F.sum("right").over(w) - F.col("right")) / (F.sum("size").over(w) - F.col("size")))
    best = train.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("train"), "k"))).where("r = 1")
    return best.select("fold", "threshold", (F.col("right") / F.col("size")).alias("acc"), (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"))


def fold_val_far(pairs: DataFrame, steps: int, width: float, target: float) -> DataFrame:
    """fold, threshold, val, far: of each fold, the threshold at which the other folds' share of false accepts is the target,
    linear between the steps around it, and the shares of true and false accepts of the fold itself below it. Zero where the
    others never reach the target."""
    by = _fold_grid(pairs, steps, width)
    w = Window.partitionBy("k")
    rest = by.withColumn("rate", (F.sum("fp").over(w) - F.col("fp")) / (F.sum("neg").over(w) - F.col("neg")))
    along = Window.partitionBy("fold").orderBy("k")
    rest = rest.withColumn("before", F.lag("rate").over(along)).withColumn("at", F.lag("threshold").over(along))
    first = rest.where(F.col("rate") >= target).groupBy("fold").agg(F.min(F.struct("k", "threshold", "rate", "before", "at")).alias("f"))
    t = F.when(F.col("f.before").isNull(), F.col("f.threshold")).otherwise(F.col("f.at") + (F.lit(target) - F.col("f.before")) / (F.col("f.rate") - F.col("f.before")) * (F.col("f.threshold") - F.col("f.at")))
    thr = by.select("fold").distinct().join(first, "fold", "left").select("fold", F.round(F.coalesce(t, F.lit(0.0)), 9).alias("threshold"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    hit, same = F.col("dist") < F.col("threshold"), F.col("same")
    out = pairs.join(thr, "fold").groupBy("fold", "threshold").agg(n(hit & same).alias("tp"), n(hit & ~same).alias("fp"), n(same).alias("p"), n(~same).alias("neg"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("fold", "threshold", share("tp", "p").alias("val"), share("fp", "neg").alias("far"))


def hard_mining(dist: DataFrame) -> DataFrame:
    """dist: a, b, same, d, both directions and the anchor itself. Farthest positive and nearest negative by anchor."""
    return dist.groupBy("a").agg(F.max(F.when(F.col("same"), F.col("d"))).alias("hard_pos"), F.min(F.when(~F.col("same"), F.col("d"))).alias("hard_neg"))


def weighted_mining(dist: DataFrame) -> DataFrame:
    """Softmax-weighted distances: of positives by distance, of negatives by its opposite."""
    side = F.when(F.col("same"), F.col("d")).otherwise(-F.col("d"))
    top = dist.groupBy("a", "same").agg(F.max(side).alias("top"))
    e = dist.join(top, ["a", "same"]).withColumn("e", F.exp(side - F.col("top")))
    s = e.groupBy("a", "same").agg((F.sum(F.col("d") * F.col("e")) / F.sum("e")).alias("w"))
    return s.groupBy("a").agg(F.max(F.when(F.col("same"), F.col("w"))).alias("pos"), F.max(F.when(~F.col("same"), F.col("w"))).alias("neg"))


def triplet(mined: DataFrame, margin: float) -> Column:
    """The margin ranking loss of an anchor's positive and negative distance."""
    return F.greatest(F.lit(0.0), F.col("hard_pos") - F.col("hard_neg") + margin)


def soft_margin(mined: DataFrame) -> Column:
    """log(1 + exp(hard_pos - hard_neg)), in a form that cannot overflow."""
    x = F.col("hard_pos") - F.col("hard_neg")
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def cosface_logits(dist: DataFrame, margin: float, gamma: float) -> DataFrame:
    """As pair_logits, with -gamma * s for positives and gamma * (s + margin) for negatives."""
    return _logits(dist, F.when(F.col("same"), -gamma * F.col("s")).otherwise(gamma * (F.col("s") + margin)))


def pair_logits(dist: DataFrame, margin: float, gamma: float) -> DataFrame:
    """dist: a, b, same, s (similarity). log-sum-exp of positive and negative logits with a margin, by anchor, and the
    soft loss log(1 + exp(lse_p + lse_n))."""
    logit = F.when(F.col("same"), -gamma * (F.col("s") - (1 - margin)) * F.greatest(F.lit(0.0), 1 + margin - F.col("s"))).otherwise(
        gamma * (F.col("s") - margin) * F.greatest(F.lit(0.0), F.col("s") + margin)
    )
    return _logits(dist, logit)


def _logits(dist: DataFrame, logit: Column) -> DataFrame:
    x = dist.where("a <> b").withColumn("x", logit)
    top = x.groupBy("a", "same").agg(F.max("x").alias("top"))
    lse = x.join(top, ["a", "same"]).groupBy("a", "same").agg((F.first("top") + F.log(F.sum(F.exp(F.col("x") - F.col("top"))))).alias("lse"))
    both = lse.groupBy("a").agg(F.max(F.when(F.col("same"), F.col("lse"))).alias("lse_p"), F.max(F.when(~F.col("same"), F.col("lse"))).alias("lse_n"))
    return both.withColumn("loss", F.log1p(F.exp(F.col("lse_p") + F.col("lse_n"))))


def sharded_cross_entropy(logits: DataFrame) -> DataFrame:
    """logits: row_id, class, logit, target, shard. Maximum and sum of exponents over shards, then -log of the target's
    share, which counts as 1e-30 at least. A row's maximum comes from a window: joined back, it would be taken for small
    enough to broadcast, one for each row."""
    rows = logits.select("row_id", "logit", (F.col("class") == F.col("target")).alias("hit"))
    e = rows.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(Window.partitionBy("row_id"))))
    per = e.groupBy("row_id").agg(F.sum("e").alias("total"), F.max(F.when(F.col("hit"), F.col("e"))).alias("t"))
    return per.select("row_id", (-F.log(F.greatest(F.col("t") / F.col("total"), F.lit(1e-30)))).alias("loss"))
