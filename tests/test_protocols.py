"""Further protocols and layouts against plain Python, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.functions import binning as B
from matchgrid.operators import evaluators as E
from matchgrid.operators import layouts as L
from matchgrid.operators import reports
from matchgrid.operators import resample
from matchgrid.operators import retrieval as R
from matchgrid.sources import nested
from matchgrid.streaming import metrics as M


def test_reconstruction_equals_the_formula_and_refuses_missing_patches(spark):
    rng = np.random.default_rng(3)
    q, g, w = rng.normal(size=(2, 3, 8)), rng.normal(size=(4, 5, 8)), rng.random((2, 3))
    queries = spark.createDataFrame([(i, q[i].tolist(), w[i].tolist()) for i in range(2)], "qid long, patches array<array<double>>, weights array<double>")
    gallery = spark.createDataFrame([(i, g[i].tolist()) for i in range(4)], "gid long, patches array<array<double>>")
    near = queries.select("qid").crossJoin(gallery.select("gid"))
    got = {(r.qid, r.gid): r.patch_dist for r in R.reconstruction(near, queries, gallery).collect()}
    for i in range(2):
        for j in range(4):
            a, b = q[i].T, g[j].T
            rest = b @ np.linalg.inv(b.T @ b + R.RIDGE * np.eye(5)) @ b.T @ a - a
            assert got[i, j] == pytest.approx((np.sqrt((rest**2).sum(0)) * w[i]).sum(), rel=1e-9)
    assert R.reconstruction(near.where("qid < 0"), queries, gallery).count() == 0
    with pytest.raises(Exception, match="no patches"):
        R.reconstruction(near, queries, gallery.withColumn("patches", F.lit(None).cast("array<array<double>>"))).count()


def test_sweep_takes_the_first_best_blend(spark):
    rows = [(1, 1, 0.1, 9.0, False), (1, 2, 0.2, 0.0, True), (2, 1, 0.5, 0.0, True), (3, 1, 0.5, 0.1, False)]
    got = {r.step: r for r in R.sweep(spark.createDataFrame(rows, "qid long, gid long, dist double, patch_dist double, match boolean"), 101).collect()}
    assert len(got) == 101 and got[0].rank1 == 50.0 and got[100].rank1 == 100.0
    assert [k for k, r in got.items() if r.chosen] == [min(k for k, r in got.items() if r.rank1 == 100.0)] == [2]
    assert all(r.rank1 is None for r in R.sweep(spark.createDataFrame([], "qid long, gid long, dist double, patch_dist double, match boolean"), 3).collect())


def test_rerank_given_equals_arrays(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    x[7] = x[6]
    raw = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    d = raw**2 / (raw**2).max(axis=1, keepdims=True)
    order = np.lexsort((np.broadcast_to(np.arange(30), d.shape), d), axis=1)
    k1, k2 = 6, 3
    mutual = lambda i, k: {j for j in order[i, :k] if i in order[j, :k]}
    v = np.zeros_like(d)
    for i in range(30):
        mine = mutual(i, k1 + 1)
        grown = set(mine)
        for j in mine:
            his = mutual(j, k1 // 2 + 1)
            if 3 * len(his & mine) > 2 * len(his):
                grown |= his
        at = sorted(grown)
        v[i, at] = np.exp(-d[i, at]) / np.exp(-d[i, at]).sum()
    v = np.array([v[order[i, :k2]].mean(0) for i in range(30)])
    low = np.minimum(v[:, None], v[None]).sum(-1)
    want = (1 - low / (2 - low)) * 0.7 + d * 0.3
    rows = spark.createDataFrame([(i, j, float(raw[i, j])) for i in range(30) for j in range(30)], "qid long, gid long, dist double")
    got = R.rerank_given(rows, spark.range(5).toDF("qid"), k1, k2, 0.3).collect()
    assert len(got) == 150
    for r in got:
        assert r.dist == pytest.approx(want[r.qid, r.gid], abs=1e-9)


def test_self_recall_does_not_find_itself(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 2, [0.0, 1.0]), (4, 3, [0.0, 1.0])]
    got = R.self_recall(spark.createDataFrame(rows, "crop_id long, object_id long, embedding array<double>"), (1, 2)).collect()
    assert {r.k: r.recall for r in got} == {1: 50.0, 2: 50.0}


def test_folds_count_as_a_scan_of_thresholds(spark):
    rng = np.random.default_rng(1)
    d, same, fold = np.round(rng.random(200) * 4, 2), rng.random(200) < 0.4, np.arange(200) // 50
    rows = spark.createDataFrame([(i, float(d[i]), bool(same[i]), int(fold[i])) for i in range(200)], "pair_id long, dist double, same boolean, fold long")
    grid = np.arange(400) * 0.01
    for r in E.fold_verification(rows, 4, 400, 0.01).collect():
        train = fold != r.fold
        acc = [((d[train] < t) == same[train]).mean() for t in grid]
        assert r.threshold == pytest.approx(grid[int(np.argmax(acc))])
        assert r.acc == pytest.approx(((d[~train] < r.threshold) == same[~train]).mean())
    for r in E.fold_val_far(rows, 400, 0.01, 0.1).collect():
        train = (fold != r.fold) & ~same
        rate = np.array([(d[train] < t).mean() for t in grid])
        k = int(np.argmax(rate >= 0.1))
        assert r.threshold == pytest.approx(grid[k - 1] + (0.1 - rate[k - 1]) / (rate[k] - rate[k - 1]) * 0.01)
        test = fold == r.fold
        assert r.val == pytest.approx((d[test & same] < r.threshold).mean()) and r.far == pytest.approx((d[test & ~same] < r.threshold).mean())


def test_curves_are_resampled_as_by_interpolation(spark):
    rng = np.random.default_rng(2)
    far = np.sort(np.r_[0.0, np.round(rng.random(40), 2), 1.0])
    tar = np.sort(np.r_[0.0, rng.random(40), 1.0])
    rows = spark.createDataFrame([("s", k, float(f), float(t)) for k, (f, t) in enumerate(zip(far, tar))], "site string, edge int, far double, tar double")
    grid = reports.log_grid(-4, 50)
    got = {r.step: r.tar for r in reports.resampled_curves(rows, ["site"], grid).collect()}
    assert [got[k] for k in range(50)] == pytest.approx(list(np.interp(grid, far, tar)))


def test_units_alone_or_small_are_skipped_with_a_reason(spark):
    own = spark.createDataFrame([(1, 10, 5), (2, 20, 5), (3, 30, 5)], "unit long, bin int, n long")
    units = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "unit long, site_id long")
    objects = spark.createDataFrame([(1, 5), (2, 3), (3, 5), (4, 5)], "unit long, objects long")
    held = spark.createDataFrame([(1, 0, 10, 2), (1, 1, 12, 3)], "unit long, fold long, bin int, n long")
    got = {(r["mode"], r.unit, r.fold): r for r in reports.calibration_report(reports.calibrations(own, units, held), units, objects, 0.5).collect()}
    assert len(got) == 24
    assert got["site", 1, -1].status == "used" and got["site", 1, -1].n_negatives == 5
    assert got["site", 3, -1].status == "skipped: only unit of its site" and got["site", 3, -1].threshold is None
    assert got["video", 2, 0].status == "skipped: fewer than 4 objects" and got["video", 3, 1].status == "skipped: no negative pairs"
    assert (got["video", 1, 0].n_negatives, got["video", 1, 1].n_negatives) == (3, 2)
    assert got["video-oracle", 4, -1].status == "skipped: no negative pairs" and got["global-oracle", 4, -1].n_negatives == 15


def test_few_units_have_no_interval(spark):
    p = spark.createDataFrame([(u, k % 2 == 0, k // 2, 0.5, 1, 0) for u in range(3) for k in range(40)], "unit long, same boolean, object_id_a long, s double, w long, pos_bin int")
    rows = reports.axis_tables(p, ("pos_bin",), F.col("s") >= 0.4, p.select("unit"), 10).collect()
    assert {(r.axis, r.bin, r.n_pos, r.objects, r.tar, r.lo, r.units) for r in rows} == {("all", 0, 60, 60, 1.0, None, 0), ("pos_bin", 0, 60, 60, 1.0, None, 0)}
    assert resample.MIN_UNITS == 5 and reports.axis_tables(p.limit(0), ("pos_bin",), F.col("s") >= 0.4, p.select("unit").limit(0), 10).count() == 0


def test_layouts(spark):
    paths = spark.createDataFrame([("a/cam2/7_x.jpg",), ("b.jpg",), (None,)], "path string")
    got = [tuple(r) for r in L.split_path(paths, (-1, "_", 0), (-2, "_", 0), prefix="p").collect()]
    assert got == [("a/cam2/7_x.jpg", "p7", "cam2"), ("b.jpg", "pb", None), (None, None, None)]
    docs = spark.createDataFrame([('[{"train": [["a.png", "1", "0"]], "query": [], "gallery": null}, {"query": [["b.png", "2", "1"], ["c.png", "2", "0"]]}]',), (None,)], "document string")
    assert sorted(tuple(r) for r in L.split_lists(docs).collect()) == [(0, "train", 0, "a.png", 1, 0), (1, "query", 0, "b.png", 2, 1), (1, "query", 1, "c.png", 2, 0)]
    with pytest.raises(Exception):
        L.split_lists(spark.createDataFrame([("[{",)], "document string")).collect()
    names = spark.createDataFrame([(1, "a b"), (2, "a/b"), (3, "c")], "k long, name string")
    assert [r.slug for r in L.slugs(names, "name", "k").orderBy("k").collect()] == ["a_b", "a_b_2", "c"]
    with pytest.raises(ValueError):
        L.interleave(spark.range(3).toDF("pos"), "pos", 10, 4)
    with pytest.raises(ValueError):
        L.flatten(spark.sql("select named_struct('b', 1) as a, 2 as `a/b`"))
    rows = spark.createDataFrame([("u", "x", 1), ("u", "y", 2), ("u", "x", 3)], "unit string, label string, at long")
    assert sorted((r.label, r.object_index, r.grouped) for r in L.object_index(rows, "unit", "label", "at").collect()) == [("x", 0, False), ("x", 0, False), ("y", 1, True)]


def test_camera_draws_differ_and_keep_to_their_camera(spark):
    items = spark.createDataFrame([(p, p % 2) for p in range(40) for _ in range(1 + p % 5)], "pid long, camid long")
    w = L.camera_weights(items)
    assert {round(r.t, 9) for r in w.groupBy("camid").agg(F.sum("weight").alias("t")).collect()} == {1.0}
    draws = [sorted((r.camid, r.pid) for r in L.camera_draw(w, 4, seed).collect()) for seed in (1, 2)]
    assert draws[0] != draws[1] and all(len(set(d)) == 8 and all(p % 2 == c for c, p in d) for d in draws)
    assert L.camera_draw(w.limit(0), 4, 1).count() == 0


def test_a_damaged_document_is_an_error(spark):
    with pytest.raises(Exception):
        nested.parse_documents(spark.createDataFrame([("{", "f")], "document string, folder string")).collect()


def test_eta_and_bin_sums(spark):
    e = spark.createDataFrame([("t", k, float(k)) for k in range(4)], "name string, iteration long, value double")
    assert [r.eta for r in M.eta(e, spark.sql("select 6 as total"), 2).orderBy("iteration").collect()] == [0.0, 2.0, 4.5, 5.0]
    assert sorted((r.bin, r.n, r.sum, r.sum_squares) for r in M.histogram_sums(e, 2).collect()) == [(0, 2, 1.0, 1.0), (1, 2, 5.0, 13.0)]
    assert M.histogram_sums(e.limit(0), 2).count() == 0


def test_soft_margin_does_not_overflow(spark):
    m = spark.createDataFrame([(1000.0, 0.0), (0.0, 1000.0), (1.0, 1.0)], "hard_pos double, hard_neg double")
    assert [r[0] for r in m.select(E.soft_margin(m)).collect()] == pytest.approx([1000.0, 0.0, np.log(2)])
    assert B.MIN_OBJECTS == 10
