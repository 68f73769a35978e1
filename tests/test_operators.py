import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.functions import binning as B
from matchgrid.operators import curves, pairs, resample, retrieval, sampling
from matchgrid.sources import listings, nested
from matchgrid.streaming import metrics as M


def objects(spark, units=3, per=4, size=5, noise=0.0, seed=0):
    """Crops whose vectors are their object's axis, with noise."""
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for u in range(units):
        for o in range(per):
            for _ in range(size):
                v = np.eye(per)[o] + noise * rng.normal(size=per)
                rows.append((k, u, u % 2, o, k % 3, [float(x) for x in v]))
                k += 1
    return spark.createDataFrame(rows, "crop_id long, video_id long, site_id long, object_id long, camid long, embedding array<float>")


def test_perfect_vectors_separate(spark):
    c = objects(spark)
    p = pairs.with_objects(pairs.similarities(c), c)
    h = pairs.histogram(p, B.FINE)
    assert curves.auc(h).first().auc == 1.0
    assert curves.eer(h, B.FINE).first().eer == 0.0
    assert curves.best_tar(h, B.FINE, 0.01).first().best_tar == 1.0
    assert p.count() == 3 * 20 * 19 // 2


def test_blocks_do_not_change_pairs(spark, monkeypatch):
    c = objects(spark, noise=0.4)
    whole = {tuple(r) for r in pairs.similarities(c).collect()}
    q, g = c.where("crop_id % 5 = 0"), c.where("crop_id % 5 <> 0")
    near = {tuple(r) for r in retrieval.distances(q, g, nearest=4).collect()}
    monkeypatch.setattr(pairs, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "BLOCK", 6)
    assert {tuple(r) for r in pairs.similarities(c).collect()} == whole
    assert {tuple(r) for r in retrieval.distances(q, g, nearest=4).collect()} == near


def test_pairs_against_brute_force(spark):
    c = objects(spark, noise=0.3, seed=4)
    rows = c.collect()
    want = {}
    for a in rows:
        for b in rows:
            if a.video_id == b.video_id and a.crop_id < b.crop_id:
                x, y = np.array(a.embedding), np.array(b.embedding)
                want[a.video_id, a.crop_id, b.crop_id] = float(x @ y / np.sqrt((x @ x) * (y @ y)))
    assert {(r.unit, r.a, r.b): r.s for r in pairs.similarities(c).collect()} == pytest.approx(want, abs=1e-9)


def test_curves_against_arrays(spark):
    rng = np.random.default_rng(3)
    p, n = rng.integers(0, 5, 40), rng.integers(0, 9, 40)
    rows = [(True, k, int(x)) for k, x in enumerate(p) if x] + [(False, k, int(x)) for k, x in enumerate(n) if x]
    h = spark.createDataFrame(rows, "same boolean, bin int, n long")
    below = np.cumsum(n) - n
    assert curves.auc(h).first().auc == pytest.approx((p * (below + n / 2)).sum() / (p.sum() * n.sum()))
    tail = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])
    for t in (0.0, 0.03, 0.5, 1.0):
        k = int(np.argmax(tail <= t * n.sum()))
        want = -1.0 if k == 0 else -1 + k * 0.05 - ((t * n.sum() - tail[k]) / n[k - 1] if n[k - 1] else 0) * 0.05
        assert curves.far_thresholds(h, 40, (t,)).first().threshold == pytest.approx(want)
    assert curves.far_thresholds(h.where("same"), 40, (0.1,)).count() == 0
    assert curves.auc(h.where("same")).first().auc is None


def test_bins(spark):
    xs = [None, -1.0, 0.0, 0.999, 1.0, 39.9, 40.0, 1e9]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(B.bucket(F.col("x"), B.POSITION_M).alias("b"))
    assert [r.b for r in df.collect()] == [7, 0, 0, 0, 1, 5, 6, 6]
    s = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "s double").select(B.similarity_bin(F.col("s"), 200).alias("b"))
    assert [r.b for r in s.collect()] == [0, 100, 199]
    assert B.labels(B.KEYPOINT_IOU)[-2:] == ["[0.75,1]", "unknown"]
    with pytest.raises(ValueError):
        B.check_edges((0, 1, 1))


def test_average_precision_by_hand(spark):
    c = spark.createDataFrame([(0, 1, 1), (10, 1, 1), (11, 2, 1), (12, 1, 2), (13, 1, 3)], "crop_id long, object_id long, camid long")
    d = spark.createDataFrame([(0, 10, 0.1), (0, 11, 0.2), (0, 12, 0.3), (0, 13, 0.9)], "qid long, gid long, dist double")
    q = retrieval.per_query(retrieval.labelled(d, c))
    r = q.first()
    assert (r.n_match, r.first) == (2, 2) and r.ap == pytest.approx((1 / 2 + 2 / 3) / 2) and r.inp == pytest.approx(2 / 3)
    curve = [x.cmc for x in retrieval.cmc(q, 3).orderBy("rank").collect()]
    assert curve == [0.0, 1.0, 1.0]


def document(k, **over):
    crop = lambda i, **o: {"crop_file": f"\\tracks\\{i}.jpg", "frame": i, "timestamp_s": i / 2, "position_road_m": [1.0, 2.0], "position_reliable": i % 2 == 0, "distance_m": 3.0, "overlap_by_closer_box": 0.3 + i / 10, "keypoints": {"points": [[0, 0, 0.4], [0, 0, 0.5]]}, **o}
    d = {"video_id": f"v{k}", "site": "s", "n_crops": 3, "tracks": [{"track_id": 1, "label": "car", "crops": [crop(0), crop(1)]}, {"track_id": 2, "tracklet_id": "t", "identity_id": "i", "label": "bus", "crops": [crop(2, occluded_annot=True, keypoints=None)]}], "rejected_crops": [{"crop_file": "x"}]}
    return {**d, **over}


def written(tmp_path, docs):
    for folder, d in docs:
        (tmp_path / "videos" / folder).mkdir(parents=True)
        (tmp_path / "videos" / folder / "meta.json").write_text(json.dumps(d))
    return f"file://{tmp_path}/videos/*/meta.json"


def test_nested_documents(spark, tmp_path):
    rows = {r.crop_uid: r for r in nested.load(spark, written(tmp_path, [("v1", document(1)), ("v2", document(2))])).collect()}
    assert len(rows) == 6
    a, b, c = (rows[f"v1/tracks/{k}.jpg"] for k in range(3))
    assert (a.tracklet_id, a.identity_id, a.pos_x, a.occluded, a.occlusion_source, a.keypoints) == ("v1_1", "v1_1", 1.0, False, "none", [False, True])
    assert (b.pos_x, b.distance_m, b.occluded, b.occlusion_source) == (None, None, True, "overlap")
    assert (c.tracklet_id, c.identity_id, c.occlusion_source, c.keypoints) == ("t", "i", "annotated", None)
    assert nested.load(spark, f"file://{tmp_path}/videos/*/meta.json", labels=["bus"]).count() == 2


@pytest.mark.parametrize("bad", ["folder", "count", "twice"])
def test_damaged_documents_are_errors(spark, tmp_path, bad):
    d = document(1)
    if bad == "count":
        d["n_crops"] = 9
    if bad == "twice":
        d["tracks"].append(d["tracks"][0])
        d["n_crops"] = 5
    with pytest.raises(ValueError, match="damaged"):
        nested.load(spark, written(tmp_path, [("other" if bad == "folder" else "v1", d)]))


def test_listings(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a/1.jpg 7\nb/2.jpg 9\n\n")
    assert [tuple(r) for r in listings.from_list(spark, f"file://{tmp_path}/list.txt").collect()] == [("a/1.jpg", "7"), ("b/2.jpg", "9")]
    p = spark.createDataFrame([("x/0002_c1s1_01.jpg",), ("x/-1_c2s1_02.jpg",), ("x/readme",)], "path string")
    assert [tuple(r) for r in listings.from_names(p, "pid_cam", "train", "d_").collect()] == [("train", "x/0002_c1s1_01.jpg", "d_2", "d_0")]
    assert [r.label for r in listings.from_folders(p).collect()] == ["x"] * 3


def stream(spark, tmp_path, rows, schema, batches=3):
    for k in range(batches):
        part = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(f"{tmp_path}/in")


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streamed_history_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), k, rng.randrange(1000) / 8) for k in range(60)]
    schema = "name string, iteration long, value double"
    got = run(M.history_stream(stream(spark, tmp_path, rows, schema), 5), "history")
    want = M.history(spark.createDataFrame(rows, schema), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_throttle(spark, tmp_path):
    rows = [("a", k, t) for k, t in enumerate([0.0, 1.0, 5.0, 5.5, 9.9, 10.0])] + [("b", 9, 1.0)]
    got = run(M.throttle_stream(stream(spark, tmp_path, rows, "name string, iteration long, seconds double", 1), 5.0), "throttle")
    assert sorted((r.name, r.seconds) for r in got.collect()) == [("a", 0.0), ("a", 5.0), ("a", 10.0), ("b", 1.0)]


def test_sink_takes_only_newer(spark, tmp_path):
    ev = spark.createDataFrame([("a", k, float(k)) for k in range(5)], "name string, iteration long, value double")
    path = f"file://{tmp_path}/log"
    M.append_newer(ev.where("iteration < 3"), path)
    M.append_newer(ev, path)
    assert sorted(r.iteration for r in spark.read.json(path).collect()) == [0, 1, 2, 3, 4]


def test_interval_and_draws(spark):
    draws = resample.multinomial(spark, [3, 4, 5], 50, 0)
    assert draws.groupBy("b").agg(F.sum("n").alias("n")).where("n <> 3").count() == 0
    v = spark.createDataFrame([(k, float(k)) for k in range(101)], "b long, value double")
    r = resample.interval(v, "value", 0.9).first()
    assert (r.lo, r.hi) == pytest.approx((5.0, 95.0))


def test_numbering_is_total(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    got = {r.k: r.pos for r in sampling.numbered(df, F.col("k")).collect()}
    assert got == {k: n for n, k in enumerate(sorted(got))}


def test_wrong_vectors_are_errors(spark):
    schema = "crop_id long, video_id long, object_id long, embedding array<double>"
    good = [(1, 0, 0, [1.0, 0.0]), (2, 0, 0, [1.0, 0.0]), (3, 0, 1, [0.0, 1.0])]
    for bad in ((4, 0, 1, None), (4, 0, 1, [1.0, None]), (4, 0, 1, [1.0]), (4, 0, 1, [1.0, float("nan")]), (4, 0, 1, [float("inf"), 0.0]), (None, 0, 1, [1.0, 0.0]), (4, None, 1, [1.0, 0.0])):
        df = spark.createDataFrame([*good, bad], schema)
        for run in (lambda: pairs.similarities(df).collect(), lambda: pairs.counts(df, 200).collect()):
            with pytest.raises(Exception, match="have no|null or not finite|components"):
                run()
        if bad[1] is not None:
            with pytest.raises(Exception, match="have no|null or not finite|components"):
                retrieval.distances(df, df, nearest=2).collect()
    with pytest.raises(Exception, match="have no object_id"):
        pairs.counts(spark.createDataFrame([*good, (4, 0, None, [1.0, 0.0])], schema), 200).collect()
    none = spark.createDataFrame([], schema)
    assert pairs.similarities(none).count() == pairs.counts(none, 200).count() == retrieval.distances(none, none).count() == 0
    zero = spark.createDataFrame([*good, (4, 0, 1, [0.0, 0.0])], schema)
    assert {(r.a, r.b): r.s for r in pairs.similarities(zero).collect()} == {(1, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0, (1, 4): 0.0, (2, 4): 0.0, (3, 4): 0.0}


def test_counts_in_tasks_equal_counts_of_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    c = objects(spark, noise=0.4)
    p = pairs.similarities(c, carry=["object_id", "camid"])
    assert {(r.a, r.object_id_a, r.camid_a) for r in p.collect()} <= {(r.crop_id, r.object_id, r.camid) for r in c.collect()}
    rows = pairs.histogram(p.withColumn("same", F.expr("object_id_a = object_id_b")), 200, "unit")
    assert {tuple(r) for r in pairs.counts(c, 200).collect()} == {tuple(r) for r in rows.collect()}


def test_roc_of_different_identities(spark):
    """Scores are distances, the positive class is the pair of different identities; points inside straight runs are dropped."""
    rng = np.random.default_rng(11)
    rows = [(float(d), bool(m)) for d, m in zip(rng.integers(0, 40, 300) / 10, rng.random(300) < 0.3)]
    rows += [(5.0 + k, False) for k in range(5)]
    curve = retrieval.roc(spark.createDataFrame(rows, "dist double, match boolean").repartition(5))
    falling = sorted({d for d, _ in rows}, reverse=True)
    diff, same = sum(not m for _, m in rows), sum(m for _, m in rows)
    points = [(sum(not m for d, m in rows if d >= t), sum(m for d, m in rows if d >= t)) for t in falling]
    bent = [k for k in range(len(points)) if k in (0, len(points) - 1) or any(points[k + 1][j] - 2 * points[k][j] + points[k - 1][j] for j in (0, 1))]
    want = [(None, 0.0, 0.0)] + [(falling[k], points[k][0] / diff, points[k][1] / same) for k in bent]
    assert [tuple(r) for r in curve.orderBy(F.desc_nulls_first("dist")).collect()] == want
    fprs = np.array([x[2] for x in want])
    got = {r.target: r.tpr for r in retrieval.tpr_at(curve, (0.0, 0.01, 0.3)).collect()}
    assert got == {t: want[int(np.argmin(np.abs(fprs - t)))][1] for t in (0.0, 0.01, 0.3)}
    assert retrieval.roc(spark.createDataFrame([], "dist double, match boolean")).count() == 0


def test_resampling_without_units(spark):
    none = spark.createDataFrame([], "unit long, tp long, n_pos long")
    boot = resample.hashed(none, 20)
    assert boot.count() == 0 and resample.pooled(none, boot, "tp", "n_pos").count() == 0
    few = spark.createDataFrame([(u, 1 + u, 9) for u in range(4)], "unit long, tp long, n_pos long")
    i = resample.interval(resample.pooled(few, resample.hashed(few, 20), "tp", "n_pos"), "value", units=few).first()
    assert (i.lo, i.hi) == (None, None)


def test_contiguous_folds(spark):
    got = sampling.contiguous_folds(spark.range(23).repartition(4), [F.col("id")], 10).orderBy("id").collect()
    assert [r.fold for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, *(k for k in range(3, 10) for _ in range(2))]
