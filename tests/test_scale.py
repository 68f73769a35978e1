"""What only shows on larger tables: positions over drawn range bounds, rounding at ties, tasks that hold no pair rows."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from matchgrid.functions.vectors import decimals
from matchgrid.operators import batches, pairs, retrieval, sampling


def test_positions_hold_where_range_bounds_are_drawn_again(spark):
    rows = spark.range(0, 100_000, 1, 8).select(((F.col("id") * 7919) % 100_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    n = rows.count()
    got = sampling.numbered(rows, F.col("k")).agg(F.countDistinct("pos").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.max("text")).first()
    assert (got.n, got.a, got.b) == (n, 0, n - 1)
    sums = sampling.running(rows.withColumn("one", F.lit(1)), [F.col("k")], ["one"]).agg(F.countDistinct("pos").alias("n"), F.max("cum_one").alias("b"), F.max("text")).first()
    assert (sums.n, sums.b) == (n, n)


def test_released_holds_where_range_bounds_are_drawn_again(spark):
    rows = spark.range(0, 100_000, 1, 8).select(((F.col("id") * 7919) % 100_003).alias("seq"), F.col("id").alias("arrived"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    got = batches.released(rows, "seq", "arrived").toPandas().sort_values("seq")
    assert (got["released"].to_numpy() == np.maximum.accumulate(got["arrived"].to_numpy())).all()


def test_distances_are_sql_bit_for_bit(spark):
    x = np.random.default_rng(3).normal(size=(800, 16)).astype(np.float32) * 30
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "crop_id long, embedding array<float>")
    frame = rows.toPandas()  # noqa: F841, read by DuckDB
    want = duckdb.sql("SELECT a.crop_id, b.crop_id, round(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e), 9) FROM (SELECT crop_id, embedding::DOUBLE[] AS e FROM frame) a, (SELECT crop_id, embedding::DOUBLE[] AS e FROM frame) b ORDER BY ALL").fetchnumpy()
    got = retrieval.distances(rows, rows, metric="euclidean").toPandas().sort_values(["qid", "gid"])["dist"].to_numpy()
    assert (got == list(want.values())[2]).all()


def test_vectors_without_length_are_like_none():
    x, y = np.array([[2.0**-10, 0.0]]), np.array([[3.0, 0.0]])
    assert pairs.products(x, y, "similarity")[0, 0] == 1.0 and pairs.products(x * 0, y, "cosine")[0, 0] == 1.0


def test_decimals_are_sqls(spark):
    con = duckdb.connect()
    want = [r[0] for r in con.execute("SELECT round(0.7::DOUBLE + (k * 500)::DOUBLE / 1e9::DOUBLE * 0.3::DOUBLE, 7) FROM range(100000) t(k) ORDER BY k").fetchall()]
    x = F.lit(0.7) + (F.col("id") * 500).cast("double") / F.lit(1e9) * F.lit(0.3)
    assert [r[0] for r in spark.range(100_000).orderBy("id").select(decimals(x, 7)).collect()] == want


def small(spark, n=60):
    """Crops in two units and sites, with five objects, one row without an object."""
    rng = np.random.default_rng(5)
    rows = [(k, k % 4, k % 2, None if k == 7 else k % 5, k % 3, rng.normal(size=4).astype(np.float32).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "crop_id long, video_id long, site_id long, object_id long, camid long, embedding array<float>")


def forbid(monkeypatch, module, name):
    def stop(*args, **more):
        raise AssertionError(f"{name} makes a row for a pair")

    monkeypatch.setattr(module, name, stop)


def test_query_profiles_make_no_pair_rows(spark, monkeypatch):
    c = small(spark)
    q, g = c.where("crop_id % 5 < 2"), c.where("crop_id % 5 >= 1")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(retrieval.per_query(retrieval.labelled(retrieval.distances(q, g), c)).select("qid", "n_match", "first", "ap", "inp"))
    monkeypatch.setattr(retrieval, "CELLS", 100)
    assert len(want) > 5 and rows(retrieval.query_profiles(q, g, c).select("qid", "n_match", "first", "ap", "inp")) == want
    with monkeypatch.context() as m:
        m.setattr(retrieval, "PANEL", 16)
        assert rows(retrieval.query_profiles(q, g, c).select("qid", "n_match", "first", "ap", "inp")) == want
    forbid(monkeypatch, retrieval, "distances")
    assert retrieval.query_profiles(q, g, c).count() == len(want)


def test_counts_at_thresholds_make_no_pair_rows(spark, monkeypatch):
    c = small(spark).where("object_id is not null")
    p = pairs.with_objects(pairs.similarities(c), c)
    want = {(r.unit, t): (r.tp, r.p, r.fp, r.n) for t in (0.0, 0.5) for r in p.groupBy("unit").agg(
        F.sum((F.col("same") & (F.col("s") >= t)).cast("int")).alias("tp"), F.sum(F.col("same").cast("int")).alias("p"), F.sum((~F.col("same") & (F.col("s") >= t)).cast("int")).alias("fp"), F.sum((~F.col("same")).cast("int")).alias("n")).collect()}
    monkeypatch.setattr(pairs, "BLOCK", 4)
    forbid(monkeypatch, pairs, "similarities")
    got = pairs.counts_at(c, {u: [(0.1, 0.0), (0.2, 0.5)] for u in range(4)}).collect()
    assert {(r.unit, r.threshold): (r.tp, r.n_pos, r.fp, r.n_neg) for r in got} == want


def test_queries_of_thresholds_and_medoids_make_no_pair_rows(spark, sf, monkeypatch):
    from matchgrid.plans import registry

    forbid(monkeypatch, pairs, "similarities")
    for name in ("thr_site_oracle", "site_gallery_oracle", "object_medoid", "top_pos_neg", "match_index"):
        assert registry.queries()[name](spark, sf).count() > 0


def test_softmax_broadcasts_no_maxima(spark, capsys):
    from matchgrid.operators import evaluators

    spark.range(1000).selectExpr("id AS row_id", "id % 10 AS class", "id / 7.0D AS logit", "3L AS target").write.mode("overwrite").parquet(path := sampling_path(spark))
    evaluators.sharded_cross_entropy(spark.read.parquet(path)).explain()
    assert "Join" not in capsys.readouterr().out


def sampling_path(spark):
    from matchgrid.functions.shared import scratch

    return scratch(spark, "softmax")


def test_tpr_at_makes_rows_of_few_pairs(spark, monkeypatch):
    c = small(spark, 120).where("object_id is not null")
    q, g = c.where("crop_id % 5 < 2"), c.where("crop_id % 5 >= 1")
    targets = (1e-4, 0.01, 0.1, 0.37, 0.999)
    want = {r.target: r.tpr for r in retrieval.tpr_at(retrieval.roc(retrieval.labelled(retrieval.distances(q, g), c)), targets).collect()}
    forbid(monkeypatch, retrieval, "distances")
    assert {r.target: r.tpr for r in retrieval.tpr_at_exact(q, g, c, targets).collect()} == want


def test_sweep_candidates_decide_every_blend(spark, monkeypatch):
    c = small(spark, 120)
    q, g = c.where("crop_id % 5 < 2"), c.where("crop_id % 5 >= 1")
    patch = retrieval.distances(q, g, nearest=4).select("qid", "gid", (F.col("gid") % 7 * 0.3).alias("patch_dist"))
    sweep = lambda pairs: sorted(tuple(r) for r in retrieval.sweep(pairs.join(patch, ["qid", "gid"], "left").withColumn("patch_dist", F.coalesce("patch_dist", F.lit(retrieval.UNSEEN)))).collect())
    want = sweep(retrieval.labelled(retrieval.distances(q, g), c))
    forbid(monkeypatch, retrieval, "distances")
    few = retrieval.sweep_candidates(q, g, 4)
    assert sweep(few) == want and few.count() < 10 * q.count()


def test_dense_cells_make_no_pair_rows(spark, sf, monkeypatch):
    from matchgrid.plans import base, registry
    from matchgrid.plans.pair_queries import cube_hist

    rows = lambda df: sorted(tuple(r) for r in df.select("unit", "same", "cell", "n").collect())
    want = rows(cube_hist(spark, sf).groupBy("unit", "same", "cell").agg(F.sum("n").alias("n")))
    forbid(monkeypatch, pairs, "similarities")
    monkeypatch.setattr(pairs, "CELL_ROWS", 7)
    monkeypatch.setattr(pairs, "BLOCK", 16)
    assert len(want) > 50 and rows(pairs.cell_counts(base.crops(spark, sf))) == want
    got = rows(registry.queries()["dense_cells"](spark, sf))
    assert [r for r in got if r[3]] == want and len(got) == 840 * len({r[:2] for r in want})


def test_heads_of_digests():
    import hashlib

    ids = np.array([0, 7, -3, 10, 99999, 123456789, 2**62, 5, -(2**63)])
    heads = retrieval.Heads(ids)
    for prefix in ("0|1|2|", "0|123456|9|", "", "0|-9223372036854775808|10|"):
        assert heads(prefix.encode()).tolist() == [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in ids.tolist()]


def test_single_shots_make_no_pair_rows(spark, monkeypatch):
    c = small(spark, 120)
    q, g = c.where("crop_id % 5 < 2"), c.where("crop_id % 5 >= 1")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(retrieval.single_shot(retrieval.labelled(retrieval.distances(q, g), c), 4).select("qid", "repeat", "first"))
    with monkeypatch.context() as m:
        m.setattr(retrieval, "PANEL", 16)
        assert rows(retrieval.single_shot_ranks(q, g, c, 4).select("qid", "repeat", "first")) == want
    forbid(monkeypatch, retrieval, "distances")
    monkeypatch.setattr(retrieval, "CELLS", 100)
    assert len(want) > 50 and rows(retrieval.single_shot_ranks(q, g, c, 4)) == want


def test_reranking_makes_rows_of_queries_and_gallery_only(spark, monkeypatch):
    c = small(spark)
    q, g = c.where("crop_id % 5 < 2"), c.where("crop_id % 5 >= 1")
    rows = lambda df: {(r.qid, r.gid): round(r.dist, 9) for r in df.collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    with monkeypatch.context() as m:
        m.setattr(retrieval, "PANEL", 16)
        want = rows(retrieval.rerank_cosine(c, q, g, 6, 3))
    forbid(monkeypatch, retrieval, "distances")
    got = rows(retrieval.rerank_cosine(c, q, g, 6, 3))
    assert len(got) == q.count() * g.count() and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_ranked_reranking_makes_rows_of_its_result_only(spark, monkeypatch):
    c = small(spark, 120).withColumn("embedding", F.when(F.col("crop_id") % 9 == 0, F.array(*(F.lit(float(k)).cast("float") for k in range(4)))).otherwise(F.col("embedding")))  # copies
    q, g = c.where("crop_id % 5 < 2"), c.where("crop_id % 5 >= 1")
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "gid", "dist", "rank").collect())
    for k1, k2 in ((6, 3), (5, 1)):
        with monkeypatch.context() as m:
            m.setattr(retrieval, "PANEL", 16)
            want = rows(retrieval.rerank_ranked(c, q, g, k1, k2))
        with monkeypatch.context() as m:
            for name in ("distances", "encode", "overlap"):
                forbid(m, retrieval, name)
            m.setattr(retrieval, "CELLS", 100)
            m.setattr(retrieval, "ENCODED", 50)
            assert len(want) == q.count() * g.count() and rows(retrieval.rerank_ranked(c, q, g, k1, k2)) == want
    assert retrieval.rerank_ranked(c, q.where("crop_id < 0"), g).count() == 0 == retrieval.rerank_ranked(c, q, g.where("crop_id < 0")).count()


def test_nearest_columns_are_those_of_a_sort():
    d = np.random.default_rng(1).integers(0, 4, (50, 40)) * 1.0
    for k in (1, 7, 40, 60):
        assert (retrieval._nearest(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_queries_of_reranking_make_no_rows_of_common_neighbours(spark, sf, monkeypatch):
    from matchgrid.plans import registry

    for name in ("distances", "encode", "overlap"):
        forbid(monkeypatch, retrieval, name)
    for name in ("rerank_blend", "rerank_given"):
        assert registry.queries()[name](spark, sf).count() > 0


def test_closest_rows_of_objects(spark, monkeypatch):
    c = small(spark, 120).where("object_id is not null")
    monkeypatch.setattr(pairs, "BLOCK", 2)
    rows = c.collect()
    v = {r.crop_id: np.array(r.embedding, float) for r in rows}
    of = lambda u, o: [r.crop_id for r in rows if (r.video_id, r.object_id) == (u, o)]
    objects = [(0, 0, 1, 1, 2), (1, 2, 3, 3, 4), (2, 0, 0, 2, 0)]
    got = pairs.closest_rows(spark.createDataFrame(objects, "rank long, video_id_a long, object_id_a long, video_id_b long, object_id_b long"), c, ["rank"]).collect()
    cos = lambda a, b: round(float(v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b]))), 7)
    want = {k: min((-cos(a, b), a, b) for a in of(ua, oa) for b in of(ub, ob)) for k, ua, oa, ub, ob in objects}
    assert {r.rank: (-r.best, r.a, r.b) for r in got} == want
