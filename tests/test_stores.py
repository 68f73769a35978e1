"""Stored tables, manifests, reports, plug points, hooks, projected verification."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid import plugins
from matchgrid.operators import batches
from matchgrid.operators.projection import fold_verification_projected
from matchgrid.operators.retrieval import expand_queries
from matchgrid.sources import documents, stores


def test_units_are_read_by_folder(spark):
    path = stores.scratch(spark, "units")
    rows = spark.range(40).select("id", (F.col("id") % 2).alias("part"), (F.col("id") % 5).alias("unit"))
    stores.write_units(rows, path, "part", "unit")
    got = stores.read_units(spark, path, part=1, unit=[0, 3])
    assert sorted(r.id for r in got.collect()) == [3, 5, 13, 15, 23, 25, 33, 35]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "unit" in plan.split("PartitionFilters")[1][:120]
    with pytest.raises(Exception, match="nowhere"):
        stores.read_units(spark, path, nowhere=1).count()


def test_alignment_is_loud(spark):
    records = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 20, 0)], "unit int, uid long, place long")
    make = lambda rows: spark.createDataFrame(rows, "unit int, uid long, place long, embedding array<double>")
    good = [(1, 10, 0, [1.0]), (1, 11, 1, [0.0]), (2, 20, 0, [2.0])]
    assert stores.check_aligned(records, make(good)).count() == 3
    for bad in (good[:2], [*good, (2, 21, 1, [1.0])], [(1, 10, 1, [1.0]), (1, 11, 0, [0.0]), good[2]], [*good[:2], (2, 20, 0, [float("nan")])], [*good[:2], (2, 20, 0, None)], [*good[:2], (2, 20, 0, [])], [*good[:2], (2, 20, 0, [None])]):
        with pytest.raises(ValueError, match="do not match"):
            stores.check_aligned(records, make(bad))
    assert stores.alignment(records.limit(0), make([])).count() == 0


def test_manifest_round_trip(spark):
    path = stores.scratch(spark, "manifest") + "/split.json"
    for value in ({"b": [1, 2], "a": "ü\n|"}, {"b": 3}):
        stores.write_manifest(spark, path, value)
        assert stores.read_manifest(spark, path) == value
    assert list(json.loads(stores.read_text(spark, path))) == ["b"]
    with pytest.raises(ValueError):
        stores.write_manifest(spark, path, float("nan"))
    assert stores.read_manifest(spark, path) == {"b": 3}
    stores.write_tables({"bins": spark.range(3)}, path + ".d", "csv")
    assert spark.read.option("header", True).csv(path + ".d/bins").count() == 3


def test_markdown(spark):
    df = spark.createDataFrame([("b", 0.5, None, True), ("a|c", float("nan"), 2, False)], "name string, tar double, n int, ok boolean")
    assert documents.markdown(df, "name", percent=["tar"]).splitlines() == ["| name | tar | n | ok |", "|-|-|-|-|", "| a\\|c | – | 2 | no |", "| b | 50.00 % | – | yes |"]
    with pytest.raises(ValueError, match="more than 1"):
        documents.markdown(df, most=1)
    assert documents.report("R", [("One", "text", "| x |\n")]) == "# R\n\n## One\n\ntext\n\n| x |\n"
    assert documents.metric_lines(spark.createDataFrame([("loss", 1.0)], "name string, value double"), 3, 9) == "iter 3/9  loss: 1.0000"


def test_registries_and_hooks(spark):
    with pytest.raises(ValueError, match="twice"):
        plugins.ENCODERS.register("signs")(None)
    with pytest.raises(KeyError, match="unknown encoder"):
        plugins.ENCODERS.get("nothing")
    rows = spark.createDataFrame([(1, [1.0, -1.0]), (2, None)], "k long, v array<double>")
    got = {r.k: r.embedding for r in plugins.export(rows, "matchgrid.plugins:Signs", "k", "v").collect()}
    assert got == {1: [1.0, 0.0], 2: None}
    assert plugins.export(rows.limit(0), "signs", "k", "v").count() == 0
    seen = []

    class Log(plugins.Hooks):
        def before_step(self, step, name):
            seen.append((step, name))

        def after_run(self):
            seen.append("end")

    calls = []
    every = plugins.Every(2, lambda k, r: calls.append((k, r)))
    assert plugins.run_steps([("a", lambda: 1), ("b", lambda: 2), ("c", lambda: 3)], [Log(), every]) == {"a": 1, "b": 2, "c": 3}
    assert seen == [(0, "a"), (1, "b"), (2, "c"), "end"] and calls == [(1, 2), (2, 3)]
    with pytest.raises(ZeroDivisionError):
        plugins.run_steps([("x", lambda: 1 / 0)], [Log()])
    assert seen[-1] == "end"
    evaluator = plugins.Evaluator()
    with pytest.raises(ValueError, match="nothing"):
        evaluator.evaluate()
    evaluator.process(spark.range(2)), evaluator.process(spark.range(3))
    assert evaluator.rows.count() == 5


def test_sets_without_rows_or_partners(spark):
    images = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "pos long, image long")
    flags = spark.createDataFrame([(0, True), (1, False)], "pair long, same boolean")
    assert [tuple(r) for r in stores.pair_set(images, flags).collect()] == [(0, 7, 8, True)]
    records = spark.createDataFrame([(0, [3.0, 13.0]), (1, [5.0]), (2, [6.0, 1.0]), (3, [7.0])], "idx long, label array<double>")
    assert sorted(tuple(r) for r in stores.indexed_records(records).collect()) == [(1, 5, 10), (2, 6, 10)]
    assert batches.released(spark.createDataFrame([], "s long, a long"), "s", "a").count() == 0
    got = batches.released(spark.createDataFrame([(0, 4), (1, 1), (2, 9), (3, 2)], "s long, a long"), "s", "a")
    assert sorted((r.s, r.released) for r in got.collect()) == [(0, 4), (1, 4), (2, 9), (3, 9)]


def test_expansion_repeats(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(12)], "crop_id long, embedding array<double>")
    once = expand_queries(items, 3, 2)
    two = {r.crop_id: r.embedding for r in expand_queries(items, 3, 2, times=2).collect()}
    again = {r.crop_id: r.embedding for r in expand_queries(once, 3, 2).collect()}
    assert all(np.allclose(two[k], again[k]) for k in again) and len(two) == 12


def brute(fold, same, a, b, components, steps, width):
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for f in np.unique(fold):
        train = np.concatenate([a[fold != f], b[fold != f]])
        _, _, vt = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)
        p, q = (unit((x - train.mean(axis=0)) @ vt[:components].T) for x in (a, b))
        dist = ((p - q) ** 2).sum(axis=1)
        best = None
        for k in range(steps):
            acc = ((dist < k * width) == same)[fold != f].mean()
            if best is None or acc > best[0]:
                best = acc, k
        hit = dist[fold == f] < best[1] * width
        own = same[fold == f]
        out[int(f)] = (round(best[1] * width, 9), (hit == own).mean(), hit[own].mean(), hit[~own].mean())
    return out


def test_projected_verification(spark):
    rng = np.random.default_rng(5)
    n, d = 300, 10
    a, fold, same = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d), np.arange(n) % 5, rng.random(n) < 0.5
    b = np.where(same[:, None], a + rng.normal(size=(n, d)) * 0.4, rng.normal(size=(n, d)) * np.linspace(3, 0.2, d))
    df = spark.createDataFrame([(int(f), bool(s), x.tolist(), y.tolist()) for f, s, x, y in zip(fold, same, a, b)], "fold long, same boolean, a array<double>, b array<double>").repartition(7)
    got = {r.fold: (round(r.threshold, 9), r.acc, r.tpr, r.fpr) for r in fold_verification_projected(df, 4).collect()}
    want = brute(fold, same, a, b, 4, 400, 0.01)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert fold_verification_projected(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError, match="at least two folds"):
        fold_verification_projected(df.where("fold = 1"), 4)
    with pytest.raises(ValueError, match="components"):
        fold_verification_projected(df, 11)
