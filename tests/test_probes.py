"""Many probes in one loop against single fits, closed optimality conditions and plain Python scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltable.operators import learning as L


def data(spark, n=120, d=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    er = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    pr = np.where(rng.random(n) < 0.1, -1, (x[:, 1] > 0.3).astype(int))
    emb = spark.createDataFrame([(f"s{i:03d}", [float(v) for v in x[i]]) for i in range(n)], "slide_id string, embedding array<float>")
    return emb, spark.createDataFrame([(f"s{i:03d}", int(er[i]), int(pr[i])) for i in range(n)], "slide_id string, er int, pr int")


def test_folds_are_the_single_k_shots(spark):
    emb, labels = data(spark)
    table = L.probe_table(emb, labels, ["er", "pr"])
    got = {}
    for r in L.k_shot_folds(table, [1, 5, 80], 3).collect():
        got.setdefault((r.task, r.k, r.fold), set()).add(r.slide_id)
    assert len(got) == 18
    for (task, k, fold), items in got.items():
        assert items == {r.slide_id for r in L.k_shot(L.labelled(emb, labels, task), k, fold, "label").collect()}


def test_many_fits_equal_single_fits(spark):
    emb, labels = data(spark)
    train = L.k_shot_folds(L.probe_table(emb, labels, ["er", "pr"]), [3, 20], 2)
    keys = ["task", "k", "fold"]
    weights = L.fit_probes(train, keys)
    assert set(weights) == {(t, k, f) for t in ("er", "pr") for k in (3, 20) for f in (0, 1)}
    by = {}
    for r in train.collect():
        by.setdefault((r.task, r.k, r.fold), []).append((r.embedding, r.label))
    for key, w in weights.items():
        x, y = np.array([v for v, _ in by[key]], float), np.array([t for _, t in by[key]])
        lack = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        assert np.abs(lack @ x + w[:-1]).max() < 1e-4 and abs(lack.sum()) < 1e-4
    one = train.filter("task = 'er' and k = 20 and fold = 1")
    test = L.labelled(emb, labels, "er")
    alone = {r.slide_id: r.score for r in L.linear_probe(one, test).collect()}
    rows = test.withColumns({"task": F.lit("er"), "k": F.lit(20), "fold": F.lit(1)})
    many = {r.slide_id: r.score for r in L.probe_scores(rows, weights, keys, ["slide_id"]).collect()}
    assert many.keys() == alone.keys() and max(abs(many[i] - alone[i]) for i in alone) < 1e-3


def test_grid_is_the_mean_over_folds(spark):
    emb, labels = data(spark)
    got = {(r.task, r.k): r for r in L.probe_grid(emb, labels, ["er", "pr"], [1, 10], 3).collect()}
    assert set(got) == {(t, k) for t in ("er", "pr") for k in (1, 10)}
    for (task, k), row in got.items():
        d, areas = L.labelled(emb, labels, task), []
        for fold in range(3):
            train = L.k_shot(d, k, fold, "label")
            scored = L.linear_probe(train, L.holdout(d, train)).collect()
            p, n = ([r.score for r in scored if r.label == c] for c in (1, 0))
            areas.append(np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n]))
        assert row.n == 3 and row["mean"] == pytest.approx(np.mean(areas), abs=2e-3)


def test_one_class_and_limits(spark):
    emb, labels = data(spark)
    with pytest.raises(ValueError, match="two classes"):
        L.probe_grid(emb, labels.withColumn("er", F.lit(1)), ["er"], [2], 2)
    train = L.k_shot_folds(L.probe_table(emb, labels, ["er"]), [3], 2)
    with pytest.raises(ValueError, match="max_weights"):
        L.fit_probes(train, ["task", "k", "fold"], max_weights=10)
    assert L.fit_probes(train.limit(0), ["task", "k", "fold"]) == {}
