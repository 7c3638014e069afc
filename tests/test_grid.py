"""Stratified folds, designs of settings, cross-validation by cell and halving."""

import itertools
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabpredict.operators import gbm as G
from tabpredict.operators import grid as R
from tabpredict.operators.split import assign_stratified_folds

LEVELS = {c: [1, 2, 3] for c in "abcdefghijklm"}


def folds_of(n, k):
    return [i for i in range(k) for _ in range(n // k + (i < n % k))]


@pytest.mark.parametrize("target", [200_000, 7])
@pytest.mark.parametrize("k", [1, 3, 4])
def test_stratified_folds(spark, target, k):
    rng = np.random.default_rng(k)
    rows = [(int(i), c, 1) for i, c in zip(rng.permutation(101), ["x"] * 70 + ["y"] * 29 + ["z"] + [None])]
    df = spark.createDataFrame(rows, "key long, label string, fold int").repartition(3)
    got = assign_stratified_folds(df, "key", "label", k, target_rows=target)
    assert got.columns == ["key", "label", "fold"]
    got = got.collect()
    assert len(got) == 101
    for c in ("x", "y", "z", None):
        own = sorted((r["key"], r["fold"]) for r in got if r["label"] == c)
        assert [f for _, f in own] == folds_of(len(own), k)


def test_stratified_folds_of_odd_rows(spark):
    shape = "key double, label int"
    assert assign_stratified_folds(spark.createDataFrame([], shape), "key").count() == 0
    df = spark.createDataFrame([(None, 1), (float("nan"), 0)] + [(5.0, 1)] * 8 + [(float(i), 0) for i in range(4)], shape)
    got = assign_stratified_folds(df, "key").collect()
    assert len(got) == 14
    assert {r["fold"] for r in got if r["key"] is None or r["key"] != r["key"]} == {0}
    assert len({r["fold"] for r in got if r["label"] == 1 and r["key"] == 5.0}) == 1        # equal keys stay together
    assert sorted(r["fold"] for r in got if r["label"] == 0 and r["key"] == r["key"]) == [0, 1, 2, 3]


def test_pairs_of_levels_are_even():
    cells = R.pair_cells(LEVELS)
    assert len(cells) == 27
    for a, b in itertools.combinations(LEVELS, 2):
        assert set(Counter((c[a], c[b]) for c in cells).values()) == {3}
    with pytest.raises(ValueError):
        R.pair_cells({"a": [1, 2]})
    assert R.every_cell({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 600
    a, b = rng.integers(0, 30, n).astype(float), rng.normal(size=n).round(2)
    pdf = pd.DataFrame({"a": a, "b": b, "label": (rng.random(n) < 1 / (1 + np.exp(2 - 0.2 * a - b))).astype(int), "fold": np.arange(n) % 3})
    return spark.createDataFrame(pdf).repartition(3).persist()


CELLS = [G.Settings(learning_rate=0.3, max_leaves=5), G.Settings(learning_rate=0.3, max_leaves=8, max_depth=3, l1=0.5, pos_weight=2.0, max_bins=16),
         G.Settings(learning_rate=1e-6, max_leaves=2, pos_weight=1e-6)]


def test_cells_are_single_fits(rows):
    here = sorted(R.fold_scores(rows, ["a", "b"], CELLS, 4))
    apart = sorted(R.fold_scores(rows, ["a", "b"], CELLS[:2], 4, together=0))
    assert [r[:4] for r in apart] == [r[:4] for r in here[:6]] and [r[4] for r in apart] == pytest.approx([r[4] for r in here[:6]])
    for cell, fold, n, right, area in here[:6:2]:
        model = G.boost(rows.where(F.col("fold") != fold), ["a", "b"], rounds=4, settings=CELLS[cell], edges=G.bin_edges(rows, ["a", "b"], CELLS[cell].max_bins))
        own = model.transform(rows.where(F.col("fold") == fold)).select("margin", "prediction", "label").toPandas()
        assert (len(own), (own.prediction == own.label).sum()) == (n, right) and n == 200
        yes, no = own.margin[own.label == 1].to_numpy(), own.margin[own.label == 0].to_numpy()
        gap = np.sign((yes[:, None] - no[None, :]).round(9))
        assert area == pytest.approx((gap > 0).mean() + (gap == 0).mean() / 2)
    assert R.auc(np.array([0.1, 0.2]), np.array([True, True])) is None


def test_halving(rows):
    found = R.successive_halving(rows, ["a", "b"], CELLS, 9, keep=2)
    assert [(r[0], r[1]) for r in found] == [(0, 4)] * 3 + [(1, 9)] * 2
    kept = [r[2] for r in found[:2]]
    assert {r[2] for r in found[3:]} == set(kept) and found[0][3] >= found[1][3] >= found[2][3]
    assert found[2][2] == 2                                           # the setting that always says no
    flat = R.successive_halving(rows, ["a", "b"], CELLS, 4, keep=len(CELLS))
    scores = R.fold_scores(rows, ["a", "b"], CELLS, 4)
    assert [r[0] for r in flat] == [0] * 3
    for _, _, cell, share, area in flat:
        assert share == sum(r[3] for r in scores if r[0] == cell) / 600
        assert area == pytest.approx(np.mean([r[4] for r in scores if r[0] == cell]))
    twins = R.successive_halving(rows, ["a", "b"], [CELLS[2], replace(CELLS[2], max_leaves=9, learning_rate=0.5, min_hessian=0.0, l2=1.0)], 3, keep=2)
    assert [r[3] for r in twins] == [twins[0][3]] * 2 and twins[0][2] == 1 and twins[0][4] > twins[1][4]     # all say no: AUC decides
    assert R.successive_halving(rows, ["a", "b"], [], 4) == [] == R.fold_scores(rows.limit(0), ["a", "b"], CELLS, 4)


def test_large_tables_are_counted_by_bins_and_fold(spark, rows, monkeypatch):
    """More rows than one task may hold: the different rows with their numbers by fold and label give the same scores, binned once for all rungs."""
    few = rows.withColumn("b", F.round("b"))
    want = sorted(R.fold_scores(few, ["a", "b"], CELLS, 4))
    size = few.select("a", "b").distinct().count()
    assert 2 * size < 1000
    made = R.Folds(few, ["a", "b"], [s.max_bins for s in CELLS], together=1000)
    codes, yes, every = made.sent(255).value
    assert codes.shape == (2, size) and every.shape == (3, size) and every.sum() == 600 and every.dtype == np.uint8
    monkeypatch.setattr(R, "boost", None)              # no fit by the cluster
    got = sorted(R.fold_scores(few, ["a", "b"], CELLS, 4, together=1000))
    assert [r[:4] for r in got] == [r[:4] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want])
    asked = []
    each = R.bin_edges_each
    monkeypatch.setattr(R, "bin_edges_each", lambda *a: (asked.append(1), each(*a))[1])
    assert [x[:4] for x in R.successive_halving(few, ["a", "b"], CELLS, 9, keep=2, together=1000)] == [x[:4] for x in R.successive_halving(few, ["a", "b"], CELLS, 9, keep=2)]
    assert len(asked) == 2                             # once a search, not once a rung
    m, yes = np.array([0.1, 0.2, 0.2, 0.5]), np.array([1, 0, 2, 1])
    assert R.auc(m, yes, np.array([2, 1, 3, 1])) == pytest.approx(R.auc(np.repeat(m, [2, 1, 3, 1]), np.array([1, 0, 0, 1, 1, 0, 1], bool)))
