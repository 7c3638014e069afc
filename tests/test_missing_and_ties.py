"""Ties, nulls, NaN and edges that the test tables do not hold."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabpredict.operators import clean as C
from tabpredict.operators import evaluate as EV
from tabpredict.operators import gram as G
from tabpredict.operators import select as S
from tabpredict.operators.boost import boost
from tabpredict.operators.knn import neighbours
from tabpredict.operators.orderstat import kth_values, quantiles
from tabpredict.operators.profile import describe

NAN = float("nan")


def test_equal_vectors_fall_to_the_smaller_ids(spark):
    train = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(400)] + [(900, [1.0, 2.5], 1)], "row_id long, embedding array<double>, label int")
    ask = spark.createDataFrame([(5000, [1.0, 2.0], 0), (5001, [1.0, 9.0], 0)], "row_id long, embedding array<double>, label int")
    for blocks in (1, 3):
        got = {}
        for r in neighbours(train, ask, 5, t_blocks=blocks, q_blocks=blocks).orderBy("q_id", "rank").collect():
            got.setdefault(r.q_id, []).append(r.t_id)
        assert got == {5000: [0, 1, 2, 3, 4], 5001: [900, 0, 1, 2, 3]}


def test_correlation_of_a_pair_ignores_other_columns(spark):
    rows = [(float(i % 7), float((i * i) % 11), None if i % 2 else float(i), NAN if i % 5 == 0 else float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, half double, gaps double")
    want = df.agg(F.corr("x", "y")).first()[0]
    full = {(r.feature_a, r.feature_b): r["corr"] for r in S.corr_matrix(df, ["x", "half", "gaps"], "y", digits=12).collect()}
    assert full["x", "y"] == pytest.approx(want, abs=1e-11) and full["x", "x"] == pytest.approx(1.0)
    kept = df.where("not isnan(gaps)").agg(F.corr("x", "gaps")).first()[0]
    assert full["x", "gaps"] == pytest.approx(kept, abs=1e-11)
    assert {r.feature for r in S.select_pearson(df, ["x", "half", "gaps"], "y", 0.0).collect()} <= {"x", "half", "gaps", "y"}


def test_least_squares_names_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (None, 1.0), (4.0, NAN), (5.0, 7.0)], "x double, y double")
    with pytest.raises(ValueError, match="2 rows"):
        G.gram(df, ["x"], "y")
    assert G.gram(df, ["x"], "y", on_null="drop").total()[0, 0] == 3


def test_summaries_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (3.0,), (2.0,), (5.0,), (None,)], "v double")
    r = describe(df, ["v"]).first()
    assert (r["count"], r["mean"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == (4, 2.75, 1.0, 1.75, 2.5, 3.5, 5.0)
    assert quantiles(df, "v", [0.5]) == [2.5] and kth_values(df, "v", [3]) == {3: 5.0}


def test_histogram_leaves_out_both_sides(spark):
    df = spark.createDataFrame([(x,) for x in (-6.0, 0.0, 0.5, 1.0, 2.0, 2.1, NAN)], "v double")
    got = {r.bin: r.n for r in EV.score_histogram(df, "v", bins=2, lo=0.0, hi=2.0).collect()}
    assert got == {0: 2, 1: 2}


def test_pairing_by_key(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 0), ("b", 1), ("c", 1)], "k string, y int")
    pred = spark.createDataFrame([("b", 0.5), ("c", 0.1), ("c", 0.2), ("d", 0.9)], "k string, p double")
    got = sorted(tuple(r) for r in EV.pair(truth, pred, "k", "y", "p").collect())
    assert got == [("b", 0, 0.5), ("b", 1, 0.5), ("c", 1, 0.1), ("c", 1, 0.2)]


def test_warm_start_keeps_the_old_trees(spark):
    df = spark.range(200).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                 ((F.col("id") % 13) > 6).cast("int").alias("label"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    fit = dict(max_depth=2, min_rows=2, min_hessian=0.1, l1=0.0, l2=1.0)
    first = boost(df, rounds=2, learning_rate=0.5, **fit)
    same = boost(df, rounds=0, learning_rate=0.05, init=first, **fit)
    a = [r[0] for r in first.margin(df).select("margin").collect()]
    assert a == [r[0] for r in same.margin(df).select("margin").collect()]
    assert max(a) - min(a) > 0.5
    more = boost(df, rounds=1, learning_rate=0.05, init=first, **fit)
    b = [r[0] for r in more.margin(df).select("margin").collect()]
    assert 0 < max(abs(x - y) for x, y in zip(a, b)) < 0.5


def test_early_stop_cuts_back_to_the_best(spark):
    df = spark.range(60).select((F.col("id") % 2).cast("double").alias("a"), F.lit(0.0).alias("b"), (F.col("id") % 2).cast("int").alias("label"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    # a rate beyond 1 overshoots: the loss turns
    got = boost(df, rounds=8, learning_rate=40.0, max_depth=1, min_rows=1, min_hessian=0.0, l1=0.0, l2=0.0, early_stopping_rounds=2)
    losses = [v for _, v in got.history]
    best = min(range(len(losses)), key=losses.__getitem__)
    assert len(got.trees) == got.history[best][0] or len(losses) == 8
    assert not any(math.isnan(v) for v in losses)


def test_codes_over_ranges(spark):
    rng = np.random.default_rng(6)
    words = sorted({"".join(chr(97 + c) for c in rng.integers(0, 26, 3)) for _ in range(900)} | {"", "\u00e9", "Z"}, key=lambda w: w.encode())
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "m string").repartition(5)
    got = C.label_codes(df, "m")
    assert [(r["value"], r["code"]) for r in got.orderBy("code").collect()] == [(w, i) for i, w in enumerate(words)]
    assert C.label_codes(df.limit(0), "m").count() == 0


def test_area_beyond_64_bits(spark, monkeypatch):
    points = spark.createDataFrame([(0.9, 3 * 10 ** 9, 10 ** 9, 3 * 10 ** 9, 10 ** 9), (0.1, 10 ** 9, 3 * 10 ** 9, 4 * 10 ** 9, 4 * 10 ** 9)],
                                   "threshold double, tp long, fp long, cum_tp long, cum_fp long")
    monkeypatch.setattr(EV, "roc_points", lambda *a: (points, 4 * 10 ** 9, 4 * 10 ** 9))
    assert EV.roc_auc(points).first()["roc_auc"] == 0.75


def test_cuts_of_an_absent_class(spark, monkeypatch):
    from tabpredict.plans import q_evaluate as Q
    rows = spark.createDataFrame([(i, 0, i / 10) for i in range(5)], "row_id long, label int, s double")
    monkeypatch.setattr(Q, "scored_s", lambda *a: rows)
    assert [tuple(r) for r in Q.binarize_median(spark, "").orderBy("row_id").collect()] == [(i, 0, int(i < 2), 0) for i in range(5)]
    assert Q.segment_at_risk(spark, "").count() == 3 and Q.segment_class_share(spark, "").count() == 0
