"""Properties, equivalences and edge cases of the operators."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL
from tabpredict.functions.expr import inverse_log
from tabpredict.operators import clean as C
from tabpredict.operators import evaluate as EV
from tabpredict.operators import gram as G
from tabpredict.operators import profile as PR
from tabpredict.operators.orderstat import column_quantiles, grouped_quantiles, kth_values
from tabpredict.operators.ranged import ranged_cumsum
from tabpredict.operators.scale import standardize
from tabpredict.operators.split import assign_folds, n_test_rows, split_holdout
from tabpredict.sources.tables import CHURN_FEATURES, churn_obs, raw_obs, read_csv, scored_obs


# -- split -----------------------------------------------------------------------

def test_split_exact_size_and_reproducible(spark):
    ob = churn_obs(spark, SF_MID)
    a = split_holdout(ob, "row_id", 0.333, 1337)
    n = ob.count()
    test_a = {r.row_id for r in a.where("is_test = 1").select("row_id").collect()}
    assert len(test_a) == n_test_rows(n, 0.333) == math.ceil(0.333 * n)
    # other layout, same seed -> same rows
    b = split_holdout(ob.repartition(3).orderBy(F.rand(7)), "row_id", 0.333, 1337)
    test_b = {r.row_id for r in b.where("is_test = 1").select("row_id").collect()}
    assert test_a == test_b
    c = split_holdout(ob, "row_id", 0.333, 42)
    assert {r.row_id for r in c.where("is_test = 1").select("row_id").collect()} != test_a


def test_split_tie_on_boundary_hash(spark):
    # many rows per key -> shared hashes; size must still be exact
    df = spark.range(0, 400).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"))
    s = split_holdout(df, "k", 0.5, 3)
    got = s.where("is_test = 1").count()
    # rows with the same key share the hash; a key is never split across sides
    sides = s.groupBy("k").agg(F.countDistinct("is_test").alias("d")).where("d > 1").count()
    assert sides == 0
    assert got >= n_test_rows(400, 0.5)


def test_folds_contiguous_sizes(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "row_id")
    f = assign_folds(df, "row_id", 5).groupBy("fold").agg(F.count("*").alias("n"),
                                                            F.min("row_id").alias("lo"))
    rows = sorted((r.fold, r.n, r.lo) for r in f.collect())
    assert [r[1] for r in rows] == [21, 21, 21, 20, 20]
    assert [r[2] for r in rows] == [0, 21, 42, 63, 83]


# -- order statistics and running sums ----------------------------------------------

def test_kth_values_narrowing_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=5000), np.full(2500, 0.25)])  # one hot value
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    ranks = [0, 1000, 3749, 3750, 7499]
    got = kth_values(df, "x", ranks, exact_limit=50, buckets=20)
    srt = np.sort(vals)
    assert all(got[r] == srt[r] for r in ranks)


def test_column_and_grouped_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 2), float(v), float(round(v, 1))) for i, v in enumerate(rng.normal(size=999))]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    q = column_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75], exact_limit=100)
    xs = np.array([r[1] for r in rows])
    ys = np.array([r[2] for r in rows])
    assert np.allclose(q["x"], np.quantile(xs, [0.25, 0.5, 0.75]))
    assert np.allclose(q["y"], np.quantile(ys, [0.25, 0.5, 0.75]))
    g = grouped_quantiles(df, "g", "x", [0.5])
    for k in (0, 1):
        assert math.isclose(g[k][0], float(np.median(xs[np.arange(999) % 2 == k])))


def test_ranged_cumsum_many_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(float(v), int(c)) for v, c in zip(rng.permutation(3000), rng.integers(0, 5, 3000))]
    df = spark.createDataFrame(rows, "s double, c long")
    out = ranged_cumsum(df, "s", ["c"], descending=True, target_rows=100).orderBy(F.desc("s"))
    got = [r.cum_c for r in out.collect()]
    want = np.cumsum([c for _, c in sorted(rows, reverse=True)])
    assert got == list(want)


def test_roc_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    so = scored_obs(spark, SF_MID)
    ours = EV.roc_auc(so, "label", "p").first()["roc_auc"]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label").evaluate(
        so.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - theirs) < 1e-6


def test_roc_edge_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, p double")
    assert EV.roc_auc(df).first()["roc_auc"] == pytest.approx(0.875)
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, p double")
    assert EV.roc_auc(one).first()["roc_auc"] is None


# -- Gram solves ------------------------------------------------------------------

def test_ols_pvalues_match_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    ob = churn_obs(spark, SF_MID)
    feats = ["c_acctbal", "n_orders", "spend", "recency"]
    fit = G.ols(G.gram(ob, feats, "label"))
    lr = LinearRegression(solver="normal", labelCol="label").fit(
        VectorAssembler(inputCols=feats, outputCol="features").transform(
            ob.withColumn("label", F.col("label").cast("double"))))
    pv = lr.summary.pValues  # features then intercept
    assert np.allclose(fit.coef[1:], lr.coefficients.toArray(), rtol=1e-6, atol=1e-9)
    assert np.allclose(fit.p[1:], pv[:-1], atol=1e-6)
    assert math.isclose(fit.p[0], pv[-1], abs_tol=1e-6)


def test_gram_collinear_features(spark):
    df = spark.range(0, 200).select(F.col("id").cast("double").alias("a"),
                                    (F.col("id") * 2.0).alias("b"),
                                    (F.col("id") * 3.0 + 1.0).alias("y"))
    fit = G.ols(G.gram(df, ["a", "b"], "y"))
    pred = fit.coef[0] + fit.coef[1] * 10 + fit.coef[2] * 20
    assert pred == pytest.approx(31.0)


def test_betainc_against_known_t_tail():
    # two-sided p of t=2.0 with 10 dof = 0.0733880...
    assert G.t_two_sided_p(2.0, 10) == pytest.approx(0.07338803477074, rel=1e-9)
    assert G.t_two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_lasso_kkt(spark):
    ob = churn_obs(spark, SF_MID)
    g = G.gram(assign_folds(ob, "row_id", 5), CHURN_FEATURES, "label", key="fold")
    res = G.lasso_cv(g, list(range(5)))
    Q, c, n, _ = G._centered(g.total())
    grad = (c - Q @ res["coef"]) / n
    a = res["alpha"]
    for j, b in enumerate(res["coef"]):
        if b != 0:
            assert grad[j] == pytest.approx(a * np.sign(b), rel=1e-4, abs=1e-9)
        else:
            assert abs(grad[j]) <= a * (1 + 1e-6)


# -- cleaning / profiling edges ------------------------------------------------------

def test_fill_nulls_covers_strings(spark):
    ro = raw_obs(spark, SF_SMALL)
    out = C.fill_nulls(ro)
    assert out.where(F.col("has_credit_card").isNull() | F.col("service_area").isNull()
                     | F.col("monthly_revenue").isNull()).count() == 0


def test_zero_count_on_text_is_zero_and_no_null_table(spark):
    df = spark.createDataFrame([("0", 0), ("a", 1)], "t string, n int")
    zn = {r.col_name: (r.n_zero, r.n_null) for r in PR.zeros_nulls(df).collect()}
    assert zn == {"t": (0, 0), "n": (1, 0)}
    assert PR.max_null_pct(df).first()["max_null_pct"] == 0.0


def test_inverse_log_extremes(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "p double")
    vals = [r.s for r in df.select(inverse_log("p").alias("s")).collect()]
    assert all(math.isfinite(v) for v in vals)
    assert vals[2] == pytest.approx(1 / math.log(0.5))


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "c double, x double")
    out = standardize(df, ["c", "x"]).collect()
    assert [r.c for r in out] == [0.0, 0.0]
    assert sorted(r.x for r in out) == [-1.0, 1.0]


def test_csv_roundtrip(spark):
    ro = raw_obs(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="tabpredict-csv-"), "raw")
    ro.write.mode("overwrite").option("header", True).csv(path)
    back = read_csv(spark, path, schema=ro.schema)
    assert back.count() == ro.count()
    assert sorted(back.collect()) == sorted(ro.collect())


def test_label_encoder_alphabetical(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("Unknown",), ("No",)], "m string")
    codes = {r.m_raw: r.m for r in C.label_encode(df.withColumn("m_raw", F.col("m")), ["m"]).collect()}
    assert codes == {"No": 0, "Unknown": 1, "Yes": 2}


def test_describe_paths_agree(spark, monkeypatch):
    ob = churn_obs(spark, SF_SMALL)
    one_pass = sorted(PR.describe(ob, CHURN_FEATURES).collect())
    monkeypatch.setattr(PR, "EXACT_LIMIT", 3)  # force moments + order statistics
    two_pass = sorted(PR.describe(ob, CHURN_FEATURES).collect())
    assert one_pass == two_pass


def test_describe_reads_its_rows_once(spark, monkeypatch):
    """Quartiles of many distinct values take many passes; the rows behind them are made once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(k):
        seen.add(1)
        return k * 1.0

    df = spark.range(200).select(told(F.col("id")).alias("v"), F.lit(None).cast("double").alias("n"))
    monkeypatch.setattr(PR, "EXACT_LIMIT", 3)
    got = {r.feature: r for r in PR.describe(df, ["v", "n"]).collect()}
    assert seen.value <= 400                    # the column and its missing values, each asked once
    assert (got["v"]["count"], got["v"].q25, got["v"].q50, got["v"].max) == (200, 49.75, 99.5, 199.0)
    assert (got["n"]["count"], got["n"].q50) == (0, None)


def test_grid_search_joins_once(spark, monkeypatch):
    from tabpredict.plans import q_train as T

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(k):
        seen.add(1)
        return k

    rows = spark.range(80).select(told(F.col("id")).alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
                                  *[(F.hash("id", F.lit(k)) % 50).cast("double").alias(c) for k, c in enumerate(CHURN_FEATURES)])
    monkeypatch.setattr(T, "churn_obs", lambda spark, sf: rows)
    found = T.grid_search_gbt(spark, None, rounds=1, depths=(1,), steps=(0.1,)).collect()
    assert len(found) == 1 and found[0].best and seen.value == 80


def test_grid_search_of_depths_and_rates_is_whole(spark, monkeypatch):
    """By default 100 rounds of each of 15 settings on four folds; each figure is that of single fits."""
    import inspect

    from tabpredict.operators import evaluate as EV
    from tabpredict.operators import gbm as G
    from tabpredict.operators.split import assign_folds
    from tabpredict.plans import q_train as T

    told = {k: p.default for k, p in inspect.signature(T.grid_search_gbt).parameters.items()}
    assert told["rounds"] == 100 and {5} <= set(told["depths"]) and {0.01, 0.025, 0.05} <= set(told["steps"])
    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.hash("id", F.lit(1)) % 50 + F.hash("id", F.lit(9)) % 30 > 0).cast("int").alias("label"),
                                   *[(F.hash("id", F.lit(k)) % 50).cast("double").alias(c) for k, c in enumerate(CHURN_FEATURES)]).persist()
    monkeypatch.setattr(T, "churn_obs", lambda spark, sf: rows)
    found = {(r.max_depth, r.step_size): r for r in T.grid_search_gbt(spark, None, rounds=6, depths=(2, 3), steps=(0.3,)).collect()}
    assert sorted(found) == [(2, 0.3), (3, 0.3)] and [r.best for r in found.values()].count(True) == 1
    d, areas = assign_folds(rows, "row_id", 4), []
    edges = G.bin_edges(d, CHURN_FEATURES, 255)
    for f in range(4):
        model = G.boost(d.where(F.col("fold") != f), CHURN_FEATURES, rounds=6, settings=G.Settings(learning_rate=0.3, max_leaves=8, max_depth=3, min_rows=1), edges=edges)
        assert model.nodes.groupby("tree").size().max() > 7       # deeper than two levels
        areas.append(EV.roc_auc(model.transform(d.where(F.col("fold") == f)), "label", "margin", digits=12).first()["roc_auc"])
    assert abs(found[3, 0.3].auc - sum(areas) / 4) < 1e-9 and found[3, 0.3].auc > 0.6
