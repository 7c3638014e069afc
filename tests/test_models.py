"""Model operators: equivalence with MLlib / brute force, and learning
properties on the line-item observations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL
from tabpredict.operators import evaluate as EV
from tabpredict.operators import models as M
from tabpredict.operators.bayes import fit_gaussian_nb
from tabpredict.operators.boost import boost
from tabpredict.operators.knn import knn_predict, neighbours
from tabpredict.operators.split import split_holdout
from tabpredict.plans.q_train import KEEP, line_sets
from tabpredict.sources.tables import CHURN_FEATURES, churn_obs, embeddings_obs


def _acc(df):
    return EV.accuracy_pct(df).first()["accuracy"]


def _majority(df):
    r = df.agg(F.avg("label").alias("m")).first()["m"]
    return 100 * max(r, 1 - r)


def test_gaussian_nb_matches_mllib(spark):
    from pyspark.ml.classification import NaiveBayes
    d = split_holdout(churn_obs(spark, SF_MID), "row_id")
    tr, te = d.where("is_test = 0"), d.where("is_test = 1")
    ours = fit_gaussian_nb(tr, CHURN_FEATURES).transform(te).select("row_id", "prediction")
    nb = NaiveBayes(modelType="gaussian", labelCol="label").fit(M.assemble(tr, CHURN_FEATURES))
    theirs = nb.transform(M.assemble(te, CHURN_FEATURES)).select(
        "row_id", F.col("prediction").cast("int").alias("mllib"))
    j = ours.join(theirs, "row_id")
    agree = j.where(F.col("prediction") == F.col("mllib")).count() / j.count()
    assert agree > 0.99


def test_knn_blocks_equal_single_block(spark):
    d = split_holdout(embeddings_obs(spark, SF_MID), "row_id")
    tr, te = d.where("is_test = 0"), d.where("is_test = 1")
    one = neighbours(tr, te, 7, t_blocks=1, q_blocks=1)
    many = neighbours(tr, te, 7, t_blocks=3, q_blocks=2)
    a = sorted((r.q_id, r.rank, r.t_id) for r in one.collect())
    b = sorted((r.q_id, r.rank, r.t_id) for r in many.collect())
    assert a == b and len(a) == te.count() * 7


def test_knn_brute_force(spark):
    d = split_holdout(embeddings_obs(spark, SF_SMALL), "row_id")
    tr = [(r.row_id, np.array(r.embedding, dtype=float), r.label) for r in d.where("is_test = 0").collect()]
    te = d.where("is_test = 1")
    got = {r.row_id: r.prediction for r in knn_predict(d.where("is_test = 0"), te, 5).collect()}
    for r in te.collect():
        q = np.array(r.embedding, dtype=float)
        near = sorted(tr, key=lambda t: (float(np.sqrt(((t[1] - q) ** 2).sum())), t[0]))[:5]
        votes = {}
        for t in near:
            votes[t[2]] = votes.get(t[2], 0) + 1
        best = min(votes, key=lambda c: (-votes[c], c))
        assert got[r.row_id] == best


@pytest.fixture(scope="module")
def line(spark):
    return line_sets(spark, SF_SMALL), line_sets(spark, SF_SMALL, scaled=True)


def test_trees_beat_majority(spark, line):
    (tr, te), _ = line
    base = _majority(te)
    assert _acc(M.scored(M.train_decision_tree(tr, max_depth=6), te, KEEP)) > base
    assert _acc(M.scored(M.train_random_forest(tr, num_trees=10, max_depth=6), te, KEEP)) > base


def test_linear_models_beat_majority(spark, line):
    _, sets = line
    tr, te = sets
    base = _majority(te)
    assert _acc(M.scored(M.train_logistic(tr, sets.n_train), te, KEEP)) > base
    assert _acc(M.scored(M.train_linear_svm(tr, sets.n_train), te, KEEP, prob=False)) > base


def test_positive_weight_raises_recall(spark, line):
    (tr, te), _ = line
    lo = M.train_gbt(tr, rounds=5, step=0.1, pos_weight=None)
    hi = M.train_gbt(tr, rounds=5, step=0.1, pos_weight=20.0)
    r_lo = EV.tpr_tnr(M.scored(lo, te, KEEP)).first()["tpr"]
    r_hi = EV.tpr_tnr(M.scored(hi, te, KEEP)).first()["tpr"]
    assert r_hi >= r_lo


def test_warm_start_lowers_training_loss(spark, line):
    (tr, _), _ = line
    first = boost(tr, rounds=3, learning_rate=0.3, max_depth=3, min_rows=5, pos_weight=1.0)
    more = boost(tr, rounds=3, learning_rate=0.3, max_depth=3, min_rows=5, pos_weight=1.0, init=first)
    losses = [v for _, v in more.history]
    assert len(more.trees) == 6
    assert losses[-1] < losses[0]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))


def test_warm_start_from_mllib_gbt(spark, line):
    (tr, te), _ = line
    gbt = M.train_gbt(tr, rounds=3, step=0.1, pos_weight=None)
    cont = boost(tr, rounds=2, learning_rate=0.1, max_depth=3, min_rows=5, init=gbt)
    base_p = M.scored(gbt, te, KEEP).select("row_key", F.col("p1").alias("a"))
    start = cont.history[0][1]
    # the continued model starts from the MLlib margin: its first loss is the
    # MLlib model's training loss
    m = gbt.transform(tr).select(F.col("label").cast("double").alias("y"),
                                 M.vector_to_array("probability")[1].alias("p"))
    ll = m.agg(F.avg(-(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p"))))).first()[0]
    assert start == pytest.approx(ll, rel=1e-6)
    assert base_p.count() == te.count()


def test_rbf_features_beat_linear_on_ring(spark):
    rng = np.random.default_rng(5)
    pts = rng.uniform(-2, 2, size=(1500, 2))
    lab = (np.hypot(pts[:, 0], pts[:, 1]) < 1.2).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(y), i) for i, ((a, b), y) in enumerate(zip(pts, lab))],
                               "a double, b double, label int, row_key long")
    feats = ["a", "b"]
    lin = M.train_linear_svm(M.assemble(df, feats), 1500)
    acc_lin = _acc(M.scored(lin, M.assemble(df, feats), ["row_key", "label"], prob=False))
    g = M.gamma_scale(df, feats)
    mdf, names = M.mapped(df, M.rff_columns(feats, g, dim=200), ["row_key", "label"])
    rbf = M.train_linear_svm(M.assemble(mdf, names), 1500, C=100.0)
    acc_rbf = _acc(M.scored(rbf, M.assemble(mdf, names), ["row_key", "label"], prob=False))
    assert acc_rbf > acc_lin + 10


def test_cubic_map_is_exact_kernel(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (-1.0, 0.5, 2.0)], "a double, b double, c double")
    feats = ["a", "b", "c"]
    mdf, names = M.mapped(df, M.cubic_columns(feats, 0.7), [])
    z = np.array([[r[n] for n in names] for r in mdf.collect()])
    x = np.array([[1.0, 2.0, 0.5], [-1.0, 0.5, 2.0]])
    assert z[0] @ z[1] == pytest.approx((0.7 * x[0] @ x[1]) ** 3)


def test_split_counts_and_model_roundtrip(spark, line):
    (tr, te), _ = line
    gbt = M.train_gbt(tr, rounds=3, step=0.1)
    counts = dict(M.split_counts(gbt, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    assert sum(counts.values()) > 0
    import __spark_entry__ as E
    out = E.queries()["model_roundtrip"](spark, SF_SMALL)
    assert out.where(~F.col("same")).count() == 0


def test_log_loss_clip(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0)], "label int, p double")
    v = EV.log_loss(df).first()["log_loss"]
    assert math.isfinite(v) and v == pytest.approx(-math.log(1e-15) / 3, rel=1e-3)


def test_tensor_sketch_estimates_cubic_kernel(spark):
    rng = np.random.default_rng(3)
    p = 40
    x = rng.normal(size=p)
    rows = [(0, *map(float, x))]
    for i in range(1, 6):
        rows.append((i, *map(float, x + 0.3 * rng.normal(size=p))))
    cols = [f"f{j}" for j in range(p)]
    df = spark.createDataFrame(rows, ["row_key", *cols])
    gamma = 0.05
    z = {r.row_key: r.features.toArray()
         for r in M.tensor_sketch(df, cols, gamma, ["row_key"], dim=8192, seed=11).collect()}
    X = {r[0]: np.array(r[1:]) for r in rows}
    for i in range(1, 6):
        want = (gamma * X[0] @ X[i]) ** 3
        assert z[0] @ z[i] == pytest.approx(want, rel=0.25)


def test_logistic_gradient_vanishes_at_optimum(spark, line):
    _, sets = line
    tr, _ = sets
    n = sets.n_train
    m = M.train_logistic(tr, n, max_iter=500)
    w = m.coefficients.toArray()
    b = m.intercept
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    margin = F.lit(b)
    for c, wc in zip(feats, w):
        margin = margin + F.lit(float(wc)) * F.col(c)
    r = F.lit(1.0) / (1 + F.exp(-margin)) - F.col("label")
    g = tr.agg(*[F.avg(r * F.col(c)).alias(c) for c in feats], F.avg(r).alias("b")).first()
    reg = 1.0 / n
    for c, wc in zip(feats, w):
        assert abs(g[c] + reg * wc) < 1e-4
    assert abs(g["b"]) < 1e-4


def test_training_queries_take_their_size(spark):
    import inspect

    from tabpredict.plans import q_train as T

    default = lambda f: {k: p.default for k, p in inspect.signature(f).parameters.items() if p.default is not p.empty}
    assert default(T.train_gbt) == default(T.gbt_round_metrics) == {"rounds": 1000}
    assert default(T.train_gbt_continue) == {"rounds": 1000, "more_rounds": 1000}
    assert default(T.sweep_random_forest) == {"depths": tuple(range(1, 11)), "max_trees": 25}
    assert default(T.select_top_importance)["k"] == 10 and default(T.top_k_importance)["k"] == 20
    small = "/root/testdata/sf0.001"
    assert T.gbt_round_metrics(spark, small, rounds=2).count() == 2
    assert T.sweep_random_forest(spark, small, depths=(1, 3), max_trees=4).count() == 8
    assert T.train_gbt_continue(spark, small, rounds=2, more_rounds=1).count() > 0
    assert T.top_k_importance(spark, small).count() == 4


def test_one_forest_gives_every_depth_and_number_of_trees(spark):
    from tabpredict.plans import q_train as T

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)).round(2)
    y = ((x[:, 0] * x[:, 1] + 0.5 * rng.normal(size=600)) > 0).astype(int)
    df = M.assemble(spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, c double, label int"), ["a", "b", "c"]).persist()
    fits = []
    fit = M.train_random_forest
    M.train_random_forest = lambda *a, **k: (fits.append(1), fit(*a, **k))[1]
    try:
        got = T.forest_prefix_accuracy(df, df, (1, 2, 4), 5).collect()
    finally:
        M.train_random_forest = fit
    assert len(fits) == 1 and len(got) == 15
    for depth in (1, 2, 4):
        forest = fit(df, num_trees=5, max_depth=depth)
        share = forest.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert next(r.accuracy for r in got if r.depth == depth and r.n_trees == 5) == round(100 * share, 2)


def test_sketch_of_few_features_is_narrow(spark):
    rows = [(i, float(i), 1.0 - i, 0.5 * i) for i in range(5)]
    df = spark.createDataFrame(rows, ["row_key", "a", "b", "c"])
    z = {r.row_key: r.features.toArray() for r in M.tensor_sketch(df, ["a", "b", "c"], 0.3, ["row_key"], dim=4096, seed=2).collect()}
    assert {len(v) for v in z.values()} == {len(z[0])} and len(z[0]) <= 27
    assert z[2] @ z[3] == pytest.approx((0.3 * (6 + 2 + 1.5)) ** 3, rel=0.1)


def test_sketch_of_few_features_is_columns_of_products(spark):
    """The places of four features' sketch equal the Fourier transform's, without a Python stage; a missing value is refused, as before."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(40, 1.0, None, 1.0, 1.0)], "row_key int, a double, b double, c double, d double")
    got = M.tensor_sketch(df, ["a", "b", "c", "d"], 0.25, ["row_key"])
    assert "MapIn" not in got._jdf.queryExecution().toString()
    z = {r.row_key: r.features.toArray() for r in got.where("row_key < 40").collect()}
    rng = np.random.default_rng(1337)
    buckets, signs, prod = rng.integers(0, 1024, size=(3, 4)), rng.choice([-1.0, 1.0], size=(3, 4)), 1.0
    for i in range(3):
        cs = np.zeros((40, 1024))
        for j in range(4):
            cs[:, buckets[i, j]] += signs[i, j] * x[:, j] * 0.5
        prod = prod * np.fft.rfft(cs, axis=1)
    want = np.fft.irfft(prod, n=1024, axis=1)
    places = np.unique([(a + b + c) % 1024 for a in buckets[0] for b in buckets[1] for c in buckets[2]])
    assert len(z[0]) == len(places) and np.allclose(np.stack([z[i] for i in range(40)]), want[:, places], atol=1e-12)
    with pytest.raises(Exception, match="NOT_NULL_ASSERT_VIOLATION"):
        got.where("row_key = 40").collect()
