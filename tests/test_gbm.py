"""Boosting on binned rows: trees against brute force, both ways of running, model tables, early stop."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabpredict.operators import evaluate as EV
from tabpredict.operators import gbm as G
from tabpredict.operators.bayes import GaussianNBModel, fit_gaussian_nb

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 900
    a, b, c = rng.integers(0, 12, n).astype(float), rng.normal(size=n).round(2), rng.random(n).round(3)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 * a - 2 + b * (c > 0.5))))).astype(int)
    a[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "label": y})
    return pdf, spark.createDataFrame(pdf).repartition(3).persist()


def split_of(x, g, h, s):
    """The best split of some rows by trying every cut of every feature."""
    def q(mask):
        return G.shrunk(g[mask].sum(), s.l1) ** 2 / (h[mask].sum() + s.l2)
    best = None
    for f in range(x.shape[1]):
        cuts = np.unique(x[~np.isnan(x[:, f]), f])
        for t in [-math.inf, *((cuts[1:] + cuts[:-1]) / 2)]:
            left = np.isnan(x[:, f]) | (x[:, f] <= t)
            if min(left.sum(), (~left).sum()) < s.min_rows or min(h[left].sum(), h[~left].sum()) < s.min_hessian:
                continue
            gain = q(left) + q(~left) - q(np.ones(len(g), bool))
            if gain > s.min_gain + 1e-12 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, left)
    return best


def brute(x, y, rounds, s):
    pos, neg = (y == 1).sum() * s.pos_weight, (y == 0).sum()
    m = np.full(len(y), math.log(pos / neg))
    for _ in range(rounds):
        g, h = G.gradients(m, y, s)
        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < s.max_leaves:
            found = [(split_of(x[at], g[at], h[at], s) if not s.max_depth or d < s.max_depth else None, k) for k, (at, d) in enumerate(leaves)]
            found = [(r, k) for r, k in found if r is not None]
            if not found:
                break
            r, k = max(found, key=lambda t: t[0][0])
            at, d = leaves.pop(k)
            leaves += [(at[r[2]], d + 1), (at[~r[2]], d + 1)]
        for at, _ in leaves:
            m[at] += G.leaf_value(g[at].sum(), h[at].sum(), s)
    return m


@pytest.mark.parametrize("settings", [
    G.Settings(learning_rate=0.3, max_leaves=6, min_rows=15, max_bins=1000),
    G.Settings(learning_rate=0.3, max_leaves=99, max_depth=3, min_rows=9, min_hessian=2.0, l1=0.7, l2=1.5, pos_weight=3.0, max_bins=1000)])
def test_trees_are_brute_force(rows, settings):
    pdf, df = rows
    want = brute(pdf[FEATURES].to_numpy(), pdf["label"].to_numpy(), 4, settings)
    keyed = df.select(*FEATURES, "label")
    for together in (None, 0):
        model = G.boost(keyed, FEATURES, rounds=4, settings=settings, together=together)
        got = model.transform(keyed).toPandas()
        order = lambda d, m: sorted(zip(d["a"].fillna(-1), d["b"], d["c"], np.round(m, 9)))
        assert order(got, got["margin"]) == order(pdf, want)


def test_margins_are_written_anew_without_change(rows, monkeypatch):
    _, df = rows
    s = G.Settings(learning_rate=0.2, max_depth=2, max_leaves=9, feature_fraction=0.7)
    here = G.boost(df, FEATURES, rounds=5, settings=s)
    monkeypatch.setattr(G, "KEEP_ROUNDS", 2)
    apart = G.boost(df, FEATURES, rounds=5, settings=s, together=0)
    assert (here.nodes[["tree", "node", "feature", "bin", "left", "right", "n"]] == apart.nodes[["tree", "node", "feature", "bin", "left", "right", "n"]]).all().all()
    assert np.allclose(here.nodes["value"], apart.nodes["value"])


def test_continuation_is_one_long_fit(rows):
    _, df = rows
    s = G.Settings(learning_rate=0.2, feature_fraction=0.7)
    whole = G.boost(df, FEATURES, rounds=6, settings=s)
    first = G.boost(df, FEATURES, rounds=4, settings=s)
    assert first.nodes.equals(whole.first(4).nodes)
    more = G.boost(df, FEATURES, rounds=2, settings=s, init=first)
    assert more.n_trees == 6 and np.allclose(more.nodes["value"], whole.nodes["value"])


def test_round_metrics_equal_refits_of_prefixes(rows):
    _, df = rows
    model = G.boost(df, FEATURES, rounds=6, settings=G.Settings(learning_rate=0.3, pos_weight=2.0))
    seen = {r["n_trees"]: r for r in model.round_metrics(df, weight=2.0).collect()}
    assert sorted(seen) == list(range(7))
    for n in (1, 3, 6):
        scored = model.first(n).transform(df)
        w = F.when(F.col("label") == 1, 2.0).otherwise(1.0)
        loss = -w * F.when(F.col("label") == 1, F.ln("p1")).otherwise(F.ln(1 - F.col("p1")))
        assert seen[n]["log_loss"] == pytest.approx(scored.agg(F.sum(loss) / F.sum(w)).first()[0], rel=1e-9)
        exact = EV.roc_auc(scored, "label", "margin", digits=12).first()["roc_auc"]
        assert abs(seen[n]["auc"] - exact) <= seen[n]["auc_error"] + 1e-9 < 0.05


def test_early_stop_cuts_back_to_the_best(spark, rows):
    _, df = rows
    train, valid = df.where("c <= 0.7"), df.where("c > 0.7")
    s = G.Settings(learning_rate=0.8, min_rows=2)
    full = G.boost(train, FEATURES, rounds=30, settings=s)
    loss = [r["log_loss"] for r in full.round_metrics(valid).orderBy("n_trees").collect()]
    best = G.best_round(loss, 0, 4)
    assert best is not None and best < 26
    for together in (None, 0):
        got = G.boost(train, FEATURES, rounds=30, settings=s, valid=valid, early_stopping=4, stop_every=3, together=together) if together is None or best < 9 else None
        assert got is None or (got.n_trees == best and np.allclose(got.nodes["value"], full.first(best).nodes["value"]))
    assert G.best_round([3, 2, 1], 0, 2) is None and G.best_round([3, 1, 2, 2], 0, 2) == 1


def test_model_table_round_trip(spark, rows, tmp_path):
    _, df = rows
    model = G.boost(df, FEATURES, rounds=3)
    path = model.save(spark, f"{tmp_path}/model")
    again = G.BoostedTrees.load(spark, path)
    assert again.nodes.equals(model.nodes) and again.base == model.base and again.features == model.features
    assert dict(map(tuple, model.split_counts(spark).collect())) == {f: int((model.nodes["feature"] == k).sum()) for k, f in enumerate(FEATURES)}
    spark.createDataFrame([(99, 0.0, FEATURES, len(model.nodes))], "version int, base double, features array<string>, n_nodes long").write.mode("overwrite").parquet(f"{path}/head")
    with pytest.raises(ValueError):
        G.BoostedTrees.load(spark, path)


def test_naive_bayes_round_trip(spark, rows, tmp_path):
    _, df = rows
    model = fit_gaussian_nb(df, ["b", "c"])
    assert GaussianNBModel.load(spark, model.save(spark, f"{tmp_path}/nb")) == model


def test_defined_cases(spark, rows):
    _, df = rows
    one = df.where("label = 1")
    assert G.boost(one, FEATURES, rounds=3).n_trees == 0
    assert G.boost(df.limit(0), FEATURES, rounds=3).base == 0.0
    assert G.boost(df, FEATURES, rounds=0).n_trees == 0
    flat = df.withColumn("k", F.lit(1.0)).withColumn("gone", F.lit(None).cast("double"))
    model = G.boost(flat, ["k", "gone"], rounds=2)
    assert (model.nodes["feature"] < 0).all() and model.transform(flat).where("p1 IS NULL").isEmpty()
    unlabelled = G.boost(df.unionByName(df.withColumn("label", F.lit(None).cast("long"))), FEATURES, rounds=2)
    assert np.allclose(unlabelled.nodes["value"], G.boost(df, FEATURES, rounds=2).nodes["value"])


def test_many_values_are_cut_into_even_bins(spark):
    df = spark.range(20000).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    x, z = G.bin_edges(df, ["x", "z"], 50)
    assert z == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    counts = np.bincount(np.searchsorted(x, np.arange(20000) * 0.5))
    assert len(x) == 49 and counts.max() < 1.1 * 400 and counts.min() > 0.9 * 400


def nodes_match(a, b):
    same = ["tree", "node", "feature", "bin", "left", "right", "n"]
    return (a.nodes[same] == b.nodes[same]).all().all() and np.allclose(a.nodes["value"], b.nodes["value"])


def test_trees_over_cells_are_trees_over_rows(rows, monkeypatch):
    _, df = rows
    s = G.Settings(learning_rate=0.3, max_leaves=5, feature_fraction=0.7, max_bins=8, pos_weight=2.0)
    asked = []
    cells = G.Cells.__init__
    monkeypatch.setattr(G.Cells, "__init__", lambda self, *a: (asked.append(1), cells(self, *a))[1])
    monkeypatch.setattr(G, "KEEP_ROUNDS", 2)
    got = G.boost(df, FEATURES, rounds=5, settings=s, together=0)
    assert len(asked) == 5                    # a job a tree, not a level
    monkeypatch.setattr(G, "CELLS_SENT", 0)
    monkeypatch.setattr(G, "TABLE", 0)
    by_level = G.boost(df, FEATURES, rounds=5, settings=s, together=0)
    assert len(asked) == 5 and nodes_match(got, by_level)
    monkeypatch.undo()
    assert nodes_match(G.boost(df, FEATURES, rounds=5, settings=s), by_level)
    score = lambda m: sorted(r["p1"] for r in m.transform(df).collect())
    told = score(got)
    monkeypatch.setattr(G, "looked_up", lambda *a: None)
    assert score(got) == told


def test_many_rows_of_few_bins_are_written_once(spark, rows, tmp_path):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 500).astype(float), "b": rng.integers(0, 5, 500).astype(float)})
    pdf.loc[::9, "a"] = np.nan
    pdf["label"] = (rng.random(500) < 0.2 + 0.1 * pdf["b"]).astype(int)
    df = spark.createDataFrame(pdf).repartition(3)
    edges = G.bin_edges(df, ["a", "b"], 20)
    read = lambda n: [G.read_block(b, k, 2) for b in G.bin_rows(df, ["a", "b"], "label", F.lit(0.0), edges, n).toArrow().to_batches() for k in range(b.num_rows)]
    few, every = read(500), read(0)
    size = lambda x: sum(len(r[1]) for r in x)
    assert size(every) == 500 and size(few) <= 2 * 5 * 5 and sum(r[3].sum() for r in few) == 500
    s = G.Settings(learning_rate=0.3, min_rows=5)
    once = G.boost(df, ["a", "b"], rounds=4, settings=s)
    split = G.bin_rows
    G.bin_rows = lambda *a: split(*a[:5])
    try:
        plain = G.boost(df, ["a", "b"], rounds=4, settings=s)
    finally:
        G.bin_rows = split
    score = lambda m: sorted(r["p1"] for r in m.transform(df).collect())
    assert np.allclose(score(once), score(plain))
    seen, want = ({r["n_trees"]: r for r in once.round_metrics(d).collect()} for d in (df, df.unionByName(df)))
    assert all(seen[n]["log_loss"] == pytest.approx(want[n]["log_loss"]) and seen[n]["auc"] == pytest.approx(want[n]["auc"]) for n in range(5))


def test_large_tables_are_put_together_by_bins(spark, rows):
    """More rows than one task may hold, but fewer than twice the combinations of bins: different rows are written, not all."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 20, 2000).astype(float), "b": rng.integers(0, 30, 2000).astype(float)})
    pdf["label"] = (rng.random(2000) < 0.1 + 0.02 * pdf["b"]).astype(int)
    df = spark.createDataFrame(pdf).repartition(3)
    edges = G.bin_edges(df, ["a", "b"], 50)
    size = math.prod(len(e) + 2 for e in edges)
    assert 2000 < 4 * size and not G.worth_merging(size, 2000, 2) and G.worth_merging(size, 2000, 2, 1000) and not G.worth_merging(2 ** 63, 2000, 2, 1000)
    blocks = [G.read_block(b, k, 2) for b in G.bin_rows(df, ["a", "b"], "label", F.lit(0.0), edges, 2000, 1000).toArrow().to_batches() for k in range(b.num_rows)]
    assert sum(len(x[1]) for x in blocks) == len(pdf.groupby(["a", "b"])) < 700
    assert sum(x[3].sum() for x in blocks) == 2000 and sum(x[1].sum() for x in blocks) == pdf["label"].sum()
    s = G.Settings(learning_rate=0.3, min_rows=5, pos_weight=3.0)
    score = lambda **k: sorted(r["p1"] for r in G.boost(df, ["a", "b"], rounds=4, settings=s, **k).transform(df).collect())
    plain = score()
    assert np.allclose(plain, score(together=1500)) and np.allclose(plain, score(together=0))      # put together, then held by one task or by none


def test_trees_of_the_same_features_are_added_up(rows, monkeypatch):
    _, df = rows
    s = G.Settings(learning_rate=0.1, feature_fraction=0.7, max_leaves=6)
    model = G.boost(df, FEATURES, rounds=40, settings=s)
    cuts, trees = model.coded()
    widths = [len(c) + 2 for c in cuts]
    left, tables = G.added_up(trees, widths)
    assert not left and 3 <= len(tables) <= 7 and G.added_up(trees[:31], widths) == (trees[:31], [])
    codes = np.stack([np.random.default_rng(1).integers(0, w, 5000) for w in widths])
    assert np.allclose(sum(G.tree_outputs(codes, tables)), sum(G.tree_outputs(codes, G.with_tables(trees, widths))))
    monkeypatch.setattr(G, "SUMMED_TABLE", 1)
    assert len(G.added_up(trees, widths)[0]) + len(G.added_up(trees, widths)[1]) >= 40
    # metrics of rows put together by the model's cuts
    want = {r["n_trees"]: r for r in model.round_metrics(df, weight=2.0).collect()}
    monkeypatch.setattr(G, "TOGETHER", 100)
    got = {r["n_trees"]: r for r in model.round_metrics(df, weight=2.0).collect()}
    assert all(got[n][c] == pytest.approx(want[n][c]) for n in want for c in ("log_loss", "auc", "auc_error"))


def test_continuation_over_the_same_bins_asks_no_raw_value(rows, monkeypatch):
    _, df = rows
    s = G.Settings(learning_rate=0.2, feature_fraction=0.7)
    first, whole = G.boost(df, FEATURES, rounds=4, settings=s), G.boost(df, FEATURES, rounds=6, settings=s)
    assert first.over([[0.123]] * 3) is None
    monkeypatch.setattr(G.BoostedTrees, "margin", None)
    for together in (None, 0):
        more = G.boost(df, FEATURES, rounds=2, settings=s, init=first, together=together)
        assert more.n_trees == 6 and np.allclose(more.nodes["value"], whole.nodes["value"])
