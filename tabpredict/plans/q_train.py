"""Queries: classifiers trained on the line-item observations, scored on the
exact-size hold-out; boosting with warm start; sweeps; model persistence."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import models as M
from ..operators.bayes import GaussianNBModel, fit_gaussian_nb
from ..operators.gbm import BoostedTrees, Settings, bin_edges, boost
from ..operators.grid import every_cell, fold_scores, pair_cells, successive_halving
from ..operators.scale import apply_scaler, fit_scaler
from ..operators.select import top_k
from ..operators.split import assign_folds, assign_stratified_folds, split_holdout_sized
from ..session import discard, materialize
from ..sources.models import load_model, save_model
from ..sources.tables import CHURN_FEATURES, LINE_FEATURES, churn_obs, line_obs
from .fixtures_sql import with_ctes
from .registry import query

KEEP = ["row_key", "label"]

# The reference's three boosted-tree settings.
CORE_GBM = Settings(learning_rate=0.05, max_leaves=31)
ADVANCED_GBM = Settings(learning_rate=0.01, max_leaves=41, max_depth=5, min_rows=21, min_hessian=5.0, l1=0.5, l2=0.5,
                        feature_fraction=0.5, pos_weight=99.0, max_bins=1000)
TEST_GBM = Settings(learning_rate=0.01, max_leaves=60, max_depth=5, min_rows=15, min_hessian=5.0, l1=0.1, l2=0.1,
                    feature_fraction=0.7, pos_weight=120.0, max_bins=500)
#: Defaults of the queries' parameters, the reference's: boosting rounds of a model (and of its
#: continuation), depths and trees of the forest sweep, sizes of the two importance lists.
ROUNDS, CORE_ROUNDS = 1000, 100
SWEEP_DEPTHS, SWEEP_TREES = tuple(range(1, 11)), 25
TOP_SPLITS, TOP_IMPORTANCE = 10, 20
# The reference's grid of nine parameters (19,683 cells) and its number of folds.
GRID = {"learning_rate": [0.01, 0.025, 0.05], "max_leaves": [20, 40, 60], "min_rows": [15, 21, 26], "min_hessian": [5.0, 10.0, 15.0],
        "l1": [0.1, 0.5, 1.0], "l2": [0.1, 0.5, 1.0], "pos_weight": [120.0, 140.0, 160.0], "feature_fraction": [0.1, 0.5, 0.7], "max_bins": [500, 1000, 1500]}
GRID_FOLDS, CELL_ROUNDS = 4, 100
#: Depths and rates of the search over trees of bounded depth: the reference's depth and its three rates among others.
TREE_DEPTHS, TREE_STEPS = (2, 3, 5), (0.01, 0.025, 0.05, 0.1, 0.3)


def line_split(spark, sf, *more):
    lo = line_obs(spark, sf).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"),
        *LINE_FEATURES, "label", *more)
    # the split rows feed several passes (scaler, fit, scoring): write once
    return split_holdout_sized(lo, "row_key", 0.333, 1337, materialize=True)


class LineSets(tuple):
    """(train, test) that also knows the training row count."""
    n_train: int


def line_sets(spark, sf, scaled: bool = False):
    """(train, test) with a features vector; scaled with training-row stats."""
    sp = line_split(spark, sf)
    d = sp.df
    if scaled:
        d = apply_scaler(d, fit_scaler(d.withColumn("__tr", F.col("is_test") == 0),
                                       LINE_FEATURES, fit_on="__tr"))
    d = M.assemble(d, LINE_FEATURES)
    out = LineSets((d.where("is_test = 0"), d.where("is_test = 1")))
    out.n_train = sp.n_train
    return out


# -- trees -----------------------------------------------------------------------

@query("train_decision_tree")
def train_decision_tree(spark, sf):
    tr, te = line_sets(spark, sf)
    return M.scored(M.train_decision_tree(tr, max_depth=10), te, KEEP)


@query("train_random_forest")
def train_random_forest(spark, sf):
    tr, te = line_sets(spark, sf)
    return M.scored(M.train_random_forest(tr, num_trees=10, max_depth=6), te, KEEP)


def gbt_model(spark, sf, rounds=ROUNDS, settings=ADVANCED_GBM):
    tr, te = line_sets(spark, sf)
    return boost(tr, LINE_FEATURES, rounds=rounds, settings=settings), tr, te


def boosted_scores(model, df):
    return model.transform(df.select(*KEEP, *LINE_FEATURES)).select(*KEEP, "prediction", "p1")


@query("train_gbt")
def train_gbt(spark, sf, rounds=ROUNDS):
    model, _, te = gbt_model(spark, sf, rounds)
    return boosted_scores(model, te)


@query("train_gbt_core")
def train_gbt_core(spark, sf, rounds=CORE_ROUNDS):
    """The first settings: 31 leaves, the leaf with the largest gain first, any depth."""
    model, _, te = gbt_model(spark, sf, rounds, CORE_GBM)
    return boosted_scores(model, te)


@query("train_gbt_third")
def train_gbt_third(spark, sf, rounds=ROUNDS):
    model, _, te = gbt_model(spark, sf, rounds, TEST_GBM)
    return boosted_scores(model, te)


@query("train_gbt_continue")
def train_gbt_continue(spark, sf, rounds=ROUNDS, more_rounds=ROUNDS):
    tr, te = line_sets(spark, sf)
    edges = bin_edges(tr, LINE_FEATURES, ADVANCED_GBM.max_bins)
    model = boost(tr, LINE_FEATURES, rounds=rounds, settings=ADVANCED_GBM, edges=edges)
    more = boost(tr, LINE_FEATURES, rounds=more_rounds, settings=ADVANCED_GBM, init=model, edges=edges)
    return boosted_scores(more, te)


@query("gbt_round_metrics")
def gbt_round_metrics(spark, sf, rounds=ROUNDS):
    """Training log-loss (class weights as in the fit) and AUC after each round, from one scan."""
    model, tr, _ = gbt_model(spark, sf, rounds)
    return model.round_metrics(tr, weight=ADVANCED_GBM.pos_weight).where("n_trees > 0").select(
        "n_trees", F.col("log_loss").alias("train_log_loss"), F.col("auc").alias("train_auc"), "auc_error")


@query("gbt_early_stop")
def gbt_early_stop(spark, sf, rounds=300, patience=10):
    """Rounds end when the hold-out's log-loss has not fallen for ``patience`` of them."""
    tr, te = line_sets(spark, sf)
    model = boost(tr, LINE_FEATURES, rounds=rounds, settings=CORE_GBM, valid=te, early_stopping=patience)
    return model.round_metrics(te).select("n_trees", F.col("log_loss").alias("valid_log_loss"), F.col("auc").alias("valid_auc"))


@query("select_top_importance")
def select_top_importance(spark, sf, rounds=ROUNDS, k=TOP_SPLITS):
    model, _, _ = gbt_model(spark, sf, rounds)
    return top_k(model.split_counts(spark), k)


STUMP = Settings(learning_rate=0.01, max_leaves=2, max_depth=1, min_rows=21, min_hessian=5.0, l1=0.5, l2=0.5, pos_weight=99.0)
STUMP_FEATURES = ["l_discount", "l_tax"]
STUMP_SQL = with_ctes("""
, w AS (SELECT 99.0 * sum(label) / (99.0 * sum(label) + sum(1 - label)) AS p FROM line_obs),
v AS (SELECT 'l_discount' AS feature, l_discount AS x, label FROM line_obs UNION ALL SELECT 'l_tax', l_tax, label FROM line_obs),
b AS (SELECT feature, x, sum(label) AS pos, sum(1 - label) AS neg FROM v GROUP BY feature, x),
c AS (SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx, sum(pos) OVER (PARTITION BY feature ORDER BY x) AS lp,
             sum(neg) OVER (PARTITION BY feature ORDER BY x) AS ln, sum(pos) OVER (PARTITION BY feature) AS tp, sum(neg) OVER (PARTITION BY feature) AS tn FROM b),
g AS (SELECT feature, (x + nx) / 2 AS threshold, lp + ln AS n_left, tp + tn - lp - ln AS n_right,
             99 * (p - 1) * lp + p * ln AS gl, p * (1 - p) * (99 * lp + ln) AS hl,
             99 * (p - 1) * (tp - lp) + p * (tn - ln) AS gr, p * (1 - p) * (99 * (tp - lp) + tn - ln) AS hr FROM c, w WHERE nx IS NOT NULL),
q AS (SELECT *, sign(gl) * greatest(abs(gl) - 0.5, 0) AS sl, sign(gr) * greatest(abs(gr) - 0.5, 0) AS sr,
             sign(gl + gr) * greatest(abs(gl + gr) - 0.5, 0) AS st FROM g WHERE n_left >= 21 AND n_right >= 21 AND hl >= 5 AND hr >= 5),
s AS (SELECT *, sl * sl / (hl + 0.5) + sr * sr / (hr + 0.5) - st * st / (hl + hr + 0.5) AS gain FROM q)
""", "line_obs").rstrip()


def stump(spark, sf):
    return boost(line_obs(spark, sf), STUMP_FEATURES, rounds=1, settings=STUMP).node_table(spark)


@query("gbt_stump", STUMP_SQL + """
SELECT feature, round(threshold, 6) AS threshold, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, round(gain, 4) AS gain,
       round(-0.01 * sl / (hl + 0.5), 9) AS left_value, round(-0.01 * sr / (hr + 0.5), 9) AS right_value
FROM s ORDER BY gain DESC LIMIT 1""")
def gbt_stump(spark, sf):
    """One round of one split: gain and leaf values under both penalties and the class weight."""
    n = stump(spark, sf).groupBy("tree").pivot("node", [0, 1, 2]).agg(
        *[F.first(c).alias(c) for c in ("feature_name", "threshold", "gain", "n", "value")])
    return n.select(F.col("0_feature_name").alias("feature"), F.round("0_threshold", 6).alias("threshold"), F.col("1_n").alias("n_left"),
                    F.col("2_n").alias("n_right"), F.round("0_gain", 4).alias("gain"), F.round("1_value", 9).alias("left_value"), F.round("2_value", 9).alias("right_value"))


@query("gbt_split_counts", STUMP_SQL + """
SELECT f.feature, CAST(count(t.feature) AS BIGINT) AS importance
FROM (SELECT DISTINCT feature FROM v) f LEFT JOIN (SELECT feature FROM s ORDER BY gain DESC LIMIT 1) t ON t.feature = f.feature GROUP BY f.feature""")
def gbt_split_counts(spark, sf):
    """Splits on each feature, counted in the model's node table."""
    return boost(line_obs(spark, sf), STUMP_FEATURES, rounds=1, settings=STUMP).split_counts(spark)


@query("gbt_roundtrip", "SELECT CAST(ceil(0.333 * count(*)) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_differing FROM lineitem")
def gbt_roundtrip(spark, sf, rounds=20):
    """A boosted model written and read again scores every hold-out row alike."""
    model, _, te = gbt_model(spark, sf, rounds)
    again = BoostedTrees.load(spark, model.save(spark))
    both = te.select(*LINE_FEATURES).withColumn("a", model.margin()).withColumn("b", again.margin())
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differing"))


@query("nb_roundtrip", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differing FROM customer")
def nb_roundtrip(spark, sf):
    """A naive Bayes model written and read again predicts every row alike."""
    ob = churn_obs(spark, sf)
    model = fit_gaussian_nb(ob, CHURN_FEATURES)
    again = GaussianNBModel.load(spark, model.save(spark))
    both = again.transform(model.transform(ob, "a"), "b")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differing"))


@query("top_k_importance")
def top_k_importance(spark, sf, k=TOP_IMPORTANCE):
    tr, _ = line_sets(spark, sf)
    rf = M.train_random_forest(tr, num_trees=10, max_depth=6)
    imp = spark.createDataFrame([(f, float(v)) for f, v in zip(LINE_FEATURES, rf.featureImportances.toArray())],
                                "feature string, importance double")
    return top_k(imp, k)


@query("model_roundtrip")
def model_roundtrip(spark, sf):
    tr, te = line_sets(spark, sf)
    model = M.train_decision_tree(tr, max_depth=6)
    path = save_model(spark, model)
    again = load_model(DecisionTreeClassificationModel, path)
    a = M.scored(model, te, KEEP, prob=False)
    b = M.scored(again, te, KEEP, prob=False).withColumnRenamed("prediction", "reloaded")
    return a.join(b, KEEP).withColumn("same", F.col("prediction") == F.col("reloaded"))


# -- linear and kernel SVMs, logistic regression -------------------------------------

@query("train_linear_svm")
def train_linear_svm(spark, sf):
    sets = line_sets(spark, sf, scaled=True)
    tr, te = sets
    return M.scored(M.train_linear_svm(tr, sets.n_train), te, KEEP, prob=False)


def _mapped_sets(spark, sf, kind: str):
    sets = line_sets(spark, sf, scaled=True)
    tr, te = sets
    gamma = M.gamma_scale(tr, LINE_FEATURES)
    if kind == "sketch":         # the caller's choice: an estimate of the cubic kernel for wide inputs
        out = LineSets((M.tensor_sketch(tr, LINE_FEATURES, gamma, KEEP),
                        M.tensor_sketch(te, LINE_FEATURES, gamma, KEEP)))
        out.n_train = sets.n_train
        return out
    cols = M.rff_columns(LINE_FEATURES, gamma) if kind == "rbf" else M.cubic_columns(LINE_FEATURES, gamma)
    mtr, names = M.mapped(tr, cols, KEEP)
    mte, _ = M.mapped(te, cols, KEEP)
    out = LineSets((M.assemble(mtr, names), M.assemble(mte, names)))
    out.n_train = sets.n_train
    return out


@query("train_rbf_svm")
def train_rbf_svm(spark, sf):
    sets = _mapped_sets(spark, sf, "rbf")
    tr, te = sets
    return M.scored(M.train_linear_svm(tr, sets.n_train), te, KEEP, prob=False)


@query("train_poly_svm")
def train_poly_svm(spark, sf):
    sets = _mapped_sets(spark, sf, "poly")
    tr, te = sets
    return M.scored(M.train_linear_svm(tr, sets.n_train), te, KEEP, prob=False)


@query("train_poly_svm_sketch")
def train_poly_svm_sketch(spark, sf):
    """The cubic-kernel SVM through the tensor sketch (the path wide inputs take)."""
    sets = _mapped_sets(spark, sf, "sketch")
    tr, te = sets
    return M.scored(M.train_linear_svm(tr, sets.n_train), te, KEEP, prob=False)


@query("train_logistic")
def train_logistic(spark, sf):
    sets = line_sets(spark, sf, scaled=True)
    tr, te = sets
    return M.scored(M.train_logistic(tr, sets.n_train), te, KEEP)


@query("train_logistic_penalized_intercept")
def train_logistic_penalized_intercept(spark, sf):
    sets = line_sets(spark, sf, scaled=True)
    tr, te = M.with_bias(sets[0], LINE_FEATURES), M.with_bias(sets[1], LINE_FEATURES)
    model = M.train_logistic(tr, sets.n_train, penalize_intercept=True)
    return M.scored(model, te, KEEP)


# -- sweeps ------------------------------------------------------------------------------

def forest_prefix_accuracy(tr, te, depths, max_trees, label="label"):
    """Accuracy of every (depth, first-t-trees) forest. Trees grow level by level from the same
    draws, so a shallower forest is the deepest one cut at its depth: one fit, and one
    pass over the test rows that sums the trees' class probabilities."""
    spark = tr.sparkSession
    depths = list(depths)
    forest = M.train_random_forest(tr, num_trees=max_trees, max_depth=max(depths))
    right = M.cut_forest_right(M.tree_arrays(spark, forest), te, depths, label)
    n = te.count()
    rows = [(depth, t + 1, round(right[depth][t] / n * 100, 2)) for depth in depths for t in range(forest.getNumTrees)]
    # best setting: highest accuracy, then fewest trees, then shallowest
    best = max(rows, key=lambda t: (t[2], -t[1], -t[0]))
    rows = [t + (t == best,) for t in rows]
    return spark.createDataFrame(rows, "depth int, n_trees int, accuracy double, best boolean")


@query("sweep_random_forest")
def sweep_random_forest(spark, sf, depths=SWEEP_DEPTHS, max_trees=SWEEP_TREES):
    tr, te = line_sets(spark, sf)
    return forest_prefix_accuracy(tr, te, depths=depths, max_trees=max_trees)


@query("grid_search_gbt")
def grid_search_gbt(spark, sf, rounds=CELL_ROUNDS, depths=TREE_DEPTHS, steps=TREE_STEPS):
    """Mean AUC over four folds of boosted trees of each depth (all leaves that it has room for) and rate."""
    # every job of the search reads the written rows: the join is run once, and no task reports on its plan
    observed = materialize(churn_obs(spark, sf).select("row_id", "label", *CHURN_FEATURES), "observed")
    grid = [(depth, step) for depth in depths for step in steps]
    cells = [Settings(learning_rate=step, max_leaves=2 ** depth, max_depth=depth, min_rows=1) for depth, step in grid]
    areas = {}
    for cell, *_, area in fold_scores(assign_folds(observed, "row_id", GRID_FOLDS), CHURN_FEATURES, cells, rounds):
        areas.setdefault(cell, []).extend([] if area is None else [area])
    discard(observed)
    mean = [math.fsum(areas[i]) / len(areas[i]) if areas.get(i) else None for i in range(len(grid))]
    best = max(range(len(grid)), key=lambda i: -math.inf if mean[i] is None else mean[i])
    return spark.createDataFrame([(depth, float(step), mean[i], i == best) for i, (depth, step) in enumerate(grid)],
                                 "max_depth int, step_size double, auc double, best boolean")


def searched(spark, sf, rounds, full, keep):
    """(cells, found, training rows with folds, hold-out) of the nine-parameter search on the line items."""
    d = line_split(spark, sf, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place")).df
    tr = materialize(assign_stratified_folds(d.where("is_test = 0"), "place", "label", GRID_FOLDS).select("fold", "label", *LINE_FEATURES), "folds")
    cells = every_cell(GRID) if full else pair_cells(GRID)
    found = successive_halving(tr, LINE_FEATURES, [Settings(**c) for c in cells], rounds, keep=len(cells) if keep is None else keep)
    return cells, found, tr, d.where("is_test = 1")


@query("grid_search_boost")
def grid_search_boost(spark, sf, rounds=CELL_ROUNDS, full=False, keep=3):
    """Share right and AUC over four stratified folds of the settings in each rung of the halving;
    of settings with the same share right the larger AUC is better.

    27 settings in which every pair of levels of any two of the nine parameters occurs three
    times; ``full``: all 19,683. ``keep=None``: no halving, each one trained in full."""
    cells, found, tr, _ = searched(spark, sf, rounds, full, keep)
    discard(tr)
    last = max((r[0] for r in found), default=0)
    best = next((r[2] for r in found if r[0] == last), None)
    kinds = {k: "int" if isinstance(v[0], int) else "double" for k, v in GRID.items()}
    return spark.createDataFrame([(*r, *cells[r[2]].values(), r[0] == last and r[2] == best) for r in found],
                                 "rung int, n_rounds int, cell int, accuracy double, auc double, " + ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", best boolean")


@query("grid_best_confusion")
def grid_best_confusion(spark, sf, rounds=CELL_ROUNDS, full=False, keep=3):
    """The best settings of the search, fitted again on all training rows and asked on the hold-out."""
    cells, found, tr, te = searched(spark, sf, rounds, full, keep)
    best = next(r[2] for r in found if r[0] == found[-1][0])
    model = boost(tr, LINE_FEATURES, rounds=rounds, settings=Settings(**cells[best]))
    discard(tr)
    return EV.confusion_matrix(model.transform(te))
