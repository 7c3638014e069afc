"""Queries: score boards, best / worst, appended and ordered reports, the
report skeleton, and the model comparison table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import binarize, inverse_log
from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import report as R
from ..operators import select as S
from ..sources.tables import CHURN_FEATURES, churn_obs, scored_obs
from .fixtures_sql import register, with_ctes
from .q_evaluate import class_medians
from .q_models import nb_predictions
from .q_train import KEEP, boosted_scores, gbt_model, line_sets
from .registry import query

# scores over scored_obs: name -> (Spark column builder, SQL expression)
SCORES = {
    "p": (lambda: F.col("p"), "p"),
    "extendedprice": (lambda: F.col("l_extendedprice"), "l_extendedprice"),
    "p_half": (lambda: binarize("p", 0.5), "CASE WHEN p > 0.5 THEN 1 ELSE 0 END"),
}


def _auc_sql(name: str, expr: str) -> str:
    return f"""
SELECT '{name}' AS model, round(sum(fp * (2 * ctp - tp)) / (2.0 * max(P) * max(N)), 6) AS roc_auc FROM (
  SELECT tp, fp, sum(tp) OVER (ORDER BY t DESC) AS ctp, sum(tp) OVER () AS P, sum(fp) OVER () AS N
  FROM (SELECT t, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label <> 1) AS fp
        FROM (SELECT CAST({expr} AS DOUBLE) AS t, label FROM scored_obs) GROUP BY t))"""


register("score_aucs", " UNION ALL ".join(_auc_sql(n, e) for n, (_, e) in SCORES.items()),
         ["scored_obs"])


def score_aucs(spark, sf):
    so = scored_obs(spark, sf)
    rows = [EV.roc_auc(so.select("label", c().alias("score")), "label", "score")
            .select(F.lit(n).alias("model"), "roc_auc") for n, (c, _) in SCORES.items()]
    return R.append(*rows)


@query("rank_models", with_ctes(
    "SELECT model, roc_auc, CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) "
    "AS rank FROM score_aucs", "score_aucs"))
def rank_models(spark, sf):
    return R.ranked(score_aucs(spark, sf)).withColumn("rank", F.col("rank").cast("int"))


@query("best_worst_model", with_ctes("""
SELECT (SELECT model FROM score_aucs ORDER BY roc_auc DESC, model LIMIT 1) AS best_model,
       (SELECT max(roc_auc) FROM score_aucs) AS best_value,
       (SELECT model FROM score_aucs ORDER BY roc_auc, model LIMIT 1) AS worst_model,
       (SELECT min(roc_auc) FROM score_aucs) AS worst_value""", "score_aucs"))
def best_worst_model(spark, sf):
    return R.best_worst(score_aucs(spark, sf))


# rules over scored_obs: (classifier, details, attributes, Spark prediction, SQL prediction);
# the Spark side is built only when a median is given (needs a session).
def _rules(med1: float | None):
    spark_side = med1 is not None
    return [
        ("threshold", "p > 0.5", "p", binarize("p", 0.5) if spark_side else None,
         "CASE WHEN p > 0.5 THEN 1 ELSE 0 END"),
        ("threshold", "p > 0.4", "p", binarize("p", 0.4) if spark_side else None,
         "CASE WHEN p > 0.4 THEN 1 ELSE 0 END"),
        ("median_cut", "1/ln(p) < churn median", "p",
         binarize(inverse_log("p"), med1, strict_above=False) if spark_side else None,
         "CASE WHEN s < med1 THEN 1 ELSE 0 END"),
    ]


def _acc_sql(c, d, a, expr) -> str:
    return (f"SELECT '{c}' AS classifier, '{d}' AS details, '{a}' AS attributes, "
            f"round(avg(CASE WHEN label = ({expr}) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 2) "
            "AS accuracy FROM scored_s, class_medians")


register("rule_report", " UNION ALL ".join(_acc_sql(c, d, a, e) for c, d, a, _, e in _rules(None)),
         ["scored_s", "class_medians"])


def rule_report(spark, sf):
    so = scored_obs(spark, sf).withColumn("s", inverse_log("p"))
    med = class_medians(so)
    rows = [R.report_row(EV.accuracy_pct(so.withColumn("prediction", pred)), c, d, a)
            for c, d, a, pred, _ in _rules(med[1])]
    return R.append(*rows)


@query("report_append", with_ctes("SELECT * FROM rule_report", "rule_report"))
def report_append(spark, sf):
    return rule_report(spark, sf)


@query("report_insert_ordered", with_ctes("""
SELECT CAST(CASE WHEN pos >= 2 THEN pos + 1 ELSE pos END AS INTEGER) AS pos, classifier, details, accuracy
FROM (SELECT row_number() OVER (ORDER BY details) AS pos, * FROM rule_report)
UNION ALL
SELECT 2, 'threshold', 'p > 0.3',
       round(avg(CASE WHEN label = (CASE WHEN p > 0.3 THEN 1 ELSE 0 END) THEN 100.0::DOUBLE
                 ELSE 0.0::DOUBLE END), 2) FROM scored_obs""", "rule_report", "scored_obs"))
def report_insert_ordered(spark, sf):
    base = rule_report(spark, sf)
    base = base.withColumn("pos", F.row_number().over(Window.orderBy("details")).cast("int"))
    so = scored_obs(spark, sf)
    new = R.report_row(EV.accuracy_pct(so.withColumn("prediction", binarize("p", 0.3))),
                       "threshold", "p > 0.3", "p")
    return R.insert_at(base.drop("attributes"), new.drop("attributes"), 2).select(
        "pos", "classifier", "details", "accuracy")


# -- rows-only: real model runs -------------------------------------------------------

CLASSIFIERS = ["DecisionTree", "NaiveBayes", "RandomForest", "KNN", "SVM", "LogisticRegression"]


@query("report_skeleton")
def report_skeleton(spark, sf):
    ob = churn_obs(spark, sf)
    sets = R.append(
        S.select_pearson(ob, CHURN_FEATURES, "label").where("feature <> 'label'")
         .select(F.lit("pearsons").alias("feature_set"), "feature"),
        S.select_backward_ols(ob, CHURN_FEATURES, "label").where("selected")
         .select(F.lit("ols").alias("feature_set"), "feature"),
        S.select_rfe(ob, CHURN_FEATURES, "label", 3).where("selected")
         .select(F.lit("rfe").alias("feature_set"), "feature"),
        spark.createDataFrame([("full", f) for f in CHURN_FEATURES], "feature_set string, feature string"),
    )
    per_set = sets.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n_features"))
    return R.skeleton(per_set, CLASSIFIERS)


@query("model_report")
def model_report(spark, sf):
    tr, te = line_sets(spark, sf)
    sets = line_sets(spark, sf, scaled=True)
    trs, tes = sets
    attrs = "l_quantity,l_extendedprice,l_discount,l_tax"
    dt = M.scored(M.train_decision_tree(tr, max_depth=10), te, KEEP)
    rf = M.scored(M.train_random_forest(tr, num_trees=10, max_depth=6), te, KEEP)
    lr = M.scored(M.train_logistic(trs, sets.n_train), tes, KEEP)
    svm = M.scored(M.train_linear_svm(trs, sets.n_train), tes, KEEP, prob=False)
    nb = nb_predictions(spark, sf)
    return R.append(
        R.report_row(EV.accuracy_pct(nb), "NaiveBayes", "gaussian", ",".join(CHURN_FEATURES)),
        R.report_row(EV.accuracy_pct(dt), "DecisionTree", "entropy, depth 10", attrs),
        R.report_row(EV.accuracy_pct(rf), "RandomForest", "10 trees, depth 6", attrs),
        R.report_row(EV.accuracy_pct(lr), "LogisticRegression", "L2, C=1", attrs),
        R.report_row(EV.accuracy_pct(svm), "SVM", "linear, C=1", attrs),
    )


@query("model_scoreboard")
def model_scoreboard(spark, sf):
    model, tr, te = gbt_model(spark, sf)
    gbt = boosted_scores(model, te)
    rf = M.scored(M.train_random_forest(tr, num_trees=10, max_depth=6), te, KEEP)
    nb = nb_predictions(spark, sf)
    board = R.append(
        EV.roc_auc(gbt, "label", "p1").select(F.lit("GBM").alias("model"), "roc_auc"),
        EV.roc_auc_hard(rf).select(F.lit("RandomForest").alias("model"), "roc_auc"),
        EV.roc_auc_hard(nb).select(F.lit("NaiveBayes").alias("model"), "roc_auc"),
    )
    return R.ranked(board)

