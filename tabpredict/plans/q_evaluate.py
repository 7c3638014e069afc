"""Queries: evaluation of a fixed score (scored_obs) — binarising, the
1/ln(p) transform and its class medians, confusion matrix, report, rates,
ROC / AUC, Youden cut, log-loss, histogram and density."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import binarize, inverse_log
from ..operators import evaluate as EV
from ..operators import profile as PR
from ..operators.orderstat import grouped_quantiles
from ..sources.tables import scored_obs
from .fixtures_sql import register, with_ctes
from .registry import query


def scored_s(spark, sf):
    return scored_obs(spark, sf).withColumn("s", inverse_log("p"))


def scored_pred(spark, sf):
    return scored_obs(spark, sf).withColumn("prediction", binarize("p", 0.5))


def class_medians(df):
    med = grouped_quantiles(df, "label", "s", [0.5])
    return {k: v[0] for k, v in med.items()}


register("scored_pred", "SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM scored_obs",
         ["scored_obs"])
register("roc_g", """
SELECT CAST(p AS DOUBLE) AS threshold, count(*) FILTER (WHERE label = 1) AS tp,
       count(*) FILTER (WHERE label <> 1) AS fp FROM scored_obs GROUP BY p""", ["scored_obs"])
register("roc_c", """
SELECT threshold, tp, fp, sum(tp) OVER (ORDER BY threshold DESC) AS ctp,
       sum(fp) OVER (ORDER BY threshold DESC) AS cfp FROM roc_g""", ["roc_g"])
register("roc_t", "SELECT sum(tp) AS P, sum(fp) AS N FROM roc_g", ["roc_g"])


# -- P13, P14, A8, P15, P16, A2 ------------------------------------------------

@query("binarize_half", with_ctes("SELECT row_id, label, prediction FROM scored_pred", "scored_pred"))
def binarize_half(spark, sf):
    return scored_pred(spark, sf).select("row_id", "label", "prediction")


@query("score_inverse_log", with_ctes(
    "SELECT row_id, label, round(s, 6) AS s FROM scored_s", "scored_s"))
def score_inverse_log(spark, sf):
    return scored_s(spark, sf).select("row_id", "label", F.round("s", 6).alias("s"))


@query("class_median_score", with_ctes(
    "SELECT label, round(quantile_cont(s, 0.5), 6) AS median_s FROM scored_s GROUP BY label",
    "scored_s"))
def class_median_score(spark, sf):
    med = class_medians(scored_s(spark, sf))
    rows = [(int(k), float(v)) for k, v in med.items()]
    return spark.createDataFrame(rows, "label int, median_s double").select(
        "label", F.round("median_s", 6).alias("median_s"))


@query("binarize_median", with_ctes(
    "SELECT row_id, label, CASE WHEN s < med0 THEN 1 ELSE 0 END AS pred_mnc, "
    "CASE WHEN s < med1 THEN 1 ELSE 0 END AS pred_mc FROM scored_s, class_medians",
    "scored_s", "class_medians"))
def binarize_median(spark, sf):
    d = scored_s(spark, sf)
    med = class_medians(d)
    return d.select("row_id", "label", binarize("s", med.get(0), strict_above=False).alias("pred_mnc"),
                    binarize("s", med.get(1), strict_above=False).alias("pred_mc"))


@query("segment_at_risk", with_ctes(
    "SELECT row_id, label, round(s, 6) AS s FROM scored_s, class_medians WHERE s <= med0",
    "scored_s", "class_medians"))
def segment_at_risk(spark, sf):
    d = scored_s(spark, sf)
    med = class_medians(d)
    return d.where(F.col("s") <= F.lit(med.get(0))).select("row_id", "label", F.round("s", 6).alias("s"))


@query("segment_class_share", with_ctes(
    "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share "
    "FROM scored_s, class_medians WHERE s <= med1 GROUP BY label", "scored_s", "class_medians"))
def segment_class_share(spark, sf):
    d = scored_s(spark, sf)
    med = class_medians(d)
    return PR.segment_class_share(d.where(F.col("s") <= F.lit(med.get(1))), "label")


# -- E1 - E3, E6, E8, E9 ---------------------------------------------------------

@query("confusion_matrix", with_ctes("""
SELECT a.actual, a.predicted, count(s.row_id) AS n
FROM (SELECT CAST(x AS INTEGER) AS actual, CAST(y AS INTEGER) AS predicted
      FROM (VALUES (0), (1)) t1(x), (VALUES (0), (1)) t2(y)) a
LEFT JOIN scored_pred s ON s.label = a.actual AND s.prediction = a.predicted
GROUP BY a.actual, a.predicted""", "scored_pred"))
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(scored_pred(spark, sf))


register("cls_counts", """
SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tp_0,
       count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp_1,
       count(*) FILTER (WHERE prediction = 0) AS pp_0, count(*) FILTER (WHERE prediction = 1) AS pp_1,
       count(*) FILTER (WHERE label = 0) AS sup_0, count(*) FILTER (WHERE label = 1) AS sup_1,
       count(*) AS total FROM scored_pred""", ["scored_pred"])
register("cls_rows", """
SELECT c AS class, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
       CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS recall, sup AS support, total, acc
FROM (SELECT '0' AS c, tp_0::DOUBLE AS tp, pp_0 AS pp, sup_0 AS sup, total,
             (tp_0 + tp_1) / total::DOUBLE AS acc FROM cls_counts
      UNION ALL
      SELECT '1', tp_1::DOUBLE, pp_1, sup_1, total, (tp_0 + tp_1) / total::DOUBLE FROM cls_counts)""",
         ["cls_counts"])
register("cls_f1", """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
          ELSE 0.0 END AS f1 FROM cls_rows""", ["cls_rows"])


@query("classification_report", with_ctes("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM cls_f1
UNION ALL SELECT 'accuracy', NULL, NULL, round(max(acc), 6), CAST(sum(support) AS BIGINT) FROM cls_f1
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM cls_f1
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM cls_f1""",
    "cls_f1"))
def classification_report(spark, sf):
    return EV.classification_report(scored_pred(spark, sf))


register("rates", """
SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
       count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
       count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn,
       count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp FROM scored_pred""", ["scored_pred"])


@query("tpr_tnr", with_ctes(
    "SELECT tp, fn, tn, fp, round(tp / (tp + fn)::DOUBLE, 6) AS tpr, "
    "round(tn / (tn + fp)::DOUBLE, 6) AS tnr FROM rates", "rates"))
def tpr_tnr(spark, sf):
    return EV.tpr_tnr(scored_pred(spark, sf))


@query("roc_auc_hard", with_ctes(
    "SELECT round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS roc_auc FROM rates",
    "rates"))
def roc_auc_hard(spark, sf):
    return EV.roc_auc_hard(scored_pred(spark, sf))


@query("log_loss", with_ctes(
    "SELECT round(-avg(label * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - label) * "
    "ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM scored_obs", "scored_obs"))
def log_loss(spark, sf):
    return EV.log_loss(scored_obs(spark, sf), "label", "p")


@query("accuracy_pct", with_ctes(
    "SELECT round(avg(CASE WHEN label = prediction THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 2) "
    "AS accuracy FROM scored_pred", "scored_pred"))
def accuracy_pct(spark, sf):
    return EV.accuracy_pct(scored_pred(spark, sf))


# -- E4, E5, T3, E7 --------------------------------------------------------------

@query("roc_curve", with_ctes("""
SELECT threshold, round(cfp / N, 6) AS fpr, round(ctp / P, 6) AS tpr FROM roc_c, roc_t
UNION ALL SELECT NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""", "roc_c", "roc_t"))
def roc_curve(spark, sf):
    return EV.roc_curve(scored_obs(spark, sf), "label", "p")


@query("roc_auc", with_ctes(
    "SELECT round(sum(fp * (2 * ctp - tp)) / (2.0 * max(P) * max(N)), 6) AS roc_auc "
    "FROM roc_c, roc_t", "roc_c", "roc_t"))
def roc_auc(spark, sf):
    return EV.roc_auc(scored_obs(spark, sf), "label", "p")


@query("youden_threshold", with_ctes(
    "SELECT round(threshold, 6) AS threshold, round(j, 6) AS youden_j FROM "
    "(SELECT threshold, ctp / P - cfp / N AS j FROM roc_c, roc_t) ORDER BY j DESC, threshold DESC "
    "LIMIT 1", "roc_c", "roc_t"))
def youden_threshold(spark, sf):
    return EV.youden_threshold(scored_obs(spark, sf), "label", "p")


register("cut_cls", "SELECT label, CASE WHEN s < med1 THEN 1 ELSE 0 END AS cls, 0 AS zero "
                    "FROM scored_s, class_medians",
         ["scored_s", "class_medians"])


def _roc_sql_of(src: str, score: str, curve: str) -> str:
    return f"""
SELECT '{curve}' AS curve, threshold, round(cfp / N, 6) AS fpr, round(ctp / P, 6) AS tpr FROM
 (SELECT threshold, sum(tp) OVER (ORDER BY threshold DESC) AS ctp,
         sum(fp) OVER (ORDER BY threshold DESC) AS cfp, sum(tp) OVER () AS P, sum(fp) OVER () AS N
  FROM (SELECT CAST({score} AS DOUBLE) AS threshold, count(*) FILTER (WHERE label = 1) AS tp,
               count(*) FILTER (WHERE label <> 1) AS fp FROM {src} GROUP BY {score}))
UNION ALL SELECT '{curve}', NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"""


@query("roc_at_cut", with_ctes(_roc_sql_of("cut_cls", "cls", "model") + " UNION ALL "
                               + _roc_sql_of("cut_cls", "zero", "no_skill"), "cut_cls"))
def roc_at_cut(spark, sf):
    d = scored_s(spark, sf)
    med = class_medians(d)
    return EV.roc_at_cut(d, "label", "s", med[1])


# -- A11 ---------------------------------------------------------------------------

@query("score_histogram", with_ctes("""
SELECT label, bin, round(lo + bin * w, 6) AS bin_lo, round(lo + (bin + 1) * w, 6) AS bin_hi,
       count(*) AS n
FROM (SELECT label, CAST(least(floor((s - lo) / w), 19) AS INTEGER) AS bin, lo, w
      FROM scored_s, (SELECT min(s) AS lo, (max(s) - min(s)) / 20 AS w FROM scored_s))
GROUP BY label, bin, lo, w""", "scored_s"))
def score_histogram(spark, sf):
    return EV.score_histogram(scored_s(spark, sf), "s", by="label", bins=20)


@query("score_density", with_ctes("""
SELECT label, CAST(i AS INTEGER) AS grid_index, round(x, 6) AS x,
       round(sum(exp(-0.5 * z * z) / (h * n * sqrt(2 * pi()))), 6) AS density
FROM (SELECT d.label, g.i, mm.lo + g.i * mm.step AS x, bw.h, bw.n,
             (mm.lo + g.i * mm.step - d.s) / bw.h AS z
      FROM scored_s d
      JOIN (SELECT label, stddev_samp(s) * pow(count(*), -0.2) AS h, count(*)::DOUBLE AS n
            FROM scored_s GROUP BY label) bw ON d.label = bw.label,
           (SELECT min(s) AS lo, (max(s) - min(s)) / 49 AS step FROM scored_s) mm,
           (SELECT range AS i FROM range(50)) g)
GROUP BY label, i, x""", "scored_s"))
def score_density(spark, sf):
    return EV.score_density(scored_s(spark, sf), "s", by="label", grid=50)


# -- J1 --------------------------------------------------------------------------

@query("pair_truth_prediction", with_ctes(
    "SELECT a.row_id, a.label AS true_value, b.p AS predicted_value FROM scored_obs a "
    "JOIN scored_obs b ON a.row_id = b.row_id WHERE b.p > 0.2", "scored_obs"))
def pair_truth_prediction(spark, sf):
    """Truth and (some rows') predictions, from two tables, aligned on their key."""
    d = scored_obs(spark, sf)
    return EV.pair(d.select("row_id", "label"), d.where("p > 0.2").select("row_id", "p"), "row_id", "label", "p")
