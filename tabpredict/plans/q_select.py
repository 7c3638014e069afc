"""Queries: correlation, OLS, and the feature selectors (one Gram pass each)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import gram as G
from ..operators import select as S
from ..operators.split import assign_folds, split_holdout
from ..sources.tables import CHURN_FEATURES, churn_obs
from .fixtures_sql import with_ctes
from .q_profile import churn_split
from .registry import query

COLS = CHURN_FEATURES + ["label"]


def _corr_sql() -> str:
    parts = [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr "
             "FROM churn_obs" for a in COLS for b in COLS]
    return with_ctes(" UNION ALL ".join(parts), "churn_obs")


@query("corr_matrix", _corr_sql())
def corr_matrix(spark, sf):
    return S.corr_matrix(churn_obs(spark, sf), CHURN_FEATURES, "label")


def _pearson_sql() -> str:
    parts = [f"SELECT '{a}' AS feature, round(abs(corr({a}, label)), 6) AS abs_corr, "
             f"abs(corr({a}, label)) AS raw FROM churn_obs" for a in COLS]
    return with_ctes("SELECT feature, abs_corr FROM (" + " UNION ALL ".join(parts)
                     + ") WHERE raw > 0.05", "churn_obs")


@query("select_pearson", _pearson_sql())
def select_pearson(spark, sf):
    return S.select_pearson(churn_obs(spark, sf), CHURN_FEATURES, "label", 0.05)


OLS_X = "recency"


@query("ols_summary", with_ctes(f"""
SELECT term, round(coef, 6) AS coef, round(se, 6) AS std_err, round(coef / se, 6) AS t_value FROM (
  SELECT 'const' AS term, b0 AS coef, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se FROM r
  UNION ALL SELECT '{OLS_X}', b1, sqrt(s2 / sxx) FROM r)""", "churn_obs", extra=[
    ("s", f"SELECT regr_slope(label, {OLS_X}) AS b1, regr_intercept(label, {OLS_X}) AS b0, "
          f"regr_count(label, {OLS_X}) AS n, regr_sxx(label, {OLS_X}) AS sxx, "
          f"regr_sxy(label, {OLS_X}) AS sxy, regr_syy(label, {OLS_X}) AS syy, "
          f"regr_avgx(label, {OLS_X}) AS mx FROM churn_obs"),
    ("r", "SELECT *, (syy - b1 * sxy) / (n - 2) AS s2 FROM s")]))
def ols_summary(spark, sf):
    return S.ols_summary(churn_obs(spark, sf), [OLS_X], "label", with_p=False)


@query("r2_score", with_ctes(f"""
SELECT round(1 - sum((label - (b0 + b1 * {OLS_X})) * (label - (b0 + b1 * {OLS_X})))
             / (sum(label * label) - sum(label) * sum(label) / count(*)::DOUBLE), 6) AS r2
FROM churn_split, (SELECT regr_slope(label, {OLS_X}) AS b1, regr_intercept(label, {OLS_X}) AS b0
                   FROM churn_split WHERE is_test = 0) f
WHERE is_test = 1""", "churn_split"))
def r2_score(spark, sf):
    d = churn_split(spark, sf)
    fit = G.ols(G.gram(d.where("is_test = 0"), [OLS_X], "label"))
    pred = F.lit(float(fit.coef[0])) + F.lit(float(fit.coef[1])) * F.col(OLS_X)
    return EV.r2_score(d.where("is_test = 1").withColumn("pred", pred), "label", "pred")


@query("ols_pvalues")
def ols_pvalues(spark, sf):
    return S.ols_summary(churn_obs(spark, sf), CHURN_FEATURES, "label")


@query("select_backward_ols")
def select_backward_ols(spark, sf):
    return S.select_backward_ols(churn_obs(spark, sf), CHURN_FEATURES, "label", 0.05)


@query("select_rfe")
def select_rfe(spark, sf):
    return S.select_rfe(churn_obs(spark, sf), CHURN_FEATURES, "label", 3)


@query("rfe_size_sweep")
def rfe_size_sweep(spark, sf):
    d = split_holdout(churn_obs(spark, sf), "row_id", 0.3, 0)
    return S.rfe_size_sweep(d, CHURN_FEATURES, "label", "is_test")


def lasso_table(spark, sf):
    d = assign_folds(churn_obs(spark, sf), "row_id", 5)
    return S.select_lasso(d, CHURN_FEATURES, "label", "fold")


@query("select_lasso")
def select_lasso(spark, sf):
    return lasso_table(spark, sf)


@query("feature_union")
def feature_union(spark, sf):
    ob = churn_obs(spark, sf)
    pear = S.select_pearson(ob, CHURN_FEATURES, "label").where(F.col("feature") != "label")
    back = S.select_backward_ols(ob, CHURN_FEATURES, "label").where("selected")
    rfe = S.select_rfe(ob, CHURN_FEATURES, "label", 3).where("selected")
    las = lasso_table(spark, sf).where("selected")
    return S.feature_union(pear, back, rfe, las)


# -- T1 on a data-derived importance table, F6 closed form for one feature ----

@query("top_k_corr_importance", with_ctes(
    "SELECT feature, importance FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, round(abs(corr({a}, label)), 6) AS importance FROM churn_obs"
        for a in CHURN_FEATURES) + ") ORDER BY importance DESC, feature LIMIT 3", "churn_obs"))
def top_k_corr_importance(spark, sf):
    """Top 3 features by |Pearson correlation| with the label."""
    pear = S.select_pearson(churn_obs(spark, sf), CHURN_FEATURES, "label", threshold=-1.0)
    imp = pear.where(F.col("feature") != "label").select("feature", F.col("abs_corr").alias("importance"))
    return S.top_k(imp, 3)


LASSO_X = "recency"


@query("lasso_one_feature", with_ctes(f"""
SELECT '{LASSO_X}' AS feature, round(alpha, 9) AS alpha,
       round(sign(sxy) * greatest(abs(sxy) / n - alpha, 0) / (sxx / n), 9) AS coef
FROM (SELECT *, 0.5 * abs(sxy) / n AS alpha FROM
      (SELECT regr_sxy(label, {LASSO_X}) AS sxy, regr_sxx(label, {LASSO_X}) AS sxx,
              regr_count(label, {LASSO_X}) AS n FROM churn_obs))""", "churn_obs"))
def lasso_one_feature(spark, sf):
    """Lasso on one feature at half of the smallest alpha that zeroes it,
    by coordinate descent on the Gram matrix (closed form in the twin)."""
    g = G.gram(churn_obs(spark, sf), [LASSO_X], "label")
    Q, c, n, _ = G._centered(g.total())
    alpha = float(0.5 * abs(float(c[0])) / n)
    beta = G.lasso_cd(Q, c, n, alpha)
    return spark.createDataFrame([(LASSO_X, round(alpha, 9), round(float(beta[0]), 9))],
                                 "feature string, alpha double, coef double")
