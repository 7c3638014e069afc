"""Queries: model training and scoring on the hold-out rows."""

from __future__ import annotations

from ..operators import evaluate as EV
from ..operators.bayes import fit_gaussian_nb
from ..sources.tables import CHURN_FEATURES
from .fixtures_sql import register, with_ctes
from .q_profile import churn_split
from .registry import query

F_ = CHURN_FEATURES


def _nb_sql() -> str:
    stats = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in F_)
    register("nb_st", f"SELECT label AS c, count(*) AS n, {stats} FROM churn_split "
                      "WHERE is_test = 0 GROUP BY label", ["churn_split"])
    register("nb_tot", f"SELECT 1e-9 * greatest({', '.join(f'var_pop({f})' for f in F_)}) AS eps, "
                       "count(*) AS n FROM churn_split WHERE is_test = 0", ["churn_split"])
    terms = " + ".join(
        f"(-0.5 * ln(2 * pi() * (v_{f} + eps))) + (-0.5 / (v_{f} + eps)) * (t.{f} - m_{f}) * (t.{f} - m_{f})"
        for f in F_)
    register("nb_scores", f"""
SELECT t.row_id, t.label, st.c, ln(st.n / tot.n) + {terms} AS jll
FROM churn_split t, nb_st st, nb_tot tot WHERE t.is_test = 1""", ["churn_split", "nb_st", "nb_tot"])
    register("nb_pred", """
SELECT row_id, label, c AS prediction FROM
  (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY jll DESC, c) AS rn FROM nb_scores)
WHERE rn = 1""", ["nb_scores"])
    return with_ctes("SELECT row_id, label, prediction FROM nb_pred", "nb_pred")


def nb_predictions(spark, sf):
    d = churn_split(spark, sf)
    model = fit_gaussian_nb(d.where("is_test = 0"), F_, "label")
    return model.transform(d.where("is_test = 1")).select("row_id", "label", "prediction")


@query("train_gaussian_nb", _nb_sql())
def train_gaussian_nb(spark, sf):
    return nb_predictions(spark, sf)


@query("nb_confusion_matrix", with_ctes("""
SELECT a.actual, a.predicted, count(s.row_id) AS n
FROM (SELECT CAST(x AS INTEGER) AS actual, CAST(y AS INTEGER) AS predicted
      FROM (VALUES (0), (1)) t1(x), (VALUES (0), (1)) t2(y)) a
LEFT JOIN nb_pred s ON s.label = a.actual AND s.prediction = a.predicted
GROUP BY a.actual, a.predicted""", "nb_pred"))
def flagship(spark, sf):
    """churn_obs -> exact-size hold-out -> Gaussian NB -> confusion matrix."""
    return EV.confusion_matrix(nb_predictions(spark, sf))
