"""Feature selection as DataFrames: Pearson filter, OLS summary, backward
elimination, recursive elimination (and its size sweep), Lasso with k-fold
alpha, top-k by tree importance, union of selected lists.

All linear ones share one ``gram`` pass; results are p-sized tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gram as G


def _df(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def corr_matrix(df: DataFrame, features: Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """Long-form Pearson matrix over features and the label; each pair over the
    rows that hold both. Null where undefined (constant or no rows)."""
    names = [*features, label]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    of = {}
    for (a, b), v in zip(pairs, G.pair_correlations(df, pairs)):
        of[a, b] = of[b, a] = None if v is None else round(v, digits)
    rows = [(a, b, of[a, b]) for a in names for b in names]
    return _df(df.sparkSession, rows, "feature_a string, feature_b string, corr double")


def select_pearson(df: DataFrame, features: Sequence[str], label: str, threshold: float = 0.05,
                   digits: int = 6) -> DataFrame:
    """Columns whose |corr with label| exceeds ``threshold`` (label itself
    included, as a correlation-table filter yields it)."""
    names = [*features, label]
    found = G.pair_correlations(df, [(n, label) for n in names])
    rows = [(n, round(abs(v), digits)) for n, v in zip(names, found) if v is not None and abs(v) > threshold]
    return _df(df.sparkSession, rows, "feature string, abs_corr double")


def ols_summary(df: DataFrame, features: Sequence[str], label: str, digits: int = 6,
                with_p: bool = True) -> DataFrame:
    fit = G.ols(G.gram(df, features, label))
    rows = []
    for i, t in enumerate(fit.terms):
        r = [t, float(round(fit.coef[i], digits)), float(round(fit.se[i], digits)),
             float(round(fit.t[i], digits))]
        if with_p:
            r.append(float(fit.p[i]))
        rows.append(tuple(r))
    schema = "term string, coef double, std_err double, t_value double"
    return _df(df.sparkSession, rows, schema + (", p_value double" if with_p else ""))


def select_backward_ols(df: DataFrame, features: Sequence[str], label: str,
                        alpha: float = 0.05) -> DataFrame:
    log = G.backward_elimination(G.gram(df, features, label), alpha)
    rows = [(r["feature"], r["step"], round(r["p_value"], 4), r["selected"]) for r in log]
    return _df(df.sparkSession, rows, "feature string, step int, p_value double, selected boolean")


def select_rfe(df: DataFrame, features: Sequence[str], label: str, n_select: int) -> DataFrame:
    rk = G.rfe_ranking(G.gram(df, features, label), n_select)
    return _df(df.sparkSession, [(r["feature"], r["rank"], r["selected"]) for r in rk],
               "feature string, rank int, selected boolean")


def rfe_size_sweep(df: DataFrame, features: Sequence[str], label: str, split: str,
                   digits: int = 6) -> DataFrame:
    """Hold-out R² per subset size; ``split`` = 1 marks test rows."""
    g = G.gram(df, features, label, key=split)
    sw = G.rfe_size_sweep(g, 0, 1)
    best = max(sw, key=lambda r: (r["r2"], -r["n_features"]))["n_features"]
    return _df(df.sparkSession, [(r["n_features"], float(round(r["r2"], digits)),
                                  r["n_features"] == best) for r in sw],
               "n_features int, r2 double, best boolean")


def select_lasso(df: DataFrame, features: Sequence[str], label: str, fold: str,
                 folds: Sequence[int] = (0, 1, 2, 3, 4), digits: int = 6) -> DataFrame:
    g = G.gram(df, features, label, key=fold)
    res = G.lasso_cv(g, list(folds))
    rows = [(f, float(round(res["coef"][i], digits)), bool(res["coef"][i] != 0.0),
             float(res["alpha"])) for i, f in enumerate(g.features)]
    return _df(df.sparkSession, rows, "feature string, coef double, selected boolean, alpha double")


def feature_union(*lists: DataFrame) -> DataFrame:
    """Distinct union of several one-column (feature) tables."""
    out = lists[0].select("feature")
    for d in lists[1:]:
        out = out.unionByName(d.select("feature"))
    return out.distinct()


def top_k(importance: DataFrame, k: int, value: str = "importance",
          name: str = "feature") -> DataFrame:
    """Highest ``value`` first, ties by name; the limit is the feature."""
    return importance.orderBy(F.desc(value), F.asc(name)).limit(k)
