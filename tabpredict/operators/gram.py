"""One distributed pass -> small cross-product matrices -> every linear fit.

``gram`` computes, per value of an optional key (train/test flag, fold),
G = Z'Z with Z = [1, x_1 - m_1, …, x_p - m_p, y - m_y]. Each task folds its
rows into one (p+2)² matrix with numpy (rows arrive as Arrow batches) and
emits only the upper triangle as (key, i, j, value); ``groupBy(key, i, j)``
sums them. What reaches the driver is keys × (p+2)², independent of the
row count. Shifting by the global means first keeps the sums well
conditioned.

From those matrices the driver solves, without touching the rows again:
Pearson correlations, OLS with standard errors and two-sided t p-values,
backward elimination on p-values, recursive elimination on |coef|, the
hold-out R² of every elimination size, and the Lasso path with k-fold
choice of alpha (covariance-form coordinate descent).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- the pass ------------------------------------------------------------------


@dataclass
class Gram:
    features: list[str]
    label: str
    shift: np.ndarray            # means of features then label (length p+1)
    mats: dict                   # key -> (p+2)x(p+2) matrix

    def total(self) -> np.ndarray:
        return sum(self.mats.values())

    def get(self, key=None) -> np.ndarray:
        return self.total() if key is None else self.mats.get(key, np.zeros_like(self.total()))

    def without(self, key) -> np.ndarray:
        return self.total() - self.get(key)

    @property
    def p(self) -> int:
        return len(self.features)


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[float | None]:
    """Pearson correlation of each pair over the rows that hold both (null and NaN
    are missing): one aggregate, whatever the other columns hold. None: undefined."""
    def present(c: str):
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)

    row = df.agg(*[F.corr(present(a), present(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [None if v is None or math.isnan(v) else v for v in row]


def gram(df: DataFrame, features: Sequence[str], label: str, key: str | None = None,
         on_null: str = "raise") -> Gram:
    """``on_null``: a row with a null or NaN raises (least squares has no rule for
    it), or with "drop" leaves the fit."""
    feats = list(features)
    cols = feats + [label]
    d = df.select(*([F.col(key).alias("__k")] if key else [F.lit(0).alias("__k")]),
                  *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # two passes (means, then the shifted Gram) read this compact projection:
    # keep it for the duration of this call only
    d = (d.dropna() if on_null == "drop" else d).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _gram_passes(d, feats, label, cols, key)
    finally:
        d.unpersist()


def _gram_passes(d: DataFrame, feats: list[str], label: str, cols: list[str],
                 key: str | None) -> Gram:
    gaps = F.count_if(F.greatest(*[(F.col(f"c{i}").isNull() | F.isnan(f"c{i}")).cast("int")
                                   for i in range(len(cols))], F.lit(0)) > 0)
    means = d.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(cols))], gaps.alias("gaps")).first()
    if means["gaps"]:
        raise ValueError(f"{means['gaps']} rows hold a null or NaN in {cols}: fill them, or pass on_null='drop'")
    shift = np.array([means[f"c{i}"] or 0.0 for i in range(len(cols))], dtype=float)
    q = len(cols) + 1
    iu, ju = np.triu_indices(q)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for b in batches:
            if b.empty:
                continue
            z = np.empty((len(b), q))
            z[:, 0] = 1.0
            z[:, 1:] = b[[f"c{i}" for i in range(q - 1)]].to_numpy(dtype=float) - shift
            for k, idx in b.groupby("__k").indices.items():
                zk = z[idx]
                acc[k] = acc.get(k, 0.0) + zk.T @ zk
        for k, m in acc.items():
            yield pd.DataFrame({"k": np.repeat(k, len(iu)).astype(np.int64), "i": iu.astype(np.int32),
                                "j": ju.astype(np.int32), "v": m[iu, ju]})

    parts = d.mapInPandas(part, "k long, i int, j int, v double")
    rows = parts.groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect()
    mats: dict = {}
    for r in rows:
        m = mats.setdefault(r["k"] if key else None, np.zeros((q, q)))
        m[r["i"], r["j"]] = r["v"]
        m[r["j"], r["i"]] = r["v"]
    if not mats:
        mats[None] = np.zeros((q, q))
    return Gram(feats, label, shift, mats)


# --- t distribution tail (no scipy) ------------------------------------------


def _betacf(a: float, b: float, x: float, itmax: int = 20000) -> float:
    """Continued fraction of the incomplete beta, modified Lentz."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if not math.isfinite(t):
        return 0.0 if not math.isnan(t) else float("nan")
    if dof <= 0:
        return float("nan")
    if dof > 1e7:  # normal limit; error O(1/dof)
        return math.erfc(abs(t) / math.sqrt(2.0))
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


# --- solves on the matrices -------------------------------------------------


@dataclass
class OLSFit:
    terms: list[str]          # 'const' first
    coef: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    n: float
    rss: float
    r2: float


def _design(g: Gram, idx: Sequence[int]) -> tuple[list[int], int]:
    return [0] + [1 + i for i in idx], g.p + 1


def ols(g: Gram, idx: Sequence[int] | None = None, key=None, mat: np.ndarray | None = None) -> OLSFit:
    """OLS of the label on the chosen features (+ intercept), raw scale."""
    idx = list(range(g.p)) if idx is None else list(idx)
    G = g.get(key) if mat is None else mat
    cols, yi = _design(g, idx)
    A = G[np.ix_(cols, cols)]
    b = G[cols, yi]
    n = G[0, 0]
    Ainv = np.linalg.pinv(A)
    beta = Ainv @ b
    rss = max(float(G[yi, yi] - 2 * beta @ b + beta @ A @ beta), 0.0)
    rank = np.linalg.matrix_rank(A)
    dof = n - rank
    sigma2 = rss / dof if dof > 0 else float("nan")
    cov = sigma2 * Ainv
    # back to the raw scale: intercept_raw = b0 + m_y - sum(beta_j m_j)
    m = g.shift[[i for i in idx]]
    T = np.eye(len(cols))
    T[0, 1:] = -m
    beta_raw = T @ beta
    beta_raw[0] += g.shift[-1]
    cov_raw = T @ cov @ T.T
    se = np.sqrt(np.maximum(np.diag(cov_raw), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        tv = beta_raw / se
    pv = np.array([t_two_sided_p(float(x), dof) for x in tv])
    sst = G[yi, yi] - G[0, yi] ** 2 / n if n > 0 else float("nan")
    r2 = 1.0 - rss / sst if sst > 0 else float("nan")
    return OLSFit(["const"] + [g.features[i] for i in idx], beta_raw, se, tv, pv, n, rss, r2)


def holdout_r2(g: Gram, idx: Sequence[int], train_key, test_key) -> float:
    """Fit on ``train_key`` rows, R² on ``test_key`` rows (both from one pass)."""
    Gtr, Gte = g.get(train_key), g.get(test_key)
    cols, yi = _design(g, idx)
    A = Gtr[np.ix_(cols, cols)]
    beta = np.linalg.pinv(A) @ Gtr[cols, yi]
    w = np.zeros(Gte.shape[0])
    w[cols] = -beta
    w[yi] = 1.0
    sse = float(w @ Gte @ w)
    n = Gte[0, 0]
    sst = Gte[yi, yi] - Gte[0, yi] ** 2 / n
    return 1.0 - sse / sst


def backward_elimination(g: Gram, alpha: float = 0.05) -> list[dict]:
    """Drop the feature with the highest p-value while it exceeds ``alpha``.
    Returns one record per feature: step dropped (None = kept), p-value."""
    cols = list(range(g.p))
    log = []
    step = 0
    while cols:
        fit = ols(g, cols)
        p = fit.p[1:]
        j = int(np.nanargmax(p))
        if p[j] > alpha:
            step += 1
            log.append({"feature": g.features[cols[j]], "step": step, "p_value": float(p[j]),
                        "selected": False})
            cols.pop(j)
        else:
            for k, c in enumerate(cols):
                log.append({"feature": g.features[c], "step": None, "p_value": float(p[k]),
                            "selected": True})
            break
    return log


def rfe_ranking(g: Gram, n_select: int = 1, key=None, mat: np.ndarray | None = None) -> list[dict]:
    """Recursive elimination with a linear fit: drop the smallest |coef|
    one at a time. rank 1 = kept; higher = eliminated earlier."""
    cols = list(range(g.p))
    G = g.get(key) if mat is None else mat
    order = []
    while len(cols) > n_select:
        fit = ols(g, cols, mat=G)
        j = int(np.argmin(np.abs(fit.coef[1:])))
        order.append(cols.pop(j))
    ranks = {c: 1 for c in cols}
    for i, c in enumerate(reversed(order)):
        ranks[c] = i + 2
    return [{"feature": g.features[c], "rank": ranks[c], "selected": ranks[c] == 1}
            for c in range(g.p)]


def rfe_size_sweep(g: Gram, train_key, test_key) -> list[dict]:
    """Hold-out R² for every subset size. Elimination is nested, so one
    ranking from the full model gives every size's subset."""
    Gtr = g.get(train_key)
    rk = rfe_ranking(g, 1, mat=Gtr)
    by_rank = sorted(range(g.p), key=lambda c: rk[c]["rank"])
    out = []
    for n in range(1, g.p + 1):
        idx = sorted(by_rank[:n])
        out.append({"n_features": n, "r2": holdout_r2(g, idx, train_key, test_key)})
    return out


def _centered(G: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    n = G[0, 0]
    s = G[0, 1:]
    C = G[1:, 1:] - np.outer(s, s) / n
    return C[:-1, :-1], C[:-1, -1], n, s / n


def lasso_cd(Q: np.ndarray, c: np.ndarray, n: float, alpha: float, beta0=None,
             tol: float = 1e-10, max_iter: int = 100000) -> np.ndarray:
    """min (1/2n)||y - Xb||² + alpha |b|_1 on centred data, from X'X and X'y."""
    p = len(c)
    beta = np.zeros(p) if beta0 is None else beta0.copy()
    diag = np.diag(Q)
    thr = n * alpha
    for _ in range(max_iter):
        biggest = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            rho = c[j] - Q[j] @ beta + diag[j] * beta[j]
            new = math.copysign(max(abs(rho) - thr, 0.0), rho) / diag[j]
            biggest = max(biggest, abs(new - beta[j]))
            beta[j] = new
        if biggest <= tol * max(1.0, float(np.max(np.abs(beta))) if p else 1.0):
            break
    return beta


def lasso_cv(g: Gram, folds: Sequence, n_alphas: int = 100, eps: float = 1e-3) -> dict:
    """k-fold choice of alpha on a log grid from alpha_max down to
    eps·alpha_max, then a refit on all rows. ``g`` must be keyed by fold."""
    Q, c, n, _ = _centered(g.total())
    alpha_max = float(np.max(np.abs(c))) / n if len(c) else 0.0
    alphas = np.logspace(math.log10(alpha_max * eps), math.log10(alpha_max), n_alphas)[::-1] \
        if alpha_max > 0 else np.array([0.0])
    mse = np.zeros((len(folds), len(alphas)))
    for fi, f in enumerate(folds):
        Gtr, Gte = g.without(f), g.get(f)
        Qt, ct, nt, mt = _centered(Gtr)
        beta = np.zeros(g.p)
        for ai, a in enumerate(alphas):
            beta = lasso_cd(Qt, ct, nt, a, beta)
            b0 = mt[-1] - mt[:-1] @ beta
            w = np.concatenate([[-b0], -beta, [1.0]])
            mse[fi, ai] = float(w @ Gte @ w) / Gte[0, 0]
    best = int(np.argmin(mse.mean(axis=0)))
    beta = np.zeros(g.p)
    for a in alphas[: best + 1]:
        beta = lasso_cd(Q, c, n, a, beta)
    return {"alpha": float(alphas[best]), "coef": beta, "alphas": alphas,
            "mse_path": mse.mean(axis=0)}


def correlations(g: Gram) -> tuple[list[str], np.ndarray]:
    """Pearson correlation of features and label from the total matrix."""
    G = g.total()
    n = G[0, 0]
    s = G[0, 1:]
    C = G[1:, 1:] - np.outer(s, s) / n
    d = np.sqrt(np.diag(C))
    with np.errstate(divide="ignore", invalid="ignore"):
        R = C / np.outer(d, d)
    return g.features + [g.label], R
