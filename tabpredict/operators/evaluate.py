"""Evaluation of scored rows: confusion matrix, per-class report, rates,
ROC curve and area, log-loss, accuracy, R², Youden cut, score histogram
and kernel density.

Every metric is one aggregate pass (map-side partial aggregation, a
handful of rows per task to the reducer). The ROC curve needs a running
sum over descending scores; it uses ``ranged_cumsum`` so no step gathers
all distinct scores into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, clip_prob
from ..session import shared_dir
from .ranged import ranged_cumsum


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction",
                     labels: Sequence[int] = (0, 1)) -> dict[tuple[int, int], int]:
    row = confusion_matrix(df, label, pred, labels).collect()
    return {(r["actual"], r["predicted"]): r["n"] for r in row}


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(actual, predicted, n) for every pair of ``labels``, zeros kept."""
    aggs = []
    for a in labels:
        for p in labels:
            aggs.append(F.count_if((F.col(label) == a) & (F.col(pred) == p))
                        .alias(f"c_{a}_{p}"))
    wide = df.agg(*aggs)
    parts = ", ".join(f"{a}, {p}, c_{a}_{p}" for a in labels for p in labels)
    return wide.selectExpr(f"stack({len(labels) ** 2}, {parts}) as (actual, predicted, n)") \
        .select(F.col("actual").cast("int"), F.col("predicted").cast("int"),
                F.col("n").cast("bigint"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          labels: Sequence[int] = (0, 1), digits: int = 6) -> DataFrame:
    """Rows: each class, 'accuracy', 'macro avg', 'weighted avg'; columns
    precision, recall, f1, support. Undefined ratios are 0."""
    cm = confusion_matrix(df, label, pred, labels)
    # precision/recall per class from the (tiny) matrix
    per = cm.groupBy().agg(*(
        [F.sum(F.when((F.col("actual") == c) & (F.col("predicted") == c), F.col("n"))
               .otherwise(0)).alias(f"tp_{c}") for c in labels]
        + [F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias(f"pp_{c}")
           for c in labels]
        + [F.sum(F.when(F.col("actual") == c, F.col("n")).otherwise(0)).alias(f"sup_{c}")
           for c in labels]
        + [F.sum("n").alias("total")]))

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    rows = []
    for c in labels:
        p = ratio(f"tp_{c}", f"pp_{c}")
        r = ratio(f"tp_{c}", f"sup_{c}")
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(str(c)).alias("class"), p.alias("precision"),
                             r.alias("recall"), f1.alias("f1"),
                             F.col(f"sup_{c}").alias("support")))
    arr = F.array(*rows)
    t = per.select(F.explode(arr).alias("r"), "total",
                   *[F.col(f"tp_{c}") for c in labels])
    t = t.select("r.*", "total", *[f"tp_{c}" for c in labels])
    acc = sum(F.col(f"tp_{c}") for c in labels) / F.col("total")
    base = t.select("class", "precision", "recall", "f1", "support")
    summ = t.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("n"), F.first(acc).alias("acc"))
    extra = summ.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")),
    )).alias("r")).select("r.*")
    out = base.unionByName(extra)
    return out.select("class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint"))


def tpr_tnr(df: DataFrame, label: str = "label", pred: str = "prediction",
            digits: int = 6) -> DataFrame:
    """tp, fn, tn, fp and TPR = tp/(tp+fn), TNR = tn/(tn+fp) (null if undefined)."""
    y, p = F.col(label), F.col(pred)
    a = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 1) & (p != 1)).alias("fn"),
               F.count_if((y != 1) & (p != 1)).alias("tn"), F.count_if((y != 1) & (p == 1)).alias("fp"))
    return a.select(
        *[F.col(c).cast("bigint") for c in ("tp", "fn", "tn", "fp")],
        F.round(F.try_divide(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double")), digits).alias("tpr"),
        F.round(F.try_divide(F.col("tn"), (F.col("tn") + F.col("fp")).cast("double")), digits).alias("tnr"))


def roc_auc_hard(df: DataFrame, label: str = "label", pred: str = "prediction",
                 digits: int = 6) -> DataFrame:
    """ROC-AUC of hard 0/1 predictions: (TPR + TNR) / 2."""
    r = tpr_tnr(df, label, pred, digits=15)
    return r.select(F.round((F.col("tpr") + F.col("tnr")) / 2, digits).alias("roc_auc"))


def accuracy_pct(df: DataFrame, label: str = "label", pred: str = "prediction",
                 digits: int = 2) -> DataFrame:
    """round(100 * share of rows with prediction == label, digits)."""
    return df.agg(F.round(F.avg(F.when(F.col(label) == F.col(pred), 100.0).otherwise(0.0)),
                          digits).alias("accuracy"))


def log_loss(df: DataFrame, label: str = "label", prob: str = "p", eps: float = EPS,
             digits: int = 6) -> DataFrame:
    p = clip_prob(prob, eps)
    y = F.col(label)
    return df.agg(F.round(-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p)), digits).alias("log_loss"))


def r2_score(df: DataFrame, label: str = "label", pred: str = "prediction",
             digits: int = 6) -> DataFrame:
    """1 - SSE/SST in one pass (SST from sums of y and y²)."""
    y, p = F.col(label).cast("double"), F.col(pred)
    a = df.agg(F.sum((y - p) ** 2).alias("sse"), F.sum(y).alias("sy"),
               F.sum(y * y).alias("syy"), F.count(F.lit(1)).alias("n"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return a.select(F.round(1 - F.col("sse") / sst, digits).alias("r2"))


# -- ROC ---------------------------------------------------------------------

def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).cast("bigint").alias("tp"),
        F.count_if(F.col(label) != 1).cast("bigint").alias("fp"))


def roc_points(df: DataFrame, label: str = "label", score: str = "p") -> tuple[DataFrame, int, int]:
    """Per distinct score (descending): tp, fp at that score and cumulative
    cum_tp, cum_fp. Returns (points, P, N)."""
    # one pass over the rows; the per-score table (at most one row per
    # distinct score) is checkpointed, so the totals, the range cuts and
    # the running sums read it instead of the rows
    shared_dir(df.sparkSession)
    g = _score_counts(df, label, score).checkpoint()
    tot = g.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"),
                F.count(F.lit(1)).alias("k")).first()
    P, N = int(tot["P"] or 0), int(tot["N"] or 0)
    return ranged_cumsum(g, "threshold", ["tp", "fp"], descending=True, n=tot["k"]), P, N


def roc_curve(df: DataFrame, label: str = "label", score: str = "p", digits: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score plus the (0, 0) start
    (threshold null). Rates are null when a class is absent."""
    pts, P, N = roc_points(df, label, score)
    tpr = F.col("cum_tp") / F.lit(P) if P else F.lit(None).cast("double")
    fpr = F.col("cum_fp") / F.lit(N) if N else F.lit(None).cast("double")
    curve = pts.select("threshold", F.round(fpr, digits).alias("fpr"),
                       F.round(tpr, digits).alias("tpr"))
    start = pts.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"))
    return curve.unionByName(start)


def roc_auc(df: DataFrame, label: str = "label", score: str = "p", digits: int = 6) -> DataFrame:
    """Trapezoid area under the ROC curve of a continuous score (ties share
    a diagonal segment, as in the rank formula). The pairs are summed in 38
    digits: their number passes 64 bits from some 2e9 rows a class."""
    pts, P, N = roc_points(df, label, score)
    if P == 0 or N == 0:
        return pts.sparkSession.range(1).select(F.lit(None).cast("double").alias("roc_auc"))
    area = F.sum(F.col("fp").cast("decimal(18,0)") * (2 * F.col("cum_tp") - F.col("tp")).cast("decimal(19,0)"))
    return pts.agg(F.round(area.cast("double") / F.lit(2.0 * P * N), digits).alias("roc_auc"))


def youden_threshold(df: DataFrame, label: str = "label", score: str = "p",
                     digits: int = 6) -> DataFrame:
    """Threshold maximising TPR - FPR; ties go to the highest threshold."""
    pts, P, N = roc_points(df, label, score)
    j = F.col("cum_tp") / F.lit(max(P, 1)) - F.col("cum_fp") / F.lit(max(N, 1))
    best = pts.select("threshold", j.alias("j")).agg(
        F.max(F.struct(F.col("j"), F.col("threshold"))).alias("b"))
    return best.select(F.round(F.col("b.threshold"), digits).alias("threshold"),
                       F.round(F.col("b.j"), digits).alias("youden_j"))


def roc_at_cut(df: DataFrame, label: str = "label", score: str = "s", cut: float = 0.0,
               digits: int = 6) -> DataFrame:
    """ROC of the score binarised at ``score < cut`` plus the no-skill curve
    (constant score): rows (curve, threshold, fpr, tpr)."""
    bin_ = df.select(label, F.when(F.col(score) < F.lit(cut), 1).otherwise(0).alias("cls"),
                     F.lit(0).alias("zero"))
    a = roc_curve(bin_, label, "cls", digits).withColumn("curve", F.lit("model"))
    b = roc_curve(bin_, label, "zero", digits).withColumn("curve", F.lit("no_skill"))
    return a.unionByName(b)


def pair(truth: DataFrame, predicted: DataFrame, key: str, label: str, prediction: str) -> DataFrame:
    """Inner join of truth and prediction on their key: (key, true_value,
    predicted_value). Rows without a partner go; a key repeated on either side pairs
    with each of the other's rows."""
    return truth.select(key, F.col(label).alias("true_value")).join(
        predicted.select(key, F.col(prediction).alias("predicted_value")), key)


# -- distributions of a score -----------------------------------------------

def score_histogram(df: DataFrame, score: str, by: str | None = None, bins: int = 20,
                    lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equi-width bins over [lo, hi] (data min / max by default); the top
    edge falls in the last bin, values outside and NaN in none. Rows (by,
    bin, lo, hi, n)."""
    if lo is None or hi is None:
        r = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
        lo = r["lo"] if lo is None else lo
        hi = r["hi"] if hi is None else hi
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(score) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    g = (df.where(F.col(score).between(F.lit(lo), F.lit(hi))).groupBy(*keys, b.alias("bin"))
         .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    return g.select(*keys, "bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("bin_lo"),
                    F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("bin_hi"), "n")


def score_density(df: DataFrame, score: str, by: str | None = None, grid: int = 50,
                  digits: int = 6) -> DataFrame:
    """Gaussian kernel density on ``grid`` equally spaced points between the
    data min and max, bandwidth std · n^(-1/5) per group (Scott's factor).
    Equal scores are counted first; then one aggregate holds a sum for every
    grid point, so rows never multiply."""
    keys = [by] if by else []
    stats = (df.where(F.col(score).isNotNull()).groupBy(*keys)
             .agg(F.stddev_samp(score).alias("sd"), F.count(F.lit(1)).alias("n"),
                  F.min(score).alias("lo"), F.max(score).alias("hi")).limit(1001).collect())
    if len(stats) > 1000:
        raise ValueError("too many groups for a density")
    lo, hi = min(s["lo"] for s in stats), max(s["hi"] for s in stats)
    step = (hi - lo) / (grid - 1) if grid > 1 and hi > lo else 0.0
    bw = {}
    for s in stats:
        g = s[by] if by else None
        bw[g] = (s["sd"] or 1.0) * s["n"] ** (-0.2), s["n"]
    if by:
        h = F.lit(None).cast("double")
        n = F.lit(None).cast("double")
        for g, (hv, nv) in bw.items():
            h = F.when(F.col(by) == F.lit(g), F.lit(hv)).otherwise(h)
            n = F.when(F.col(by) == F.lit(g), F.lit(float(nv))).otherwise(n)
    else:
        (hv, nv), = bw.values()
        h, n = F.lit(hv), F.lit(float(nv))
    once = (df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("x"))
            .agg(F.count(F.lit(1)).alias("m")).select(*keys, "x", "m", h.alias("bw"), n.alias("n")))

    def kernels(i: int):
        z = (F.lit(lo + i * step) - F.col("x")) / F.col("bw")
        return F.sum(F.col("m") * F.exp(-0.5 * z * z) / (F.col("bw") * F.col("n") * F.lit(math.sqrt(2 * math.pi))))

    sums = once.groupBy(*keys).agg(*[kernels(i).alias(f"d{i}") for i in range(grid)])
    out = sums.select(*keys, F.posexplode(F.array(*[F.col(f"d{i}") for i in range(grid)])).alias("i", "d"))
    return out.select(*keys, F.col("i").cast("int").alias("grid_index"),
                      F.round(F.lit(lo) + F.col("i") * F.lit(step), digits).alias("x"),
                      F.round("d", digits).alias("density"))
