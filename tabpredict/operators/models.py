"""Classifiers on ``pyspark.ml``: decision tree, random forest, boosted
trees, linear SVM, logistic regression (free or penalised intercept), and
kernel SVMs through explicit feature maps (random Fourier features for the
Gaussian kernel, the exact monomial map for the cubic kernel).

Penalties are given as in the libsvm / liblinear convention (C multiplies
the summed loss); MLlib averages the loss, so regParam = 1 / (n · C).
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.models import save_model


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="error").transform(df)


def scored(model, df: DataFrame, keep: Sequence[str], prob: bool = True) -> DataFrame:
    """Hold-out scoring: kept columns, int prediction and P(class 1)."""
    out = model.transform(df)
    cols = [*keep, F.col("prediction").cast("int").alias("prediction")]
    if prob and "probability" in out.columns:
        cols.append(vector_to_array("probability")[1].alias("p1"))
    return out.select(*cols)


def fit_cached(estimator, train: DataFrame):
    """MLlib fits read their input several times (summaries, binning,
    iterations). Keep the prepared rows for the fit only: MEMORY_AND_DISK,
    so a lost executor's blocks are recomputed from lineage, released as
    soon as the model exists."""
    t = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(t)
    finally:
        t.unpersist()


def train_decision_tree(train: DataFrame, label: str = "label", max_depth: int = 10,
                        seed: int = 1337):
    return fit_cached(DecisionTreeClassifier(labelCol=label, featuresCol="features",
                                             impurity="entropy", maxDepth=max_depth, seed=seed),
                      train)


def train_random_forest(train: DataFrame, label: str = "label", num_trees: int = 10,
                        max_depth: int = 6, seed: int = 1337):
    return fit_cached(RandomForestClassifier(labelCol=label, featuresCol="features",
                                             impurity="entropy", numTrees=num_trees,
                                             maxDepth=max_depth, seed=seed,
                                             featureSubsetStrategy="sqrt"), train)


def tree_arrays(spark: SparkSession, forest) -> list[dict[str, np.ndarray]]:
    """The nodes of each tree, from the forest's written form: feature, threshold, left, right
    (a leaf: feature -1), probabilities of both classes, prediction and depth."""
    path = save_model(spark, forest)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "prediction", F.col("impurityStats").alias("stats"))
    out = []
    for _, t in nodes.toPandas().sort_values(["treeID", "id"]).groupby("treeID"):       # trees x nodes rows
        stats = np.stack(t["stats"].to_numpy())
        left, right = t["leftChild"].to_numpy(), t["rightChild"].to_numpy()
        depth = np.zeros(len(t), int)
        for k in np.flatnonzero(left >= 0):         # a node's number is smaller than its children's
            depth[[left[k], right[k]]] = depth[k] + 1
        out.append(dict(feature=np.where(left >= 0, t["feature"], -1), threshold=t["threshold"].to_numpy(float), left=left, right=right,
                        p0=stats[:, 0] / stats.sum(axis=1), p1=stats[:, 1] / stats.sum(axis=1),
                        prediction=t["prediction"].to_numpy(), depth=depth))
    return out


def cut_nodes(tree: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """The node that answers for each node of a tree grown to ``depth`` only. As in a fit to that
    depth, two leaves of one prediction are put back into their parent."""
    leaf, said = (tree["left"] < 0) | (tree["depth"] >= depth), tree["prediction"].copy()
    order = np.flatnonzero(~leaf)
    for k in order[::-1]:
        a, b = tree["left"][k], tree["right"][k]
        if leaf[a] and leaf[b] and said[a] == said[b]:
            leaf[k], said[k] = True, said[a]
    out = np.arange(len(leaf))
    for k in np.flatnonzero(tree["left"] >= 0):
        for child in (tree["left"][k], tree["right"][k]):
            out[child] = out[k] if leaf[out[k]] else child
    return out


def cut_forest_right(trees: list[dict[str, np.ndarray]], df: DataFrame, depths: Sequence[int], label: str = "label") -> dict[int, list[int]]:
    """For each depth, how many rows the first 1, 2, ... trees cut at that depth answer rightly:
    class 1 where its probabilities add up to more. One pass over the rows."""
    top = max(depths)
    answers = [[cut_nodes(t, d) for d in depths] for t in trees]

    def count(batches):
        right = np.zeros((len(depths), len(trees)), np.int64)
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            y, row = batch.column(1).to_numpy(), np.arange(batch.num_rows)
            votes = np.zeros((len(depths), 2, batch.num_rows))
            for t, tree in enumerate(trees):
                at = np.zeros(batch.num_rows, np.int64)
                for d in range(top + 1):
                    for i in [i for i, k in enumerate(depths) if k == d]:
                        own = answers[t][i][at]
                        votes[i] += tree["p0"][own], tree["p1"][own]
                        right[i, t] += ((votes[i, 1] > votes[i, 0]).astype(int) == y).sum()
                    inner = tree["feature"][at] >= 0
                    goes = x[row, np.maximum(tree["feature"][at], 0)] <= tree["threshold"][at]
                    at = np.where(inner, np.where(goes, tree["left"][at], tree["right"][at]), at)
        i, t = np.indices(right.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, t, right)], names=["i", "t", "n"])

    rows = df.select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y"))
    out = {d: [0] * len(trees) for d in depths}
    for r in rows.mapInArrow(count, "i long, t long, n long").groupBy("i", "t").agg(F.sum("n").alias("n")).collect():      # depths x trees
        out[depths[r["i"]]][r["t"]] = r["n"]
    return out


def positive_weight(label: str, weight: float) -> Column:
    return F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))


def train_gbt(train: DataFrame, label: str = "label", rounds: int = 10, depth: int = 5,
              step: float = 0.01, min_rows: int = 21, bins: int = 140,
              feature_fraction: float = 0.5, pos_weight: float | None = 99.0, seed: int = 1337):
    """Boosted trees with log-loss. ``pos_weight`` up-weights class 1 (a
    weight column), ``feature_fraction`` samples columns per split."""
    d = train
    kw = {}
    if pos_weight is not None:
        d = train.withColumn("__w", positive_weight(label, pos_weight))
        kw["weightCol"] = "__w"
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth,
                        stepSize=step, minInstancesPerNode=min_rows, maxBins=bins,
                        featureSubsetStrategy=str(feature_fraction), seed=seed, **kw)
    return fit_cached(gbt, d)


def split_counts(model, features: Sequence[str]) -> list[tuple[str, int]]:
    """Number of splits on each feature over all trees of a tree model
    (the 'split' importance). Reads the model's own description, whose size
    is the model's (trees × nodes), not the data's."""
    text = model.toDebugString
    counts = [0] * len(features)
    for m in re.finditer(r"If \(feature (\d+) ", text):
        counts[int(m.group(1))] += 1
    return list(zip(features, counts))


def svm_reg(n: int, C: float = 1.0) -> float:
    return 1.0 / (n * C)


def train_linear_svm(train: DataFrame, n: int, label: str = "label", C: float = 1.0,
                     max_iter: int = 100):
    # the fit itself keeps its rows, as blocks; rows kept here would be a second copy of every mapped vector
    return LinearSVC(labelCol=label, featuresCol="features", regParam=svm_reg(n, C),
                     standardization=False, maxIter=max_iter).fit(train)


def train_logistic(train: DataFrame, n: int, label: str = "label", C: float = 1.0,
                   penalize_intercept: bool = False, max_iter: int = 100):
    """L2 logistic regression. ``penalize_intercept``: the intercept is a
    constant feature under the same penalty (liblinear's convention)."""
    if penalize_intercept:
        lr = LogisticRegression(labelCol=label, featuresCol="features_b", regParam=svm_reg(n, C),
                                elasticNetParam=0.0, standardization=False, fitIntercept=False,
                                maxIter=max_iter)
    else:
        lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=svm_reg(n, C),
                                elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return fit_cached(lr, train)


def with_bias(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=[*features, "__one"], outputCol="features_b") \
        .transform(df.withColumn("__one", F.lit(1.0)))


# --- explicit kernel feature maps (projections, no UDF) ----------------------

def gamma_scale(df: DataFrame, features: Sequence[str]) -> float:
    """1 / (p · Var(X)) with Var over all entries of X (libsvm 'scale')."""
    p = len(features)
    a = df.agg(*[F.sum(F.col(c)).alias(f"s{i}") for i, c in enumerate(features)],
               *[F.sum(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(features)],
               F.count(F.lit(1)).alias("n")).first()
    n = a["n"] * p
    s = sum(a[f"s{i}"] for i in range(p))
    q = sum(a[f"q{i}"] for i in range(p))
    var = q / n - (s / n) ** 2
    return 1.0 / (p * var) if var > 0 else 1.0


def rff_columns(features: Sequence[str], gamma: float, dim: int = 100,
                seed: int = 1337) -> dict[str, Column]:
    """Random Fourier features: z_d = sqrt(2/D) cos(w_d·x + b_d) with
    w ~ N(0, 2γI), b ~ U(0, 2π), so z(x)·z(y) ≈ exp(-γ|x-y|²)."""
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim, len(features)))
    b = rng.uniform(0.0, 2 * math.pi, size=dim)
    scale = math.sqrt(2.0 / dim)
    cols = {}
    for d in range(dim):
        lin = F.lit(float(b[d]))
        for j, c in enumerate(features):
            lin = lin + F.lit(float(W[d, j])) * F.col(c)
        cols[f"rff{d}"] = F.lit(scale) * F.cos(lin)
    return cols


def cubic_columns(features: Sequence[str], gamma: float) -> dict[str, Column]:
    """Exact feature map of (γ x·y)³: every degree-3 monomial times
    sqrt(multinomial coefficient) · γ^(3/2)."""
    cols = {}
    for i, combo in enumerate(itertools.combinations_with_replacement(range(len(features)), 3)):
        counts = [combo.count(j) for j in set(combo)]
        coef = math.factorial(3) / math.prod(math.factorial(c) for c in counts)
        term = F.lit(math.sqrt(coef) * gamma ** 1.5)
        for j in combo:
            term = term * F.col(features[j])
        cols[f"poly{i}"] = term
    return cols


def mapped(df: DataFrame, cols: dict[str, Column], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep ``keep`` and add the mapped feature columns; returns their names."""
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()]), list(cols)


def tensor_sketch(df: DataFrame, features: Sequence[str], gamma: float, keep: Sequence[str],
                  degree: int = 3, dim: int = 1024, seed: int = 1337,
                  out: str = "features") -> DataFrame:
    """Tensor sketch (Pham & Pagh 2013) of the homogeneous polynomial kernel
    (γ x·y)^degree: ``degree`` count sketches of sqrt(γ)·x multiplied in the
    Fourier domain, so <z(x), z(y)> estimates the kernel without listing
    the O(p^degree) monomials. Rows are sketched batch by batch inside the
    tasks (numpy only); the result is an MLlib vector column. A sketch is a
    sum over the p^degree products of ``degree`` features, each in its own
    place: where these places are fewer than ``dim``, all others are zero in
    every row and left out, in the order of the rest, and the sums are columns
    of products, without a transform."""
    from pyspark.ml.functions import array_to_vector

    p = len(features)
    rng = np.random.default_rng(seed)
    buckets = rng.integers(0, dim, size=(degree, p))
    signs = rng.choice([-1.0, 1.0], size=(degree, p))
    places = np.arange(dim)
    if p ** degree < dim:
        places = np.unique([sum(x) % dim for x in itertools.product(*buckets.tolist())])
    root_gamma = math.sqrt(gamma)
    cols = list(features)
    keep = list(keep)
    if len(places) < dim:
        terms = {int(k): {} for k in places}        # a place: the signs of each product of features, added up
        for x in itertools.product(range(p), repeat=degree):
            own, product = terms[int(sum(buckets[i, j] for i, j in enumerate(x)) % dim)], tuple(sorted(x))
            own[product] = own.get(product, 0.0) + float(math.prod(signs[i, j] for i, j in enumerate(x)))
        scale = root_gamma ** degree
        z = [functools.reduce(operator.add, [functools.reduce(operator.mul, [F.col(f"`{cols[j]}`").cast("double") for j in product], F.lit(sign * scale))
                                             for product, sign in own.items()]) for own in terms.values()]
        return df.select(*keep, array_to_vector(F.array(*z)).alias(out))

    # Runs in the Python workers: numpy / pandas only.
    def sketch(batches):
        import pandas as pd
        for b in batches:
            X = b[cols].to_numpy(dtype=np.float64) * root_gamma
            prod = None
            for i in range(degree):
                cs = np.zeros((len(X), dim))
                for j in range(p):
                    cs[:, buckets[i, j]] += signs[i, j] * X[:, j]
                f = np.fft.rfft(cs, axis=1)
                prod = f if prod is None else prod * f
            z = np.fft.irfft(prod, n=dim, axis=1)[:, places]
            res = b[keep].copy()
            res["__z"] = list(z)
            yield res

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    sk = df.select(*keep, *cols).mapInPandas(sketch, f"{schema}, __z array<double>")
    return sk.select(*keep, array_to_vector("__z").alias(out))


def cubic_width(p: int) -> int:
    """Number of degree-3 monomials of p features."""
    return math.comb(p + 2, 3)
