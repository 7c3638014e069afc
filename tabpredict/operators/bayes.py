"""Gaussian naive Bayes as aggregates plus a scoring projection.

Fit = one ``rollup(label)`` pass: count, mean and population variance of
every feature per class, and the same over all rows (for the variance
floor ``var_smoothing · max variance``). The model is k × p numbers, so
scoring is a projection with the parameters inlined as literals: no join,
no shuffle, whole-stage codegen end to end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

MAX_CLASSES = 1000
VERSION = 1


@dataclass
class GaussianNBModel:
    features: list[str]
    classes: list
    log_prior: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    def joint_log_likelihood(self, ci: int) -> Column:
        terms = [F.lit(self.log_prior[ci])]
        for f, m, v in zip(self.features, self.means[ci], self.variances[ci]):
            terms.append(F.lit(-0.5 * math.log(2 * math.pi * v)))
            terms.append(F.lit(-0.5 / v) * (F.col(f) - F.lit(m)) * (F.col(f) - F.lit(m)))
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Argmax of the joint log-likelihood; a tie keeps the smaller class."""
        jll = [self.joint_log_likelihood(i) for i in range(len(self.classes))]
        d = df.withColumns({f"__jll{i}": j for i, j in enumerate(jll)})
        best_v = F.col("__jll0")
        best_c = F.lit(self.classes[0])
        for i in range(1, len(self.classes)):
            better = F.col(f"__jll{i}") > best_v
            best_c = F.when(better, F.lit(self.classes[i])).otherwise(best_c)
            best_v = F.greatest(best_v, F.col(f"__jll{i}"))
        d = d.withColumn(out, best_c)
        return d.drop(*[f"__jll{i}" for i in range(len(self.classes))])


    def save(self, spark: SparkSession, path: str | None = None) -> str:
        """Write the model, a row a class, under ``path``."""
        path = path or shared_path(spark, "gaussian-nb")
        rows = [(VERSION, self.features, c, p, m, v) for c, p, m, v in zip(self.classes, self.log_prior, self.means, self.variances)]
        kind = "long" if all(isinstance(c, int) for c in self.classes) else "double" if all(isinstance(c, (int, float)) for c in self.classes) else "string"
        spark.createDataFrame(rows, f"version int, features array<string>, class {kind}, log_prior double, means array<double>, variances array<double>") \
            .coalesce(1).write.parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GaussianNBModel:
        """Read a model that ``save`` wrote; a table that isn't one raises an error."""
        rows = spark.read.parquet(path).orderBy("class").collect()
        if not rows or any(r["version"] != VERSION or r["features"] != rows[0]["features"] or len(r["means"]) != len(r["features"]) for r in rows):
            raise ValueError(f"{path} holds no naive Bayes model of version {VERSION}")
        return cls(rows[0]["features"], [r["class"] for r in rows], [r["log_prior"] for r in rows], [r["means"] for r in rows], [r["variances"] for r in rows])


def fit_gaussian_nb(df: DataFrame, features: Sequence[str], label: str = "label",
                    var_smoothing: float = 1e-9) -> GaussianNBModel:
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}")]
    rows = (df.rollup(label).agg(*aggs, F.grouping(label).alias("__g"))
            .limit(MAX_CLASSES + 2).collect())
    if len(rows) > MAX_CLASSES + 1:  # classes + the grand total
        raise ValueError("too many classes")
    total = [r for r in rows if r["__g"] == 1][0]
    per = sorted([r for r in rows if r["__g"] == 0 and r[label] is not None],
                 key=lambda r: r[label])
    eps = var_smoothing * max(total[f"v_{f}"] or 0.0 for f in features)
    if eps <= 0.0:
        raise ValueError("every feature is constant: Gaussian NB is undefined")
    n = sum(r["__n"] for r in per)
    return GaussianNBModel(
        features=list(features),
        classes=[r[label] for r in per],
        log_prior=[math.log(r["__n"] / n) for r in per],
        means=[[r[f"m_{f}"] for f in features] for r in per],
        variances=[[(r[f"v_{f}"] or 0.0) + eps for f in features] for r in per],
    )
