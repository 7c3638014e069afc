"""Gradient boosting for binary log-loss that can continue from an earlier
model (warm start), with L1 / L2 leaf penalties and a minimum hessian.

Each round is Spark work only: gradients and hessians are columns; a
``DecisionTreeRegressor`` is fitted on the Newton target -g/h with weight
h (its ``leafCol`` gives every row's leaf); leaf values are re-estimated
from ``groupBy(leaf)`` sums of g and h with the penalties (at most
2^depth rows reach the driver); the margin column is updated with a
literal leaf -> value map. The running loss rides along in the same
aggregate, giving a per-round training metric for free. Lineage is cut
every few rounds with ``checkpoint()`` into the shared checkpoint folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .evaluate import roc_auc

CHECKPOINT_EVERY = 5


@dataclass
class BoostedModel:
    base_margin: float
    learning_rate: float
    trees: list = field(default_factory=list)      # (tree model, {leaf: step}); steps hold their rate
    init_model: object = None                      # a GBTClassificationModel to start from
    history: list = field(default_factory=list)    # (n_trees, train log-loss)
    auc_history: list = field(default_factory=list)  # (n_trees, train AUC) if asked

    def _leaf_value(self, values: dict) -> Column:
        m = F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(float(k)), F.lit(v))])
        return F.coalesce(F.element_at(m, F.col("__leaf")), F.lit(0.0))

    def margin(self, df: DataFrame, out: str = "margin") -> DataFrame:
        """Adds the logistic margin; the features column must be present."""
        d = df
        if self.init_model is not None:
            d = self.init_model.transform(d).withColumn(
                out, F.lit(2.0) * vector_to_array("rawPrediction")[1]) \
                .drop("rawPrediction", "probability", "prediction")
        else:
            d = d.withColumn(out, F.lit(self.base_margin))
        for i, (tree, values) in enumerate(self.trees):
            t = tree.copy()
            t.setLeafCol("__leaf").setPredictionCol("__tp")
            d = t.transform(d)
            d = d.withColumn(out, F.col(out) + self._leaf_value(values)) \
                 .drop("__leaf", "__tp")
            if (i + 1) % 20 == 0:
                d = d.checkpoint()
        return d

    def transform(self, df: DataFrame) -> DataFrame:
        d = self.margin(df)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
        return d.withColumn("p1", p).withColumn("prediction", F.when(p > 0.5, 1).otherwise(0))


def _soft(g: float, l1: float) -> float:
    return math.copysign(max(abs(g) - l1, 0.0), g)


def boost(df: DataFrame, label: str = "label", rounds: int = 10, learning_rate: float = 0.1,
          max_depth: int = 5, min_rows: int = 21, min_hessian: float = 5.0, l1: float = 0.5,
          l2: float = 0.5, pos_weight: float = 1.0, max_bins: int = 140,
          init: BoostedModel | object | None = None, seed: int = 1337,
          track_auc: bool = False, early_stopping_rounds: int = 0) -> BoostedModel:
    """Fit ``rounds`` trees. ``init`` may be a ``BoostedModel`` (continue it:
    its trees are kept and new ones appended) or an MLlib
    ``GBTClassificationModel`` (start from its margin).

    ``track_auc`` also records the training AUC each round (one ranged ROC
    pass over the round's table). ``early_stopping_rounds`` > 0 stops when
    the training loss has not improved for that many rounds, and cuts back
    to the best one."""
    spark = df.sparkSession
    shared_dir(spark)  # make sure checkpoint() has a shared folder
    w = F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0))
    d = df.select("features", F.col(label).cast("double").alias("__y"), w.alias("__w"))
    if isinstance(init, BoostedModel):
        model = BoostedModel(init.base_margin, init.learning_rate, list(init.trees),
                             init.init_model, list(init.history))
    elif init is not None:
        model = BoostedModel(0.0, learning_rate, [], init, [])
    else:
        s = d.agg(F.sum(F.col("__w") * F.col("__y")).alias("pos"),
                  F.sum(F.col("__w") * (1 - F.col("__y"))).alias("neg")).first()
        base = math.log(s["pos"] / s["neg"]) if s["pos"] and s["neg"] else 0.0
        model = BoostedModel(base, learning_rate, [], None, [])
    model.learning_rate = learning_rate
    d = model.margin(d, "__F").checkpoint()
    for r in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__F")))
        g = (p - F.col("__y")) * F.col("__w")
        h = F.greatest(p * (1 - p), F.lit(1e-16)) * F.col("__w")
        dd = d.withColumns({"__g": g, "__h": h}).withColumn("__t", -F.col("__g") / F.col("__h"))
        # three passes read this round's table (hessian total, the tree fit,
        # leaf sums): keep it for the round only, MEMORY_AND_DISK
        dd = dd.persist(StorageLevel.MEMORY_AND_DISK)
        # the tree's row weights are the hessians, so a minimum weight
        # fraction per child of min_hessian / total hessian is the minimum
        # hessian per leaf, enforced when the split is chosen
        h_total = dd.agg(F.sum("__h").alias("H")).first()["H"] or 0.0
        frac = min(min_hessian / h_total, 0.49) if h_total > 0 else 0.0
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="__t", weightCol="__h",
                                     maxDepth=max_depth, minInstancesPerNode=min_rows,
                                     minWeightFractionPerNode=frac, maxBins=max_bins,
                                     leafCol="__leaf", predictionCol="__tp", seed=seed + r).fit(dd)
        pc = F.lit(1e-15)
        pcl = F.least(F.greatest(p, pc), 1 - pc)
        loss = -F.col("__w") * (F.col("__y") * F.ln(pcl) + (1 - F.col("__y")) * F.ln(1 - pcl))
        stats = (tree.transform(dd).groupBy("__leaf")
                 .agg(F.sum("__g").alias("G"), F.sum("__h").alias("H"), F.sum(loss).alias("L"),
                      F.sum("__w").alias("W")).collect())
        values = {}
        for s in stats:
            # a root-only tree can still fall short of the minimum: no step
            values[s["__leaf"]] = (0.0 if s["H"] < min_hessian
                                   else -learning_rate * _soft(s["G"], l1) / (s["H"] + l2))
        total_w = sum(s["W"] for s in stats)
        model.history.append((len(model.trees), sum(s["L"] for s in stats) / total_w))
        if track_auc:
            auc = roc_auc(dd.select(F.col("__y").alias("label"), F.col("__F").alias("score")),
                          "label", "score", digits=12).first()["roc_auc"]
            model.auc_history.append((len(model.trees), auc))
        dd.unpersist()
        if early_stopping_rounds > 0:
            losses = [v for _, v in model.history]
            best = min(range(len(losses)), key=lambda i: losses[i])
            if len(losses) - 1 - best >= early_stopping_rounds:
                # the loss was recorded before its round's tree was added
                del model.trees[model.history[best][0]:]
                break
        model.trees.append((tree, values))
        upd = F.col("__F") + model._leaf_value(values)
        d = tree.setLeafCol("__leaf").setPredictionCol("__tp").transform(d) \
            .withColumn("__F", upd).drop("__leaf", "__tp")
        if (r + 1) % CHECKPOINT_EVERY == 0:
            d = d.checkpoint()
    return model
