"""Comparison reports: keyed result rows appended with ``unionByName``
(never positional), ranked score boards, best / worst, ordered inserts and
the classifier × feature-set skeleton. Inputs are small per-run tables;
windows run over those, never over data rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def report_row(metric: DataFrame, classifier: str, details: str, attributes: str,
               value_col: str = "accuracy") -> DataFrame:
    """Tag a one-row metric table with the run's keys."""
    return metric.select(F.lit(classifier).alias("classifier"), F.lit(details).alias("details"),
                         F.lit(attributes).alias("attributes"), F.col(value_col).alias(value_col))


def ranked(scores: DataFrame, value: str = "roc_auc", name: str = "model") -> DataFrame:
    """Adds ``rank`` (1 = highest value, ties by name)."""
    w = Window.orderBy(F.desc(value), F.asc(name))
    return scores.withColumn("rank", F.row_number().over(w))


def best_worst(scores: DataFrame, value: str = "roc_auc", name: str = "model") -> DataFrame:
    """Best (highest, ties -> first name) and worst (lowest, ties -> first name)."""
    return scores.agg(
        F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("n"))).alias("b"),
        F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n"))).alias("w"),
    ).select(F.col("b.n").alias("best_model"), (-F.col("b.v")).alias("best_value"),
             F.col("w.n").alias("worst_model"), F.col("w.v").alias("worst_value"))


def insert_at(report: DataFrame, row: DataFrame, slot: int, pos: str = "pos") -> DataFrame:
    """Insert ``row`` at 1-based ``slot`` of a report ordered by ``pos``."""
    shifted = report.withColumn(pos, F.when(F.col(pos) >= slot, F.col(pos) + 1).otherwise(F.col(pos)))
    return shifted.unionByName(row.withColumn(pos, F.lit(slot).cast(report.schema[pos].dataType)))


def skeleton(feature_sets: DataFrame, classifiers: Sequence[str]) -> DataFrame:
    """Every classifier against every feature set: an explode per set row
    (no join), keeping the set's columns."""
    return feature_sets.select(F.explode(F.array(*[F.lit(c) for c in classifiers])).alias("classifier"),
                               *feature_sets.columns)
