"""Profiling: shape, label share, class counts, zero and null counts,
summaries with exact quartiles, per-category counts, split ratios."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize
from .orderstat import EXACT_LIMIT, _bounded_counts, _interp, _pick, column_quantiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def label_rate(df: DataFrame, label: str, positive="Yes", digits: int = 6) -> DataFrame:
    """Percentage of rows whose label equals ``positive``."""
    hit = F.when(F.col(label) == F.lit(positive), 100.0).otherwise(0.0)
    return df.agg(F.round(F.avg(hit), digits).alias("label_pct"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def segment_class_share(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """Count and share of each class; the window runs over the grouped
    result (one row per class), never over the rows."""
    g = class_counts(df, label)
    return g.select(label, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), digits)
                    .alias("share"))


def zeros_nulls(df: DataFrame) -> DataFrame:
    """(col_name, n_zero, n_null) for every column in ONE aggregate pass.
    Zeros are counted on numeric columns only (0 for text); NaN counts as
    null on floating columns."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        numeric = isinstance(f.dataType, _NUMERIC)
        floating = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        z = F.count_if(c == 0) if numeric else F.lit(0).cast("bigint")
        nul = F.count_if(c.isNull() | F.isnan(c)) if floating else F.count_if(c.isNull())
        aggs += [z.alias(f"z{len(aggs)}"), nul.alias(f"n{len(aggs) + 1}")]
    wide = df.agg(*aggs)
    names = [f.name for f in df.schema.fields]
    parts = ", ".join(f"'{n}', z{2 * i}, n{2 * i + 1}" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {parts}) as (col_name, n_zero, n_null)") \
        .select("col_name", F.col("n_zero").cast("bigint"), F.col("n_null").cast("bigint"))


def max_null_pct(df: DataFrame) -> DataFrame:
    """100 * round(max null count / rows, 4) in one pass; 0.0 when nothing
    is null (the rows count rides along in the same aggregate)."""
    nulls = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        floating = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        nulls.append(F.count_if(c.isNull() | F.isnan(c)) if floating else F.count_if(c.isNull()))
    worst = F.greatest(*nulls) if len(nulls) > 1 else nulls[0]
    return df.agg((worst / F.count(F.lit(1))).alias("r")).select(
        F.round(F.lit(100.0) * F.round("r", 4), 6).alias("max_null_pct"))


def _describe_from_counts(counts: list[tuple[float, int]]) -> tuple:
    """count, mean, sample std, min, quartiles, max from (value, count)."""
    counts = sorted(counts)
    n = sum(c for _, c in counts)
    if n == 0:
        return (0, None, None, None, None, None, None, None)
    mean = sum(v * c for v, c in counts) / n
    var = sum(c * (v - mean) ** 2 for v, c in counts) / (n - 1) if n > 1 else None
    plan = [_interp(n, q) for q in (0.25, 0.5, 0.75)]
    got = _pick(counts, [r for lo, hi, _ in plan for r in (lo, hi)])
    qs = [got[lo] + (got[hi] - got[lo]) * f for lo, hi, f in plan]
    return (n, mean, math.sqrt(var) if var is not None else None, counts[0][0], *qs, counts[-1][0])


def describe(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """count, mean, std (sample), min, 25 %, 50 %, 75 %, max per column.

    The rows may come from costly joins, so that their columns are written once
    and each pass reads that table. One pass when every column has few distinct values: a ``stack`` +
    ``groupBy(column, value)`` whose (bounded) result gives all eight
    figures. Otherwise moments come from one aggregate and the quartiles
    from exact order statistics."""
    cols = list(cols)
    # NaN counts as missing
    table = materialize(df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"v{i}")
                                    for i, c in enumerate(cols)]), "described")
    rows = _described(table, table.columns)
    discard(table)
    schema = ("feature string, count bigint, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")
    out = df.sparkSession.createDataFrame([(c, *r[1:]) for c, r in zip(cols, rows)], schema)
    return out.select("feature", "count", *[F.round(c, digits).alias(c) for c in
                                             ("mean", "std", "min", "q25", "q50", "q75", "max")])


def _described(df: DataFrame, cols: Sequence[str]) -> list[tuple]:
    """A row of figures for each column of doubles."""
    parts = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {parts}) AS (__c, __v)").where("__v IS NOT NULL")
    few = _bounded_counts(long.groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("n")),
                          EXACT_LIMIT)
    rows = []
    if few is not None:
        per: dict = {c: [] for c in cols}
        for r in few:
            per[r["__c"]].append((r["__v"], r["n"]))
        rows = [(c, *_describe_from_counts(per[c])) for c in cols]
    else:
        aggs = []
        for c in cols:
            aggs += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"),
                     F.stddev_samp(c).alias(f"s_{c}"), F.min(c).cast("double").alias(f"lo_{c}"),
                     F.max(c).cast("double").alias(f"hi_{c}"),
                     F.approx_count_distinct(c, 0.05).alias(f"d_{c}")]
        mom = df.agg(*aggs).first()
        quart = column_quantiles(df, cols, [0.25, 0.5, 0.75],
                                 stats={c: (mom[f"n_{c}"], mom[f"d_{c}"]) for c in cols})
        for c in cols:
            q = quart[c]
            rows.append((c, int(mom[f"n_{c}"]), mom[f"m_{c}"], mom[f"s_{c}"], mom[f"lo_{c}"],
                         q[0], q[1], q[2], mom[f"hi_{c}"]))
    return rows


def churn_by_category(df: DataFrame, label: str, col: str, positive=1) -> DataFrame:
    """Positive-label rows per value of ``col``."""
    return (df.where(F.col(label) == F.lit(positive)).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n_positive")))


def split_class_ratio(df: DataFrame, label: str, split: str, digits: int = 6) -> DataFrame:
    """Positive / negative counts and their ratio per split value plus a
    'whole' row (ROLLUP), in one pass."""
    g = df.rollup(split).agg(
        F.count_if(F.col(label) == 1).cast("bigint").alias("n_pos"),
        F.count_if(F.col(label) != 1).cast("bigint").alias("n_neg"),
        F.grouping(split).alias("__g"))
    part = F.when(F.col("__g") == 1, F.lit("whole")).otherwise(F.col(split).cast("string"))
    return g.select(part.alias("part"), "n_pos", "n_neg",
                    F.round(F.try_divide(F.col("n_pos"), F.col("n_neg").cast("double")), digits)
                    .alias("pos_neg_ratio"))
