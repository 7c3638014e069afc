"""Standardisation: mean 0, population standard deviation 1.

One aggregate pass collects mean and ``stddev_pop`` of every column (2·p
scalars on the driver); the transform is a projection. A constant column
maps to 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, cols: Sequence[str], fit_on: str | None = None) -> dict:
    """``fit_on``: None = all rows; else a boolean column selecting the
    rows the statistics come from (e.g. training rows only)."""
    src = df if fit_on is None else df.where(F.col(fit_on))
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = src.agg(*aggs).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"]) for c in cols}


def apply_scaler(df: DataFrame, stats: dict) -> DataFrame:
    out = {}
    for c, (m, s) in stats.items():
        if m is None:
            out[c] = F.col(c).cast("double")
        elif not s:
            out[c] = F.col(c) - F.lit(m)
        else:
            out[c] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def standardize(df: DataFrame, cols: Sequence[str], fit_on: str | None = None) -> DataFrame:
    """Scale ``cols``; all other columns pass through unchanged."""
    return apply_scaler(df, fit_scaler(df, cols, fit_on))
