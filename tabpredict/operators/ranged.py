"""Running sums over a global order without a single-partition window.

A window with an ``orderBy`` and no ``partitionBy`` moves every row to one
task. Instead the ordered domain is cut into ranges at approximate
quantiles, each range is summed, the exclusive prefix of those totals (one
row a range) becomes a per-range offset that is joined back, and the running
sum is a window *within* each range plus its offset. The number of ranges
follows from the rows, so a range holds about ``target_rows`` at any size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 200_000


def in_ranges(df: DataFrame, order_col: str, target_rows: int = TARGET_ROWS, n: int | None = None) -> DataFrame:
    """Adds ``__b``: the number of the row's range of ``order_col``, in ascending order."""
    n = df.count() if n is None else n
    ranges = max(1, math.ceil(n / target_rows))
    bounds = (sorted(set(df.approxQuantile(order_col, [i / ranges for i in range(1, ranges)],
                                           1.0 / (4 * ranges)))) if ranges > 1 else [])
    if not bounds:
        return df.withColumn("__b", F.lit(0.0))
    cut = df.withColumn("__o", F.col(order_col).cast("double"))
    return Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__o", outputCol="__b").transform(cut).drop("__o")


def ranged_cumsum(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                  descending: bool = True, prefix: str = "cum_",
                  target_rows: int = TARGET_ROWS, n: int | None = None) -> DataFrame:
    """Adds ``cum_<c>``: inclusive running sum of each ``c`` in ``order_col``
    order. ``order_col`` must be unique (aggregate to distinct values first).
    ``n`` = row count of ``df`` if the caller already has it."""
    cut = in_ranges(df, order_col, target_rows, n)

    def way(c: str):
        return F.col(c).desc() if descending else F.col(c).asc()

    before = Window.orderBy(way("__b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("__b").agg(*[F.sum(c).alias(c) for c in sum_cols])
    offsets = totals.select("__b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__off_{c}") for c in sum_cols])
    within = Window.partitionBy("__b").orderBy(way(order_col)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(offsets, "__b").withColumns(
        {f"{prefix}{c}": F.sum(c).over(within) + F.col(f"__off_{c}") for c in sum_cols})
    return out.select(*df.columns, *[f"{prefix}{c}" for c in sum_cols])
