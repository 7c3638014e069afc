"""Exact order statistics without a global sort.

``kth_values`` finds the k-th smallest values of a column by narrowing:
while the candidate interval still holds many distinct values, cut it into
~``buckets`` ranges at approximate quantiles (``approxQuantile``), count
rows per range (a partial aggregate: one row per range leaves each task),
and keep only the range that holds the wanted rank. Once an interval has
few distinct values, ``groupBy(value).count()`` returns them exactly. A
value repeated on a third of all rows collapses into one group there, so
skew never lands on a single task. Driver traffic is bounded by
``buckets`` and ``exact_limit`` rows per step, independent of table size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_LIMIT = 100_000
BUCKETS = 1000
MAX_GROUPS = 1000


def _present(col: str):
    """Neither null nor NaN."""
    return F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))


def _interval(x, lo, hi):
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (x >= F.lit(lo))
    if hi is not None:
        cond = cond & (x < F.lit(hi))
    return cond


def _pick(counts: list[tuple[float, int]], ranks: Sequence[int]) -> dict[int, float]:
    """counts sorted by value; rank r (0-based) -> value."""
    out: dict[int, float] = {}
    todo = sorted(set(ranks))
    cum = 0
    i = 0
    for v, c in counts:
        while i < len(todo) and todo[i] < cum + c:
            out[todo[i]] = v
            i += 1
        cum += c
        if i == len(todo):
            break
    return out


def kth_values(df: DataFrame, col: str, ranks: Sequence[int],
               exact_limit: int = EXACT_LIMIT, buckets: int = BUCKETS) -> dict[int, float]:
    """0-based ranks over the non-null values of ``col`` -> exact values."""
    x = df.select(F.col(col).cast("double").alias("x")).where("x is not null and not isnan(x)")
    result: dict[int, float] = {}
    few = _bounded_counts(x.groupBy("x").agg(F.count(F.lit(1)).alias("n")), exact_limit)
    if few is not None:  # one pass: few distinct values
        counts = sorted((r["x"], r["n"]) for r in few)
        got = _pick(counts, list(ranks))
        return {r: got[r] for r in ranks}
    # each task: (lo, hi, {global rank: rank inside [lo, hi)})
    tasks = [(None, None, {r: r for r in ranks})]
    while tasks:
        lo, hi, want = tasks.pop()
        sub = x.where(_interval(F.col("x"), lo, hi))
        nd = sub.agg(F.approx_count_distinct("x", 0.05).alias("nd")).first()["nd"]
        if nd <= exact_limit:
            counts = [(r["x"], r["n"]) for r in
                      sub.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").collect()]
            got = _pick(counts, list(want.values()))
            for g, local in want.items():
                result[g] = got[local]
            continue
        qs = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(sub.approxQuantile("x", qs, 1.0 / (4 * buckets))))
        splits = [-math.inf] + [b for b in bounds if (lo is None or b > lo)
                                and (hi is None or b < hi)] + [math.inf]
        if len(splits) < 3:
            # every quantile sits on the lower end: that one value dominates
            # the interval. Count it exactly, continue strictly above it.
            v = lo if lo is not None else bounds[0]
            at = sub.where(F.col("x") == F.lit(v)).count()
            above = {}
            for g, local in want.items():
                if local < at:
                    result[g] = v
                else:
                    above[g] = local - at
            if above:
                tasks.append((math.nextafter(v, math.inf), hi, above))
            continue
        bz = Bucketizer(splits=splits, inputCol="x", outputCol="b")
        per = (bz.transform(sub).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
               .orderBy("b").collect())
        nb = {int(r["b"]): r["n"] for r in per}
        cum = 0
        sub_tasks: dict[int, dict[int, int]] = {}
        for b in range(len(splits) - 1):
            c = nb.get(b, 0)
            for g, local in want.items():
                if cum <= local < cum + c:
                    sub_tasks.setdefault(b, {})[g] = local - cum
            cum += c
        for b, w in sub_tasks.items():
            blo = splits[b] if splits[b] != -math.inf else lo
            bhi = splits[b + 1] if splits[b + 1] != math.inf else hi
            if (blo, bhi) == (lo, hi):  # cannot narrow further: count exactly
                few = _bounded_counts(sub.groupBy("x").agg(F.count(F.lit(1)).alias("n")),
                                      exact_limit * 10)
                if few is None:
                    raise RuntimeError("order statistic: interval does not narrow")
                counts = sorted((r["x"], r["n"]) for r in few)
                got = _pick(counts, list(w.values()))
                for g, local in w.items():
                    result[g] = got[local]
            else:
                tasks.append((blo, bhi, w))
    return result


def _bounded_counts(grouped: DataFrame, limit: int):
    """Collect a grouped result only if it has at most ``limit`` rows
    (``limit + 1`` are fetched to tell); None otherwise."""
    rows = grouped.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def _interp(n: int, q: float) -> tuple[int, int, float]:
    pos = (n - 1) * q
    lo = math.floor(pos)
    return lo, min(lo + 1, n - 1), pos - lo


def quantiles(df: DataFrame, col: str, qs: Sequence[float],
              exact_limit: int = EXACT_LIMIT) -> list[float | None]:
    """Exact quantiles with linear interpolation (numpy / quantile_cont)."""
    df = df.where(_present(col))
    few = _bounded_counts(df.groupBy(col)
                          .agg(F.count(F.lit(1)).alias("n")), exact_limit)
    if few is not None:  # one pass
        counts = sorted((float(r[col]), r["n"]) for r in few)
        n = sum(c for _, c in counts)
        if n == 0:
            return [None for _ in qs]
        plan = [_interp(n, q) for q in qs]
        got = _pick(counts, [r for lo, hi, _ in plan for r in (lo, hi)])
        return [got[lo] + (got[hi] - got[lo]) * f for lo, hi, f in plan]
    n = df.count()
    plan = [_interp(n, q) for q in qs]
    ranks = sorted({r for lo, hi, _ in plan for r in (lo, hi)})
    vals = kth_values(df, col, ranks)
    return [vals[lo] + (vals[hi] - vals[lo]) * f for lo, hi, f in plan]


def grouped_quantiles(df: DataFrame, by: str, col: str, qs: Sequence[float],
                      exact_limit: int = EXACT_LIMIT) -> dict:
    """{group value: [quantiles]}; groups must be few (class labels)."""
    df = df.where(_present(col))
    few = _bounded_counts(df.where(F.col(by).isNotNull())
                          .groupBy(by, col).agg(F.count(F.lit(1)).alias("n")), exact_limit)
    if few is not None:  # one pass: every group has few distinct values
        per: dict = {}
        for r in few:
            per.setdefault(r[by], []).append((float(r[col]), r["n"]))
        if len(per) > MAX_GROUPS:
            raise ValueError(f"more than {MAX_GROUPS} groups in {by}")
        res = {}
        for g, counts in per.items():
            counts.sort()
            n = sum(c for _, c in counts)
            plan = [_interp(n, q) for q in qs]
            got = _pick(counts, [r for lo, hi, _ in plan for r in (lo, hi)])
            res[g] = [got[lo] + (got[hi] - got[lo]) * f for lo, hi, f in plan]
        return res
    stats = (df.groupBy(by)
             .agg(F.count(F.lit(1)).alias("n"),
                  F.approx_count_distinct(col, 0.05).alias("nd"))
             .limit(MAX_GROUPS + 1).collect())
    if len(stats) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups in {by}")
    small = [r[by] for r in stats if r["nd"] <= exact_limit // max(1, len(stats))]
    out: dict = {}
    if small:
        rows = (df.where(F.col(by).isin(small) & F.col(col).isNotNull())
                .groupBy(by, col).agg(F.count(F.lit(1)).alias("n")).collect())
        per: dict = {}
        for r in rows:
            per.setdefault(r[by], []).append((float(r[col]), r["n"]))
        for g in small:
            counts = sorted(per.get(g, []))
            n = sum(c for _, c in counts)
            plan = [_interp(n, q) for q in qs]
            got = _pick(counts, [r for lo, hi, _ in plan for r in (lo, hi)])
            out[g] = [got[lo] + (got[hi] - got[lo]) * f for lo, hi, f in plan]
    for r in stats:
        g = r[by]
        if g in out:
            continue
        out[g] = quantiles(df.where(F.col(by) == F.lit(g)), col, qs)
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                     stats: dict | None = None, exact_limit: int = EXACT_LIMIT) -> dict:
    """{column: [quantiles]} for several columns in few passes. ``stats``
    may carry per column (non-null count, approx distinct) from a pass the
    caller already made. Columns with few distinct values are counted
    together: one ``stack`` + ``groupBy(column, value)`` job whose result is
    at most ``exact_limit`` rows; the others go through ``kth_values``."""
    if stats is None:
        r = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.approx_count_distinct(c, 0.05).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        stats = {c: (r[f"n{i}"], r[f"d{i}"]) for i, c in enumerate(cols)}
    small, budget = [], exact_limit
    for c in cols:
        if stats[c][1] <= budget:
            small.append(c)
            budget -= stats[c][1]
    out: dict = {}
    if small:
        parts = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in small)
        long = df.selectExpr(f"stack({len(small)}, {parts}) AS (__c, __v)").where("__v IS NOT NULL AND NOT isnan(__v)")
        per: dict = {}
        for r in long.groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("n")).collect():
            per.setdefault(r["__c"], []).append((r["__v"], r["n"]))
        for c in small:
            counts = sorted(per.get(c, []))
            n = sum(k for _, k in counts)
            if n == 0:
                out[c] = [None for _ in qs]
                continue
            plan = [_interp(n, q) for q in qs]
            got = _pick(counts, [r for lo, hi, _ in plan for r in (lo, hi)])
            out[c] = [got[lo] + (got[hi] - got[lo]) * f for lo, hi, f in plan]
    for c in cols:
        if c not in out:
            out[c] = quantiles(df, c, qs)
    return out
