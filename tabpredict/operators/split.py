"""Reproducible exact-size hold-out split and k-fold assignment.

Rows are ordered by ``(hash32(key, seed), key)``; the test set is the
``ceil(test_size * n)`` smallest. The boundary is found with two
histograms of the 32-bit hash (high 16 bits, then low 16 bits inside the
boundary bucket; each at most 65,536 rows to the driver whatever the table
size), then a top-k on the key among rows that share the boundary hash.
``is_test`` is then a plain projection: no shuffle, no sort, and the same
rows are picked on any cluster layout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash32
from ..session import materialize as write_once
from .orderstat import kth_values
from .ranged import TARGET_ROWS, in_ranges


MAX_TIED_KEYS = 100_000


def n_test_rows(n: int, test_size: float) -> int:
    """ceil(test_size * n) in exact decimal arithmetic."""
    return math.ceil(Fraction(str(test_size)) * n)


def _locate(hist: list[tuple[int, int]], rank: int) -> tuple[int, int]:
    """hist sorted by bucket; 1-based rank -> (bucket, rank inside bucket)."""
    cum = 0
    for b, c in hist:
        if cum + c >= rank:
            return b, rank - cum
        cum += c
    raise ValueError("rank beyond total")


@dataclass
class Split:
    """A split DataFrame with its sizes (known from the histograms, so
    callers need no extra ``count()`` pass)."""
    df: DataFrame
    n: int
    n_test: int

    @property
    def n_train(self) -> int:
        return self.n - self.n_test


def split_holdout_sized(df: DataFrame, key: str, test_size: float = 0.333, seed: int = 1337,
                        out: str = "is_test", materialize: bool = False) -> Split:
    """``split_holdout`` plus the row counts. Usually two passes: the
    high-16-bit histogram (whose sum is n) and the low-16-bit histogram of
    the boundary bucket; a third (top-k on the key) only when several rows
    share the boundary hash and only some of them belong to the test set.

    ``materialize``: write the hashed input once to the shared folder; the
    histograms and every later pass then scan that table instead of
    recomputing an expensive source (a join, an aggregate, many hashes)."""
    hcol = f"__h_{out}"
    d = df.withColumn(hcol, hash32(key, F.lit(seed)))
    if materialize:
        d = write_once(d, "split")
    h = F.col(hcol)
    hi_hist = [(r["b"], r["n"]) for r in
               d.groupBy(F.shiftright(h, 16).alias("b")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy("b").collect()]
    n = sum(c for _, c in hi_hist)
    k = n_test_rows(n, test_size)
    if k <= 0:
        return Split(df.withColumn(out, F.lit(0)), n, 0)
    if k >= n:
        return Split(df.withColumn(out, F.lit(1)), n, n)
    b_hi, r1 = _locate(hi_hist, k)
    lo_hist = [(r["b"], r["n"]) for r in
               d.where(F.shiftright(h, 16) == b_hi)
               .groupBy((h % 65536).alias("b")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy("b").collect()]
    b_lo, r2 = _locate(lo_hist, r1)
    h_star = b_hi * 65536 + b_lo
    ties = dict(lo_hist)[b_lo]
    if r2 == ties:  # every row with the boundary hash is a test row
        test = h <= F.lit(h_star)
    else:
        # distinct keys sharing one 32-bit hash are hash collisions: few,
        # whatever the table size; a key repeated on many rows is one group
        tied = (d.where(h == h_star).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                .limit(MAX_TIED_KEYS + 1).collect())
        if len(tied) > MAX_TIED_KEYS:
            raise ValueError("too many distinct keys share one hash value")
        cum, key_star = 0, None
        for r in sorted(tied, key=lambda r: r[key]):
            cum += r["n"]
            key_star = r[key]
            if cum >= r2:
                break
        test = (h < F.lit(h_star)) | ((h == F.lit(h_star)) & (F.col(key) <= F.lit(key_star)))
    return Split(d.withColumn(out, F.when(test, 1).otherwise(0)).drop(hcol), n, k)


def split_holdout(df: DataFrame, key: str, test_size: float = 0.333, seed: int = 1337,
                  out: str = "is_test", materialize: bool = False) -> DataFrame:
    """Adds ``out`` (int 1 = test row). Same key set, same seed -> same rows."""
    return split_holdout_sized(df, key, test_size, seed, out, materialize).df


def assign_folds(df: DataFrame, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Contiguous folds in key order, sizes as an unshuffled k-fold split
    (the first n % k folds get one extra row). Boundaries are exact order
    statistics of the key; the fold is then a projection. The key must be
    numeric (exact up to 2**53); for text keys use ``hash_folds``."""
    n = df.count()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    starts = [sum(sizes[:i]) for i in range(1, k) if sizes[i] > 0]
    vals = kth_values(df, key, starts)
    fold = F.lit(0)
    for r in starts:
        fold = fold + F.when(F.col(key) >= F.lit(vals[r]), 1).otherwise(0)
    return df.withColumn(out, fold.cast("int"))


#: Classes up to which the table of their folds' first keys is broadcast (k - 1 numbers a class).
BROADCAST_CLASSES = 10_000


def assign_stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = 4, out: str = "fold",
                            target_rows: int = TARGET_ROWS) -> DataFrame:
    """Contiguous folds in key order within each class, as an unshuffled stratified k-fold
    split: of a class's n rows the first n % k folds get one more.

    No class is ranked as a whole. The key is cut into ranges of about ``target_rows`` rows;
    counts by (class, range) say in which range each fold of a class begins, and only the
    rows of those ranges are counted by key to find the fold's first key. The fold is then a
    projection. Three passes. Equal keys of a class share a fold; a null label is a class;
    rows whose (numeric) key is null or NaN get fold 0. A class of fewer than k rows leaves its
    last folds empty."""
    v = F.nanvl(F.col(key).cast("double"), F.lit(None).cast("double"))
    cut = in_ranges(df.select(F.col(label).alias("c"), v.alias("v")).where("v IS NOT NULL"), "v", target_rows)
    sizes = cut.groupBy("c", "__b").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("c")
    before = F.coalesce(F.sum("n").over(by_class.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fold = F.col("i")
    first = fold * F.expr(f"total div {k}") + F.least(fold, F.col("total") % k)         # rows of the class ahead of fold i
    begins = (sizes.select("*", before.alias("before"), F.sum("n").over(by_class).alias("total"))
              .withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k - 1))) if k > 1 else F.explode(F.array().cast("array<int>")))
              .withColumn("first", first - F.col("before")).where("first >= 0 AND first < n").select("c", "__b", "first"))
    begins = write_once(begins, "folds")
    a, b = F.col("x.c").eqNullSafe(F.col("y.c")), F.col("x.__b") == F.col("y.__b")
    near = cut.alias("x").join(begins.select("c", "__b").distinct().alias("y"), a & b, "left_semi")
    upto = F.sum("m").over(Window.partitionBy("c", "__b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = near.groupBy("c", "__b", "v").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", upto)
    here = (F.col("y.first") < F.col("x.upto")) & (F.col("y.first") >= F.col("x.upto") - F.col("x.m"))
    starts = ranked.alias("x").join(begins.alias("y"), a & b & here).groupBy("x.c").agg(F.collect_list("x.v").alias("__starts"))
    starts = write_once(starts.withColumnRenamed("c", "__class"), "folds")
    if starts.count() <= BROADCAST_CLASSES:
        starts = F.broadcast(starts)
    passed = F.coalesce(F.size(F.filter("__starts", lambda x: x <= v)), F.lit(0))
    return df.join(starts, F.col(label).eqNullSafe(F.col("__class")), "left").select(
        *[F.col(f"`{c}`") for c in df.columns if c != out], F.when(v.isNull() | F.col("__starts").isNull(), 0).otherwise(passed).alias(out))


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """Shuffled folds of near-equal size: hash of (key, seed) modulo k."""
    return df.withColumn(out, (hash32(key, F.lit(seed)) % k).cast("int"))
