"""Randomised properties (few examples each: every example runs Spark jobs)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabpredict.operators.orderstat import quantiles
from tabpredict.operators.ranged import ranged_cumsum
from tabpredict.operators.split import n_test_rows, split_holdout_sized

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(n=st.integers(min_value=2, max_value=3000),
       size=st.sampled_from([0.1, 0.25, 0.3, 0.333, 0.5, 0.9]),
       seed=st.integers(min_value=0, max_value=10_000),
       parts=st.integers(min_value=1, max_value=7))
def test_split_exact_and_layout_free(spark, n, size, seed, parts):
    df = spark.range(0, n).withColumnRenamed("id", "row_id")
    a = split_holdout_sized(df, "row_id", size, seed)
    b = split_holdout_sized(df.repartition(parts), "row_id", size, seed)
    ta = {r.row_id for r in a.df.where("is_test = 1").collect()}
    tb = {r.row_id for r in b.df.where("is_test = 1").collect()}
    assert len(ta) == n_test_rows(n, size) == a.n_test
    assert a.n == n and ta == tb


@SETTINGS
@given(vals=st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=400),
       q=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]))
def test_quantile_matches_numpy(spark, vals, q):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = quantiles(df, "x", [q])[0]
    assert got == np.quantile(np.array(vals, dtype=float), q)


@SETTINGS
@given(n=st.integers(min_value=1, max_value=1500),
       target=st.sampled_from([10, 100, 100_000]))
def test_running_sum_any_bucketing(spark, n, target):
    rng = np.random.default_rng(n)
    rows = [(float(v), int(c)) for v, c in zip(rng.permutation(n), rng.integers(0, 9, n))]
    df = spark.createDataFrame(rows, "s double, c long")
    out = ranged_cumsum(df, "s", ["c"], descending=False, target_rows=target).orderBy("s")
    assert [r.cum_c for r in out.collect()] == list(np.cumsum([c for _, c in sorted(rows)]))
    assert out.where(F.col("cum_c").isNull()).count() == 0
