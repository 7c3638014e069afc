"""Every query with a SQL twin equals DuckDB on the same parquet tables;
every other query runs and keeps its schema."""

import pytest

import __spark_entry__ as E
from check_oracle import compare
from paths import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()
EXACT = sorted(SQL)
# heavy model queries are exercised in test_models.py
ROWS_ONLY = sorted(set(QUERIES) - set(SQL) - {
    "model_report", "model_scoreboard", "grid_search_gbt", "train_rbf_svm", "train_poly_svm", "train_gbt_third",
    "sweep_random_forest", "train_gbt_continue", "gbt_round_metrics", "report_skeleton"})


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", EXACT)
def test_matches_duckdb(spark, duck_small, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    got = sdf.toPandas()
    want = duck_small.execute(SQL[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg
    # same column types on both sides
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    st = {f.name: names.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in sdf.schema.fields}
    dt = {r[0]: r[1] for r in duck_small.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert st == dt


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))


def test_entry(spark):
    out = E.entry(spark).collect()
    assert len(out) == 4
    assert sum(r["n"] for r in out) > 0
