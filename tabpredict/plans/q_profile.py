"""Queries: scans, profiling, cleaning, projections, split, folds, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import profile as PR
from ..operators.scale import standardize
from ..operators.split import assign_folds, assign_stratified_folds, split_holdout
from ..session import shared_path
from ..sources.tables import CHURN_FEATURES, churn_obs, raw_obs, read_csv
from .fixtures_sql import with_ctes
from .registry import query

RAW_COLS = ["row_id", "churn", "monthly_revenue", "retention_calls", "has_credit_card",
            "homeownership", "handset_price", "service_area", "credit_rating", "occupation"]
RAW_TEXT = ["churn", "has_credit_card", "homeownership", "handset_price", "service_area",
            "credit_rating", "occupation"]


def churn_split(spark, sf):
    """churn_obs (an aggregate + join) is written once, then split: the
    histogram passes and every later pass read the written table."""
    return split_holdout(churn_obs(spark, sf), "row_id", 0.333, 1337, materialize=True)


# -- S2, P1, A1 ----------------------------------------------------------------

@query("profile_shape", with_ctes(
    "SELECT count(*) AS n_rows, 10 AS n_cols FROM raw_obs", "raw_obs"))
def profile_shape(spark, sf):
    return PR.shape(raw_obs(spark, sf))


@query("profile_label_rate", with_ctes(
    "SELECT round(avg(CASE WHEN churn = 'Yes' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 6) "
    "AS label_pct FROM raw_obs", "raw_obs"))
def profile_label_rate(spark, sf):
    return PR.label_rate(raw_obs(spark, sf), "churn", "Yes")


@query("class_counts", with_ctes(
    "SELECT churn, count(*) AS n FROM raw_obs GROUP BY churn", "raw_obs"))
def class_counts(spark, sf):
    return PR.class_counts(raw_obs(spark, sf), "churn")


# -- A3, A4 --------------------------------------------------------------------

def _zeros_nulls_sql() -> str:
    parts = []
    for c in RAW_COLS:
        zero = "0::BIGINT" if c in RAW_TEXT else f"count(*) FILTER (WHERE {c} = 0)"
        null = (f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))" if c == "monthly_revenue"
                else f"count(*) FILTER (WHERE {c} IS NULL)")
        parts.append(f"SELECT '{c}' AS col_name, {zero} AS n_zero, {null} AS n_null FROM raw_obs")
    return with_ctes(" UNION ALL ".join(parts), "raw_obs")


@query("profile_zeros_nulls", _zeros_nulls_sql())
def profile_zeros_nulls(spark, sf):
    return PR.zeros_nulls(raw_obs(spark, sf))


def _max_null_sql() -> str:
    nulls = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL"
                      + (f" OR isnan({c}))" if c == "monthly_revenue" else ")") for c in RAW_COLS)
    return with_ctes(f"SELECT round(100.0::DOUBLE * round(greatest({nulls}) / count(*), 4), 6) "
                     "AS max_null_pct FROM raw_obs", "raw_obs")


@query("profile_max_null_pct", _max_null_sql())
def profile_max_null_pct(spark, sf):
    return PR.max_null_pct(raw_obs(spark, sf))


# -- A5 describe ---------------------------------------------------------------

def _describe_sql() -> str:
    parts = []
    for c in CHURN_FEATURES:
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
            f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max "
            "FROM churn_obs")
    return with_ctes(" UNION ALL ".join(parts), "churn_obs")


@query("describe_features", _describe_sql())
def describe_features(spark, sf):
    return PR.describe(churn_obs(spark, sf), CHURN_FEATURES)


# -- A10, A9 -------------------------------------------------------------------

@query("churn_by_category", with_ctes(
    "SELECT c_mktsegment, count(*) AS n_positive FROM churn_obs WHERE label = 1 "
    "GROUP BY c_mktsegment", "churn_obs"))
def churn_by_category(spark, sf):
    return PR.churn_by_category(churn_obs(spark, sf), "label", "c_mktsegment")


@query("split_class_ratio", with_ctes("""
SELECT CASE WHEN grouping(is_test) = 1 THEN 'whole' ELSE CAST(is_test AS VARCHAR) END AS part,
       count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg,
       round(count(*) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label <> 1)::DOUBLE, 6)
         AS pos_neg_ratio
FROM churn_split GROUP BY ROLLUP (is_test)""", "churn_split"))
def split_class_ratio(spark, sf):
    return PR.split_class_ratio(churn_split(spark, sf), "label", "is_test")


# -- X1, X3 --------------------------------------------------------------------

@query("split_holdout", with_ctes("SELECT row_id, is_test FROM churn_split", "churn_split"))
def q_split_holdout(spark, sf):
    return churn_split(spark, sf).select("row_id", "is_test")


@query("assign_folds", with_ctes(
    "SELECT row_id, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER) AS fold FROM churn_obs",
    "churn_obs"))
def q_assign_folds(spark, sf):
    return assign_folds(churn_obs(spark, sf), "row_id", 5).select("row_id", "fold")


@query("assign_stratified_folds", with_ctes("""
SELECT row_id, label, CAST(CASE WHEN i < n % 4 * (n // 4 + 1) THEN i // (n // 4 + 1) ELSE n % 4 + (i - n % 4 * (n // 4 + 1)) // (n // 4) END AS INTEGER) AS fold
FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM churn_obs)""", "churn_obs"))
def q_assign_stratified_folds(spark, sf):
    """Four folds with the same share of each class."""
    return assign_stratified_folds(churn_obs(spark, sf), "row_id", "label", 4).select("row_id", "label", "fold")


# -- X4, X5 --------------------------------------------------------------------

def _std_sql(cols: list[str]) -> str:
    sel = []
    for c in CHURN_FEATURES:
        if c in cols:
            sel.append(f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN {c} - avg({c}) OVER () "
                       f"ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 6) AS {c}")
        else:
            sel.append(c)
    return with_ctes(f"SELECT row_id, {', '.join(sel)} FROM churn_obs", "churn_obs")


def _std_query(spark, sf, cols):
    d = standardize(churn_obs(spark, sf), cols)
    return d.select("row_id", *[F.round(c, 6).alias(c) if c in cols else F.col(c)
                                for c in CHURN_FEATURES])


@query("standardize_all", _std_sql(CHURN_FEATURES))
def standardize_all(spark, sf):
    return _std_query(spark, sf, CHURN_FEATURES)


SUBSET = CHURN_FEATURES[:3]


@query("standardize_subset", _std_sql(SUBSET))
def standardize_subset(spark, sf):
    return _std_query(spark, sf, SUBSET)


# -- P2 - P5 projections -----------------------------------------------------

FEATURE_SET = ["spend", "recency", "n_orders"]


@query("project_feature_set", with_ctes(
    f"SELECT row_id, {', '.join(FEATURE_SET)}, label FROM churn_obs", "churn_obs"))
def project_feature_set(spark, sf):
    return churn_obs(spark, sf).select("row_id", *FEATURE_SET, "label")


@query("drop_by_ordinal", with_ctes(
    "SELECT churn, monthly_revenue, retention_calls, has_credit_card, homeownership, "
    "handset_price, credit_rating, occupation FROM raw_obs", "raw_obs"))
def drop_by_ordinal(spark, sf):
    ro = raw_obs(spark, sf)
    return C.drop_by_ordinal(ro, [0, ro.columns.index("service_area")])


@query("features_without_label", with_ctes(
    "SELECT row_id, c_acctbal, c_nationkey, c_mktsegment, n_orders, spend, n_urgent, recency "
    "FROM churn_obs", "churn_obs"))
def features_without_label(spark, sf):
    return churn_obs(spark, sf).drop("label")


@query("reorder_columns", with_ctes(
    "SELECT row_id, c_nationkey, c_mktsegment, n_orders, spend, n_urgent, label, "
    "recency, c_acctbal FROM churn_obs", "churn_obs"))
def reorder_columns(spark, sf):
    return C.move_to_end(churn_obs(spark, sf), ["recency", "c_acctbal"])


# -- P6 - P12 cleaning ---------------------------------------------------------

@query("encode_flags", with_ctes(
    "SELECT row_id, CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS churn, "
    "CASE WHEN has_credit_card = 'Yes' THEN 1 ELSE 0 END AS has_credit_card, "
    "CASE WHEN homeownership = 'Known' THEN 1 ELSE 0 END AS homeownership FROM raw_obs",
    "raw_obs"))
def encode_flags(spark, sf):
    d = C.encode_flags(raw_obs(spark, sf), C.RAW_FLAGS)
    return d.select("row_id", *C.RAW_FLAGS)


@query("replace_sentinel", with_ctes(
    "SELECT row_id, CASE WHEN handset_price = 'Unknown' THEN '0' ELSE handset_price END "
    "AS handset_price FROM raw_obs", "raw_obs"))
def replace_sentinel(spark, sf):
    return C.replace_sentinel(raw_obs(spark, sf), "handset_price").select("row_id", "handset_price")


@query("str_suffix", with_ctes(
    "SELECT row_id, right(service_area, 3) AS area_code FROM raw_obs", "raw_obs"))
def str_suffix(spark, sf):
    return C.add_suffix(raw_obs(spark, sf), "service_area", "area_code", 3).select("row_id", "area_code")


@query("str_prefix", with_ctes(
    "SELECT row_id, left(credit_rating, 1) AS credit_rating FROM raw_obs", "raw_obs"))
def str_prefix(spark, sf):
    return C.keep_prefix(raw_obs(spark, sf), "credit_rating", 1).select("row_id", "credit_rating")


@query("label_encode", with_ctes(
    "SELECT row_id, CAST(dense_rank() OVER (ORDER BY occupation) - 1 AS INTEGER) AS occupation "
    "FROM raw_obs", "raw_obs"))
def label_encode(spark, sf):
    return C.label_encode(raw_obs(spark, sf), ["occupation"]).select("row_id", "occupation")


@query("fill_nulls", with_ctes(
    "SELECT row_id, churn, coalesce(monthly_revenue, 0) AS monthly_revenue, retention_calls, "
    "coalesce(has_credit_card, '0') AS has_credit_card, homeownership, handset_price, "
    "coalesce(service_area, '0') AS service_area, credit_rating, occupation FROM raw_obs",
    "raw_obs"))
def fill_nulls(spark, sf):
    return C.fill_nulls(raw_obs(spark, sf))


@query("cast_int", with_ctes(
    "SELECT row_id, CAST(CASE WHEN handset_price = 'Unknown' THEN '0' ELSE handset_price END "
    "AS BIGINT) AS handset_price, CAST(left(credit_rating, 1) AS BIGINT) AS credit_rating "
    "FROM raw_obs", "raw_obs"))
def cast_int(spark, sf):
    d = C.keep_prefix(C.replace_sentinel(raw_obs(spark, sf), "handset_price"), "credit_rating", 1)
    return C.cast_int(d, ["handset_price", "credit_rating"]).select(
        "row_id", "handset_price", "credit_rating")


@query("clean_raw", with_ctes(
    "SELECT CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS churn, "
    "coalesce(monthly_revenue, 0) AS monthly_revenue, retention_calls, "
    "CASE WHEN has_credit_card = 'Yes' THEN 1 ELSE 0 END AS has_credit_card, "
    "CASE WHEN homeownership = 'Known' THEN 1 ELSE 0 END AS homeownership, "
    "CAST(CASE WHEN handset_price = 'Unknown' THEN '0' ELSE handset_price END AS BIGINT) "
    "AS handset_price, CAST(left(credit_rating, 1) AS BIGINT) AS credit_rating, "
    "CAST(dense_rank() OVER (ORDER BY occupation) - 1 AS INTEGER) AS occupation, "
    "CAST(coalesce(right(service_area, 3), '0') AS BIGINT) AS area_code FROM raw_obs",
    "raw_obs"))
def clean_raw(spark, sf):
    return C.clean_raw(raw_obs(spark, sf))


# -- T6 ------------------------------------------------------------------------

@query("sort_by_row_id", with_ctes(
    "SELECT row_id, label, spend FROM churn_obs ORDER BY row_id", "churn_obs"))
def sort_by_row_id(spark, sf):
    return churn_obs(spark, sf).select("row_id", "label", "spend").orderBy("row_id")


# -- S1 ------------------------------------------------------------------------

@query("scan_csv_roundtrip", with_ctes("SELECT * FROM raw_obs", "raw_obs"))
def scan_csv_roundtrip(spark, sf):
    """raw_obs written as CSV (header) under the shared folder, then scanned
    back with an explicit schema and FAILFAST: the CSV source end to end."""
    ro = raw_obs(spark, sf)
    path = shared_path(spark, "raw_csv")
    ro.write.mode("overwrite").option("header", True).csv(path)
    return read_csv(spark, path, schema=ro.schema)
