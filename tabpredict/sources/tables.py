"""Readers for the input tables and the derived observation tables.

The derived tables (``raw_obs``, ``churn_obs``, ``line_obs``, ``scored_obs``)
are plain projections / pre-aggregated joins over the parquet tables, so
their cost grows with the input and Catalyst prunes every unused column.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import hash32

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()

# Fixed values of the derived fixtures.
CHURN_CUTOFF = _dt.date(2000, 11, 4)   # 270 days before the last order date
NO_ORDER_RECENCY = 9999
URGENT = "1-URGENT"
LINE_LABEL_CUT = 2.3
SCORE_OFFSET = 1.9
HASH_SPAN = 4294967295.0               # 16**8 - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan. ``spark.tabpredict.spread`` (a number, unset by default)
    deals the rows round-robin to so many tasks: for a laptop's single-file
    tables, whose scan is one task. On a cluster leave it unset."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = int(spark.conf.get("spark.tabpredict.spread", "0"))
    return df.repartition(spread) if spread > 1 else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV scan with a header; FAILFAST so a malformed file aborts the job.

    Pass an explicit schema in production; without one the types are
    inferred (one extra pass over the file).
    """
    reader = spark.read.option("header", header).option("mode", "FAILFAST")
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema)
    return reader.csv(path)


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the dirty column kinds of a raw extract:
    yes/no text with nulls, a sentinel word in a number column, coded text
    and a nullable number."""
    c = read_table(spark, sf_dir, "customer")
    h = hash32(F.lit("c"), "c_custkey")
    return c.select(
        F.col("c_custkey").alias("row_id"),
        F.when(F.col("c_acctbal") < 0, "Yes").otherwise("No").alias("churn"),
        F.when(h % 10 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal")).alias("monthly_revenue"),
        (h % 4).cast("int").alias("retention_calls"),
        F.when(h % 7 == 0, F.lit(None).cast("string"))
         .when(h % 2 == 0, "Yes").otherwise("No").alias("has_credit_card"),
        F.when(h % 3 == 0, "Known").otherwise("Unknown").alias("homeownership"),
        F.when(h % 5 == 0, "Unknown")
         .otherwise(((h % 50) * 10).cast("string")).alias("handset_price"),
        F.when(h % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("AREA"), F.lpad((h % 1000).cast("string"), 3, "0")))
         .alias("service_area"),
        F.concat((h % 7 + 1).cast("string"), F.lit("-Level")).alias("credit_rating"),
        F.col("c_mktsegment").alias("occupation"),
    )


CHURN_FEATURES = ["c_acctbal", "c_nationkey", "n_orders", "spend", "n_urgent", "recency"]


def churn_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: order history before the cut-off, label = no
    order on or after it. Orders are aggregated per customer first (map-side
    partial aggregation absorbs a hot customer), then joined once."""
    c = read_table(spark, sf_dir, "customer")
    o = read_table(spark, sf_dir, "orders")
    cut = F.lit(CHURN_CUTOFF)
    d = F.to_date("o_orderdate")
    before = d < cut
    per_cust = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.when(before, 1)).alias("n_orders"),
        F.sum(F.when(before, F.col("o_totalprice"))).alias("spend_raw"),
        F.count(F.when(before & (F.col("o_orderpriority") == URGENT), 1)).alias("n_urgent"),
        F.max(F.when(before, d)).alias("last_before"),
        F.count(F.when(~before, 1)).alias("n_after"),
    )
    j = c.join(per_cust, "c_custkey", "left")
    return j.select(
        F.col("c_custkey").alias("row_id"),
        "c_acctbal", "c_nationkey", "c_mktsegment",
        F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("n_orders"),
        F.coalesce(F.round("spend_raw", 2), F.lit(0.0)).alias("spend"),
        F.coalesce(F.col("n_urgent"), F.lit(0)).cast("bigint").alias("n_urgent"),
        F.coalesce(F.datediff(cut, F.col("last_before")), F.lit(NO_ORDER_RECENCY))
         .cast("int").alias("recency"),
        F.when(F.coalesce(F.col("n_after"), F.lit(0)) == 0, 1).otherwise(0).alias("label"),
    )


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_signal():
    return F.col("l_quantity") * 0.04 + F.col("l_discount") * 5 + F.col("l_tax") * 5


def line_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; a learnable label mixed with hash noise."""
    li = read_table(spark, sf_dir, "lineitem")
    h = hash32("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        h.alias("h"),
        *LINE_FEATURES,
        F.when(_line_signal() + h / F.lit(HASH_SPAN) > LINE_LABEL_CUT, 1).otherwise(0)
         .alias("label"),
    )


def scored_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_obs with a fixed probability score, for model-free evaluation."""
    lo = line_obs(spark, sf_dir)
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(_line_signal() - SCORE_OFFSET))), 6)
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return lo.select(key.alias("row_id"), "l_extendedprice", "label", p.alias("p"))


def embeddings_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", "label")
