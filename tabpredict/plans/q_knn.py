"""Queries: exact KNN on the embeddings table and its k sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.knn import knn_predict, knn_sweep, neighbours, to_vector_array
from ..operators.split import split_holdout
from ..sources.tables import embeddings_obs, read_table
from .fixtures_sql import register, split_body, with_ctes
from .registry import query

K = 29
SWEEP_KS = list(range(3, 104, 2))

register("emb_split", split_body("embeddings_obs"), ["embeddings_obs"])
register("knn_d", """
SELECT te.row_id AS q, te.label AS y, tr.row_id AS t, tr.label AS c,
       list_distance(CAST(te.embedding AS DOUBLE[]), CAST(tr.embedding AS DOUBLE[])) AS dist
FROM emb_split te, emb_split tr WHERE te.is_test = 1 AND tr.is_test = 0""", ["emb_split"])
register("knn_r", "SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rn FROM knn_d",
         ["knn_d"])

register("knn_cells", """
SELECT c_custkey AS row_id, c_nationkey AS label,
       [CAST(c_nationkey % 3 AS DOUBLE), CAST(length(c_mktsegment) AS DOUBLE)] AS v FROM customer""", [])


def knn_cells(spark, sf):
    d = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("label"),
        (F.col("c_nationkey") % 3).alias("x"), F.length("c_mktsegment").alias("y"))
    return to_vector_array(d, ["x", "y"])


def emb_split(spark, sf):
    return split_holdout(embeddings_obs(spark, sf), "row_id", 0.333, 1337)


@query("knn_predict", with_ctes(f"""
SELECT q AS row_id, y AS label, CAST(c AS INTEGER) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, c) AS rk FROM (
    SELECT q, y, c, count(*) AS n FROM knn_r WHERE rn <= {K} GROUP BY q, y, c))
WHERE rk = 1""", "knn_r"))
def q_knn_predict(spark, sf):
    d = emb_split(spark, sf)
    return knn_predict(d.where("is_test = 0"), d.where("is_test = 1"), K)


@query("sweep_knn_k", with_ctes(f"""
SELECT k, round(avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(1 - avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY n DESC, c) AS rk FROM (
    SELECT q, y, k, c, count(*) AS n FROM knn_r,
      (SELECT unnest({SWEEP_KS}) AS k) ks WHERE rn <= k GROUP BY q, y, k, c))
WHERE rk = 1 GROUP BY k""", "knn_r"))
def sweep_knn_k(spark, sf):
    d = emb_split(spark, sf)
    return knn_sweep(d.where("is_test = 0"), d.where("is_test = 1"), SWEEP_KS).select(
        F.col("k").cast("int").alias("k"), "accuracy", "error")


@query("knn_tied_vectors", with_ctes("""
SELECT q AS row_id, CAST(rn AS INTEGER) AS rank, t AS t_id, round(dist, 6) AS dist FROM (
  SELECT q.row_id AS q, t.row_id AS t, list_distance(q.v, t.v) AS dist,
         row_number() OVER (PARTITION BY q.row_id ORDER BY list_distance(q.v, t.v), t.row_id) AS rn
  FROM knn_cells q, knn_cells t WHERE q.row_id % 50 = 0)
WHERE rn <= 7""", "knn_cells"))
def knn_tied_vectors(spark, sf):
    """Neighbours of customers by (nation, segment's length): over a thousand equal vectors."""
    d = knn_cells(spark, sf)
    return neighbours(d, d.where("row_id % 50 = 0"), 7).select(
        F.col("q_id").alias("row_id"), F.col("rank").cast("int"), "t_id", F.round("dist", 6).alias("dist"))


@query("best_knn_k", with_ctes(f"""
SELECT k, accuracy FROM (
  SELECT k, round(avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
    SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY n DESC, c) AS rk FROM (
      SELECT q, y, k, c, count(*) AS n FROM knn_r,
        (SELECT unnest({SWEEP_KS}) AS k) ks WHERE rn <= k GROUP BY q, y, k, c))
  WHERE rk = 1 GROUP BY k)
ORDER BY accuracy DESC, k LIMIT 1""", "knn_r"))
def best_knn_k(spark, sf):
    """Best setting of the sweep: highest accuracy, the smallest k on ties."""
    sw = sweep_knn_k(spark, sf)
    return sw.orderBy(F.desc("accuracy"), F.asc("k")).limit(1).select("k", "accuracy")
