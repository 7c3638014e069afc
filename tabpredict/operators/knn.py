"""Exact k-nearest-neighbour classification, blocked.

The training rows are split into ``t_blocks`` blocks and the query rows
into ``q_blocks`` blocks by a hash of their id. Every (query block, train
block) cell is one cogroup task: numpy computes the distances of that
cell's queries to that cell's training rows in chunks and keeps only each
query's k nearest (all rows that rounding cannot tell from the k-th are
measured exactly first), so a task emits at most k rows per query and holds
a bounded number of distances. The k × t_blocks
candidates of each query are then cut to k with ``row_number`` over a
window partitioned by the query id. Ties: smaller distance, then smaller
training id; the vote is a plain majority, ties to the smaller class.

Work is |queries| × |train| distance evaluations by nature (exact KNN);
the blocking spreads it over q_blocks × t_blocks tasks, and block sizes are
chosen from the row counts so that no cell is larger than the targets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_BLOCK_ROWS = 20_000
QUERY_BLOCK_ROWS = 20_000
#: Queries in a block, at least, when blocks are added to use the cluster.
LEAST_QUERY_ROWS = 64
#: Distances held at once, and pairs measured exactly at once.
CHUNK_CELLS, CHUNK_PAIRS = 2_000_000, 200_000


def _block(col: str, n: int):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


def neighbours(train: DataFrame, queries: DataFrame, k: int, id_col: str = "row_id",
               vec_col: str = "embedding", label_col: str = "label",
               t_blocks: int | None = None, q_blocks: int | None = None) -> DataFrame:
    """(q_id, rank, t_id, t_label, dist) for the k nearest training rows of
    every query row (rank 1 = nearest)."""
    if t_blocks is None or q_blocks is None:
        nt, nq = train.count(), queries.count()
        t_blocks = t_blocks or max(1, math.ceil(nt / TRAIN_BLOCK_ROWS))
        cores = train.sparkSession.sparkContext.defaultParallelism
        q_blocks = q_blocks or max(1, math.ceil(nq / QUERY_BLOCK_ROWS),
                                   min(cores, math.ceil(nq / LEAST_QUERY_ROWS)))
    t = train.select(F.col(id_col).alias("t_id"), F.col(vec_col).alias("v"),
                     F.col(label_col).alias("t_label"), _block(id_col, t_blocks).alias("tb"))
    t = t.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = queries.select(F.col(id_col).alias("q_id"), F.col(vec_col).alias("v"),
                       _block(id_col, q_blocks).alias("qb"))
    q = q.withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))))
    kk, chunk_cells, chunk_pairs = k, CHUNK_CELLS, CHUNK_PAIRS

    # Runs in the Python workers: self-contained (numpy / pandas only), so
    # workers need not import this package.
    def cell(qp: pd.DataFrame, tp: pd.DataFrame) -> pd.DataFrame:
        def vectors(s: pd.Series) -> np.ndarray:
            return np.stack([np.asarray(v, dtype=np.float64) for v in s.to_numpy()])

        if qp.empty or tp.empty:
            return pd.DataFrame({"q_id": pd.Series([], dtype="int64"),
                                 "t_id": pd.Series([], dtype="int64"),
                                 "t_label": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64")})
        T = vectors(tp["v"])
        tid = tp["t_id"].to_numpy(dtype=np.int64)
        tlab = tp["t_label"].to_numpy(dtype=np.int64)
        tn = (T * T).sum(axis=1)
        Q = vectors(qp["v"])
        qid = qp["q_id"].to_numpy(dtype=np.int64)
        keep = min(kk, len(tid))
        chunk = max(1, chunk_cells // len(tid))
        # what the expanded square can be off by, for vectors of this length
        slack = 1e-13 * (T.shape[1] + 8) * (tn.max() + (Q * Q).sum(axis=1).max() + 1e-300)
        out_q, out_t, out_l, out_d = [], [], [], []
        for s in range(0, len(qid), chunk):
            Qc = Q[s:s + chunk]
            approx = (Qc * Qc).sum(axis=1)[:, None] + tn[None, :] - 2.0 * (Qc @ T.T)
            # every row that rounding cannot tell from the k-th nearest is
            # measured exactly, so ties fall to the smaller id
            bound = np.partition(approx, keep - 1, axis=1)[:, keep - 1] + 2 * slack
            r, c = np.nonzero(approx <= bound[:, None])
            exact = np.empty(len(r))
            for lo in range(0, len(r), chunk_pairs):
                hi = lo + chunk_pairs
                diff = Qc[r[lo:hi]] - T[c[lo:hi]]
                exact[lo:hi] = np.sqrt((diff * diff).sum(axis=1))
            order = np.lexsort((tid[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < kk
            out_q.append(qid[s + r[first]])
            out_t.append(tid[c[first]])
            out_l.append(tlab[c[first]])
            out_d.append(exact[first])
        return pd.DataFrame({"q_id": np.concatenate(out_q), "t_id": np.concatenate(out_t),
                             "t_label": np.concatenate(out_l), "dist": np.concatenate(out_d)})

    cand = (q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb"))
            .applyInPandas(cell, "q_id long, t_id long, t_label long, dist double"))
    w = Window.partitionBy("q_id").orderBy("dist", "t_id")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("q_id", "rank", "t_id", "t_label", "dist"))


def vote(nb: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Majority class among the first k neighbours for each k in ``ks``:
    (q_id, k, prediction); ties go to the smaller class."""
    kcol = F.explode(F.array(*[F.lit(int(x)) for x in ks])).alias("k")
    e = nb.select("q_id", "rank", "t_label", kcol).where(F.col("rank") <= F.col("k"))
    c = e.groupBy("q_id", "k", "t_label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("q_id", "k").orderBy(F.desc("n"), F.asc("t_label"))
    return (c.withColumn("r", F.row_number().over(w)).where("r = 1")
            .select("q_id", "k", F.col("t_label").alias("prediction")))


def knn_predict(train: DataFrame, queries: DataFrame, k: int, id_col: str = "row_id",
                vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    nb = neighbours(train, queries, k, id_col, vec_col, label_col)
    pred = vote(nb, [k]).select(F.col("q_id").alias(id_col), F.col("prediction").cast("int"))
    return queries.select(id_col, label_col).join(pred, id_col, "left")


def knn_sweep(train: DataFrame, queries: DataFrame, ks: Sequence[int], id_col: str = "row_id",
              vec_col: str = "embedding", label_col: str = "label", digits: int = 6) -> DataFrame:
    """Accuracy and error for every k, from ONE neighbour search at max(ks)."""
    nb = neighbours(train, queries, max(ks), id_col, vec_col, label_col)
    pred = vote(nb, ks)
    truth = queries.select(F.col(id_col).alias("q_id"), F.col(label_col).alias("y"))
    j = pred.join(truth, "q_id")
    acc = F.avg(F.when(F.col("prediction") == F.col("y"), 1.0).otherwise(0.0))
    return j.groupBy("k").agg(F.round(acc, digits).alias("accuracy"),
                              F.round(1 - acc, digits).alias("error"))


def to_vector_array(df: DataFrame, cols: Sequence[str], out: str = "embedding") -> DataFrame:
    """Numeric columns -> one array<double> column for the KNN operators."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))
