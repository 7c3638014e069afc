"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a softmax
classifier learns the parts of a vector's neighbours. Every vector is indexed
under its likeliest part, a query probes its likeliest parts, as many as held-out
queries need for the target recall, and the rows there are ranked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the sample that the partition is learned on (rows), and of the queries that measure recall.
SAMPLE_ROWS, MEASURE_ROWS = 16_384, 1000
#: Rows in a part, on average, and bounds on the number of parts.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 4096, 8, 256
#: Share of true neighbours that the probed parts must hold among the sample.
RECALL = 0.97
GRAPH_DEGREE = 10
#: Rows and queries of one comparison.
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 10_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of unit vectors."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        near = x[lo:lo + 1024] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo:lo + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, edges: np.ndarray, parts: int, rounds: int = 20) -> np.ndarray:
    """Halve along the direction of largest spread until there are enough parts, then move
    nodes to the part that most of their neighbours are in while no part grows by a tenth."""
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        own = groups.pop(0)
        middle = x[own] - x[own].mean(0)
        side = middle @ np.linalg.svd(middle[:2048], full_matrices=False)[2][0]
        order = own[np.argsort(side, kind="stable")]
        groups += [order[:len(own) // 2], order[len(own) // 2:]]
    for k, own in enumerate(groups):
        part[own] = k
    room = int(np.ceil(1.1 * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), edges.shape[1]), part[edges].ravel()), 1)
        np.add.at(votes, (edges.ravel(), np.repeat(part, edges.shape[1])), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room and size[part[i]] > 1:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train_classifier(x: np.ndarray, target: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights for the target shares of each part, by gradient steps with momentum estimates."""
    w, b = np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        error = (softmax(x @ w + b) - target) / len(x)
        for k, (p, g) in enumerate(((w, x.T @ error + 1e-6 * w), (b, error.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= 0.1 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-9)
    return w, b


class Partition:
    """A learned partition: classifier weights and how many parts a query probes."""

    def __init__(self, sample: np.ndarray, parts: int, k: int, recall: float):
        every = unit(sample)
        # queries that measure recall are kept out of the graph and of the fit
        held = np.zeros(len(every), bool)
        held[::max(4, len(every) // MEASURE_ROWS)] = len(every) >= 8
        x, asked = every[~held], every[held]
        parts = max(1, min(parts, len(x) // 16))
        edges = graph(x, GRAPH_DEGREE)
        part = balanced_parts(x, edges, parts)
        target = np.zeros((len(x), parts))
        if edges.shape[1]:
            np.add.at(target, (np.repeat(np.arange(len(x)), edges.shape[1]), part[edges].ravel()), 1 / edges.shape[1])
        target = 0.5 * target + 0.5 * np.eye(parts)[part] if edges.shape[1] else np.eye(parts)[part]
        self.w, self.b = train_classifier(x, target)
        # how far down a held-out query's ranking of parts its true neighbours in the sample lie
        own = (x @ self.w + self.b).argmax(1)
        order = np.argsort(-(asked @ self.w + self.b), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(asked), 0), 1)
        near = np.argpartition(-(asked @ x.T), min(k, len(x)) - 1, axis=1)[:, :k] if len(asked) else np.zeros((0, 1), np.int64)
        depth = np.take_along_axis(rank, own[near], 1).ravel() if near.size else np.zeros(1, np.int64)
        found = np.cumsum(np.bincount(depth, minlength=parts)) / len(depth)
        self.probes = int(np.argmax(found >= recall)) + 1
        self.measured = float(found[self.probes - 1])

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(unit(x) @ self.w + self.b), axis=1, kind="stable")[:, :n]


def vectors(cells: pa.Array, size: int) -> np.ndarray:
    off = cells.offsets.to_numpy()
    return cells.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5,
            sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, recall: float = RECALL) -> DataFrame:
    """The k rows of largest cosine found for each query (rows where the Column ``is_query`` holds).

    Returns query_id, rank (from 1), vec_id, score: the cosine in double precision, ties to
    the smaller vec_id; all candidates if fewer than k. A query is no candidate of itself;
    other rows, copies of it too, are. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids and vectors of another length than
    the most common (ties: the shorter). Rows of one id are queries and candidates of their
    own, repeated rows too: equal rows are searched once and counted as often as they are
    there. An empty table gives no rows."""
    cell = F.col("cell")
    fine = (F.col("id").isNotNull() & cell.isNotNull() & ~F.exists(cell, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
            & F.exists(cell, lambda v: v != 0))
    sized = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("cell"),
                        is_query.alias("asked")).where(fine)
    common = sized.groupBy(F.size("cell").alias("n")).count().orderBy(F.desc("count"), "n").first()
    shape = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return rows.sparkSession.createDataFrame([], shape)
    size, n = common["n"], common["count"]
    full = sized.where(F.size("cell") == size).groupBy("id", "cell").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("asked").alias("asks"))
    share = min(1.0, sample_rows / n)
    sample = full.where(F.pmod(F.xxhash64("id", "cell"), F.lit(1_000_003)) < share * 1_000_003).select("cell").limit(2 * sample_rows).toPandas()
    if len(sample) < 2:
        sample = full.select("cell").limit(sample_rows).toPandas()
    learned = Partition(np.stack(sample["cell"].to_numpy()), int(np.clip(n // part_rows, LEAST_PARTS, MOST_PARTS)), k, recall)

    def route(batches):
        for batch in batches:
            x = vectors(batch.column("cell"), size)
            if not len(x):
                continue
            probe = learned.ranked(x, learned.probes)
            asked = batch.column("asks").to_numpy() > 0
            lists = [p if a else p[:0] for p, a in zip(probe, asked)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "cell", "copies", "asks")), pa.array(probe[:, 0].astype(np.int32)),
                                              pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["id", "cell", "copies", "asks", "part", "probes"])

    placed = full.mapInArrow(route, "id long, cell array<double>, copies long, asks long, part int, probes array<int>")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n_rows"))
    asks = placed.select("id", "cell", "asks", F.explode("probes").alias("part"))
    loads = asks.groupBy("part").agg(F.count("*").alias("n_asks"))
    cuts = sizes.join(loads, "part").select("part", F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("int").alias("rb"),
                                            F.ceil(F.col("n_asks") / BLOCK_QUERIES).cast("int").alias("qb"))
    cuts = F.broadcast(cuts)                                    # a row a part: at most MOST_PARTS
    base = placed.select("id", "cell", "copies", "part").join(cuts, "part").select(
        "id", "cell", "copies", "part", F.pmod(F.xxhash64("id", "cell"), F.col("rb")).cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
    asks = asks.join(cuts, "part").select(
        F.col("id").alias("ask"), F.col("cell").alias("ask_cell"), "asks", "part", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"),
        F.pmod(F.xxhash64("id", "cell"), F.col("qb")).cast("int").alias("q"))
    asks = asks.select("ask", "ask_cell", F.xxhash64("ask_cell").alias("ask_key"), "asks", "part", "r", "q")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left.column("id").to_numpy(), right.column("ask").to_numpy()
        copies, keys, times = left.column("copies").to_numpy(), right.column("ask_key").to_numpy(), right.column("asks").to_numpy()
        out = [[], [], [], [], []]
        if len(ids) and len(qids):
            x, y = vectors(left.column("cell").combine_chunks(), size), vectors(right.column("ask_cell").combine_chunks(), size)
            norm, asked_norm = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            scaled = (x / norm[:, None]).T
            for lo in range(0, len(y), 256):
                near = (y[lo:lo + 256] / asked_norm[lo:lo + 256, None]) @ scaled
                # a query's own row: of equal rows all but one are candidates
                at, own = np.nonzero(qids[lo:lo + 256, None] == ids[None, :])
                same = (y[lo + at] == x[own]).all(1)
                itself = dict(zip(at[same].tolist(), own[same].tolist()))
                alone = same & (copies[own] == 1)
                near[at[alone], own[alone]] = -np.inf
                most = min(k, near.shape[1])
                floor = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
                for i in range(len(near)):
                    # all rows that rounding cannot tell from the k-th, scored once more row by row
                    own = np.flatnonzero((near[i] >= floor[i] - 1e-12) & (near[i] > -np.inf))
                    score = (x[own] * y[lo + i]).sum(1) / (norm[own] * asked_norm[lo + i])
                    best = np.lexsort((ids[own], -score))[:k]
                    n = copies[own[best]] - (own[best] == itself.get(i, -1))
                    best = np.repeat(best, np.minimum(n, k))[:k]
                    for column, cell in zip(out, (qids[lo + i], keys[lo + i], times[lo + i])):
                        column.append(np.full(len(best), cell))
                    out[3].append(ids[own[best]])
                    out[4].append(score[best])
        cells = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({c: pa.array(cells[i].astype(np.int64 if i < 4 else np.float64)) for i, c in enumerate(("query_id", "ask_key", "asks", "vec_id", "score"))})

    found = base.groupBy("part", "r", "q").cogroup(asks.toDF("ask", "ask_cell", "ask_key", "asks", "ask_part", "ask_r", "ask_q").groupBy("ask_part", "ask_r", "ask_q")).applyInArrow(
        search, "query_id long, ask_key long, asks long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "ask_key").orderBy(F.desc("score"), "vec_id"))
    first = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return first.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "asks"))).select("query_id", "rank", "vec_id", "score")
