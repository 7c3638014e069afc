"""Connected components of a graph given by its links, without the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node each of them reaches."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for every node of a link (a, b).

    Rounds of large and small stars: each node passes on the smallest node it knows.
    A hub's links are joined with one row of its own, which a skewed join splits; every
    round is written, and ends the loop when it changes nothing."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", "m")).distinct()
        then = written(small, "links")
        drop_written(now)
        now = then
    return now.groupBy("a").agg(F.min("b").alias("b")).union(now.select("b", "b").distinct()).toDF("node", "label")
