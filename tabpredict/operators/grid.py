"""Choice of boosting settings by cross-validation on binned rows.

Rows are binned once for each number of bins, for all rungs of a search. Binned tables of at most
``TOGETHER`` values (counted first; of a larger one its different rows, with the numbers of rows of each fold
and label) are sent to the tasks, and every (setting, fold) is a task of its own; one that is larger even
then stays apart, and each (setting, fold) is fitted by the cluster. Of
many settings, successive halving keeps the best part after a few rounds and gives the
rest more, so that only a handful are trained in full.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from . import gbm
from .evaluate import roc_auc
from .gbm import (RowsHere, Settings, bin_edges_each, bin_rows, boost, grow, labelled, named, read_block, tree_features, tree_outputs,
                  with_tables, worth_merging)

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of the package


def every_cell(levels: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the levels, the last parameter running fastest."""
    return [dict(zip(levels, x)) for x in itertools.product(*levels.values())]


def pair_cells(levels: Mapping[str, Sequence]) -> list[dict]:
    """27 of the combinations of up to 13 parameters of three levels each, in which every pair of
    levels of any two parameters occurs three times: a parameter's level is a linear form over
    the numbers modulo 3 of the cell's three digits, and no two forms are multiples."""
    if len(levels) > 13 or any(len(v) != 3 for v in levels.values()):
        raise ValueError("pair_cells takes at most 13 parameters of three levels")
    forms = [f for f in itertools.product(range(3), repeat=3) if next((x for x in f if x), 0) == 1]
    return [{name: v[sum(a * b for a, b in zip(f, cell)) % 3] for (name, v), f in zip(levels.items(), forms)}
            for cell in itertools.product(range(3), repeat=3)]


class Folds:
    """The rows of a search that have a label and a fold, binned once for each number of bins and sent to the tasks."""

    def __init__(self, df: DataFrame, features: Sequence[str], numbers: Sequence[int], label: str = "label", fold: str = "fold", together: int | None = None):
        self.features, self.label, self.fold, self.together = list(features), label, fold, together
        self.df = df.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{fold}`").isNotNull())
        self.sizes = {r["f"]: r["n"] for r in self.df.groupBy(F.col(f"`{fold}`").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
        self.folds, self.made = sorted(self.sizes), {}
        self.edges = bin_edges_each(self.df, self.features, sorted(set(numbers))) if self.folds and numbers else {}

    def sent(self, b: int):
        """What ``fit_and_own`` takes for this number of bins, as a broadcast; None: too large for a task."""
        if b not in self.made:
            p, limit = len(self.features), gbm.TOGETHER if self.together is None else self.together
            rows = sum(self.sizes.values())
            found = self.rows(b) if rows * p <= limit else self.counts(b, limit) if worth_merging(math.prod(len(e) + 2 for e in self.edges[b]), rows, p, limit) else None
            self.made[b] = None if found is None else self.df.sparkSession.sparkContext.broadcast(found)
        return self.made[b]

    def rows(self, b):
        """(codes, 1 for label 1, fold) of every row."""
        blocks = bin_rows(self.df, self.features, self.label, F.col(f"`{self.fold}`"), self.edges[b])       # the fold rides where a margin would
        parts = [read_block(batch, k, len(self.features)) for batch in blocks.toArrow().to_batches() for k in range(batch.num_rows)]     # at most TOGETHER codes
        discard(blocks)
        codes, y, of = (np.concatenate([x[c] for x in parts], axis=-1) for c in range(3))
        return codes, y == 1, of

    def counts(self, b, limit):
        """(codes, rows with label 1, rows) of the different rows, the latter two by fold, in as few bytes as their greatest number takes."""
        edges, folds, p = self.edges[b], self.folds, len(self.features)
        widths, at = [len(e) + 2 for e in edges], F.col(f"`{self.fold}`").cast("double").alias("m")
        each = named(labelled(self.df, self.features, self.label, at), edges, "y int, m double")
        names = [f"{c}{i}" for c in "yn" for i in range(len(folds))]
        table = materialize(each.groupBy("k").agg(*[F.count_if((F.col("m") == float(f)) & (F.col("y") == 1)).alias(f"y{i}") for i, f in enumerate(folds)],
                                                  *[F.count_if(F.col("m") == float(f)).alias(f"n{i}") for i, f in enumerate(folds)]).select("k", *names), "binned")
        size = table.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in names]).first()
        if size["n"] * p > limit:
            discard(table)
            return None
        kind = np.min_scalar_type(max(size[c] for c in names))

        def packed(batches):
            for batch in batches:
                codes = np.stack(np.unravel_index(batch.column(0).to_numpy(), widths)).astype(np.uint16)
                count = np.stack([c.to_numpy() for c in batch.columns[1:]]).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (codes, count)]], names=["n", "codes", "count"])

        whole = table.mapInArrow(packed, "n long, codes binary, count binary").toArrow().to_pylist()      # at most TOGETHER codes
        discard(table)
        codes = np.concatenate([np.frombuffer(r["codes"], np.uint16).reshape(p, r["n"]) for r in whole], axis=1)
        count = np.concatenate([np.frombuffer(r["count"], kind).reshape(2 * len(folds), r["n"]) for r in whole], axis=1)
        return codes, count[:len(folds)], count[len(folds):]

    def close(self):
        for sent in self.made.values():
            if sent is not None:
                sent.unpersist()


def fit_and_own(sent, f: int, fold):
    """((codes, rows with label 1, rows) to fit, the same of the fold asked)."""
    codes, y, n = sent
    if y.ndim == 1:
        return tuple((codes[:, at], y[at].astype(np.int64), np.ones(int(at.sum()), np.int64)) for at in (n != fold, n == fold))
    own = y[f].astype(np.int64), n[f].astype(np.int64)
    rest = y.sum(axis=0, dtype=np.int64) - own[0], n.sum(axis=0, dtype=np.int64) - own[1]
    return tuple((codes[:, at], yes[at], every[at]) for yes, every, at in ((*rest, rest[1] > 0), (*own, own[1] > 0)))


def fold_scores(df: DataFrame, features: Sequence[str], cells: Sequence[Settings], rounds: int, label: str = "label",
                fold: str = "fold", together: int | None = None, made: Folds | None = None) -> list[tuple[int, int, int, int, float | None]]:
    """(cell, fold, rows, rows right, AUC) of each setting fitted without a fold and asked on it.

    AUC counts equal margins half and is None for a fold of one class.
    Rows without a label or fold are left out. A fold whose remaining rows are of one class is
    answered by that model's base margin. Bins are those of all rows; they read no label. ``made``: the
    binned rows, if they are there already."""
    features, cells = list(features), list(cells)
    own = made or Folds(df, features, [s.max_bins for s in cells], label, fold, together)
    if not cells or not own.folds:
        return []
    out, here = [], [(i, s) for i, s in enumerate(cells) if own.sent(s.max_bins) is not None]
    if here:
        out += _scores_here(own, here, rounds)
    for (i, s), f in itertools.product([(i, s) for i, s in enumerate(cells) if own.sent(s.max_bins) is None], own.folds):
        model = boost(own.df.where(F.col(f"`{fold}`") != f), features, label, rounds, s, together=together, edges=own.edges[s.max_bins])
        asked = model.transform(own.df.where(F.col(f"`{fold}`") == f))
        right = asked.agg(F.count_if(F.col("prediction") == F.col(f"`{label}`")).alias("n")).first()["n"]
        out.append((i, f, own.sizes[f], right, roc_auc(asked, label, "margin", digits=15).first()["roc_auc"]))
    if made is None:
        own.close()
    return out


def auc(m: np.ndarray, yes: np.ndarray, every: np.ndarray | None = None) -> float | None:
    """Share of (yes, no) pairs in which the yes has the larger margin; equal ones count half. ``every``: how many
    rows an entry stands for, ``yes`` of them with label 1."""
    place, size = np.unique(m, return_inverse=True, return_counts=True)[1:]
    pos = np.bincount(place, yes, len(size))
    neg = (size if every is None else np.bincount(place, every, len(size))) - pos
    pairs = float(pos.sum()) * float(neg.sum())
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else None


def _scores_here(made: Folds, cells, rounds):
    spark, p, folds, edges = made.df.sparkSession, len(made.features), made.folds, made.edges
    sent = {s.max_bins: made.sent(s.max_bins) for _, s in cells}
    tasks = len(cells) * len(folds)

    def run(batches):
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                cell, f = divmod(i, len(folds))
                cell, s = cells[cell]
                cuts = edges[s.max_bins]
                (codes, y, n), (asked, yes, every) = fit_and_own(sent[s.max_bins].value, f, folds[f])
                pos, neg = float(y.sum()) * s.pos_weight, float((n - y).sum())
                base = math.log(pos / neg) if pos and neg else 0.0
                m = np.full(len(every), base)
                if pos and neg:
                    here = RowsHere(codes, y, np.full(len(n), base), s, n)
                    codes = y = n = None
                    for t in range(rounds):
                        nodes = list(zip(*grow(here, t, tree_features(p, t, s), cuts, s)))
                        feature, bin_, left, right, value = (np.array(nodes[c]) for c in (2, 3, 5, 6, 7))
                        m += next(tree_outputs(asked, with_tables([((feature, bin_, left, right), value)], [len(e) + 2 for e in cuts])))
                rows.append((cell, folds[f], int(every.sum()), int(np.where(m > 0, yes, every - yes).sum()), auc(m, yes, every)))
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["cell", "fold", "n", "n_right", "auc"])

    found = spark.range(0, tasks, 1, min(tasks, 4096)).mapInArrow(run, "cell long, fold long, n long, n_right long, auc double").collect()     # five numbers a task
    return [tuple(r) for r in found]


def successive_halving(df: DataFrame, features: Sequence[str], cells: Sequence[Settings], rounds: int, label: str = "label",
                       fold: str = "fold", keep: int = 3, together: int | None = None) -> list[tuple[int, int, int, float, float | None]]:
    """(rung, rounds, cell, share right over all folds, mean AUC of the folds) of every setting
    asked, best of a rung first: the larger share right, then the larger AUC, then the earlier.

    Each rung keeps the best 1/``keep`` of its settings and gives them ``keep`` times the rounds; the last has ``rounds``. The first row of the last rung is the
    choice. ``keep`` = number of settings or more: one rung, all of them trained in full."""
    alive, out = list(range(len(cells))), []
    made = Folds(df, features, [s.max_bins for s in cells], label, fold, together)
    rungs = 1
    while keep ** rungs < len(cells):
        rungs += 1
    for rung in range(rungs if alive else 0):
        n = max(1, rounds // keep ** (rungs - 1 - rung))
        total = {i: ([], [], []) for i in alive}
        for i, _, *figures in fold_scores(df, features, [cells[i] for i in alive], n, label, fold, together, made):
            for own, x in zip(total[alive[i]], figures):
                own.append(x)
        score = {}
        for i, (asked, right, areas) in total.items():
            areas = [x for x in areas if x is not None]
            score[i] = (sum(right) / max(sum(asked), 1), math.fsum(areas) / len(areas) if areas else None)
        order = sorted(alive, key=lambda i: (-score[i][0], -(score[i][1] or 0.0), i))
        out += [(rung, n, i, *score[i]) for i in order]
        alive = sorted(order[:max(1, math.ceil(len(order) / keep))])
    made.close()
    return out
