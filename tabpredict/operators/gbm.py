"""Gradient boosting for binary log-loss on binned rows.

Rows are binned once: edges come from mergeable quantile sketches (a column of few
values keeps each of them), and blocks of bin codes, label and margin are written to
the shared folder. A tree grows from sums of gradient, hessian and rows by (leaf,
feature, bin): one aggregate a level gives them for the smaller child of every split,
the larger one is its parent less its sibling. Where the bins of a tree's features have
few combinations (cells), one aggregate by cell gives the whole tree. Split and leaf values take the L1 and L2
penalties, a minimum hessian, a minimum of rows, a fraction of the features a tree, and
a rate. Trees whose depth is bounded grow by level; with a bound on leaves only, the
leaf with the largest gain is split first.

The sums of a level, or of a tree over its cells, are a Spark job over the blocks. A job
costs some 0.1 s however few the rows, so binned tables of at most ``TOGETHER`` values
(counted, not guessed) are read by one task that runs the same rounds over its arrays. A
table with more values, or with twice as many rows as all its bins can make different
ones, is written as its different rows and how many of each label they stand for: rows
of equal bins have equal margins in every round.

A model is one table of nodes, scored batch by batch without a plan node a tree.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of the package

#: Binned values (rows x features) that one task may hold: of four features some 60 bytes a row, 480 MB.
TOGETHER = 32_000_000
#: Rounds between two writings of the margins of a table that is not held together.
KEEP_ROUNDS = 10
#: Bins of the score histograms that a round's AUC is taken from.
AUC_BINS = 1024
#: Cells by which one task may sum a tree's rows, and those that may reach the driver for a tree.
CELLS, CELLS_SENT = 2_000_000, 100_000
#: Entries of the table in which a tree's outputs are looked up; a tree that needs more is walked.
TABLE = 65_536
#: Trees from which on those of the same features are added up into one table before they are asked, and its entries at most.
SUMMED, SUMMED_TABLE = 32, 1_000_000
VERSION = 1


@dataclass(frozen=True)
class Settings:
    """``max_depth`` 0: unlimited. ``max_bins`` bins a feature, missing values apart."""

    learning_rate: float = 0.05
    max_leaves: int = 31
    max_depth: int = 0
    min_gain: float = 0.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    feature_fraction: float = 1.0
    pos_weight: float = 1.0
    max_bins: int = 255
    seed: int = 1337


NODES = ("tree int, node int, feature int, bin int, threshold double, left int, right int, value double, gain double, hessian double, n long")
_ARROW = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
NODES_ARROW = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in NODES.split(", ")])
#: y: how many of the c rows that an entry stands for have label 1.
BLOCKS = "n long, codes binary, y binary, m binary, c binary"
BLOCKS_ARROW = pa.schema([("n", pa.int64()), *[(k, pa.binary()) for k in ("codes", "y", "m", "c")]])


# -- binning -------------------------------------------------------------------------

def _value(f: str) -> Column:
    return F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double"))


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins. A feature of at most ``max_bins`` different values has a
    bin a value, with edges half-way; any other one has bins of about equal rows. One pass of
    mergeable sketches, one more for the values of the features that have few."""
    return bin_edges_each(df, features, [max_bins])[max_bins]


def bin_edges_each(df: DataFrame, features: Sequence[str], numbers: Sequence[int]) -> dict[int, list[list[float]]]:
    """``bin_edges`` for several numbers of bins from the same two passes."""
    shares = {b: F.array(*[F.lit(k / b) for k in range(1, b)]) for b in numbers}
    r = df.agg(*[x for k, f in enumerate(features) for x in (
        F.approx_count_distinct(_value(f), 0.02).alias(f"n{k}"), *[F.percentile_approx(_value(f), q, max(10_000, 20 * b)).alias(f"q{k}_{b}") for b, q in shares.items()])]).first()
    few = [k for k in range(len(features)) if r[f"n{k}"] <= 1.2 * max(numbers)]
    values = df.agg(*[F.collect_set(_value(features[k])).alias(f"v{k}") for k in few]).first() if few else None    # about 1.3 max_bins values at most
    out = {}
    for b in numbers:
        out[b] = []
        for k in range(len(features)):
            v = sorted(values[f"v{k}"]) if k in few else []
            if k in few and len(v) <= b:
                out[b].append([(x + y) / 2 for x, y in zip(v, v[1:])])
            else:
                out[b].append(sorted(set(r[f"q{k}_{b}"] or [])))
    return out


def code_values(v: np.ndarray, edges) -> np.ndarray:
    """0: missing, b: above the edges before the b-th and not above that one."""
    return np.where(np.isnan(v), 0, 1 + np.searchsorted(np.asarray(edges, float), v, "left"))


def worth_merging(size: int, rows: int, p: int, together: int | None = None) -> bool:
    """Whether rows are put together by their bins, of which there are ``size`` combinations: with two labels they come to half of the rows at
    most, or there are more than one task may hold (one shuffle before passes by the hundred). A combination's number has to fit 64 bits."""
    return size < 2 ** 62 and (4 * size <= rows or rows * p > (TOGETHER if together is None else together))


def labelled(df: DataFrame, features: Sequence[str], label: str, *more: Column) -> DataFrame:
    return df.select(*[_value(f).alias(f"x{k}") for k, f in enumerate(features)], F.col(f"`{label}`").cast("int").alias("y"), *more).where("y IS NOT NULL")


def coded(batch: pa.RecordBatch, cuts: Sequence) -> np.ndarray:
    """The codes of a batch's first columns."""
    x = [code_values(batch.column(k).to_numpy(zero_copy_only=False).astype(float), e) for k, e in enumerate(cuts)]
    return np.stack(x) if x else np.zeros((0, batch.num_rows), np.int64)


def named(table: DataFrame, cuts: Sequence, more: str) -> DataFrame:
    """The columns after the features (their types: ``more``) and k, the number of the combination of bins."""
    widths, p = [len(e) + 2 for e in cuts], len(cuts)
    names = ["k", *[c.split()[0] for c in more.split(", ")]]

    def name(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.ravel_multi_index(coded(batch, cuts), widths)), *batch.columns[p:]], names=names)

    return table.mapInArrow(name, f"k long, {more}")


def bin_rows(df: DataFrame, features: Sequence[str], label: str, margin: Column, edges: list[list[float]], rows: int = 0, together: int | None = None) -> DataFrame:
    """Blocks of rows: codes (feature by feature, 16 bits; 0: missing, b: up to the b-th edge), how many have label 1, margins
    and how many rows each stands for: one, unless (of so many ``rows``) it is ``worth_merging`` those of equal bins and margins."""
    widths, p = [len(e) + 2 for e in edges], len(edges)

    def block(codes, y, m, c):
        return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64())] + [pa.array([a.tobytes()], pa.binary()) for a in (
            codes.astype(np.uint16), y.astype(np.int64), m, c.astype(np.int64))], schema=BLOCKS_ARROW)

    def cut(batches):
        for batch in batches:
            yield block(coded(batch, edges), batch.column(p).to_numpy(), batch.column(p + 1).to_numpy(), np.ones(batch.num_rows))

    def open_names(batches):
        for batch in batches:
            yield block(np.stack(np.unravel_index(batch.column(0).to_numpy(), widths)), *[batch.column(k).to_numpy() for k in (1, 2, 3)])

    table = labelled(df, features, label, margin.cast("double").alias("m"))
    if edges and worth_merging(math.prod(widths), rows, p, together):
        names = named(table, edges, "y int, m double").groupBy("k", "m").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("c"))
        return materialize(names.select("k", "y", "m", "c").mapInArrow(open_names, BLOCKS), "binned")
    return materialize(table.mapInArrow(cut, BLOCKS), "binned")


def read_block(batch: pa.RecordBatch, k: int, p: int):
    n = batch.column(0)[k].as_py()
    codes, y, m, c = (np.frombuffer(batch.column(i)[k].as_buffer(), t) for i, t in ((1, np.uint16), (2, np.int64), (3, np.float64), (4, np.int64)))
    return codes.reshape(p, n), y, m, c


def read_blocks(batch: pa.RecordBatch, p: int, rows: int):
    """The blocks of a batch, put together until they have so many rows."""
    held = []
    for k in range(batch.num_rows):
        held.append(read_block(batch, k, p))
        if k + 1 == batch.num_rows or sum(len(h[1]) for h in held) >= rows:
            yield tuple(np.concatenate([h[c] for h in held], axis=-1) for c in range(4))
            held = []


# -- trees ---------------------------------------------------------------------------

def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def quality(g, h, s: Settings):
    return shrunk(g, s.l1) ** 2 / (h + s.l2 + 1e-300)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-s.learning_rate * shrunk(g, s.l1) / (h + s.l2)) if h >= s.min_hessian and h + s.l2 > 0 else 0.0


def best_split(hist: np.ndarray, widths: np.ndarray, s: Settings):
    """(gain, feature's place, bin, sums left) of the best split of a leaf, or None. ``hist``: (features,
    3 sums, bins). Equal gains: the first feature, then the lowest bin."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[0].sum(axis=1)
    right = total[None, :, None] - left
    gain = quality(left[:, 0], left[:, 1], s) + quality(right[:, 0], right[:, 1], s) - quality(total[0], total[1], s)
    ok = ((np.arange(left.shape[2])[None, :] < widths[:, None] - 1) & (left[:, 2] >= max(s.min_rows, 1)) & (right[:, 2] >= max(s.min_rows, 1))
          & (left[:, 1] >= s.min_hessian) & (right[:, 1] >= s.min_hessian))
    gain = np.where(ok, gain, -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    f, b = divmod(at, gain.shape[1]) if gain.size else (0, 0)
    if not gain.size or not gain[f, b] > max(s.min_gain, 0.0) + 1e-12:
        return None
    return float(gain[f, b]), f, b, left[f, :, b].copy(), total


def gradients(m: np.ndarray, y: np.ndarray, s: Settings, c=1):
    """Sums over the c rows that each entry stands for, y of them with label 1."""
    p = 1.0 / (1.0 + np.exp(-m))
    yes, no = s.pos_weight * y, c - y
    return (p - 1.0) * yes + p * no, np.maximum(p * (1.0 - p), 1e-16) * (yes + no)


def tree_features(p: int, tree: int, s: Settings) -> np.ndarray:
    """The features that a tree may use."""
    k = max(1, int(round(s.feature_fraction * p)))
    return np.arange(p) if k >= p else np.sort(np.random.default_rng([s.seed, tree]).choice(p, k, replace=False))


def histogram(codes: Sequence[np.ndarray], g: np.ndarray, h: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    return np.stack([np.stack([np.bincount(c, x, bins) for x in (g, h, n)]) for c in (c.astype(np.intp, copy=False) for c in codes)])


def cell_names(codes: Sequence[np.ndarray], features: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Each row's cell: the place of its bins of these features among all combinations."""
    at = codes[features[0]].astype(np.intp)
    for f, w in zip(features[1:], widths[1:]):
        at = at * w + codes[f]
    return at


def grow(rows, tree: int, features: np.ndarray, edges: list[list[float]], s: Settings) -> list[tuple]:
    """One tree, as rows of NODES. ``rows`` gives the sums of leaves (``sums``) and takes splits
    (``split``); leaves are numbers of nodes."""
    widths = np.array([len(edges[f]) + 2 for f in features])
    nodes = [dict(feature=-1, bin=-1, threshold=0.0, left=-1, right=-1, gain=0.0, depth=0)]
    rows.begin(features, int(widths.max()))
    rows = rows.by_cell(widths) or rows
    hist = {0: rows.sums([0])[0]}
    total = {0: hist[0][0].sum(axis=1)}
    found = {0: best_split(hist[0], widths, s)}
    by_level = 0 < s.max_depth and 2 ** s.max_depth <= s.max_leaves
    leaves = 1
    while True:
        ready = [k for k, x in found.items() if x is not None and (s.max_depth <= 0 or nodes[k]["depth"] < s.max_depth)]
        if not by_level:
            ready = sorted(ready, key=lambda k: (-found[k][0], k))[:1 if leaves < s.max_leaves else 0]
        if not ready:
            break
        ask = []
        for k in ready:
            gain, f, b, left, _ = found.pop(k)
            a = len(nodes)
            nodes += [dict(feature=-1, bin=-1, threshold=0.0, left=-1, right=-1, gain=0.0, depth=nodes[k]["depth"] + 1) for _ in "lr"]
            e = edges[features[f]]
            nodes[k].update(feature=int(features[f]), bin=b, threshold=e[b - 1] if b else -math.inf, left=a, right=a + 1, gain=gain)
            total[a], total[a + 1] = left, total[k] - left
            rows.split(k, int(features[f]), b, a, a + 1)
            leaves += 1
            if s.max_depth <= 0 or nodes[a]["depth"] < s.max_depth:
                small = a if left[2] <= total[a + 1][2] else a + 1
                ask.append((k, small, 2 * a + 1 - small))
            else:
                hist.pop(k)
        for (k, small, large), sums in zip(ask, rows.sums([x[1] for x in ask]) if ask else []):
            hist[small], hist[large] = sums, hist.pop(k) - sums
            for x in (small, large):
                found[x] = best_split(hist[x], widths, s)
    value = [leaf_value(total[k][0], total[k][1], s) if n["feature"] < 0 else 0.0 for k, n in enumerate(nodes)]
    rows.end(value)
    return [(tree, k, n["feature"], n["bin"], n["threshold"], n["left"], n["right"], value[k], n["gain"], float(total[k][1]), int(round(total[k][2]))) for k, n in enumerate(nodes)]


class Leaves:
    """The rows of each leaf of the tree that grows, as their places in the arrays g, h, n and codes[feature]."""

    def sums(self, leaves):
        out = []
        for k in leaves:
            at = self.at[k]
            codes = [self.codes[f] if at is None else self.codes[f][at] for f in self.features]
            out.append(histogram(codes, *[x if at is None else x[at] for x in (self.g, self.h, self.n)], self.bins))
        return out

    def split(self, leaf, f, b, left, right):
        at = self.at.pop(leaf)
        goes = (self.codes[f] if at is None else self.codes[f][at]) <= b
        self.at[left], self.at[right] = (np.flatnonzero(goes), np.flatnonzero(~goes)) if at is None else (at[goes], at[~goes])

    def add(self, value, to):
        for leaf, at in self.at.items():
            if at is None:
                to += value[leaf]
            else:
                to[at] += value[leaf]


class Cells(Leaves):
    """The sums of a tree's rows by cell; the tree grows over them as over rows."""

    def __init__(self, rows, features, widths, bins, g, h, n):
        self.rows, self.features, self.bins, self.size = rows, features, bins, len(n)
        self.full = np.flatnonzero(n)
        self.codes = dict(zip(features, np.unravel_index(self.full, widths)))
        self.g, self.h, self.n, self.at = g[self.full], h[self.full], n[self.full], {0: None}

    def split(self, leaf, f, b, left, right):
        super().split(leaf, f, b, left, right)
        self.rows.note(leaf, f, b, left, right)

    def end(self, value):
        own = np.zeros(len(self.full))
        self.add(value, own)
        table = np.zeros(self.size)
        table[self.full] = own
        self.rows.end_cells(value, table)


class RowsHere(Leaves):
    """All binned rows in one task's arrays; gradients of all rows at once are kept only for trees that are not grown over cells."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, m: np.ndarray, s: Settings, c: np.ndarray | None = None):
        c = np.ones(len(y), np.int8) if c is None else c
        self.codes, self.m, self.s, self.names, self.n = codes, m.copy(), s, {}, None
        self.c, self.yes, self.no = c.astype(np.min_scalar_type(c.max(initial=0))), s.pos_weight * y, (c - y).astype(float)
        self.g, self.h = np.empty(0), np.empty(0)

    def begin(self, features, bins):
        self.features, self.bins, self.at = features, bins, {0: None}

    def rates(self, start, stop):
        """Gradients and hessians of some rows, in the first places of g and h."""
        if len(self.g) < stop - start:
            self.g, self.h = np.empty(stop - start), np.empty(stop - start)
        for k in range(start, stop, 8192):      # few enough rows for the processor's cache; as ``gradients``, in place
            at, to = slice(k, min(k + 8192, stop)), slice(k - start, min(k + 8192, stop) - start)
            yes, no, g, h = self.yes[at], self.no[at], self.g[to], self.h[to]
            p = np.negative(self.m[at])
            np.exp(p, p)
            p += 1.0
            np.divide(1.0, p, p)
            np.subtract(1.0, p, h)
            np.multiply(h, yes, g)
            h *= p
            np.maximum(h, 1e-16, out=h)
            p *= no
            np.subtract(p, g, g)
            h *= np.add(yes, no, p)
        return self.g[:stop - start], self.h[:stop - start]

    def parts(self, size):
        step = max(size, 1 << 20)
        return [(k, min(k + step, len(self.m))) for k in range(0, len(self.m), step)]

    def by_cell(self, widths):
        size = math.prod(map(int, widths))
        if size > min(CELLS, len(self.m) // 2):
            if self.n is None:
                self.n = self.c.astype(float)
            self.rates(0, len(self.m))
            return None
        key = tuple(self.features)
        if key not in self.names:
            if len(self.names) >= 8:
                self.names.pop(next(iter(self.names)))
            names, n = np.empty(len(self.m), np.int32), np.zeros(size)      # CELLS fit 32 bits
            for a, b in self.parts(size):
                names[a:b] = cell_names([c[a:b] for c in self.codes], self.features, widths)
                n += np.bincount(names[a:b], self.c[a:b], size)
            self.names[key] = names, n
        self.cell, n = self.names[key]
        g, h = np.zeros(size), np.zeros(size)
        for a, b in self.parts(size):
            cell = self.cell[a:b].astype(np.intp)
            for to, x in zip((g, h), self.rates(a, b)):
                to += np.bincount(cell, x, size)
        return Cells(self, self.features, widths, self.bins, g, h, n)

    def note(self, leaf, f, b, left, right):
        pass

    def end(self, value):
        self.add(value, self.m)

    def end_cells(self, value, table):
        for a, b in self.parts(0):
            self.m[a:b] += table[self.cell[a:b]]


def walked(codes: np.ndarray, feature, bin_, left, right) -> np.ndarray:
    """The leaf of each row in one tree over bin codes."""
    node, row = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return node
        node = np.where(inner, np.where(codes[np.maximum(feature[node], 0), row] <= bin_[node], left[node], right[node]), node)


def looked_up(tree: tuple, value: np.ndarray, widths: Sequence[int]):
    """([(feature, step of each bin)], outputs) of one tree over bin codes: it cuts a feature into few ranges, and
    the steps of a row's bins lead to its output. None: more than TABLE entries."""
    feature, bin_, left, right = tree
    cuts = {int(f): np.unique(bin_[feature == f]) for f in np.unique(feature[feature >= 0])}
    size = math.prod(len(c) + 1 for c in cuts.values())
    if size > TABLE:
        return None
    codes = np.zeros((max(cuts, default=0) + 1, size), np.int64)
    for f, x in zip(cuts, np.meshgrid(*[np.append(c, c[-1] + 1) for c in cuts.values()], indexing="ij")):
        codes[f] = x.ravel()
    steps, step = [], size
    for f, c in cuts.items():
        step //= len(c) + 1
        steps.append((f, step * np.searchsorted(c, np.arange(widths[f]), "left")))
    return steps, value[walked(codes, *tree)]


def tree_outputs(codes: np.ndarray, trees: list[tuple]):
    """What each tree ((feature, bin, left, right), value, ``looked_up``) adds to rows of bin codes."""
    for tree, value, found in trees:
        if found is None:
            yield value[walked(codes, *tree)]
        else:
            at = np.zeros(codes.shape[1], np.intp)
            for f, step in found[0]:
                at += step[codes[f]]
            yield found[1][at]


def with_tables(trees: list, widths: Sequence[int]) -> list[tuple]:
    return [(t, v, looked_up(t, v, widths)) for t, v in trees]


def added_up(trees: list, widths: Sequence[int]) -> tuple[list, list[tuple]]:
    """(trees, tables): of SUMMED trees or more all those of the same features are added up in one table of SUMMED_TABLE
    entries at most. ``with_tables`` of the other trees and these tables give the same sum but for rounding, from fewer look-ups."""
    if len(trees) < SUMMED:
        return trees, []
    alike, left, out = {}, [], []
    for tree in with_tables(trees, widths):
        if tree[2] is None:
            left.append(tree[:2])
        else:
            alike.setdefault(tuple(f for f, _ in tree[2][0]), []).append(tree)
    for key, own in alike.items():
        cuts = [np.unique(np.concatenate([t[0][1][t[0][0] == f] for t in own])) for f in key]
        size = math.prod(len(c) + 1 for c in cuts)
        if size > SUMMED_TABLE or len(own) == 1:
            left += [x[:2] for x in own]
            continue
        total, first = np.zeros([len(c) + 1 for c in cuts]), [np.append(c, c[-1] + 1) for c in cuts]      # a code of each range
        for _, _, (steps, value) in own:
            at = np.zeros([1] * len(key), np.intp)
            for k, (_, step) in enumerate(steps):
                at = at + step[np.minimum(first[k], len(step) - 1)].reshape([-1 if i == k else 1 for i in range(len(key))])
            total += value[at]
        steps, step = [], size
        for f, c in zip(key, cuts):
            step //= len(c) + 1
            steps.append((f, step * np.searchsorted(c, np.arange(widths[f]), "left")))
        out.append((None, None, (steps, total.ravel())))
    return left, out


def moved_margins(blocks: DataFrame, widths: Sequence[int], trees: list) -> DataFrame:
    """The blocks, written again, with the outputs of trees ((feature, bin, left, right), value) in their margins."""
    left, summed = added_up(trees, widths)

    def moved(batches):
        tables = with_tables(left, widths) + summed
        for batch in batches:
            for k in range(batch.num_rows):
                codes, _, m, _ = read_block(batch, k, len(widths))
                m = m + sum(tree_outputs(codes, tables), np.zeros(len(m)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(3)], pa.array([m.tobytes()], pa.binary()), batch.column(4).slice(k, 1)], schema=BLOCKS_ARROW)

    return materialize(blocks.mapInArrow(moved, BLOCKS), "binned")


def over_codes(nodes: pd.DataFrame) -> list:
    """The trees of a node table, as ``moved_margins`` takes them."""
    return [(tuple(t[c].to_numpy() for c in ("feature", "bin", "left", "right")), t["value"].to_numpy()) for _, t in nodes.groupby("tree", sort=True)]


class RowsApart:
    """Binned rows in a written table: a job a tree over its cells if they are few, else a job a level;
    margins written anew every KEEP_ROUNDS trees."""

    def __init__(self, blocks: DataFrame, widths: Sequence[int], s: Settings):
        self.blocks, self.widths, self.s, self.trees, self.own = blocks, list(widths), s, [], False

    def begin(self, features, bins):
        self.features, self.bins = features, bins
        self.tree = [np.array([-1]), np.array([-1]), np.array([-1]), np.array([-1])]

    def by_cell(self, widths):
        size, every, s, trees, features = math.prod(map(int, widths)), self.widths, self.s, self.trees, self.features
        if size > CELLS_SENT:
            return None

        def partial(batches):
            out, tables = np.zeros((3, size)), with_tables(trees, every)
            for batch in batches:
                for codes, y, m, c in read_blocks(batch, len(every), max(size, 50_000)):
                    m = m + sum(tree_outputs(codes, tables), np.zeros(len(m)))
                    cell = cell_names(codes, features, widths)
                    out += [np.bincount(cell, x, size) for x in (*gradients(m, y, s, c), c)]
            cell = np.flatnonzero(out[2])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *[pa.array(x[cell]) for x in out]], names=["cell", "g", "h", "n"])

        parts = self.blocks.mapInArrow(partial, "cell int, g double, h double, n double")
        whole = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()     # at most CELLS_SENT rows
        out = np.zeros((3, size))
        out[:, whole.column("cell").to_numpy()] = [whole.column(c).to_numpy() for c in "ghn"]
        return Cells(self, features, widths, self.bins, *out)

    def note(self, leaf, f, b, left, right):
        feature, bin_, lo, hi = (np.concatenate([a, [-1, -1]]) for a in self.tree)
        feature[leaf], bin_[leaf], lo[leaf], hi[leaf] = f, b, left, right
        self.tree = [feature, bin_, lo, hi]

    split = note

    def sums(self, leaves):
        every, s, trees, tree, features, bins = self.widths, self.s, self.trees, self.tree, self.features, self.bins

        def partial(batches):
            out, tables = np.zeros((len(leaves), len(features), 3, bins)), with_tables(trees, every)
            for batch in batches:
                for codes, y, m, c in read_blocks(batch, len(every), 50_000):
                    m = m + sum(tree_outputs(codes, tables), np.zeros(len(m)))
                    node, (g, h) = walked(codes, *tree), gradients(m, y, s, c)
                    for i, leaf in enumerate(leaves):
                        at = np.flatnonzero(node == leaf)
                        out[i] += histogram([codes[f][at].astype(np.intp) for f in features], g[at], h[at], c[at], bins)
            leaf, f, b = np.nonzero(out[:, :, 2])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (leaf, f, b)] + [pa.array(out[leaf, f, c, b]) for c in range(3)],
                                             names=["leaf", "f", "b", "g", "h", "n"])

        parts = self.blocks.mapInArrow(partial, "leaf int, f int, b int, g double, h double, n double")
        whole = parts.groupBy("leaf", "f", "b").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()     # leaves x features x bins rows
        out = np.zeros((len(leaves), len(features), 3, bins))
        leaf, f, b = (whole.column(c).to_numpy() for c in ("leaf", "f", "b"))
        for c, name in enumerate("ghn"):
            out[leaf, f, c, b] = whole.column(name).to_numpy()
        return list(out)

    def end(self, value):
        self.trees = [*self.trees, (tuple(self.tree), np.array(value))]
        if len(self.trees) < KEEP_ROUNDS:
            return
        new = moved_margins(self.blocks, self.widths, self.trees)
        if self.own:
            discard(self.blocks)
        self.blocks, self.own, self.trees = new, True, []

    def end_cells(self, value, table):
        self.end(value)

    def close(self):
        if self.own:
            discard(self.blocks)


# -- model ---------------------------------------------------------------------------

@dataclass
class BoostedTrees:
    """A boosted model: base margin and one table of nodes (columns of NODES). A row goes left
    where its value is at most the threshold or missing."""

    features: list[str]
    base: float
    nodes: pd.DataFrame = field(default_factory=lambda: NODES_ARROW.empty_table().to_pandas())

    @property
    def n_trees(self) -> int:
        return int(self.nodes["tree"].max()) + 1 if len(self.nodes) else 0

    def first(self, n: int) -> BoostedTrees:
        """The model of the first n trees."""
        return replace(self, nodes=self.nodes[self.nodes["tree"] < n].reset_index(drop=True))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """The nodes as a table, with the names of the features they split on."""
        names = spark.createDataFrame(list(enumerate(self.features)), "feature int, name string")
        nodes = spark.createDataFrame(pa.Table.from_pandas(self.nodes, NODES_ARROW, preserve_index=False))
        return nodes.join(F.broadcast(names), "feature", "left").withColumnRenamed("name", "feature_name")

    def split_counts(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): how many nodes split on each feature."""
        names = spark.createDataFrame([(f,) for f in self.features], "feature string")
        counts = self.node_table(spark).where("left >= 0").groupBy("feature_name").agg(F.count(F.lit(1)).alias("importance"))
        return names.join(counts, names["feature"] == counts["feature_name"], "left").select("feature", F.coalesce("importance", F.lit(0)).alias("importance"))

    def over(self, edges: Sequence[Sequence[float]]) -> list | None:
        """The trees over codes of these bins; None: they cut somewhere else."""
        feature, threshold = self.nodes["feature"].to_numpy(), self.nodes["threshold"].to_numpy()
        bins = np.full(len(feature), -1)
        for f, e in enumerate(edges):
            own, e = (feature == f) & (self.nodes["left"].to_numpy() >= 0), np.append(-math.inf, e)
            bins[own] = np.searchsorted(e, threshold[own])
            if not np.isin(threshold[own], e).all():
                return None
        return over_codes(self.nodes.assign(bin=bins))

    def coded(self) -> tuple[list[np.ndarray], list]:
        """Each feature's thresholds and the trees over the codes that these cut its values into (``code_values``)."""
        inner, feature, threshold = (self.nodes[c].to_numpy() for c in ("left", "feature", "threshold"))
        inner = inner >= 0
        feature = np.where(inner, feature, -1)
        cuts = [np.unique(threshold[feature == f]) for f in range(len(self.features))]
        bins = np.full(len(feature), -1)
        for f, c in enumerate(cuts):
            bins[feature == f] = 1 + np.searchsorted(c, threshold[feature == f])
        return cuts, over_codes(self.nodes.assign(feature=feature, bin=bins))

    def margin(self) -> Column:
        """The margin as a column over the feature columns: all trees in one pass over each batch."""
        (cuts, trees), base, tables = self.coded(), self.base, []
        left, summed = added_up(trees, [len(c) + 2 for c in cuts])

        def score(*columns: pd.Series) -> pd.Series:
            if not tables:
                tables.extend(with_tables(left, [len(c) + 2 for c in cuts]) + summed)
            codes = np.stack([code_values(x.to_numpy(dtype=float, na_value=np.nan), c) for x, c in zip(columns, cuts)])
            return pd.Series(base + sum(tree_outputs(codes, tables), np.zeros(len(columns[0]))))

        return F.pandas_udf(score, "double")(*[_value(f) for f in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds margin, p1 = P(class 1) and prediction (p1 > 0.5)."""
        p = 1.0 / (1.0 + F.exp(-F.col("margin")))
        return df.withColumn("margin", self.margin()).withColumn("p1", p).withColumn("prediction", F.when(p > 0.5, 1).otherwise(0))

    def round_metrics(self, df: DataFrame, label: str = "label", weight: float = 1.0) -> DataFrame:
        """(n_trees, log_loss, auc, auc_error) of every prefix of the trees, from one scan.

        Each batch emits the margin after every tree. Log-loss (positives count ``weight``) is exact. A round's AUC
        is taken over ``AUC_BINS`` even bins of its range of margins; auc_error bounds what ties inside bins can hide."""
        (cuts, trees), base, rounds, p = self.coded(), self.base, self.n_trees, len(self.features)
        lows = base + np.cumsum([0.0] + [v[t[0] < 0].min() for t, v in trees])
        spans = base + np.cumsum([0.0] + [v[t[0] < 0].max() for t, v in trees]) - lows
        widths = [len(c) + 2 for c in cuts]
        rows = labelled(df, self.features, label)
        merged = bool(cuts) and worth_merging(math.prod(widths), rows.count(), p)
        if merged:
            rows = named(rows, cuts, "y int").groupBy("k").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("c")).repartition(df.sparkSession.sparkContext.defaultParallelism)

        def count(batches):
            loss, total, tables = np.zeros(rounds + 1), 0.0, with_tables(trees, widths)
            seen = np.zeros((rounds + 1, 2, AUC_BINS))
            for batch in batches:
                codes = np.stack(np.unravel_index(batch.column(0).to_numpy(), widths)) if merged else coded(batch, cuts)
                y = batch.column(1 if merged else p).to_numpy().astype(float)
                n = batch.column(2).to_numpy().astype(float) if merged else np.ones(len(y))
                yes, no, m, step = weight * y, n - y, np.full(len(y), base), tree_outputs(codes, tables)
                total += yes.sum() + no.sum()
                for r in range(rounds + 1):
                    if r:
                        m = m + next(step)
                    low = np.logaddexp(0.0, m)
                    loss[r] += (yes * (low - m) + no * low).sum()
                    at = np.clip(((m - lows[r]) / (spans[r] or 1.0) * AUC_BINS).astype(np.int64), 0, AUC_BINS - 1)
                    seen[r, 0] += np.bincount(at, no, AUC_BINS)
                    seen[r, 1] += np.bincount(at, y, AUC_BINS)
            seen = seen.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds + 1, dtype=np.int32)), pa.array(np.full(rounds + 1, -1, np.int32)), pa.array(loss),
                                              pa.array(np.full(rounds + 1, total)), *[pa.array(np.zeros(rounds + 1, np.int64))] * 2], names=["r", "b", "loss", "w", "neg", "pos"])
            r, b = np.nonzero(seen.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.zeros(len(r))), pa.array(np.zeros(len(r))),
                                              pa.array(seen[r, 0, b]), pa.array(seen[r, 1, b])], names=["r", "b", "loss", "w", "neg", "pos"])

        sums = rows.mapInArrow(count, "r int, b int, loss double, w double, neg long, pos long").groupBy("r", "b").agg(*[F.sum(c).alias(c) for c in ("loss", "w", "neg", "pos")])
        below = F.coalesce(F.sum("neg").over(Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))    # AUC_BINS rows a window
        both = F.col("neg").cast("double") * F.col("pos") / 2
        ranked = sums.withColumn("right", F.col("pos").cast("double") * below + both).withColumn("ties", both)
        pairs = F.sum("pos").cast("double") * F.sum("neg")
        return ranked.groupBy(F.col("r").alias("n_trees")).agg((F.sum("loss") / F.sum("w")).alias("log_loss"), F.try_divide(F.sum("right"), pairs).alias("auc"),
                                                             F.try_divide(F.sum("ties"), pairs).alias("auc_error"))

    def save(self, spark: SparkSession, path: str | None = None) -> str:
        """Write the model (nodes, head with version, base and features) under ``path``."""
        path = path or shared_path(spark, "boosted-trees")
        spark.createDataFrame(pa.Table.from_pandas(self.nodes, NODES_ARROW, preserve_index=False)).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(VERSION, float(self.base), list(self.features), len(self.nodes))], "version int, base double, features array<string>, n_nodes long") \
            .coalesce(1).write.parquet(f"{path}/head")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        """Read a model that ``save`` wrote; a table that isn't one raises an error."""
        head = spark.read.parquet(f"{path}/head").collect()
        nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").toArrow().to_pandas().sort_values(["tree", "node"], ignore_index=True)
        if len(head) != 1 or head[0]["version"] != VERSION or head[0]["n_nodes"] != len(nodes):
            raise ValueError(f"{path} holds no whole model of version {VERSION}")
        size = nodes.groupby("tree")["node"].transform("size")
        inner = nodes["left"] >= 0
        if (nodes["node"] != nodes.groupby("tree").cumcount()).any() or (nodes.loc[inner, ["left", "right"]].max(axis=1) >= size[inner]).any() \
                or (nodes.loc[inner, "feature"] >= len(head[0]["features"])).any():
            raise ValueError(f"{path}: broken node table")
        return cls(list(head[0]["features"]), head[0]["base"], nodes)


def best_round(loss: list[float], start: int, patience: int) -> int | None:
    """The first best round after which ``patience`` rounds bring nothing better; None: there is none yet."""
    best = start
    for r in range(start, len(loss)):
        best = r if loss[r] < loss[best] else best
        if r - best >= patience:
            return best
    return None


def boost(df: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 1000, settings: Settings = Settings(), *,
          init: BoostedTrees | None = None, together: int | None = None, valid: DataFrame | None = None, early_stopping: int = 0,
          stop_every: int = 50, edges: list[list[float]] | None = None) -> BoostedTrees:
    """Fit ``rounds`` trees, or as many more on top of ``init``.

    ``early_stopping`` > 0: stop when the log-loss on ``valid`` (default: the training rows) has not
    fallen for so many rounds, and cut back to its best; looked at every ``stop_every`` rounds. Rows
    without a label are left out; missing values go left. One class only, or no rows: the base margin
    alone. ``together`` overrides TOGETHER; ``edges`` are bins made before (``bin_edges``)."""
    features = list(features)
    y = F.col(f"`{label}`").cast("int")
    counts = df.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")).first()
    pos, neg = counts["pos"] * settings.pos_weight, float(counts["neg"])
    base = init.base if init is not None else (math.log(pos / neg) if pos and neg else 0.0)
    model = init if init is not None else BoostedTrees(features, base)
    if not pos or not neg or not features or rounds <= 0:
        return model
    edges = bin_edges(df, features, settings.max_bins) if edges is None else edges
    widths, before = [len(e) + 2 for e in edges], init.over(edges) if init is not None and init.features == features else None
    blocks = bin_rows(df, features, label, init.margin() if init is not None and before is None else F.lit(base), edges, counts["pos"] + counts["neg"], together)
    if before:
        plain, blocks = blocks, moved_margins(blocks, widths, before)
        discard(plain)
    held = blocks.agg(F.sum("n").alias("n")).first()["n"] * len(features)
    here = held <= (TOGETHER if together is None else together)
    start, apart = model.n_trees, None if here else RowsApart(blocks, widths, settings)
    table, state, done = [model.nodes], blocks, 0
    while done < rounds:
        more = min(rounds - done, stop_every) if early_stopping > 0 else rounds
        trees = range(start + done, start + done + more)
        if here:
            grown = grown_here(state, trees, edges, settings)
        else:
            grown = pd.DataFrame([n for t in trees for n in grow(apart, t, tree_features(len(features), t, settings), edges, settings)], columns=NODES_ARROW.names)
        done += more
        table.append(grown)
        model = replace(model, nodes=pd.concat([t for t in table if len(t)], ignore_index=True))
        if early_stopping > 0:
            loss = [r["log_loss"] for r in model.round_metrics(valid if valid is not None else df, label, settings.pos_weight).orderBy("n_trees").collect()]
            best = best_round(loss, start, early_stopping)
            if best is not None or done >= rounds:
                model = model.first(int(np.argmin(loss[start:])) + start if best is None else best)
                break
        if here and done < rounds:
            before, state = state, moved_margins(state, widths, over_codes(grown))
            if before is not blocks:
                discard(before)
    if apart is not None:
        apart.close()
    if state is not blocks:
        discard(state)
    discard(blocks)
    return model


def grown_here(blocks: DataFrame, trees: range, edges: list[list[float]], s: Settings) -> pd.DataFrame:
    """The given trees, all grown in one task."""
    p = len(edges)

    def run(batches):
        held = [read_block(batch, k, p) for batch in batches for k in range(batch.num_rows)]
        codes, y, m, c = (np.concatenate([h[k] for h in held], axis=-1) for k in range(4))
        rows = RowsHere(codes, y, m, s, c)
        held = y = m = c = None
        nodes = [n for t in trees for n in grow(rows, t, tree_features(p, t, s), edges, s)]
        yield from pa.table([pa.array(c, f.type) for c, f in zip(zip(*nodes), NODES_ARROW)], schema=NODES_ARROW).to_batches()

    return blocks.coalesce(1).mapInArrow(run, NODES).toArrow().to_pandas()
