"""Prefix trie of rebuilt conversations, by composable fingerprints.

A conversation is rebuilt from the head of its family's base and its own later
turns. No rebuilt text is ever made: a run of turns t0 t1 .. has the fingerprint
(n, x0 + x1 B + x2 B^2 + ..) modulo a prime, and runs compose as a monoid:
(n, v) (m, w) = (n + m, v + B^n w). Hence

1. turns are sorted by conversation and turn over ranges (a long conversation spans
   several), each range scans its part, and one composed value a range carries the
   scan over its borders;
2. the fingerprint of a rebuilt prefix is base head composed with own suffix: a few
   multiplications of stored numbers. The base's head is at most 8 turns.

Four lanes of 31 bits make a fingerprint. A prefix group is a node; its members
must have the same stored turn as their last one (a turn is referred to by its
SHA-256) and the same fingerprint before it, which by induction over the depth
proves equality; if they haven't, the trie is built anew over other bases.

Sums over subtrees need no walk. A node is owned by its smallest member. What a
conversation owns is the tail of its path, so the sum over the subtree of a node is
that over the tails of all members, but for the owner's own part above the node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAMILY = 5
HEADS = 9

PRIME = (1 << 31) - 1
LANES = 4
ATTEMPTS = 4
#: Depths in one window of a running sum along a conversation.
STRETCH = 4096
RANGE_ROWS = 1_000_000

SCANNED = "conv long, part int, at long, s1 long, s2 long, n_bytes long, v1 long, v2 long, u1 long, u2 long"
SCANNED_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in SCANNED.split(", ")])
ENDS = "depth long, f1 long, f2 long, ends string"
ENDS_ARROW = pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends", pa.string())])
NODE = ["depth", "f1", "f2"]


def bases(attempt: int) -> list[int]:
    """A base for each lane."""
    return [3 + int.from_bytes(hashlib.sha256(f"{attempt}/{lane}".encode()).digest()[:8], "little") % (PRIME - 5) for lane in range(LANES)]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo PRIME."""
    out, p, e = np.ones(len(exponents), np.uint64), np.uint64(PRIME), exponents.astype(np.uint64)
    for bit in range(int(e.max(initial=0)).bit_length()):
        on = (e >> np.uint64(bit)) & np.uint64(1) == 1
        out[on] = out[on] * np.uint64(pow(base, 1 << bit, PRIME)) % p
    return out


def stored_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, s1, s2, n_bytes): a turn's place, its reference (120 bits of SHA-256 of role
    and text) and its text's bytes."""
    r = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = turns.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.octet_length(t).cast("long").alias("n_bytes"),
                         F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256).alias("sha")).where("conv IS NOT NULL")
    return named.select("conv", "turn", *[F.conv(F.substring("sha", at, 15), 16, 10).cast("long").alias(s) for at, s in ((1, "s1"), (16, "s2"))], "n_bytes")


def scanned(stored: DataFrame, base: list[int]) -> DataFrame:
    """The turns in order, each with its place ``at`` and the fingerprints with (v) and without it (u),
    counted from where its conversation begins in its range."""
    spark = stored.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // RANGE_ROWS))
    order = ["conv", F.col("turn").asc_nulls_first(), "s1", "s2"]

    def scan(batches):
        part, last, n, held = TaskContext.get().partitionId(), None, 0, [np.uint64(0)] * LANES
        p, low = np.uint64(PRIME), np.uint64((1 << 30) - 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            s = [batch.column(k).to_numpy().astype(np.uint64) for k in (1, 2)]
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = last is None or conv[0] != last
            row = np.arange(len(conv))
            begin = np.maximum.accumulate(np.where(new, row, -1))
            at = np.where(begin < 0, row + n, row - begin)
            v, u = [], []
            for lane in range(LANES):
                x = (s[lane // 2] >> np.uint64(30)) if lane % 2 else s[lane // 2] & low
                x = x * power(base[lane], at) % p
                run = np.cumsum(x)
                before = np.where(begin < 0, np.uint64(0), run[begin] - x[begin])
                v.append((run - before + np.where(begin < 0, held[lane], np.uint64(0))) % p)
                u.append((v[-1] + p - x) % p)
            last, n, held = conv[-1], int(at[-1]) + 1, [lane[-1] for lane in v]
            pack = [(a << np.uint64(31) | b).view(np.int64) for a, b in ((v[0], v[1]), (v[2], v[3]), (u[0], u[1]), (u[2], u[3]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(at), *[batch.column(k) for k in (1, 2, 3)],
                 *map(pa.array, pack)], schema=SCANNED_ARROW)

    dealt = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "s1", "s2", "n_bytes")
    return written(dealt.mapInArrow(scan, SCANNED), "scanned")


def lanes(a: str | Column, b: str | Column) -> list[Column]:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return [F.shiftright(a, 31), a.bitwiseAND(PRIME), F.shiftright(b, 31), b.bitwiseAND(PRIME)]


def packed(values: list[Column], *names: str) -> list[Column]:
    return [F.shiftleft(values[2 * k], 31).bitwiseOR(values[2 * k + 1]).alias(name) for k, name in enumerate(names)]


def carried(scan: DataFrame, base: list[int]) -> DataFrame:
    """``scan`` with places and fingerprints counted from the conversations' first turns.

    Only conversations cut by a border of the ranges need it: at most one a border. Their composed
    values (two rows a range) are folded on the driver and joined back."""
    edges = sorted((r["part"], r["lo"], r["hi"]) for r in scan.groupBy("part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi")).collect())
    cut = sorted({a[2] for a, b in zip(edges, edges[1:]) if a[2] == b[1]})
    if not cut:
        return scan.drop("part")
    spark = scan.sparkSession
    own = F.broadcast(spark.createDataFrame([(c,) for c in cut], "conv long"))             # below the number of ranges
    pieces = (scan.join(own, "conv", "left_semi").groupBy("conv", "part")
              .agg(F.max("at").alias("at"), F.max_by(F.struct("v1", "v2"), "at").alias("v")).collect())
    rows, n, held, conv = [], 0, [0] * LANES, None
    for piece in sorted(pieces, key=lambda r: (r["conv"], r["part"])):
        if piece["conv"] != conv:
            conv, n, held = piece["conv"], 0, [0] * LANES
        shift = [pow(b, n, PRIME) for b in base]
        rows.append((conv, piece["part"], n, held, shift))
        own_v = [piece["v"]["v1"] >> 31, piece["v"]["v1"] & PRIME, piece["v"]["v2"] >> 31, piece["v"]["v2"] & PRIME]
        held = [(a + w * x) % PRIME for a, w, x in zip(held, shift, own_v)]
        n += piece["at"] + 1
    carry = F.broadcast(spark.createDataFrame(rows, "conv long, part int, n long, held array<long>, shift array<long>"))   # twice that
    out = scan.join(carry, ["conv", "part"], "left")

    def moved(a, b, *names):
        whole = packed([(F.col("held")[k] + F.col("shift")[k] * x) % PRIME for k, x in enumerate(lanes(a, b))], "a", "b")
        return [F.when(F.col("n").isNull(), F.col(c)).otherwise(w).alias(c) for c, w in zip(names, whole)]

    return out.select("conv", (F.col("at") + F.coalesce("n", F.lit(0))).alias("at"), "s1", "s2", "n_bytes", *moved("v1", "v2", "v1", "v2"), *moved("u1", "u2", "u1", "u2"))


def rebuilt(turns: DataFrame, base: list[int], family: int, heads: int) -> DataFrame:
    """Every prefix of every rebuilt conversation, as (conv, depth, f1, f2), its prefix one turn
    shorter (p1, p2), its last turn's reference (s1, s2) and bytes, and whether it is the whole."""
    most = heads - 1
    first = F.when(F.col("at") < most, F.struct("at", "v1", "v2", "u1", "u2", "s1", "s2", "n_bytes"))
    convs = turns.groupBy("conv").agg((F.max("at") + 1).alias("n"), F.array_sort(F.collect_list(first)).alias("head"))    # at most ``most`` turns
    own = convs.withColumns({"base": F.col("conv") - F.col("conv") % family, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads})
    of_base = convs.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    none = F.array().cast(own.schema["head"].dataType)
    c = own.join(of_base, "base", "left").withColumn("base_head", F.coalesce("base_head", none))
    c = c.withColumn("m", F.least("h", F.size("base_head").cast("long")))
    c = c.withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    # composed prefix: head of the base + B^(m - h) (own prefix - own first h turns)
    def value(head, k):
        at = F.get(head, (k - 1).cast("int"))
        return [F.coalesce(x, F.lit(0)) for x in lanes(at["v1"], at["v2"])]

    back = [F.array(*[F.lit(pow(pow(b, k, PRIME), PRIME - 2, PRIME)) for k in range(heads)]) for b in base]
    shift = [F.get(t, (F.col("h") - F.col("m")).cast("int")) for t in back]
    info = c.select("conv", "h", "m", "len", F.array(*value(F.col("base_head"), F.col("m"))).alias("front"),
                    F.array(*value(F.col("head"), F.col("h"))).alias("skip"), F.array(*shift).alias("shift"))

    def composed(a, b, *names):
        return packed([(F.col("front")[k] + F.col("shift")[k] * ((x - F.col("skip")[k] + PRIME) % PRIME)) % PRIME
                       for k, x in enumerate(lanes(a, b))], *names)

    zero = F.lit(0).cast("long")
    roots = c.select("conv", zero.alias("depth"), *[zero.alias(x) for x in ("f1", "f2", "p1", "p2", "s1", "s2", "n_bytes")], (F.col("len") == 0).alias("ends"))
    taken = c.select("conv", "len", F.explode(F.slice("base_head", F.lit(1), F.col("m").cast("int"))).alias("t"))
    taken = taken.select("conv", (F.col("t.at") + 1).alias("depth"), *[F.col(f"t.{a}").alias(b) for a, b in
                         (("v1", "f1"), ("v2", "f2"), ("u1", "p1"), ("u2", "p2"), ("s1", "s1"), ("s2", "s2"), ("n_bytes", "n_bytes"))],
                         (F.col("t.at") + 1 == F.col("len")).alias("ends"))
    later = turns.join(info, "conv").where("at >= h")
    depth = F.col("m") + F.col("at") - F.col("h") + 1
    later = later.select("conv", depth.alias("depth"), *composed("v1", "v2", "f1", "f2"), *composed("u1", "u2", "p1", "p2"), "s1", "s2", "n_bytes",
                         (depth == F.col("len")).alias("ends"))
    return roots.unionByName(taken).unionByName(later)


def end_digests(paths: DataFrame) -> DataFrame:
    """For every node at which conversations end the SHA-256 of their ids, ascending, comma-joined.

    The sorted ids stream through the hash, so a node at which very many end costs a task their
    time (a hash has no parts), but no memory."""
    def digest(batches):
        now, sha = None, None
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)]))
            ids, out, at = batch.column(3).to_pylist(), [], 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[at]:
                    said = ",".join(map(str, ids[at:k])).encode()
                    if keys[at] == now:
                        sha.update(b"," + said)
                    else:
                        if now is not None:
                            out.append((*now, sha.hexdigest()))
                        now, sha = keys[at], hashlib.sha256(said)
                    at = k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), ENDS_ARROW)], schema=ENDS_ARROW)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, sha.hexdigest()), ENDS_ARROW)], schema=ENDS_ARROW)

    ends = paths.where("ends").select(*NODE, "conv")
    return ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv").mapInArrow(digest, ENDS)


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *,
                family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of all rebuilt conversations, one row a node.

    Conversation c is rebuilt from the first h turns of conversation c - c % ``family`` (all if
    fewer, none if absent) and its own turns after its first h, with h = crc32(decimal c) % ``heads``.
    Turns are ordered by turn, null first; equal turns by the SHA-256 of role and text. A null role or
    text is empty; rows without a conversation id belong to none and make no node. Repeated rows are
    repeated turns. An empty table gives no rows, not even a root. Other columns are not read.

    Returns conv_id (the smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; n_leaves and saved_tokens count the node's subtree, itself
    included: childless nodes, and (n_convs - 1) times the UTF-8 bytes of the last text."""
    stored = written(stored_turns(turns, conv_col, turn_col, role_col, text_col), "turns")
    for attempt in range(ATTEMPTS):
        base = bases(attempt)
        ordered = written(carried(scanned(stored, base), base), "ordered")
        paths = written(rebuilt(ordered, base, family, heads), "paths")
        same = ["s1", "s2", "p1", "p2"]
        nodes = written(paths.groupBy(*NODE).agg(
            F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("n_bytes").alias("n_bytes"),
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), *[(F.min(x) != F.max(x)).alias(f"not_{x}") for x in same]), "nodes")
        if nodes.where(" OR ".join(f"not_{x}" for x in same)).isEmpty():
            break
    else:
        raise RuntimeError("fingerprints of different prefixes were equal over all bases")

    # what a node adds to each subtree it lies in, summed along the part of the path that its owner owns
    nodes = nodes.drop(*[f"not_{x}" for x in same]).withColumns({
        "leaf": (F.col("n_ends") == F.col("n_convs")).cast("long"), "saves": (F.col("n_convs") - 1) * F.col("n_bytes"),
        "stretch": F.floor(F.col("depth") / STRETCH)})
    in_stretch = Window.partitionBy("owner", "stretch").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    deeper = Window.partitionBy("owner").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by_stretch = nodes.groupBy("owner", "stretch").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
    offsets = by_stretch.select("owner", "stretch", *[F.coalesce(F.sum(x).over(deeper), F.lit(0)).alias(f"off_{x}") for x in ("leaf", "saves")])
    tails = nodes.groupBy("owner").agg(F.sum("leaf").alias("all_leaf"), F.sum("saves").alias("all_saves"))
    own = nodes.withColumns({f"run_{x}": F.sum(x).over(in_stretch) for x in ("leaf", "saves")}).join(offsets, ["owner", "stretch"]).join(tails, "owner")
    own = own.select(*NODE, "owner", "n_convs", "n_ends", "p1", "p2",
                     *[(F.col(f"run_{x}") + F.col(f"off_{x}") - F.col(f"all_{x}")).alias(f"less_{x}") for x in ("leaf", "saves")])
    members = paths.select("conv", *NODE).join(tails.withColumnRenamed("owner", "conv"), "conv").groupBy(*NODE).agg(
        F.sum("all_leaf").alias("sum_leaf"), F.sum("all_saves").alias("sum_saves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    whole = own.join(members, NODE).join(children, NODE, "left").join(end_digests(paths), NODE, "left")

    # parents; the root's children all know theirs
    root = nodes.where("depth = 0").select(F.min("owner")).first()[0]
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("owner").alias("above"))
    result = lambda nodes, above: nodes.select(
        F.col("owner").alias("conv_id"), "depth", above.cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (F.col("sum_leaf") + F.col("less_leaf")).alias("n_leaves"),
        (F.col("sum_saves") + F.col("less_saves")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    whole = written(whole, "trie")
    deep = whole.where("depth > 1").join(parents, ["depth", "p1", "p2"])
    return result(whole.where("depth <= 1"), F.when(F.col("depth") == 1, F.lit(root))).unionByName(result(deep, F.col("above")))
