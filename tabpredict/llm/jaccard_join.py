"""N-gram Jaccard join by chosen paths.

Every text is its set of word shingles; texts with equal sets are one class
from the start. A set is embedded as MinHash tokens. At each node of a path,
tokens are sampled by a hash of the path; sets move on to the nodes of the
sampled tokens they hold, so two sets of the sought similarity share one node on
average. Small nodes are compared pair by pair on one-bit sketches; large ones
are split again; a node still large at the last level links all its members.
Runs are repeated until the target recall. What this gives are groups that hold
every link; inside them shingle sets are compared exactly, block by block, and
only counts and spanning links leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BITMAP_BITS, MULT, SPACED, U64, bitmap, byte_codes, drop_written, in_bitmap, mix, text_bytes, valid_starts, window_hash,
                     word_bounds, word_hashes, written)
from .components import components, local_labels
from .decontaminate import slices

SHINGLE_WORDS = 5
#: Similarity as a fraction, so that the comparison is exact.
SIMILARITY = (4, 5)
RECALL = 0.9999
TOKENS = 128
DEPTH = 3
#: Nodes of up to so many sets are compared pair by pair.
SMALL_NODE = 256
#: Sketch bits (of 128) that must agree: 6 standard deviations below the mean at 0.8.
SKETCH_BITS = 96
#: Sets in a block of the exact comparison.
BLOCK_SETS = 512
SLICE_BYTES = 2 << 20

SIGNED = "doc_id long, text_key long, size long, set_a long, set_b long, tokens binary"
SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                          ("tokens", pa.binary())])
NODES = "node long, set_id long, size long, sketch_a long, sketch_b long"
NODES_ARROW = pa.schema([("node", pa.int64()), ("set_id", pa.int64()), ("size", pa.int64()), ("sketch_a", pa.int64()),
                         ("sketch_b", pa.int64())])


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 54-bit shingle hashes of each text, sorted, and their offsets. A text of
    fewer words has one shingle of all of them."""
    starts, ends, woff = word_bounds(buf, off, SPACED)
    words = word_hashes(buf, starts, ends, byte_codes())
    count = np.diff(woff)
    at = np.flatnonzero(valid_starts(woff, width))
    keys = [((np.searchsorted(woff, at, "right") - 1).astype(U64) << U64(54)) | (window_hash(words, width, at) >> U64(10))]
    for n in range(1, width):
        doc = np.flatnonzero(count == n)
        if len(doc):
            keys.append((doc.astype(U64) << U64(54)) | (window_hash(words, n, woff[doc]) >> U64(10)))
    keys = np.unique(np.concatenate(keys))
    return keys & U64((1 << 54) - 1), np.searchsorted(keys >> U64(54), np.arange(len(off), dtype=U64))


def set_names(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, whatever the order of its members."""
    out = []
    for salt in (MULT, MULT ^ U64(1 << 40)):
        run = np.zeros(len(sets) + 1, U64)
        np.cumsum(mix(sets + salt), out=run[1:])
        out.append((run[off[1:]] - run[off[:-1]]).view(np.int64))
    return out[0], out[1]


def few_texts(off: np.ndarray, size: int):
    """Slices of at most 512 texts: the text's number has 10 bits beside a shingle's 54."""
    for lo, hi in slices(off, size):
        for at in range(lo, hi, 512):
            yield at, min(at + 512, hi)


def signed_texts(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Size, names and MinHash tokens of every text's shingle set (no tokens: no words)."""
    def sign(batches):
        seeds = mix(np.arange(1, 2 * TOKENS + 1, dtype=U64) * MULT)
        flip, odd = (seeds[:TOKENS] >> U64(32)).astype(np.uint32), (seeds[TOKENS:] >> U64(32)).astype(np.uint32) | np.uint32(1)
        for batch in batches:
            buf, off = text_bytes(batch.column(2))
            for lo, hi in few_texts(off, SLICE_BYTES):
                sets, soff = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], width)
                size = np.diff(soff)
                full = np.flatnonzero(size)
                short = (mix(sets) >> U64(32)).astype(np.uint32)
                tokens = np.empty((len(full), TOKENS), np.uint32)
                for i in range(TOKENS if len(full) else 0):
                    tokens[:, i] = np.minimum.reduceat((short ^ flip[i]) * odd[i], soff[full])
                cell = [b""] * (hi - lo)
                for k, row in zip(full.tolist(), tokens):
                    cell[k] = row.tobytes()
                a, b = set_names(sets, soff)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size), pa.array(a), pa.array(b),
                                                  pa.array(cell, pa.binary())], schema=SIGNED_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(sign, SIGNED), "signed")


def token_matrix(cells: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint32).reshape(-1, TOKENS)


def sketches(tokens: np.ndarray) -> np.ndarray:
    """One bit a token, as two words."""
    bits = ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, 2)


def survival(depth: int) -> float:
    """Chance that a pair of the sought similarity still shares a node at this depth:
    at each level the number of shared nodes is Poisson of mean 1 for each shared node."""
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return 1 - lost


def runs_needed(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def children(path: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows at nodes ``path`` the row numbers and nodes of the sampled tokens they hold."""
    names = mix(tokens.astype(U64) + (np.arange(1, TOKENS + 1, dtype=U64) << U64(32)))
    drawn = mix(names ^ path[:, None])
    row, col = np.nonzero(drawn < U64(int(2.0 ** 64 / (similarity * TOKENS))))
    return row, mix(drawn[row, col] + MULT)


def split(rows: DataFrame, similarity: float, paths: list[int] | None) -> DataFrame:
    """Nodes of the next level. Rows have set_id, size, tokens, and node unless ``paths`` gives the roots."""
    def walk(batches):
        for batch in batches:
            tokens = token_matrix(batch.column("tokens"))
            if not len(tokens):
                continue
            sketch = sketches(tokens)
            ids, size = batch.column("set_id").to_numpy(), batch.column("size").to_numpy()
            for at in range(0, len(tokens), 4096):
                part = tokens[at:at + 4096]
                starts = ([np.full(len(part), p, U64) for p in paths] if paths is not None
                          else [batch.column("node").to_numpy()[at:at + 4096].view(U64)])
                for path in starts:
                    row, node = children(path, part, similarity)
                    row = row + at
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[row]), pa.array(size[row]),
                                                      pa.array(sketch[row, 0]), pa.array(sketch[row, 1])], schema=NODES_ARROW)

    return rows.mapInArrow(walk, NODES)


def linked(rows: dict[str, np.ndarray], same: tuple[int, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as set ids) in nodes of up to ``most`` rows whose sizes and sketches agree.
    Rows come sorted by node; step by step each is compared with the one d places on."""
    node, ids, size = rows["node"], rows["set_id"], rows["size"]
    a, b = rows["sketch_a"].view(U64), rows["sketch_b"].view(U64)
    num, den = same
    live, found = np.arange(len(node)), []
    for d in range(1, most):
        live = live[live + d < len(node)]
        live = live[node[live] == node[live + d]]
        if not len(live):
            break
        x, y = live, live + d
        near = (np.bitwise_count(a[x] ^ a[y]) + np.bitwise_count(b[x] ^ b[y])) <= TOKENS - SKETCH_BITS
        near &= np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num
        found.append((ids[x[near]], ids[y[near]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def compare_nodes(nodes: DataFrame, parts: int, same: tuple[int, int], last: bool) -> DataFrame:
    """Links (a, b) inside small nodes, spanning ones only; rows of large nodes as (node, set id, null),
    or, at the last level, links of all members of a large node."""
    keys = ["node", "set_id", "size", "sketch_a", "sketch_b"]

    def compare(batches):
        held: dict[str, np.ndarray] | None = None      # rows of the node that the last batch ended in
        large, hub = None, 0                           # a node known to be large, its first set

        def out(kind, a, b, marks):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(marks)], names=["a", "b", "large"])

        def finish(rows, more):
            nonlocal held, large, hub
            node = rows["node"]
            if large is not None:
                own = int(np.searchsorted(node != large, True)) if (node != large).any() else len(node)
                if own:
                    yield from big({k: v[:own] for k, v in rows.items()})
                    rows = {k: v[own:] for k, v in rows.items()}
                    node = rows["node"]
                if len(node):
                    large = None
            if not len(node):
                held = None
                return
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.concatenate([first, [len(node)]]))
            if more:                                   # the last node may go on
                lo = int(first[-1])
                if size[-1] > SMALL_NODE:
                    large, hub, held = int(node[lo]), int(rows["set_id"][lo]), None
                    yield from big({k: v[lo:] for k, v in rows.items()})
                else:
                    held = {k: v[lo:] for k, v in rows.items()}
                rows = {k: v[:lo] for k, v in rows.items()}
                first, size = first[:-1], size[:-1]
            for k in np.flatnonzero(size > SMALL_NODE).tolist():
                part = {c: v[first[k]:first[k] + size[k]] for c, v in rows.items()}
                hub = int(part["set_id"][0])
                yield from big(part)
            keep = np.repeat((size > 1) & (size <= SMALL_NODE), size)
            rows = {k: v[keep] for k, v in rows.items()}
            a, b = linked(rows, same, SMALL_NODE)
            if len(a):
                nodes_, label = local_labels(a, b)
                other = nodes_ != label
                yield out("link", nodes_[other], label[other], np.zeros(int(other.sum()), bool))

        def big(rows):
            n = len(rows["node"])
            if last:
                yield out("link", rows["set_id"], np.full(n, hub, np.int64), np.zeros(n, bool))
            else:
                yield out("large", rows["node"], rows["set_id"], np.ones(n, bool))

        for batch in batches:
            rows = {k: batch.column(k).to_numpy() for k in keys}
            if held is not None:
                rows = {k: np.concatenate([held[k], rows[k]]) for k in keys}
                held = None
            yield from finish(rows, True)
        if held is not None:
            rows, held = held, None
            yield from finish(rows, False)

    return (nodes.repartition(parts, "node").sortWithinPartitions("node")
            .mapInArrow(compare, "a long, b long, large boolean"))


def candidate_links(sets: DataFrame, n_sets: int, same: tuple[int, int], recall: float, depth: int) -> DataFrame:
    """Spanning links (a, b) of groups that hold every pair of the sought similarity, up to the recall."""
    similarity = same[0] / same[1]
    runs = runs_needed(recall, depth)
    roots = [int(x) for x in mix(np.arange(1, runs + 1, dtype=U64) * MULT)]
    session = sets.sparkSession
    least = int(session.conf.get("spark.sql.shuffle.partitions"))
    rows, found, links = n_sets * runs / similarity, None, []
    nodes = split(sets, similarity, roots)
    for level in range(1, depth + 1):
        got = written(compare_nodes(nodes, max(least, math.ceil(rows / 500_000)), same, level == depth), "nodes")
        links.append(got.where("not large").select("a", "b"))
        large = got.where("large").select(F.col("a").alias("node"), F.col("b").alias("set_id"))
        rows = large.count() / similarity
        if not rows or level == depth:
            break
        nodes = split(large.join(sets, "set_id").select("set_id", "size", "tokens", "node"), similarity, None)
    for more in links:
        found = more if found is None else found.union(more)
    return found.distinct()


def exact_links(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, width: int, same: tuple[int, int]) -> DataFrame:
    """Compare the sets of each group exactly. ``groups``: set_id, label, doc_id, set_a, set_b, copies.

    Rows (a, null, links) count, for a set, the rows linked to it in one pair of blocks;
    rows (a, b, null) are spanning links. Members of a group are dealt to blocks by hash,
    each pair of blocks is one comparison; small groups share one."""
    num, den = same

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).cast("long")
    bits = bitmap(groups.select(bit.alias("bit")), "bit")

    def cut(batches):
        for batch in batches:
            some = np.flatnonzero(in_bitmap(bits, batch.column("bit").to_numpy()))
            batch = batch.take(pa.array(some))
            buf, off = text_bytes(batch.column("text"))
            for lo, hi in few_texts(off, SLICE_BYTES):
                sets, soff = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], width)
                a, b = set_names(sets, soff)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(a), pa.array(b), pa.array(
                    [raw[8 * s:8 * e] for s, e in zip(soff[:-1].tolist(), soff[1:].tolist())], pa.binary())],
                    names=["doc_id", "set_a", "set_b", "members"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = texts.withColumn("bit", bit).mapInArrow(cut, "doc_id long, set_a long, set_b long, members binary").alias("t")
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
    shared = max(1, math.ceil((sizes.where(F.col("n") <= BLOCK_SETS).agg(F.sum("n")).first()[0] or 0) / BLOCK_SETS))
    blocks = F.ceil(F.col("n") / BLOCK_SETS)
    known = groups.join(sizes, "label").select(
        "doc_id", "set_a", "set_b", "label", "set_id", "copies", F.pmod(F.xxhash64("set_id"), blocks).alias("own"), blocks.alias("blocks"),
        F.when(blocks > 1, F.col("label")).otherwise(-1 - F.pmod(F.xxhash64("label"), F.lit(shared))).alias("group")).alias("g")
    # always a shuffled join, so that its cost grows in proportion
    joined = cuts.join(known.hint("merge"), (F.col("t.set_a") == F.col("g.set_a")) & (F.col("t.set_b") == F.col("g.set_b"))
                       & F.col("t.doc_id").eqNullSafe(F.col("g.doc_id")))
    dealt = (joined.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     "own", "label", "set_id", "copies", "members"))

    def compare(table: pa.Table) -> pa.Table:
        label, ids = table.column("label").to_numpy(), table.column("set_id").to_numpy()
        block, copies = table.column("own").to_numpy(), table.column("copies").to_numpy()
        cells = table.column("members").combine_chunks()
        _, off, data = cells.buffers()
        off = np.frombuffer(off, np.int32, len(cells) + 1, cells.offset * 4).astype(np.int64) // 8
        flat = np.frombuffer(data, U64)
        two = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        size = np.diff(off)
        order = np.unique(ids, return_index=True)[1]        # rows that share an id may bring a set twice
        order = order[np.lexsort((size[order], label[order]))]
        count, a, b = np.zeros(len(ids), np.int64), [], []
        for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(rows) < 2:
                continue
            n = size[rows]
            bounds = np.concatenate([[0], np.cumsum(n)])
            code = np.unique(np.concatenate([flat[off[r]:off[r + 1]] for r in rows]), return_inverse=True)[1]
            here = np.zeros(int(code.max()) + 1, bool)
            for i in range(len(rows) - 1):
                top = int(np.searchsorted(n, n[i] * den // num, "right"))       # larger sets are too large
                if top <= i + 1:
                    continue
                mine = code[bounds[i]:bounds[i + 1]]
                here[mine] = True
                common = np.add.reduceat(here[code[bounds[i + 1]:bounds[top]]], bounds[i + 1:top] - bounds[i + 1], dtype=np.int64)
                here[mine] = False
                hit = common * den >= (n[i] + n[i + 1:top] - common) * num
                if two:
                    hit &= block[rows[i + 1:top]] != block[rows[i]]
                j = rows[i + 1:top][hit]
                if len(j):
                    count[rows[i]] += copies[j].sum()
                    count[j] += copies[rows[i]]
                    a.append(np.full(len(j), ids[rows[i]]))
                    b.append(ids[j])
        some = np.flatnonzero(count)
        nodes, least = local_labels(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        span = nodes != least
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], nodes[span]]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(least[span], pa.int64())]),
            "links": pa.concat_arrays([pa.array(count[some], pa.int64()), pa.nulls(int(span.sum()), pa.int64())])})

    return written(dealt.groupBy("group", "lo", "hi").applyInArrow(compare, "a long, b long, links long"), "exact")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = SHINGLE_WORDS,
                 same: tuple[int, int] = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """Classes and links of texts whose shingle sets have a Jaccard similarity of at least ``same``.

    Words are runs of other than white space, unchanged; a text of fewer words than a
    shingle has one shingle of all its words. Returns one row per input row: doc_id,
    class_id (smallest doc_id of its class: the rows it reaches by links), n_links (other
    rows linked to it, copies among them), n_copies (rows with the same set, itself
    among them), n_shingles, text_key (xxhash64 of the text) and stands: the row, or rows
    repeated with id and text, that stands for its class, the first by doc_id, then text_key.
    Null and empty texts have no shingles: no links, a class of their own. Repeated rows
    are copies of each other. A null id comes before all others. An empty table gives no
    rows. Other columns are not read."""
    rows = signed_texts(docs, id_col, text_col, width)
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_key")
    sets = written(
        rows.where("size > 0").groupBy("set_a", "set_b").agg(
            F.min(first).alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("tokens").alias("tokens"))
        .select("set_a", "set_b", "least", F.col("least.doc_id").alias("doc_id"), "copies", "size", "tokens")
        .withColumn("set_id", F.monotonically_increasing_id()), "sets")
    found = candidate_links(sets.select("set_id", "size", "tokens"), sets.count(), same, recall, depth)
    groups = written(components(found).join(sets, F.col("node") == F.col("set_id"))
                     .select("set_id", "label", "doc_id", "set_a", "set_b", "copies"), "groups")
    exact = exact_links(docs, groups, id_col, text_col, width, same)
    count = exact.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    label = components(exact.where("b is not null").select("a", "b"))
    own = (sets.select("set_id", "set_a", "set_b", "least", "copies")
           .join(count.withColumnRenamed("a", "set_id"), "set_id", "left")
           .join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
           .withColumn("label", F.coalesce("label", "set_id")))
    head = own.groupBy("label").agg(F.min("least").alias("head"))
    own = own.join(head, "label").select("set_a", "set_b", "copies", "links", "head")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    full = (rows.where("size > 0").select("doc_id", "text_key", "size", "set_a", "set_b").join(own, ["set_a", "set_b"])
            .select("doc_id", F.col("head.doc_id").alias("class_id"),
                    (F.coalesce("links", zero) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"),
                    F.col("size").alias("n_shingles"), "text_key", (first == F.col("head")).alias("stands")))
    bare = rows.where("size = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), one.alias("n_copies"), zero.alias("n_shingles"), "text_key", F.lit(True).alias("stands"))
    result = written(full.union(bare), "classes")
    for table in (rows, sets, groups, exact):
        drop_written(table)
    return result
