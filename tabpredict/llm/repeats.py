"""Repeated windows of a corpus, found through difference-cover samples.

Texts are packed into blocks of bounded size, written once. A window of W
elements (bytes or words) that occurs twice shares, wherever its two copies
lie, at least one offset at which both copies have a position of the cover: a
set D modulo v whose differences take every value. So

1. only cover positions (|D| of v) are named: each block sends the names of the
   L = W - v + 1 elements at its cover positions, sorted and without doubles,
   to buckets by value; one bucket at a time is sorted, and tells each block
   which of its names are shared (a bit per name);
2. windows around a shared cover position are the only ones that can repeat.
   They extend it: the names of all W elements go to buckets in the same way,
   and the sorted bucket tells which windows occur in another (or, where order
   counts, an earlier) block.

A block sends each name once, so a passage that a third of all texts hold costs
a bucket one entry a block, and buckets are even. Nothing goes to the driver
but one sum of sizes. Block and bucket sizes bound the memory of a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, text_bytes, valid_starts, window_hash, written, written_by

#: For a period, a set of residues whose differences take every residue.
COVERS = {13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 4, 10, 12, 17), 57: (0, 1, 3, 13, 32, 36, 43, 52)}

BLOCKS = "block long, n_bytes long, ids array<long>, texts array<string>"
SENT = "block long, bucket int, names binary"
BITS = "block long, bucket int, bits binary"


#: Text in one part of the block table.
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class Windows:
    """What repeats: windows of ``width`` elements; cover period; ``elements``
    turns (bytes, offsets) into (64-bit codes, offsets); ``earlier``: only
    copies that start earlier in (doc_id, position) order count."""

    width: int
    period: int
    elements: Callable
    earlier: bool
    elements_per_byte: float
    names_per_bucket: int = 1 << 21

    @property
    def core(self) -> int:
        return self.width - self.period + 1


def to_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, ordered: bool, carry: bool = False) -> DataFrame:
    """Texts packed into blocks of about ``block_bytes`` (a longer text is a block of its own).

    ``ordered``: blocks follow the ids (null first), and texts inside a block too.
    ``carry``: the rows' other columns come along, as one struct a row."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       *([F.struct(*rest).alias("rest")] if rest else []))
    schema = T.StructType.fromDDL(BLOCKS)
    if rest:
        schema = schema.add("rest", T.ArrayType(rows.schema["rest"].dataType))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    if ordered:
        rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def block():
            columns = [pa.concat_arrays([h.column(k) for h in held]) for k in range(held[0].num_columns)]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | seq], pa.int64()), pa.array([size], pa.int64())]
                + [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
                names=["block", "n_bytes", "ids", "texts", "rest"][:2 + len(columns)])

        for batch in batches:
            ends = np.cumsum(text_lengths(batch.column(1)))
            at = 0
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + block_bytes - size, "right")))
                if size and int(ends[to - 1]) - base + size > block_bytes:
                    yield block()
                    seq, held, size = seq + 1, [], 0
                    continue
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - base
                at = to
                if size >= block_bytes:
                    yield block()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield block()

    return written_by(rows.mapInArrow(pack, schema), "blocks", "block", parts)


def text_lengths(text: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(text)[1])


def opened(batch: pa.RecordBatch, k: int, elements: Callable):
    """Ids, texts' bytes, offsets and coded elements of the batch's k-th block."""
    ids = batch.column("ids")[k].values
    texts = batch.column("texts")[k].values
    buf, off = text_bytes(texts)
    return (ids, buf, off, *elements(buf, off))


def cover_positions(n: int, period: int) -> np.ndarray:
    at = (np.arange(0, n, period)[:, None] + np.array(COVERS[period])).ravel()
    return at[at < n]


def core_names(codes: np.ndarray, off: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions whose core lies in one text, and 40-bit names of the cores."""
    ok = valid_starts(off, w.core)
    at = cover_positions(len(ok), w.period)
    at = at[ok[at]]
    return at, window_hash(codes, w.core, at) >> U64(24)


def window_names(codes: np.ndarray, off: np.ndarray, w: Windows, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that hold the core at a shared cover position, and their names."""
    ok = valid_starts(off, w.width)
    if not len(shared) or not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    around = np.zeros(len(codes) + 1, np.int32)
    np.add.at(around, np.maximum(shared - w.period + 1, 0), 1)
    np.add.at(around, shared + 1, -1)
    at = np.flatnonzero((np.cumsum(around)[:len(ok)] > 0) & ok)
    return at, window_hash(codes, w.width, at)


def packed(names: np.ndarray) -> bytes:
    """Sorted names as steps, byte plane by byte plane: the high planes compress to nothing."""
    steps = np.diff(names, prepend=U64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(steps.view(U64).ravel(), dtype=U64)


def dealt(block: int, names: np.ndarray, bits: int, buckets: int):
    """The sorted names of a block cut at the buckets' borders."""
    shift = U64(bits - (buckets.bit_length() - 1))
    cuts = np.searchsorted(names, np.arange(1, buckets, dtype=U64) << shift) if buckets > 1 else np.zeros(0, np.int64)
    bounds = [0, *cuts.tolist(), len(names)]
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            yield block, b, packed(names[bounds[b]:bounds[b + 1]])


def as_batches(rows, schema: pa.Schema, most: int = 64):
    """Record batches of at most ``most`` rows from tuples."""
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


SENT_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("names", pa.binary())])
BITS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def sort_buckets(sent: DataFrame, earlier: bool) -> DataFrame:
    """One bucket at a time: sort its names and tell each block which of them another
    (``earlier``: a smaller) block has sent too."""

    def sort_bucket(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        turn = np.argsort(blocks, kind="stable")
        cells = table.column("names").combine_chunks()
        parts = [unpacked(cells[int(i)].as_buffer()) for i in turn]
        sizes = np.array([len(p) for p in parts])
        names = np.concatenate(parts)
        del parts
        order = np.argsort(names, kind="stable")           # ties stay in block order
        names = names[order]
        same = names[1:] == names[:-1]
        shared = np.zeros(len(names), bool)
        shared[order[1:]] = same
        if not earlier:
            shared[order[:-1]] |= same
        cuts = np.cumsum(sizes)[:-1]
        return pa.Table.from_arrays([
            pa.array(blocks[turn], pa.int64()),
            table.column("bucket").combine_chunks().take(pa.array(turn)),
            pa.array([np.packbits(b).tobytes() for b in np.split(shared, cuts)], pa.binary()),
        ], schema=BITS_ARROW)

    return sent.groupBy("bucket").applyInArrow(sort_bucket, BITS)


def answered(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """Blocks with the bits that the buckets gave back, as one array column an exchange."""
    for name, bits in answers.items():
        own = bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
        blocks = blocks.join(own.hint("shuffle_hash"), "block", "left")
    return blocks


def read_bits(cell, names: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The answer for a block's sorted names."""
    out = np.zeros(len(names), bool)
    if cell is None or not len(names):
        return out
    shift = U64(bits - (buckets.bit_length() - 1))
    cuts = np.searchsorted(names, np.arange(1, buckets, dtype=U64) << shift) if buckets > 1 else np.zeros(0, np.int64)
    bounds = [0, *cuts.tolist(), len(names)]
    for part in cell:
        lo, hi = bounds[part["bucket"]], bounds[part["bucket"] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


def power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(x, 1)))))


def repeated_windows(blocks: DataFrame, w: Windows):
    """The exchange of both steps. Returns the blocks with their answers (columns
    ``cores`` and ``windows``) and a function that, in a task, turns a row of them
    into (ids, bytes, offsets, element offsets, starts of repeated windows)."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    names = total * w.elements_per_byte * len(COVERS[w.period]) / w.period
    buckets = power_of_two(names / w.names_per_bucket)

    def send_cores(batches):
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    codes, off = opened(batch, k, w.elements)[3:5]
                    yield from dealt(batch.column("block")[k].as_py(), np.unique(core_names(codes, off, w)[1]), 40, buckets)
        yield from as_batches(rows(), SENT_ARROW)

    cores = written(sort_buckets(blocks.mapInArrow(send_cores, SENT), False), "cores")

    def shared_windows(batch, k):
        ids, buf, boff, codes, off, *more = opened(batch, k, w.elements)
        at, name = core_names(codes, off, w)
        own, back, n = np.unique(name, return_inverse=True, return_counts=True)
        hit = read_bits(batch.column("cores")[k].as_py(), own, 40, buckets) | (n > 1)
        starts, names = window_names(codes, off, w, at[hit[back]])
        return (ids, buf, boff, off, more), starts, names

    def send_windows(batches):
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    names = shared_windows(batch, k)[2]
                    yield from dealt(batch.column("block")[k].as_py(), np.unique(names), 64, buckets)
        yield from as_batches(rows(), SENT_ARROW)

    windows = written(sort_buckets(answered(blocks, cores=cores).mapInArrow(send_windows, SENT), w.earlier), "windows")

    def repeated(batch, k):
        block, starts, names = shared_windows(batch, k)
        own, first, back, n = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        hit = read_bits(batch.column("windows")[k].as_py(), own, 64, buckets)[back]
        if w.earlier:
            hit |= np.arange(len(names)) != first[back]
        else:
            hit |= n[back] > 1
        return block, starts[hit]

    return answered(blocks, cores=cores, windows=windows), repeated
