"""Helpers shared by the operators: written tables, word and window hashing.

The array helpers work on one block of texts at a time: all UTF-8 bytes of the
block in one numpy array plus the texts' offsets. Hashes are 64 bits wide;
among n different keys a false match has probability below n*n / 2**65.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict):
    """The session's settings are these for the actions inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of an action inside go when the action ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a parquet table in the shared folder (spark.checkpoint.dir).

    Cuts the lineage: a lost executor costs a re-read, and the shuffle files
    of the write go at once. ``options``: the parquet writer's."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with short_lived_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """``df`` as a parquet table in the shared folder, bucketed by ``key``: a later join
    on the key moves only its other side. ``parts`` must not be below
    spark.sql.shuffle.partitions, or Spark prefers to shuffle both."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    entry = path.rsplit("/", 1)[1].replace("-", "_")
    with short_lived_shuffles(spark):
        (df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(entry))
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")            # the catalog's entry only: the files and this plan stay
    return table


def drop_written(table: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Bits of a bitmap of hashed keys: 8 MB at most, however many keys there are.
BITMAP_BITS = 1 << 26


def bitmap(keys: DataFrame, column: str) -> bytes:
    """Which of the BITMAP_BITS values occur in ``column``, as one bitmap. It lets through
    what may match: with many more keys than bits it lets all through, and a join decides."""
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    at = keys.select((F.col(column) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    for row in parts.toLocalIterator():
        bits[(row["b"] - 1) * 4096:row["b"] * 4096] = np.frombuffer(row["m"], np.uint8)
    return bits.tobytes()


def in_bitmap(bits: bytes, at: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, np.uint8)
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


# ------------------------------------------------------------------ arrays

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93                  # odd
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_codes() -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=U64) * MULT)


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array (null: empty) and the offsets of its items."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def word_bounds(buf: np.ndarray, off: np.ndarray, in_word: np.ndarray):
    """Starts, ends of the words of every text, and the offsets of each text's words.

    ``in_word`` tells for each byte value if it belongs to a word."""
    inside = in_word[buf]
    first, last = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = before
    after[:-1] = inside[1:]
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << max(n - 1, 0).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one running sum over the block."""
    up, down = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U64)
    np.cumsum(codes[buf] * up[:len(buf)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U64) * MULT)


def window_hash(x: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of x[p:p+k], for every p or those in ``at``, by doubling the length."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    level, width, done, out = x, 1, 0, None
    while True:
        if k & width:
            part = level[done:done + n] if at is None else level[at + done]
            out = part.copy() if out is None else _joined(out, part)
            done += width
        if done == k:
            return mix(out)
        level = _joined(level[:-width], level[width:])
        width *= 2


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * MULT
    z += b
    z ^= z >> U64(29)
    return z


def valid_starts(off: np.ndarray, k: int) -> np.ndarray:
    """For each of off[-1] - k + 1 positions: does a window of k lie inside one text?"""
    n = int(off[-1])
    ok = np.ones(max(n - k + 1, 0), bool)
    if not len(ok):
        return ok
    delta = np.zeros(n + 1, np.int32)
    size = np.diff(off)
    lo = np.maximum(off[1:] - k + 1, off[:-1])
    np.add.at(delta, lo[size > 0], 1)
    np.add.at(delta, off[1:][size > 0], -1)
    return np.cumsum(delta)[:len(ok)] == 0


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the given length at one of ``starts``."""
    delta = np.zeros(n + 1, np.int32)
    delta[starts] += 1                       # starts are distinct
    ends = starts + length
    delta[ends] -= 1
    return np.cumsum(delta)[:n] > 0


def word_class(pattern_bytes: bytes) -> np.ndarray:
    """A table that is False for the given (separator) bytes."""
    table = np.ones(256, bool)
    table[np.frombuffer(pattern_bytes, np.uint8)] = False
    return table


#: Words are runs of bytes other than space, tab, line feed, vertical tab, form feed, return.
SPACED = word_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, digits and all bytes beyond ASCII, after lower-casing.
ALNUM = word_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def lower_codes() -> np.ndarray:
    """Byte codes in which A-Z have those of a-z."""
    codes = byte_codes()
    codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes
