"""Benchmark decontamination by winnowing.

Of the k-grams in every window the smallest hash is its fingerprint: whatever
two texts share a window, both keep the same fingerprint. Fingerprints of the
test items fill a bitmap of fixed size; document windows whose fingerprint is
in it are extended to the whole window, whose name is joined with the items'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ALNUM, BITMAP_BITS, U64, bitmap, in_bitmap, lower_codes, text_bytes, valid_starts, window_hash,
                     word_bounds, word_hashes)

WINDOW_WORDS = 13
GRAM_WORDS = 8
SLICE_BYTES = 2 << 20

FOUND = "rid long, id long, text_key long, n_words long, width int, name long, start long"
FOUND_ARROW = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("width", pa.int32()),
                         ("name", pa.int64()), ("start", pa.int64())])
ITEMS = "item long, width int, name long, print long"
ITEMS_ARROW = pa.schema([("item", pa.int64()), ("width", pa.int32()), ("name", pa.int64()), ("print", pa.int64())])


def plain_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the lower-cased words, and their offsets by text."""
    codes = lower_codes()
    table = ALNUM.copy()
    table[0x41:0x5B] = True                      # A-Z count as a-z
    starts, ends, woff = word_bounds(buf, off, table)
    return word_hashes(buf, starts, ends, codes), woff


def slices(off: np.ndarray, size: int):
    """Ranges of texts of about ``size`` bytes each."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def fingerprints(words: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each window of ``width`` words the smallest hash of its k-grams."""
    k = min(gram, width)
    least = window_hash(words, k)
    have, want = 1, width - k + 1
    while have < want and len(least):
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least + U64(width)


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """Windows of every item: ``width`` words, or all words of a shorter item."""
    def cut(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                words, woff = plain_words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                size = np.diff(woff)
                for w in np.unique(np.minimum(size, width)).tolist():
                    if w:
                        own = np.minimum(size, width) == w
                        at = np.flatnonzero(valid_starts(woff, w))
                        doc = np.searchsorted(woff, at, "right") - 1
                        at, doc = at[own[doc]], doc[own[doc]]
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(doc + lo)), pa.array(np.full(len(at), w), pa.int32()),
                            pa.array(window_hash(words, w, at).view(np.int64)),
                            pa.array(fingerprints(words, w, gram)[at].view(np.int64))], schema=ITEMS_ARROW)

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, ITEMS)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", *,
                  window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, share: int = 20) -> DataFrame:
    """Which words of each document lie in a window of a test item.

    Returns one row per input row: doc_id, n_words, n_hit, n_items, items (ids of the
    items with occurring windows, as strings in string order), contaminated (any hit, and
    at least 1 word in ``share``), text_key (xxhash64 of the text). Null or empty texts have no words and are clean; items
    without words match nothing; without items every document is clean. Repeated rows
    are judged each by itself, repeated items count once. A null item id is not listed.
    An empty table gives no rows. Other columns are not read."""
    windows = item_windows(items, item_id_col, item_text_col, window, gram)
    widths = sorted({window, *(r[0] for r in windows.select("width").distinct().collect())})
    bits = bitmap(windows.select(F.pmod("print", F.lit(BITMAP_BITS)).cast("long").alias("bit")), "bit")

    def scan(batches):
        for batch in batches:
            rid, ids, keys = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            buf, off = text_bytes(batch.column(3))
            for lo, hi in slices(off, SLICE_BYTES):
                words, woff = plain_words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                n = hi - lo
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid[lo:hi]), ids.slice(lo, n), keys.slice(lo, n), pa.array(np.diff(woff)),
                    pa.array(np.zeros(n, np.int32)), pa.array(rid[lo:hi]), pa.nulls(n, pa.int64())], schema=FOUND_ARROW)
                for w in widths:
                    prints = fingerprints(words, w, gram)
                    at = np.flatnonzero(in_bitmap(bits, (prints % U64(BITMAP_BITS)).astype(np.int64)))
                    at = at[valid_starts(woff, w)[at]] if len(at) else at
                    if len(at):
                        doc = np.searchsorted(woff, at, "right") - 1
                        yield pa.RecordBatch.from_arrays([
                            pa.array(rid[doc + lo]), ids.take(pa.array(doc + lo)), *[pa.nulls(len(at), pa.int64())] * 2,
                            pa.array(np.full(len(at), w), pa.int32()),
                            pa.array(window_hash(words, w, at).view(np.int64)), pa.array(at - woff[doc])], schema=FOUND_ARROW)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                       F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    # a document's own row has width 0 and its row number for a name: it matches nothing and lands anywhere
    found = rows.mapInArrow(scan, FOUND)
    known = windows.groupBy("width", "name").agg(F.collect_set(F.col("item").cast("string")).alias("own"))
    hit = F.when(F.col("own").isNotNull(), F.sequence("start", F.col("start") + F.col("width") - 1))
    by_doc = (found.join(known, ["width", "name"], "left").groupBy("rid")
              .agg(F.max("id").alias("id"), F.max("text_key").alias("text_key"), F.max("n_words").alias("n_words"),
                   F.array_distinct(F.flatten(F.collect_list(hit))).alias("hits"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("items")))
    n_hit = F.size("hits").cast("long")
    return by_doc.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "text_key")
