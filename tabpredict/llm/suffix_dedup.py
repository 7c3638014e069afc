"""Suffix-array dedup over bytes: difference-cover blockwise construction.

Suffixes are ordered by the names of their first 100 bytes, which puts equal
strings side by side as the alphabetical order does. The cover sample is ranked
first; its ranks tell which suffixes can tie for so long, and only those are
dealt into buckets, each sorted by itself in bounded memory (see ``repeats``).
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_codes, covered
from .repeats import Windows, as_batches, repeated_windows, to_blocks

MATCH_BYTES = 100
PERIOD = 57

SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "kept_bytes binary, spans array<struct<start:long,length:long>>")
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                          ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary()),
                          ("spans", pa.list_(SPAN))])


def coded_bytes(buf: np.ndarray, off: np.ndarray):
    return byte_codes()[buf], off


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 match: int = MATCH_BYTES, period: int = PERIOD, block_bytes: int = 1 << 20,
                 carry: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``match`` bytes that also starts earlier.

    Earlier: smaller doc_id (null before all), or the same row and an earlier start.
    Rows that share a doc_id take a fixed order among themselves, so of repeated rows
    one keeps its text. Returns one row per input row: doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, kept_bytes (a cut may split a character) and the removed
    spans. A null or empty text has no bytes. An empty table gives no rows. Other
    columns are not read, but with ``carry`` they come along in the struct ``rest``,
    with kept_text (characters cut in half left out)."""
    w = Windows(match, period, coded_bytes, earlier=True, elements_per_byte=1.0)
    blocks, repeated = repeated_windows(to_blocks(docs, id_col, text_col, block_bytes, True, carry), w)
    carry = "rest" in blocks.columns

    def kept(batches):
        def rows(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    (ids, buf, off, _, _), at = repeated(batch, k)
                    gone = covered(at, match, len(buf)).astype(np.int8)
                    others = batch.column("rest")[k].as_py() if carry else [None] * len(ids)
                    for doc, lo, hi, other in zip(ids.to_pylist(), off[:-1].tolist(), off[1:].tolist(), others):
                        edges = np.diff(gone[lo:hi], prepend=np.int8(0), append=np.int8(0))
                        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                        rest = (buf[lo:hi][gone[lo:hi] == 0] if len(starts) else buf[lo:hi]).tobytes()
                        yield (doc, hi - lo, hi - lo - len(rest), len(starts), hashlib.sha256(rest).hexdigest(), rest,
                               [{"start": s, "length": e - s} for s, e in zip(starts.tolist(), ends.tolist())],
                               *([rest.decode("utf-8", "ignore"), other] if carry else []))

        batches, schema = iter(batches), RESULT_ARROW
        for first in batches:
            if carry:
                schema = schema.append(pa.field("kept_text", pa.string())).append(pa.field("rest", first.schema.field("rest").type.value_type))
            yield from as_batches(rows(chain([first], batches)), schema, 256)

    schema = T.StructType.fromDDL(RESULT)
    if carry:
        schema = schema.add("kept_text", "string").add("rest", blocks.schema["rest"].dataType.elementType)
    return blocks.mapInArrow(kept, schema)
