"""Substring dedup over words: difference-cover anchors.

Windows are hashed only at cover positions modulo a period; any long match
shares an aligned anchor, which then extends to whole windows (see ``repeats``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACED, byte_codes, covered, word_bounds, word_hashes
from .repeats import Windows, as_batches, repeated_windows, to_blocks

WINDOW_WORDS = 35
PERIOD = 21

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                          ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def spaced_words(buf: np.ndarray, off: np.ndarray):
    """Codes of the words, their offsets by text, and where each word lies."""
    starts, ends, woff = word_bounds(buf, off, SPACED)
    return word_hashes(buf, starts, ends, byte_codes()), woff, starts, ends


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    window: int = WINDOW_WORDS, period: int = PERIOD, block_bytes: int = 2 << 20) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts anywhere else.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 and the kept
    words joined by one space (kept_text). Windows are judged on the input. A null or
    empty text has no words; its kept text is empty. Repeated rows are copies of each
    other, so all their windows go. A null id stays null. An empty table gives no rows.
    Other columns are not read."""
    w = Windows(window, period, spaced_words, earlier=False, elements_per_byte=1 / 6)
    blocks, repeated = repeated_windows(to_blocks(docs, id_col, text_col, block_bytes, ordered=False), w)

    def kept(batches):
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    (ids, buf, _, off, (starts, ends)), at = repeated(batch, k)
                    gone = covered(at, window, int(off[-1]))
                    # copy the kept words with one separator byte behind each
                    raw = buf.tobytes()
                    for doc, lo, hi in zip(ids.to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                        keep = np.flatnonzero(~gone[lo:hi]) + lo
                        text = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
                        yield doc, hi - lo, hi - lo - len(keep), hashlib.sha256(text).hexdigest(), text.decode()
        yield from as_batches(rows(), RESULT_ARROW, 256)

    return blocks.mapInArrow(kept, RESULT)
