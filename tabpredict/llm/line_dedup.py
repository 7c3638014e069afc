"""Line dedup: hashes of lines dealt out by range, bitmaps of what stays given back.

A line's key (trimmed, A-Z lower-cased) is known by a 128-bit hash. The entries
(hash, document, position) are partitioned by ranges of the hash and sorted by
hash, then document, then position, so that one pass over a sorted partition sees
the first occurrence of each key and tells every later one from it. What goes back
to a document is a bitmap of the lines that leave it, 64 lines a word, words without
such a line left out; texts are never sent.

A key that a large share of all lines have would fill one range. An approximate
top-k finds such keys; it only decides how an entry is judged, never what becomes
of it: entries of frequent keys stay where they are and are judged against a table
of those keys' exact counts (``HOT_KEYS`` rows at most), all others are dealt out.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_CHARS = 20
MIN_DOCS = 3
#: Frequent keys that the sketch names, and that the table of them can hold.
HOT_KEYS = 1_000
HOT_TRACKED = 10_000
#: Entries of about 40 bytes in one range.
RANGE_ROWS = 2_000_000

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_entries(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, text_key, at): an entry for each line whose key has ``min_chars`` code points."""
    cut = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_key"),
                      F.posexplode(lines_of(F.col(f"`{text_col}`"))).alias("at", "line"))
    keyed = cut.select("doc", "text_key", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_key", "at")


def dropped_lines(entries: DataFrame, min_docs: int) -> DataFrame:
    """The entries (doc, text_key, at) whose line goes: its key is in ``min_docs`` documents, and
    in a document with a larger id. ``entries`` is read three times: a written table."""
    n = entries.count()
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    # 64 sketches, then one of them; in one partition, as combine fails on a partition without any
    sketches = entries.groupBy((F.spark_partition_id() % 64).alias("some")).agg(F.expr(f"approx_top_k_accumulate(h1, {HOT_TRACKED})").alias("s"))
    found = sketches.repartition(1).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {HOT_TRACKED}), {HOT_KEYS})").alias("top"))
    often = F.col("h1").isin([r["item"] for r in (found.first()["top"] if n else []) if r["count"] > n / (4 * parts)])

    # frequent keys: exact figures by partial sums; entries are judged where they lie
    hot = entries.where(often)
    mark = F.struct(F.col("doc").isNotNull(), "doc")                                       # a null id is the smallest
    known = (hot.groupBy("h1", "h2").agg(F.count_distinct(mark).alias("n_docs"), F.max(mark).alias("last"))
             .where(F.col("n_docs") >= min_docs).select("h1", "h2", F.col("last.doc").alias("last")))
    # as many rows as frequent h1 have different h2: HOT_KEYS but for clashes of 64 bits
    hot_gone = hot.join(F.broadcast(known), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("last")))

    # all others: ranges of hashes, in each the entries by document, last first, and position
    order = [F.col("doc").desc_nulls_last(), F.col("at").asc()]
    dealt = (entries.where(~often).repartitionByRange(parts, "h1", "h2")
             .sortWithinPartitions("h1", "h2", *order))
    key = Window.partitionBy("h1", "h2")
    ranked = dealt.withColumn("place", F.dense_rank().over(key.orderBy(*order[:1])))
    gone = ranked.withColumn("n_docs", F.max("place").over(key)).where((F.col("n_docs") >= min_docs) & (F.col("place") > 1))
    return hot_gone.select("doc", "text_key", "at").unionByName(gone.select("doc", "text_key", "at"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Which lines of each document go, as one bitmap a document.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines except in the document with the largest id holding them. Returns a row for each
    document that loses a line: doc, text_key (xxhash64 of the text), n_dropped, words: array of
    (word, bits), bit b of word w standing for line 64 w + b; words without a lost line are left out.

    A document is what has one id: rows with the same id count as one, and keep or lose alike; a
    null id is one document, before all others. A null or empty text is one empty line. Repeated
    rows give one bitmap. Line keys are compared by 128-bit hashes. An empty table gives no rows.
    Other columns are not read."""
    entries = written(line_entries(docs, id_col, text_col, min_chars), "lines")
    gone = dropped_lines(entries, min_docs)
    bit = F.expr("shiftleft(1L, at % 64)")
    words = gone.groupBy("doc", "text_key", F.expr("at div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return written(words.groupBy("doc", "text_key").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")), "bitmaps")


def dropped_at(words: Column) -> Column:
    """The positions in a bitmap, ascending; null if there is no bitmap."""
    def lines(word):
        return F.filter(F.sequence(word["word"] * 64, word["word"] * 64 + 63), lambda at: F.getbit(word["bits"], at % 64) == 1)

    return F.flatten(F.transform(words, lines))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Texts without the lines that ``line_bitmaps`` marks (defined cases: see there).

    Returns a row for each input row: doc_id, n_lines (before), n_dropped, kept_text (other
    lines, joined by a line feed; empty if all are gone)."""
    marks = line_bitmaps(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("own_key"), text.alias("own_text"))
    rows = rows.join(marks.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(marks["doc"]) & (rows["own_key"] == marks["text_key"]), "left")
    n = F.size("lines")                      # named twice below, so the text is split once a row, not once a line
    stay = F.array_except(F.sequence(F.lit(0), n - 1), dropped_at(F.col("words")))
    kept = F.array_join(F.transform(stay, lambda at: F.get(F.col("lines"), at)), "\n")
    return rows.withColumn("lines", lines_of(F.col("own_text"))).select(
        "doc_id", n.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("words").isNull(), F.coalesce("own_text", F.lit(""))).otherwise(kept).alias("kept_text"))
