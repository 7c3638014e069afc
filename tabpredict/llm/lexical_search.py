"""Ranked lexical search by MaxScore with bounds of term pairs.

The index (``index_terms``) is a table of blocks of documents: for each block its
distinct terms and, term by term, the documents that hold it and how often. It holds
every term of every document and knows no query.

A search takes the queries in bounded batches. For a batch

1. ``df`` of its terms is summed over all blocks, which gives the weights;
2. each block keeps the lists of the batch's terms with their impacts (a term's part of
   a document's score), the largest impact of each term and, for pairs of terms that a
   query holds, the joint maximum: the largest sum of both impacts over the documents of
   the block, taken from the two lists' intersection and their single maxima. Rare terms
   seldom meet, so a pair's maximum is often half the sum of the two;
3. the blocks with the largest bounds of a query are scored first; the k-th best score
   found there is the query's threshold;
4. every block whose bound reaches the threshold is searched. A query's bound is a sum
   over disjoint pairs (neighbours in its terms by weight) and the terms left over. Pairs
   are taken, smallest bounds first, as long as they can't reach the threshold together:
   documents that hold none of the other terms are never looked at, and a document goes
   as soon as its score so far and the bounds of what is left don't reach it.

Bounds only skip what can't be among the first k, so results are exact. All figures are
64-bit integers but the logarithm. Nothing is shuffled but figures and found documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, text_bytes, written
from .decontaminate import plain_words, slices

TOP = 20
#: Text of a block of the index, and of a batch of queries (a longer query is a batch of its own).
BLOCK_BYTES = 4 << 20
BATCH_BYTES = 1 << 20
#: Documents of a block: their numbers have 16 bits.
BLOCK_DOCS = 1 << 16
#: Blocks scored first for each query.
SEEDS = 4

INDEX = "block long, n_docs long, n_words long, ids binary, id_null binary, sizes binary, terms binary, counts binary, docs binary, tfs binary"
INDEX_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in INDEX.split(", ")])
LISTS = "block long, ids binary, id_null binary, terms binary, counts binary, docs binary, impacts binary, pairs binary, joint binary, most binary"
LISTS_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in LISTS.split(", ")])
FOUND = "query int, doc_id long, score long"
FOUND_ARROW = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def index_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of ``docs``, written in the shared folder.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z,
    known by 64-bit hashes. A null or empty text has none. Repeated rows are documents of their
    own; a null id stays null. Other columns are not read."""

    def build(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(2))
            for lo, hi in slices(off, block_bytes):
                for lo, hi in [(a, min(a + BLOCK_DOCS, hi)) for a in range(lo, hi, BLOCK_DOCS)]:
                    words, woff = plain_words(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                    size = np.diff(woff)
                    doc = np.repeat(np.arange(hi - lo, dtype=np.uint16), size)
                    terms, back = np.unique(words, return_inverse=True)
                    key, tf = np.unique(back.astype(np.uint64) << U64(16) | doc, return_counts=True)
                    counts = np.bincount((key >> U64(16)).astype(np.int64), minlength=len(terms))
                    ids = batch.column(1).slice(lo, hi - lo)
                    null = ids.is_null().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((
                        batch.column(0)[lo].as_py(), int((size > 0).sum()), int(woff[-1]), ids.fill_null(0).to_numpy().tobytes(), null.tobytes(),
                        size.astype(np.int64).tobytes(), terms.tobytes(), counts.astype(np.int32).tobytes(),
                        (key & U64(0xFFFF)).astype(np.uint16).tobytes(), tf.astype(np.int32).tobytes()), INDEX_ARROW)], schema=INDEX_ARROW)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return written(rows.mapInArrow(build, INDEX), "terms")


def cells(batch: pa.RecordBatch, k: int, **types) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(name)[k].as_buffer(), kind) for name, kind in types.items()]


def lengths_part(size: np.ndarray, n_all: int, l_all: int) -> np.ndarray:
    """A document's m: 75 + (25 n N) div L."""
    if len(size) and int(size.max()) * n_all * 25 >= 1 << 63:
        return np.array([75 + 25 * int(n) * n_all // l_all for n in size], np.int64)
    return 75 + 25 * size * n_all // max(l_all, 1)


@dataclass
class Batch:
    """Queries as arrays: the sorted codes of all their terms, and for each query its terms
    (numbers of those) with how often it holds each, heaviest first, in disjoint pairs."""

    codes: np.ndarray
    weights: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]
    pairs: np.ndarray             # sorted, distinct: a << 32 | b
    pair_of: list[np.ndarray]     # for each query the numbers of its pairs

    @classmethod
    def of(cls, words: list[np.ndarray]) -> Batch:
        codes = np.unique(np.concatenate([*words, np.zeros(0, U64)]))
        held = [np.unique(np.searchsorted(codes, w), return_counts=True) for w in words]
        return cls(codes, np.zeros(len(codes), np.int64), [t for t, _ in held], [n for _, n in held], np.zeros(0, np.int64), [])

    def weigh(self, df: np.ndarray, n_all: int) -> None:
        """Weights from document frequencies; each query's terms by weight, neighbours paired."""
        self.weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        for q, (t, n) in enumerate(zip(self.terms, self.times)):
            held = df[t] > 0
            by = np.lexsort((t[held], -self.weights[t[held]]))
            self.terms[q], self.times[q] = t[held][by], n[held][by]
        keys = [t[0:len(t) // 2 * 2:2].astype(np.int64) << 32 | t[1::2] for t in self.terms]
        self.pairs = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]))
        self.pair_of = [np.searchsorted(self.pairs, k) for k in keys]


def frequencies(index: DataFrame, codes: np.ndarray) -> np.ndarray:
    """Document frequencies of the given terms over the whole index."""
    def count(batches):
        df = np.zeros(len(codes), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                terms, counts = cells(batch, k, terms=U64, counts=np.int32)
                at = np.searchsorted(terms, codes)
                at[at == len(terms)] = 0
                if len(terms):
                    df += np.where(terms[at] == codes, counts[at], 0)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(len(codes), np.int64)
    for r in index.select("terms", "counts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def impact_lists(index: DataFrame, q: Batch, n_all: int, l_all: int) -> DataFrame:
    """For each block the lists of the batch's terms: documents, impacts, the largest impact of
    each term, and the joint maximum of each pair both of whose terms the block holds."""
    def build(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, null, size, terms, counts, docs, tfs = cells(batch, k, ids=np.int64, id_null=bool, sizes=np.int64, terms=U64,
                                                                  counts=np.int32, docs=np.uint16, tfs=np.int32)
                m = lengths_part(size, n_all, l_all)
                start = np.cumsum(counts) - counts
                at = np.searchsorted(terms, q.codes)
                at[at == len(terms)] = 0
                held = np.flatnonzero(terms[at] == q.codes) if len(terms) else np.zeros(0, np.int64)
                n = counts[at[held]].astype(np.int64)
                if not len(held):
                    continue
                first = np.cumsum(n) - n
                rows = np.arange(int(n.sum())) - np.repeat(first - start[at[held]], n)
                doc, tf = docs[rows], tfs[rows].astype(np.int64)
                impact = np.repeat(q.weights[held], n) * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                most = np.maximum.reduceat(impact, first)
                place = np.full(len(q.codes), -1)
                place[held] = np.arange(len(held))
                a, b = place[q.pairs >> 32], place[q.pairs & 0xFFFFFFFF]
                both = np.flatnonzero((a >= 0) & (b >= 0))
                joint = joint_maxima(doc, impact, first, n, most, a[both], b[both], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((
                    batch.column("block")[k].as_py(), ids.tobytes(), null.tobytes(), held.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(),
                    doc.tobytes(), impact.tobytes(), both.astype(np.int32).tobytes(), joint.tobytes(), most.tobytes()), LISTS_ARROW)], schema=LISTS_ARROW)

    return written(index.mapInArrow(build, LISTS), "lists")


def joint_maxima(doc, impact, first, n, most, a, b, n_docs: int) -> np.ndarray:
    """For pairs of lists (a, b) the largest sum of both impacts over all documents: over their
    intersection, and the larger of the two alone. Lists of few documents are looked up in a row
    of the other's impacts by document, some rows at a time."""
    joint = np.maximum(most[a], most[b])
    swap = n[a] > n[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)                  # b is the longer list
    by = np.argsort(b, kind="stable")
    row, seen = np.zeros(n_docs, np.int64), -1
    for k in by.tolist():
        if b[k] != seen:
            if seen >= 0:
                row[doc[first[seen]:first[seen] + n[seen]]] = 0
            seen = int(b[k])
            row[doc[first[seen]:first[seen] + n[seen]]] = impact[first[seen]:first[seen] + n[seen]]
        lo = first[a[k]]
        joint[k] = max(joint[k], (impact[lo:lo + n[a[k]]] + row[doc[lo:lo + n[a[k]]]]).max())
    return joint


class Block:
    """A block's lists in a task."""

    def __init__(self, batch: pa.RecordBatch, k: int, q: Batch, lists: bool = True):
        held, self.pair_ids, self.joint, self.most = cells(batch, k, terms=np.int32, pairs=np.int32, joint=np.int64, most=np.int64)
        self.place = np.full(len(q.codes), -1)
        self.place[held] = np.arange(len(held))
        self.pair_bound = np.full(len(q.pairs), -1, np.int64)
        self.pair_bound[self.pair_ids] = self.joint
        if lists:
            self.ids, self.null, self.n, self.doc, self.impact = cells(batch, k, ids=np.int64, id_null=bool, counts=np.int32, docs=np.uint16, impacts=np.int64)
            self.first = np.cumsum(self.n.astype(np.int64)) - self.n

    def parts(self, q: Batch, at: int):
        """A query's disjoint parts, pairs or single terms: their terms' places (-1: not in the
        block), how often the query holds them, and the bound of each part."""
        t, times = q.terms[at], q.times[at]
        place = self.place[t]
        alone = np.where(place >= 0, self.most[place] if len(self.most) else 0, 0) * times
        even = len(t) // 2 * 2
        x, y, nx, ny = alone[0:even:2], alone[1:even:2], times[0:even:2], times[1:even:2]
        joint = self.pair_bound[q.pair_of[at]]
        # what a query holds more often than its partner counts alone
        less = np.minimum(nx, ny)
        pair = joint * less + np.where(nx > 0, x // np.maximum(nx, 1), 0) * (nx - less) + np.where(ny > 0, y // np.maximum(ny, 1), 0) * (ny - less)
        pair = np.where(joint >= 0, np.minimum(pair, x + y), np.maximum(x, y))
        # without a joint maximum one of the two is absent from the block
        return place, times, np.concatenate([pair, alone[even:]])

    def search(self, q: Batch, at: int, least: int, top: int):
        """Documents of the block that reach ``least`` (at least 1), with their scores: all that can be among the first."""
        place, times, bound = self.parts(q, at)
        if bound.sum() < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        free = int(np.searchsorted(below, least, "left"))               # parts that can't reach it together
        score = np.zeros(len(self.ids), np.int64)
        own = np.zeros(len(self.ids), bool)
        rest = int(below[free - 1]) if free else 0
        for part in order[free:].tolist():
            for term in range(2 * part, min(2 * part + 2, len(place))):
                doc, impact = self.list(place[term])
                score[doc] += impact * times[term]
                own[doc] = True
        docs = np.flatnonzero(own)
        for part in order[:free][::-1].tolist():
            docs = docs[score[docs] + rest >= least]
            if not len(docs):
                return docs, docs
            for term in range(2 * part, min(2 * part + 2, len(place))):
                doc, impact = self.list(place[term])
                if len(doc):
                    score[doc] += impact * times[term]
            rest -= int(bound[part])
        docs = docs[score[docs] >= least]
        if len(docs) > top:                                             # the block's own first ones are enough
            docs = docs[np.lexsort((self.ids[docs], self.null[docs], -score[docs]))[:top]]
        return docs, score[docs]

    def list(self, place: int):
        if place < 0:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        lo, n = self.first[place], self.n[place]
        return self.doc[lo:lo + n], self.impact[lo:lo + n]


def searched(lists: DataFrame, q: Batch, least: np.ndarray, top: int, only: DataFrame | None = None) -> DataFrame:
    """(query, doc_id, score) of documents that reach the query's threshold, ``top`` a block at
    most; over all blocks, or for each block over the queries that ``only`` (block, queries) names."""
    chosen = only is not None

    def search(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                block = Block(batch, k, q)
                for at in batch.column("queries")[k].as_py() if chosen else range(len(q.terms)):
                    docs, score = block.search(q, at, max(int(least[at]), 1), top)
                    if len(docs):
                        out.append((np.full(len(docs), at, np.int32), pa.array(block.ids[docs], mask=block.null[docs]), score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _, _ in out])), pa.concat_arrays([x for _, x, _ in out]),
                                                  pa.array(np.concatenate([x for _, _, x in out]))], schema=FOUND_ARROW)

    if chosen:
        lists = lists.join(F.broadcast(only), "block")                  # SEEDS blocks a query of a bounded batch
    return lists.mapInArrow(search, FOUND)


def first_blocks(lists: DataFrame, q: Batch) -> DataFrame:
    """(block, queries): for each query the SEEDS blocks with the largest bounds."""
    def bounds(batches):
        best = np.full((len(q.terms), SEEDS), -1, np.int64)
        which = np.zeros((len(q.terms), SEEDS), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch, k, q, lists=False)
                for at in range(len(q.terms)):
                    bound = int(block.parts(q, at)[2].sum())
                    low = int(best[at].argmin())
                    if bound > best[at, low]:
                        best[at, low], which[at, low] = bound, batch.column("block")[k].as_py()
        query, place = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(which[query, place]), pa.array(best[query, place])],
                                         names=["query", "block", "bound"])

    found = lists.select("block", "terms", "pairs", "joint", "most").mapInArrow(bounds, "query int, block long, bound long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc(), "block")))
    return ranked.where(F.col("place") <= SEEDS).groupBy("block").agg(F.collect_list("query").alias("queries"))


def leading(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def query_batches(items: DataFrame, id_col: str, text_col: str, batch_bytes: int):
    """The queries in batches: [(id, words)], so long as their texts stay within ``batch_bytes``."""
    held, size = [], 0
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        buf, off = text_bytes(pa.array([row["text"]], pa.string()))
        if held and size + len(buf) > batch_bytes:
            yield held
            held, size = [], 0
        held.append((row["id"], plain_words(buf, off)[0]))
        size += len(buf)
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, top: int = TOP,
           batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The ``top`` documents of ``index`` for each item, with scores above 0.

    With N the documents that hold a term, L all their terms, n a document's, df the documents that
    hold a term and tf its occurrences: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + (25 n N) div L,
    and a score sums w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

    Returns item_id, rank (from 1; equal scores by doc_id, a null id last, copies with the same id
    in any order), doc_id, score. Items without terms, or whose terms are in no document, have no rows.
    A repeated item has its rows again; a null item id stays null."""
    spark = index.sparkSession
    n_all, l_all = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    schema = f"item_id {items.schema[id_col].dataType.simpleString()}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for batch in query_batches(items, id_col, text_col, batch_bytes):
        q = Batch.of([words for _, words in batch])
        if not n_all or not len(q.codes):
            continue
        q.weigh(frequencies(index, q.codes), n_all)
        lists = impact_lists(index, q, n_all, l_all)
        seeds = first_blocks(lists, q)
        seen = leading(searched(lists, q, np.zeros(len(batch), np.int64), top, seeds), top)
        least = np.zeros(len(batch), np.int64)
        for r in seen.where(F.col("rank") == top).collect():            # a number a query of the batch
            least[r["query"]] = r["score"]
        found = leading(searched(lists, q, least, top), top)
        names = F.broadcast(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(batch)], f"query int, {schema.split(', ')[0]}"))
        found = written(found, "found")
        out = out.unionByName(found.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
