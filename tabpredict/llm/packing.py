"""Best-fit packing of tokenised documents by bin completion.

The pieces of all documents are summed up by length: at most as many counts as
a sequence has tokens, whatever the corpus. Over these counts the driver looks
for fillings (a multiset of lengths and how often to use it): best-fit
decreasing gives the incumbent; branch and bound completes bins around the
largest length left with undominated fillings and cuts off what wastes too
much. Each piece then finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_codes, text_bytes, word_hashes, written
from .decontaminate import slices

SEQUENCE_TOKENS = 2048
END_ID = 0
SLICE_BYTES = 2 << 20
#: Words whose ids a task keeps at hand; beyond it the store starts anew.
CACHED_WORDS = 500_000
#: Default for the steps of the search (some 1 us each); earlier fillings that a new one is compared with.
SEARCH_STEPS, REMEMBERED = 10_000_000, 64
#: Levels of the search whose choices are held, up to 1 MB each; those of an earlier one are looked for anew when it comes back to it.
HELD_LEVELS = 8

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                          ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


#: Bytes by kind: white space 0, letters 1, punctuation other than the apostrophe 2, the rest 3.
KINDS = np.full(256, 3, np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KINDS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] = 2


class WordIds:
    """Token ids of whole texts; each distinct word is encoded once.

    The tokenizer normalises and splits by word: nothing reaches over white space,
    or over a border between an ASCII letter and punctuation (the apostrophe of a
    contraction apart). A text's ids are those of its words in turn, whatever the
    case of A-Z. Words are told apart by 64-bit hashes. Texts that hold one of the
    tokenizer's special strings are encoded as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the model sees each byte as a printable character: itself, or one from 256 on
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        self.shown = dict(zip([b for b in range(256) if b not in plain], map(chr, range(256, 512))))
        self.codes = lower_codes()
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids, self.ends = np.array([END_ID], np.uint32), np.ones(1, np.int64)    # entry 0 ends a text

    def word(self, word: str) -> list[int]:
        simple = word.isalpha() and word == word.lower()
        if simple and word.isascii():
            return [t.id for t in self.tokenizer.model.tokenize(word)]
        if simple and max(word) < "\u0250" and unicodedata.is_normalized("NFC", word):
            return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text with the end id behind it, and its offsets."""
        if len(self.at) > CACHED_WORDS:
            self.clear()
        buf, off = text_bytes(texts)
        kind = KINDS[buf]
        border = np.ones(len(buf) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=border[1:-1])
        border[1:-1] &= (kind[1:] == 0) | (kind[:-1] == 0) | ((kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0))
        border[off] = True
        cuts = np.flatnonzero(border)
        inside = kind[cuts[:-1]] > 0 if len(buf) else np.zeros(0, bool)
        starts, ends = cuts[:-1][inside], cuts[1:][inside]
        own, first, back = np.unique(word_hashes(buf, starts, ends, self.codes), return_index=True, return_inverse=True)
        at = np.array([self.at.get(k, -1) for k in own.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = buf.tobytes().lower()
            got = [self.word(raw[s:e].decode()) for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            at[new] = len(self.ends) + np.arange(len(new))
            self.at.update(zip(own[new].tolist(), at[new].tolist()))
            size = np.array([len(g) for g in got], np.int64)
            self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        words = np.searchsorted(starts, off)
        index = np.insert(at[back], words[1:], 0)
        size = np.diff(self.ends, prepend=0)[index]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.ends[index] - upto[1:], size) + np.arange(upto[-1])]
        bounds = upto[words + np.arange(len(words))]
        odd = np.zeros(len(texts), bool)
        for text in self.special:
            odd |= pc.match_substring(texts, text).fill_null(False).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids + [END_ID], np.uint32)
                     if odd[i] else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """A row for each piece: its place in its document, its checksum, and its number
    among the pieces of its length in its part of the table."""
    def cut(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part = WordIds(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(text_bytes(texts)[1], SLICE_BYTES):
                ids, off = words.encode(texts.slice(lo, hi - lo))
                n = np.diff(off)
                count = -(-n // size)
                doc = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, n[doc] - start)
                at = off[doc] + start
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - first + seen[length[order]]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([
                    ids_of.slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                    pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()),
                    pa.array(nth)], schema=PIECES_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(cut, PIECES), "pieces")


# ------------------------------------------------------------- fillings

Plan = list[tuple[dict[int, int], int]]        # (length: how often in a bin, bins)


def best_fit_decreasing(counts: dict[int, int], size: int) -> Plan:
    """Largest first, each into the fullest bin that takes it; equal bins go together."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}       # room left: bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((r for r in room if r >= length), default=None)
            if gap is None:
                per = min(size // length, left)
                bins = left // per
                room.setdefault(size - per * length, []).append(({length: per}, bins))
                left -= per * bins
                continue
            fill, bins = room[gap].pop()
            if not room[gap]:
                del room[gap]
            per = min(gap // length, left)
            use = min(bins, left // per)
            if use < bins:
                room.setdefault(gap, []).append((fill, bins - use))
            room.setdefault(gap - per * length, []).append(({**fill, length: per}, use))
            left -= per * use
    return [x for bins in room.values() for x in bins]


def least_sequences(counts: dict[int, int], size: int) -> int:
    """A lower bound: the pieces' sum, and for each length k the pieces that cannot share
    with one of k or more, with what is left beside the others over one half taken by the rest."""
    k = np.array(sorted(counts), np.int64)
    c = np.array([counts[x] for x in k.tolist()], np.int64)
    total = int((k * c).sum())
    best = -(-total // size)
    for low in [0, *k[2 * k <= size].tolist()]:
        alone, large, small = k > size - low, (2 * k > size) & (k <= size - low), (2 * k <= size) & (k >= low)
        rest = int((k * c)[small].sum() - (size * c[large].sum() - (k * c)[large].sum()))
        best = max(best, int(c[alone].sum() + c[large].sum()) + max(0, -(-rest // size)))
    return best


def reach(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each i, a bit set of the sums up to ``room`` that pieces of the first i lengths make."""
    mask, sums = (1 << room + 1) - 1, [1]
    for k in lengths:
        bits, n, step = sums[-1], min(counts[k], room // k), 1
        while n:
            use = min(step, n)
            bits |= bits << use * k & mask
            n -= use
            step *= 2
        sums.append(bits)
    return sums


def covers(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether the pieces of ``b`` fit, parted, into the pieces of ``a``: then ``a`` is as good a
    filling as ``b``, since they can change places. Pieces in both stand for themselves. More
    than twelve others are not looked at (False), which leaves a filling in."""
    left = [k for k, c in a.items() for _ in range(c - b.get(k, 0))]
    own = sorted((k for k, c in b.items() for _ in range(c - a.get(k, 0))), reverse=True)
    if len(own) > 12 or sum(left) < sum(own):
        return False

    def place(i: int) -> bool:
        if i == len(own):
            return True
        for j in {r: j for j, r in enumerate(left) if r >= own[i]}.values():
            left[j] -= own[i]
            if place(i + 1):
                return True
            left[j] += own[i]
        return False

    return place(0)


def fillings(lengths: list[int], counts: dict[int, int], room: int, spare: int, budget: list[int]) -> Iterator[tuple[int, dict[int, int]]]:
    """Every undominated (waste, filling) of the room beside the largest length that wastes at
    most ``spare``: least waste first, larger pieces first. ``budget[0]`` steps, then no more.

    A filling that wastes w holds all pieces of at most w, else one more would fit. Sums that the
    pieces cannot make are never entered. Of equal sums a filling comes before those that part
    its pieces, so only earlier ones can dominate."""
    seen: list[dict[int, int]] = []
    lengths = [k for k in lengths if k <= room and counts[k]]
    held, sums = -1, []

    def exact(i: int, left: int) -> Iterator[dict[int, int]]:
        if not left:
            yield {}
            return
        j = bisect_right(lengths, left, held, held + i) - 1
        while j >= held and sums[j + 1 - held] >> left & 1:
            k = lengths[j]
            for c in range(min(counts[k], left // k), 0, -1):
                if sums[j - held] >> left - c * k & 1:
                    budget[0] -= 1
                    if budget[0] <= 0:
                        return
                    for rest in exact(j - held, left - c * k):
                        yield {k: c, **rest}
            j -= 1

    for waste in range(min(room, spare) + 1):
        small = bisect_right(lengths, waste)
        if small != held:
            held = small
            whole = {k: counts[k] for k in lengths[:held]}
            used = sum(k * c for k, c in whole.items())
            if used > room:
                return
            sums = reach(lengths[held:], counts, room - used)
            budget[0] -= len(sums)
        target = room - waste - used
        if target < 0 or budget[0] <= 0:
            return
        if not sums[-1] >> target & 1:
            continue
        for more in exact(len(lengths) - held, target):
            fill = {**whole, **more}
            if not any(covers(a, fill) for a in seen):
                if len(seen) < REMEMBERED:
                    seen.append(fill)
                yield waste, fill


def bin_completion(counts: dict[int, int], size: int, steps: int = SEARCH_STEPS) -> tuple[Plan, int, bool]:
    """Fewest bins, a lower bound on them, and whether no fewer can do.

    Incumbent by best fit; then depth first: the largest length left is completed by every
    undominated filling, used as often as the counts allow, then less often. A branch ends
    when its waste cannot beat the incumbent. The search is complete unless its ``steps``
    run out first; then the best found so far is returned, and the last value is False."""
    total = sum(k * c for k, c in counts.items())
    best, bound = best_fit_decreasing(counts, size), least_sequences(counts, size)
    fewest = sum(m for _, m in best)
    if fewest <= bound:
        return best, bound, True
    left, budget = {k: c for k, c in counts.items() if c}, [steps]
    plan: Plan = []
    waste = 0

    def choices(spare: int) -> Iterator[tuple[dict[int, int], int]]:
        own, lengths = dict(left), sorted(left)
        top = lengths[-1]
        own[top] -= 1
        for w, fill in fillings(lengths, own, size - top, spare, budget):
            fill = {top: fill.get(top, 0) + 1, **{k: c for k, c in fill.items() if k != top}}
            most = min(left[k] // c for k, c in fill.items())
            for m in range(min(most, spare // w) if w else most, 0, -1):
                yield fill, m

    def level() -> list:
        """Choices, the waste they may have, and how many were taken."""
        spare = (fewest - 1) * size - total - waste
        return [choices(spare), spare, 0]

    def again(spare: int, taken: int) -> Iterator[tuple[dict[int, int], int]]:
        """A level's choices behind those taken; their steps were counted the first time."""
        counted, budget[0] = budget[0], steps + 1
        found = choices(spare)
        for _ in range(taken):
            next(found)
        budget[0] = counted
        return found

    levels = [level()]
    while levels and fewest > bound and budget[0] > 0:
        if len(plan) == len(levels):                # take this level's last bins back
            fill, m = plan.pop()
            waste -= m * (size - sum(k * c for k, c in fill.items()))
            for k, c in fill.items():
                left[k] = left.get(k, 0) + c * m
        here = levels[-1]
        if here[0] is None:
            here[0] = again(*here[1:])
        step = next(here[0], None)
        here[2] += 1
        budget[0] -= 1
        if step is None:
            levels.pop()
            continue
        fill, m = step
        lost = m * (size - sum(k * c for k, c in fill.items()))
        if waste + lost > (fewest - 1) * size - total:      # the incumbent got better meanwhile
            continue
        plan.append(step)
        waste += lost
        for k, c in fill.items():
            left[k] -= c * m
            if not left[k]:
                del left[k]
        if left:
            levels.append(level())
            if len(levels) > HELD_LEVELS:
                levels[-1 - HELD_LEVELS][0] = None
        else:
            best, fewest = list(plan), sum(m for _, m in plan)
    return best, bound, fewest <= bound or budget[0] > 0


def places(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first sequence, offset), by length and rank."""
    rows, used, sequence = [], {}, 0
    for fill, bins in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            lo = used.get(length, 0)
            rows.append((length, lo, fill[length], sequence, offset))
            used[length] = lo + fill[length] * bins
            offset += length * fill[length]
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *,
         size: int = SEQUENCE_TOKENS, search_steps: int = SEARCH_STEPS) -> DataFrame:
    """Pack all documents into few sequences of at most ``size`` tokens.

    A document's ids are its tokens and the end id 0; longer ones are cut into pieces of
    ``size``, the last may be shorter. Returns one row per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. A null or empty text is the end id alone.
    Repeated rows, and rows of one doc_id, are documents of their own; a null id stays
    null. An empty table gives no rows. Other columns are not read.

    The fewest sequences are found unless the search runs out of ``search_steps``, a bound
    on the driver's time alone: no piece is ever lost, and ``bin_completion`` says whether
    fewer could do."""
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, size)
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(bin_completion(counts, size, search_steps)[0])
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = table[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own[:, 3] + nth // own[:, 2]),
                                              pa.array(own[:, 4] + nth % own[:, 2] * length)],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
