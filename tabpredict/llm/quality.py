"""Quality classifier by co-training.

Two views of a document, its words and its metadata, each have a logistic
regression of their own. Round by round each view labels every unlabelled document
that it is sure about for the other's training set. A third regression, on words and
with both classes at equal weight, tells toxic texts. All are calibrated on labelled
rows kept apart, and a last small regression combines the scores; there the rejected, of
whom toxic texts are a part, weigh as much as the good, unless that would cost more than
3 in 100 of the good rows kept apart. Fits are distributed over all labelled documents and all pseudo-labels; every document is scored.

Both views of all documents are joined to the labels, without the texts, and written once, in blocks. A fit writes the rows that it takes
once more; then each look at the loss is one job, whose gradients are
added up in the cluster by ranges of columns so that one vector a regression reaches the driver.
The steps are quasi-Newton ones, over columns scaled by the root of their greatest curvature.
They end when the loss stands still; a fit of the next round starts from the last one's weights.
What a job broadcasts is destroyed. The fits' blocks, parquet pages and batches are small,
however many rows a task has, so that executors need little memory. The driver holds a few
vectors a regression; the steps' memory is in a file that it maps.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, SPACED, U64, byte_codes, drop_written, lower_codes, mix, settings, short_lived_shuffles, text_bytes, word_bounds, word_hashes, written
from .decontaminate import slices

ROUNDS = 2
#: View, label, penalties to choose from (by log-loss on the rows kept apart, in the first round) and most looks at the loss of each regression.
FIT = {"words": ("words", "good", (1e-4,), 100), "meta": ("meta", "good", (1e-3,), 100), "toxic": ("words", "toxic", (2e-3,), 100)}
#: A view passes on a label that it gives this calibrated probability or more.
SURE = 0.97
#: Labelled rows kept apart for the calibration: a fifth, of many labels about so many.
HELD_ROWS = 50_000
#: Share of the good rows kept apart that the combined score accepts, at least.
KEEP_GOOD = 0.97
#: A fit ends when so many steps together lower the loss by less than this share of it.
FEW, STILL = 5, 1e-2
#: Columns of a gradient that are added up together; tasks that do so, each sending the driver well below a MB;
#: steps that the quasi-Newton memory holds.
CHUNK = 1 << 14
SUM_TASKS = 16
MEMORY = 10
#: Documents of one task.
PART_ROWS = 20_000
WORD_BITS = 18
N_STYLE = 8
#: The few style columns are scaled up, so that the penalty weighs less on them than on the many words.
STYLE_WEIGHT = 4.0
META_BITS = 12
WIDTH = {"words": (1 << WORD_BITS) + N_STYLE, "meta": 1 << META_BITS}
DRAWS = 1_000_003
#: Bytes of text looked at together, and of a block. Arrays of half a MB and more are allocated apart
#: by the JVM, whose heap they break up and make grow, so blocks stay well below.
SLICE_BYTES, BLOCK_BYTES = 1 << 19, 1 << 18
#: Bytes sent to Python together; blocks read together; options of tables of blocks: a page ends by its size, however few its rows.
BATCH_BYTES, READ_BLOCKS = 2 << 20, 8
PAGES = {"parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False}


def text_view(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ones (columns, offsets) for the words that occur, and the last columns' values: shares that tell of the style."""
    n = len(off) - 1
    table = ALNUM.copy()
    table[0x41:0x5B] = True
    starts, ends, woff = word_bounds(buf, off, table)
    hashes = word_hashes(buf, starts, ends, lower_codes())
    doc = np.repeat(np.arange(n), np.diff(woff))
    keys = np.sort((doc.astype(U64) << U64(WORD_BITS)) | (hashes >> U64(64 - WORD_BITS)))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    col, row = (keys & U64((1 << WORD_BITS) - 1)).astype(np.int64), (keys >> U64(WORD_BITS)).astype(np.int64)

    def per_text(flags):
        return np.diff(np.searchsorted(np.flatnonzero(flags), off)).astype(float)

    size, words = np.maximum(np.diff(off), 1), np.maximum(np.diff(woff), 1)
    upper = per_text((buf >= 0x41) & (buf <= 0x5A))
    letters = np.maximum(upper + per_text((buf >= 0x61) & (buf <= 0x7A)), 1)
    marks = per_text(~table[buf] & SPACED[buf])
    digits = per_text((buf >= 0x30) & (buf <= 0x39))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.bincount(row, minlength=n)
    twin = np.zeros(len(buf), bool)
    twin[1:] = (buf[1:] == buf[:-1]) & ~table[buf[1:]] & SPACED[buf[1:]]
    style = np.stack([upper / letters, np.minimum(10 * marks / size, 3), np.minimum(10 * digits / size, 3),
                      np.bincount(doc, again, n) / words, distinct / words, np.minimum(20 * per_text(twin) / size, 3),
                      np.log1p(np.diff(woff)) / 10, np.minimum(np.diff(off) / words / 10, 3)], 1)
    return col, np.searchsorted(row, np.arange(n + 1)), STYLE_WEIGHT * style


def meta_view(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, None]:
    """Rows of ones (columns, offsets) for hashed metadata: each column's value as a token; numbers by their power of two."""
    n, cols = len(columns[0]), []
    for k, column in enumerate(columns):
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            number = column.cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                token = np.where(np.isfinite(number), np.floor(np.log2(np.abs(number) + 1)), -1).astype(np.int64).astype(U64)
        else:
            text = column.cast(pa.large_string())
            buf, off = text_bytes(text)
            token = word_hashes(buf, off[:-1], off[1:], byte_codes()) if n else np.zeros(0, U64)
            token = np.where(text.is_null().to_numpy(zero_copy_only=False), U64(1), token)
        cols.append((mix(token + U64((k + 1) * 0x1000003)) >> U64(64 - META_BITS)).astype(np.int64))
    # equal columns of one row add up, so each row's are made distinct
    flat = np.sort(np.stack(cols, 1), axis=1)
    first = np.concatenate([np.ones((n, 1), bool), flat[:, 1:] != flat[:, :-1]], 1)
    return flat[first], np.concatenate([[0], np.cumsum(first.sum(1))]), None


def small_batches(spark: SparkSession, read: int | None = None):
    """An action inside sends Python BATCH_BYTES at a time, and reads so many rows of a parquet table together."""
    values = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    return settings(spark, values if read is None else {**values, "spark.sql.parquet.columnarReaderBatchSize": read})


BLOCKS = "n long, draw binary, good binary, toxic binary, words_cols binary, words_off binary, style binary, meta_cols binary, meta_off binary"


def packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Cells of bytes: values[at[k]:at[k + 1]] in cell k."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(cells: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of such cells and where each begins."""
    cells = cells.cast(pa.large_binary())
    _, offsets, data = cells.buffers()
    off = np.frombuffer(offsets, np.int64, len(cells) + 1, cells.offset * 8) if len(cells) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(kind) if off[-1] > off[0] else np.zeros(0, kind)
    return values, (off - off[0]) // np.dtype(kind).itemsize


def viewed(rows: DataFrame, meta_cols: list[str], known: DataFrame | None = None) -> DataFrame:
    """Both views of the rows (id, text and metadata) with their labels in blocks, written as a table.
    Labels (id, good, toxic) come from ``known``, joined to the views so that no text moves; without it the rows hold them.
    ``draw`` is a number below DRAWS that a row's id fixes."""
    own = ["id"] if known is not None else ["id", "good", "toxic"]

    def see(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(len(own)))
            for lo, hi in slices(off, SLICE_BYTES):
                cols, at, style = text_view(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                m_cols, m_at, _ = meta_view([c.slice(lo, hi - lo) for c in batch.columns[len(own) + 1:]])
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[:len(own)]] + [packed(cols.astype(np.int32), at), packed(style.ravel(), np.arange(hi - lo + 1) * N_STYLE),
                                                  packed(m_cols.astype(np.int32), m_at)], names=[*own, "words", "style", "meta"])

    def gather(batches):
        for batch in batches:
            told = [c.fill_null(-1).to_numpy().astype(t) for c, t in zip(batch.columns[:3], (np.int32, np.int8, np.int8))]
            (cols, at), (style, _), (m_cols, m_at) = (unpacked(batch.column(k), t) for k, t in ((3, np.int32), (4, np.float64), (5, np.int32)))
            for lo, hi in slices(4 * (at + m_at) + (8 * N_STYLE + 22) * np.arange(len(at)), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([hi - lo])] + [pa.array([x.tobytes()], pa.binary()) for x in (
                    *(t[lo:hi] for t in told), cols[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], style[lo * N_STYLE:hi * N_STYLE],
                    m_cols[m_at[lo]:m_at[hi]], m_at[lo:hi + 1] - m_at[lo])], names=[c.split()[0] for c in BLOCKS.split(", ")])

    kinds = ", ".join(f"{c} {t}" for c, t in zip(own, ("long", "int", "int")))
    seen = (rows.select(*[F.col(c).cast("long" if c == "id" else "int") for c in own], F.col("text").cast("string"), *[F.col(f"meta_{k}") for k in range(len(meta_cols))])
            .mapInArrow(see, f"{kinds}, words binary, style binary, meta binary"))
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(DRAWS)).cast("int")
    seen = seen if known is None else seen.join(known, "id", "left")
    with small_batches(rows.sparkSession):
        return written(seen.select(draw.alias("draw"), "good", "toxic", "words", "style", "meta").mapInArrow(gather, BLOCKS), "views", **PAGES)


class Part:
    """One block's rows."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        def cell(name, kind):
            return np.frombuffer(batch.column(name)[k].as_buffer(), kind)

        n = batch.column("n")[k].as_py()
        self.draw, self.good, self.toxic = cell("draw", np.int32), cell("good", np.int8), cell("toxic", np.int8)
        self.views = {"words": (cell("words_cols", np.int32), cell("words_off", np.int64), cell("style", np.float64).reshape(n, N_STYLE)),
                      "meta": (cell("meta_cols", np.int32), cell("meta_off", np.int64), None)}


@dataclass(frozen=True)
class Teacher:
    """What a view passes on: the label of the rows without one that its calibrated line is sure of."""

    view: str
    line: tuple[float, float]

    def labels(self, part: Part, weights: np.ndarray) -> np.ndarray:
        return np.where(part.good < 0, sure(margins(part.views[self.view], weights), self.line), -1)


def sure(margin: np.ndarray, line) -> np.ndarray:
    """1 or 0 where the calibrated probability is SURE or more for it, else -1."""
    p = 1 / (1 + np.exp(-np.clip(line[0] * margin + line[1], -30, 30)))
    return np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1))


@dataclass(frozen=True)
class Task:
    """What one regression is fitted on: a view; the label (``good`` or ``toxic``), the weight of its
    positives, the rows kept apart (draws below ``apart``), and a teacher's labels."""

    view: str
    label: str
    apart: int
    positive: float = 1.0
    teacher: Teacher | None = None

    def rows(self, part: Part, taught: np.ndarray | None):
        """The view, labels and weights of a block's rows that the fit takes."""
        y = np.where((part.good >= 0) & (part.draw >= self.apart), part.good if self.label == "good" else part.toxic, -1)
        if self.teacher is not None:
            y = np.maximum(y, self.teacher.labels(part, taught))
        at = np.flatnonzero(y >= 0)
        return only(part.views[self.view], at), y[at] == 1, np.where(y[at] == 1, self.positive, 1.0)


def margins(view, weights: np.ndarray) -> np.ndarray:
    cols, off, dense = view
    run = np.concatenate([[0.0], np.cumsum(weights[cols])])
    out = run[off[1:]] - run[off[:-1]] + weights[-1]
    return out if dense is None else out + dense @ weights[-1 - dense.shape[1]:-1]


def only(view, at: np.ndarray):
    """Some rows of a view."""
    cols, off, dense = view
    n = np.diff(off)[at]
    first = np.cumsum(n) - n
    return cols[np.arange(int(n.sum())) + np.repeat(off[at] - first, n)], np.concatenate([[0], np.cumsum(n)]), None if dense is None else dense[at]


def add_sums(out: np.ndarray, view, factor: np.ndarray, square: bool = False) -> None:
    """Add the rows, times their factors, to ``out`` (one place a column, the intercept last)."""
    cols, off, dense = view
    out += np.bincount(cols, np.repeat(factor, np.diff(off)), len(out))
    if dense is not None:
        out[-1 - dense.shape[1]:-1] += factor @ (dense ** 2 if square else dense)
    out[-1] += factor.sum()


def add_rows(out: list[np.ndarray], rows, w: np.ndarray) -> None:
    """Add the rows' gradient, and their loss and weight, to ``out``."""
    view, y, c = rows
    z = margins(view, w)
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    out[-1] += (c * (np.logaddexp(0, z) - y * z)).sum(), c.sum()
    add_sums(out[0], view, c * (p - y))


TAKEN = "task int, cols binary, size binary, style binary, y binary, c binary"


def taken(blocks: DataFrame, tasks: list[Task], shared) -> DataFrame:
    """The rows that each task takes, in blocks of BLOCK_BYTES at most; ``shared``: what teachers each task has."""
    def join(k, held):
        cells = [np.concatenate(x) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)], names=[c.split()[0] for c in TAKEN.split(", ")])

    def take(batches):
        held, size = [[] for _ in tasks], [0] * len(tasks)
        for batch in batches:
            for b in range(batch.num_rows):
                part = Part(batch, b)
                for k, (task, other) in enumerate(zip(tasks, shared.value)):
                    (cols, off, style), y, c = task.rows(part, other)
                    if not len(y):
                        continue
                    cells = cols.astype(np.int32), np.diff(off).astype(np.int32), np.zeros(0) if style is None else style.ravel(), y, c
                    more = sum(x.nbytes for x in cells)
                    if held[k] and size[k] + more > BLOCK_BYTES:
                        yield join(k, held[k])
                        held[k], size[k] = [], 0
                    held[k].append(cells)
                    size[k] += more
        for k, rows in enumerate(held):
            if rows:
                yield join(k, rows)

    return blocks.mapInArrow(take, TAKEN)


def taken_rows(batches):
    """Task and rows of what ``taken`` made, a task's blocks of one batch together."""
    for batch in batches:
        task = batch.column(0).to_numpy()
        for k in np.unique(task):
            own = batch.filter(pa.array(task == k))
            cols, size, style, y, c = (unpacked(own.column(j), t)[0] for j, t in enumerate((np.int32, np.int32, np.float64, np.bool_, np.float64), 1))
            off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            yield int(k), ((cols.astype(np.int64), off, style.reshape(len(y), -1) if len(style) else None), y, c)


def summed(rows: DataFrame, lengths: list[int], run) -> list[np.ndarray]:
    """The vectors that ``run`` makes of each task's blocks, added up in the cluster by ranges of columns."""
    def send(batches):
        flat = np.concatenate(run(taken_rows(batches)))
        for chunk in range(0, len(flat), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([chunk // CHUNK], pa.int32()), pa.array([flat[chunk:chunk + CHUNK].tobytes()], pa.binary())], names=["chunk", "sums"])

    def add(batches):
        held = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[chunk] = held.get(chunk, 0.0) + np.frombuffer(data.as_buffer())
        for chunk, data in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "sums"])

    out = [np.zeros(n) for n in lengths]
    # a job's shuffle files go with it; its two stages are fixed: adaptive execution would only make each a job with driver threads of its own
    with short_lived_shuffles(rows.sparkSession), small_batches(rows.sparkSession, READ_BLOCKS), settings(rows.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
        found = rows.mapInArrow(send, "chunk int, sums binary").repartition(min(-(-sum(lengths) // CHUNK), SUM_TASKS), "chunk").mapInArrow(add, "chunk int, sums binary").toArrow()
    ends = np.cumsum(lengths)
    for chunk, data in zip(found.column("chunk").to_pylist(), found.column("sums")):
        part, lo = np.frombuffer(data.as_buffer()), chunk * CHUNK
        for own, end in zip(out, ends):
            a, b = max(lo, end - len(own)), min(lo + len(part), end)
            if a < b:
                own[a - end + len(own):b - end + len(own)] = part[a - lo:b - lo]
    return out


def evaluated(rows: DataFrame, weights: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Loss, weight of all rows and gradient of some tasks at some weights, by one job over what ``taken`` made."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(blocks):
        own = shared.value
        sums = {k: [np.zeros(len(w)), np.zeros(2)] for k, w in own.items()}
        for k, told in blocks:
            add_rows(sums[k], told, own[k])
        return [x for out in sums.values() for x in out]

    try:
        found = summed(rows.where(F.col("task").isin(list(weights))), [len(w) + 2 for w in weights.values()], run)
    finally:
        shared.destroy()
    return {k: (x[-2], x[-1], x[:-2]) for k, x in zip(weights, found)}


def steepest(rows: DataFrame, lengths: list[int]) -> list[np.ndarray]:
    """For each task the greatest second derivatives that its loss, added up, can have."""
    def run(blocks):
        sums = [np.zeros(n) for n in lengths]
        for k, (view, _, c) in blocks:
            add_sums(sums[k], view, c / 4, True)
        return sums

    return summed(rows, lengths, run)


def gradients(blocks: DataFrame, tasks: list[Task], weights: list[np.ndarray], taught: list) -> list[tuple]:
    """For each task loss, weight of all rows and gradient over all its rows, by one job."""
    shared = blocks.sparkSession.sparkContext.broadcast(taught)
    try:
        return list(evaluated(taken(blocks, tasks, shared), dict(enumerate(weights))).values())
    finally:
        shared.destroy()


def descent(penalty: float, looks: int, w: np.ndarray, steep: np.ndarray):
    """Minimise mean log-loss + penalty / 2 * |w|^2 (no penalty on the intercept, which is last) from ``w``:
    yields weights to look at, at most ``looks``, is sent loss, weight and gradient of all rows there, and
    returns the best weights. L-BFGS over columns scaled by the root of their greatest curvature; a step that
    does not lower the loss is shortened to where a parabola has its least, within a tenth and a half.
    The steps that it remembers are in a file in the driver's temp folder, mapped: 20 vectors that the system can put out of memory."""

    def at(found, w):
        total, rows, grad = found
        rows = max(rows, 1e-12)
        grad = grad / rows
        grad[:-1] += penalty * w[:-1]
        return total / rows + 0.5 * penalty * float(w[:-1] @ w[:-1]), grad, rows

    loss, grad, rows = at((yield w), w)
    scale = steep / rows
    scale[:-1] += penalty
    scale = 1 / np.sqrt(np.maximum(scale, 1e-12))
    with tempfile.TemporaryFile() as file:
        held = np.asarray(np.memmap(file, float, "w+", shape=(MEMORY, 2, len(w))))
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    known = 0
    past, left = [loss], looks - 1
    while left > 0:
        step, kept = grad.copy(), []
        for move, turn in reversed(moves):
            kept.append(float(move @ step) / float(move @ turn))
            step -= kept[-1] * turn
        step *= scale * (float(moves[-1][0] @ moves[-1][1]) / float(moves[-1][1] @ (scale * moves[-1][1])) if moves else 1.0)
        for (move, turn), a in zip(moves, reversed(kept)):
            step += (a - float(turn @ step) / float(move @ turn)) * move
        # the first step moves the margins by one on average, at most
        size, slope = 1.0 if moves else 1 / max(1.0, float(4 * (steep / rows) @ np.abs(step))), float(grad @ step)
        while True:
            new, left = w - size * step, left - 1
            found, turned, _ = at((yield new), new)
            if found <= loss - 1e-4 * size * slope or size < 1e-4 or left <= 0:
                break
            size = min(0.5 * size, max(0.1 * size, 0.5 * slope * size * size / (found - loss + slope * size)))
        if not found < loss:
            break
        move, turn = new - w, turned - grad
        if float(move @ turn) > 1e-12 * float(turn @ turn):
            own, known = held[known % MEMORY], known + 1       # the place of the oldest
            own[0], own[1] = move, turn
            moves = [*moves, (own[0], own[1])][-MEMORY:]
        del move, turn
        w, grad, loss = new, turned, found
        past.append(loss)
        if len(past) > FEW and past[-1 - FEW] - loss < STILL * past[-1 - FEW]:
            break
    return w


def fitted(blocks: DataFrame, tasks: list[Task], fits: list[tuple[float, int]], starts: list, taught: list) -> list[np.ndarray]:
    """Weights of several logistic regressions over all rows of their tasks, side by side, so that one job
    serves all that still go on; ``fits``: penalty and most looks at the loss of each."""
    shared = blocks.sparkSession.sparkContext.broadcast(taught)
    try:
        with small_batches(blocks.sparkSession, READ_BLOCKS):
            rows = written(taken(blocks, tasks, shared), "taken", **PAGES)
    finally:
        shared.destroy()
    w = [np.zeros(WIDTH[t.view] + 1) if s is None else s for t, s in zip(tasks, starts)]
    steep = steepest(rows, [len(x) for x in w])
    going = {k: descent(*fit, w[k], steep[k]) for k, fit in enumerate(fits)}
    asked = {k: next(way) for k, way in going.items()}
    while asked:
        found, ahead = evaluated(rows, asked), {}
        for k, told in found.items():
            try:
                ahead[k] = going[k].send(told)
            except StopIteration as end:
                w[k] = end.value
        asked = ahead
    drop_written(rows)
    return w


def held_out(blocks: DataFrame, apart: int, models: dict, views: dict):
    """Labels and margins of the rows kept apart."""
    shared = blocks.sparkSession.sparkContext.broadcast(dict(models))

    def told(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part = Part(batch, k)
                at = np.flatnonzero((part.good >= 0) & (part.draw < apart))
                z = [margins(only(part.views[views[v]], at), w) for v, w in shared.value.items()]
                yield pa.RecordBatch.from_arrays([pa.array(part.good[at].astype(float)), pa.array(part.toxic[at].astype(float)), *map(pa.array, z)],
                                                 names=["good", "toxic", *[f"m_{v}" for v in shared.value]])

    try:
        with small_batches(blocks.sparkSession, READ_BLOCKS):
            return blocks.mapInArrow(told, "good double, toxic double, " + ", ".join(f"m_{v} double" for v in models)).toPandas()
    finally:
        shared.destroy()


def label_counts(blocks: DataFrame) -> np.ndarray:
    """Rows by draw (tenths of a thousandth), good and toxic (0, 1 or unknown, 2)."""
    def count(batches):
        out = np.zeros((10_000, 3, 3), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                part = Part(batch, k)
                np.add.at(out, (part.draw.astype(np.int64) * 10_000 // DRAWS, part.good % 3, part.toxic % 3), 1)
        d, g, t = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (d, g, t)] + [pa.array(out[d, g, t])], names=["d", "g", "t", "n"])

    out = np.zeros((10_000, 3, 3), np.int64)
    with small_batches(blocks.sparkSession, READ_BLOCKS):
        counts = blocks.select("n", *[c.split()[0] for c in BLOCKS.split(", ")[1:]]).mapInArrow(count, "d int, g int, t int, n long").groupBy("d", "g", "t").agg(F.sum("n").alias("n")).collect()
    for r in counts:
        out[r["d"], r["g"], r["t"]] = r["n"]
    return out


def small_logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-2, even: bool = False) -> np.ndarray:
    """A few-column logistic regression by Newton steps (calibration, combination); ``even``: both classes weigh the same."""
    share = y.mean()
    c = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) if even else np.ones(len(y))
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (c * (p - y)) + ridge * w)
    return w


class QualityModel:
    """Weights of the views and of the toxic words, their calibration lines and their combination."""

    def __init__(self, weights, lines, mixed):
        self.weights, self.lines, self.mixed = weights, lines, mixed

    def scores(self, buf: np.ndarray, off: np.ndarray, meta: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and the combined one."""
        views = {"words": text_view(buf, off), "meta": meta_view(meta)}
        z = {v: self.lines[v][0] * margins(views[FIT[v][0]], w) + self.lines[v][1] for v, w in self.weights.items()}
        both = combined(z, self.mixed)
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (z["words"], z["meta"], both))


def combined(z: dict[str, np.ndarray], mixed: np.ndarray) -> np.ndarray:
    """Log-odds from all regressions' calibrated log-odds."""
    return sum(m * x for m, x in zip(mixed, z.values())) + mixed[-1]


def train_quality(docs: DataFrame, labels: DataFrame, meta_cols: list[str], good, id_col: str = "doc_id",
                  text_col: str = "text", *, toxic=None, rounds: int = ROUNDS) -> QualityModel | None:
    """Co-train on all documents; None if the labels don't hold both classes. ``toxic`` is a label
    (1 or 0) of its own, by default the column of that name if the labels have one."""
    if toxic is None:
        toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None)
    known = (labels.select(F.col(id_col).cast("long").alias("id"), good.cast("int").alias("good"), toxic.cast("int").alias("toxic"))
             .where("good is not null and id is not null").groupBy("id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic")))
    if len(known.select("good").distinct().take(2)) < 2 or docs.isEmpty():
        return None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"meta_{k}") for k, c in enumerate(meta_cols)])
    blocks = viewed(rows, meta_cols, known)
    n = label_counts(blocks)
    blocks = blocks.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(n.sum()) // PART_ROWS)))
    n_known = int(n[:, :2].sum())
    if not n[:, 0].sum() or not n[:, 1].sum():
        return None
    # rows kept apart: so many of the draws' ten thousandths; all rows in both if a class is missing on one side
    cut = int(10_000 * min(0.2, HELD_ROWS / n_known))
    apart = -(-cut * DRAWS // 10_000)
    two = all(n[side, c].sum() for side in (slice(cut), slice(cut, None)) for c in (0, 1))
    fit_apart, held_apart = (apart, apart) if two else (0, DRAWS)
    told_toxic = n[cut if two else 0:, :2].sum(axis=(0, 1))
    held_toxic = n[:cut if two else None, :2].sum(axis=(0, 1))

    toxic_too = min(told_toxic[:2]) and min(held_toxic[:2])
    views = {name: fit[0] for name, fit in FIT.items() if name != "toxic" or toxic_too}
    models, lines, chosen = {}, {}, {name: FIT[name][2] for name in views}

    def line(told, name, column):
        """The calibration of a regression, and its loss, on the rows kept apart."""
        y, z = told[FIT[name][1]].to_numpy(float), told[column].to_numpy()
        y, z = y[y >= 0], z[y >= 0]
        own = small_logistic(z[:, None], y)
        return own, float(np.mean(np.logaddexp(0, own[0] * z + own[1]) - y * (own[0] * z + own[1])))

    for turn in range(rounds + 1):
        runs = []
        for name in views:
            if turn and name == "toxic":
                continue
            other = {"words": "meta", "meta": "words"}.get(name) if turn else None
            task = Task(views[name], FIT[name][1], fit_apart, told_toxic[0] / told_toxic[1] if name == "toxic" else 1.0,
                        Teacher(other, tuple(lines[other])) if other else None)
            runs += [(name, f"{name}_{k}", task, (penalty, FIT[name][3]), models.get(name), models.get(other)) for k, penalty in enumerate(chosen[name])]
        found = dict(zip([r[1] for r in runs], fitted(blocks, *[[r[k] for r in runs] for k in (2, 3, 4, 5)])))
        told = held_out(blocks, held_apart, found, {r[1]: views[r[0]] for r in runs})
        for name in {r[0]: None for r in runs}:
            best = min(((line(told, name, f"m_{r[1]}"), r) for r in runs if r[0] == name), key=lambda x: x[0][1])
            models[name], lines[name], chosen[name] = found[best[1][1]], best[0][0], (best[1][3][0],)
    models = {name: models[name] for name in views}
    told = held_out(blocks, held_apart, models, views)
    drop_written(blocks)
    z = np.stack([lines[v][0] * told[f"m_{v}"].to_numpy() + lines[v][1] for v in models], 1)
    good = told["good"].to_numpy() == 1
    mixed = small_logistic(z, good.astype(float), even=True)
    mixed[-1] -= min(0.0, float(np.quantile(z[good] @ mixed[:-1] + mixed[-1], 1 - KEEP_GOOD)))
    return QualityModel(models, lines, mixed)


def judge_quality(docs: DataFrame, model: QualityModel | None, meta_cols: list[str], id_col: str = "doc_id",
                  text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Score every row: doc_id, p_words, p_meta (calibrated views), score (combined), keep (score >= cut).

    Without a model (no labels of both classes) scores are null and every row is kept. Null
    or empty texts have no words and are judged by the rest; null metadata is a value of its
    own. Repeated rows get equal scores. An empty table gives no rows. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(f"meta_{k}") for k, c in enumerate(meta_cols)])
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("p_words"), none.alias("p_meta"), none.alias("score"), F.lit(True).alias("keep"))

    def score(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            for lo, hi in slices(off, SLICE_BYTES):
                p = model.scores(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], [c.slice(lo, hi - lo) for c in batch.columns[2:]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, (*p, p[2] >= cut))],
                                                 names=["doc_id", "p_words", "p_meta", "score", "keep"])

    return rows.mapInArrow(score, "doc_id long, p_words double, p_meta double, score double, keep boolean")


def accepted(docs: DataFrame, model: QualityModel | None, meta_cols: list[str], id_col: str = "doc_id", text_col: str = "text",
             cut: float = 0.5) -> DataFrame:
    """The rows that ``judge_quality`` keeps, with all their columns."""
    if model is None:
        return docs

    def sift(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column(text_col))
            for lo, hi in slices(off, SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                score = model.scores(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], [part.column(c) for c in meta_cols])[2]
                yield part.filter(pa.array(score >= cut))

    return docs.mapInArrow(sift, docs.schema)


#: Metadata columns of documents, and what counts as good: of quality and not toxic.
META_COLS = ["lang", "source", "n_chars"]


def good_label():
    return F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels that the tables hold and judge every document."""
    return judge_quality(docs, train_quality(docs, labels, META_COLS, good_label()), META_COLS)
