"""Operator 6: best-fit decreasing packing of token ids into fixed windows.

Each document's ids (with an end id) are cut into full windows and one rest. Rests are packed by
best fit decreasing: longest first, each into the tightest open window that holds it, which a segment
tree over remaining capacities finds. Rests of one length are alike, so the driver packs a histogram
of lengths (one counter a length, fixed by the window) and gets runs of (length, rank) -> (window,
offset); its work doesn't grow with the number of documents. Ranks come from counts by task and
length, so no length's rows ever meet in one task.

Defined cases: a null or empty text is one piece with the end id only; repeated rows and rows of equal id
are packed as rows of their own; a null id stays null; an empty table gives no rows; a very long text
becomes many pieces; other columns never take part, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import arrow_map, table
from ._text import ranges
from ._tokens import encode_batch, tokenizer_path

WINDOW = 2048
END_ID = 1
RUN = 1000
MAX_BROADCAST_ROWS = 1_000_000
_PIECES = "doc_id long, start long, length int, doc_tokens long, task int, local_rank long, ids array<int>"


def pieces(docs: DataFrame, window: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their ids; (task, length, local_rank) numbers the pieces of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            ids_col = batch.column(0).cast(pa.int64())
            for first, last, ids, offsets in encode_batch(batch.column(1), tokenizer, end_id):
                n = np.diff(offsets)
                counts = -(-n // window)
                doc = np.repeat(np.arange(last - first), counts)
                start = ranges(np.zeros(len(n), dtype=np.int64), counts) * window
                length = np.minimum(n[doc] - start, window)
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=window + 1)
                rank = np.empty(len(length), dtype=np.int64)
                rank[order] = ranges(seen, sizes)
                seen += sizes
                begins = pa.array(np.append(offsets[:-1][doc] + start, offsets[-1]), pa.int32())
                own = [ids_col.slice(first, last - first).take(pa.array(doc)), pa.array(start), pa.array(length, pa.int32()), pa.array(n[doc])]
                place = [pa.array(np.full(len(doc), task, dtype=np.int32)), pa.array(rank)]
                lists = pa.ListArray.from_arrays(begins, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*own, *place, lists], [f.split()[0] for f in _PIECES.split(", ")])

    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return arrow_map(slim, run, _PIECES)


class _Capacities:
    """A segment tree over remaining capacities 0..window: the smallest open one of at least x."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.open[at] += n
            at //= 2

    def tightest(self, x: int) -> int | None:
        at = x + self.size
        if self.open[at]:
            return x
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank from, rank to, first window, offset) for counts of pieces by length.

    The windows of a run are consecutive. Each length ends at most one run early, so the runs grow
    with the number of lengths, not with the pieces.
    """
    tree, open_runs, runs, windows = _Capacities(window), {}, [], 0

    def fill(length: int, rank: int, low: int, size: int, room: int, layers: int) -> None:
        """Lays pieces of one length, `layers` of them each, into windows low.. with `room` left."""
        for k in range(layers):
            runs.append((length, rank + k * size, rank + (k + 1) * size, low, window - room + k * length))
        if left := room - layers * length:
            open_runs.setdefault(left, []).append((low, size))
            tree.add(left, size)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        placed, n = 0, counts[length]
        while placed < n:
            room = tree.tightest(length)
            if room is None:
                room, low, size = window, windows, n
            else:
                low, size = open_runs[room].pop()
                tree.add(room, -size)
            # a window stays the tightest until it holds no further piece of this length
            layers = room // length
            whole = min(size, (n - placed) // layers)
            if whole:
                fill(length, placed, low, whole, room, layers)
                placed += whole * layers
            used = whole
            if whole < size and placed < n:
                fill(length, placed, low + whole, 1, room, n - placed)
                placed, used = n, whole + 1
            if low == windows:
                windows += used
            elif used < size:
                open_runs[room].append((low + used, size - used))
                tree.add(room, size - used)
    return runs


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", of_pieces: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) with their sequence_id and offset.

    `of_pieces` maps the written pieces before they meet their places, such as ids to a digest of them.
    """
    spark = docs.sparkSession
    cut = table(pieces(docs, window, tokenizer or tokenizer_path(), end_id, id_col, text_col), "pieces", compression="zstd")
    by_task = table(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length at most
    runs = best_fit_decreasing(counts, window)
    packed = json.dumps([{"l": a, "lo": b, "hi": c, "w": d, "at": e} for a, b, c, d, e in runs])
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(packed), "array<struct<l:int,lo:long,hi:long,w:long,at:long>>")))
    ranked = _ranked(of_pieces(cut) if of_pieces else cut, by_task)
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    rest = [c for c in placed.columns if c not in {"doc_id", "start", "length", "doc_tokens", "task", "local_rank", "rank", "l", "lo", "hi", "w", "at"}]
    sequence = (F.col("w") + F.col("rank") - F.col("lo")).alias("sequence_id")
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", sequence, F.col("at").alias("offset"), *rest)


def _ranked(cut: DataFrame, by_task: DataFrame) -> DataFrame:
    """cut with the rank of each piece among all of its length: that in its task after those of the tasks before.

    Tasks' counts are broadcast up to MAX_BROADCAST_ROWS; beyond that, pieces of one length and task meet them
    in runs of RUN, since all full windows of a task have one length.
    """
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    base = F.coalesce(before, F.lit(0)).cast("long").alias("base")
    bases = by_task.select(F.col("length").alias("own_length"), F.col("task").alias("own_task"), "n", base)
    same = (F.col("length") == F.col("own_length")) & (F.col("task") == F.col("own_task"))
    if by_task.count() <= MAX_BROADCAST_ROWS:
        bases = F.broadcast(bases)
    else:
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run")
        bases = bases.select("own_length", "own_task", "n", "base", runs)
        same &= F.floor(F.col("local_rank") / RUN) == F.col("run")
    joined = cut.join(bases, same)
    return joined.select(*(joined[c] for c in cut.columns), (F.col("base") + F.col("local_rank")).alias("rank"))
