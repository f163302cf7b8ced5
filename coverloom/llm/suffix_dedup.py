"""Operator 1: passages that repeat across or within documents, from a sparse suffix array.

Words are compared regardless of A-Z case and of white space. Only suffixes at minimiser positions are
retained: of any PASSAGE words in a row, the K-word run with the least hash begins a retained suffix,
and equal passages retain the same one. Suffixes whose first K words occur once are dropped. The rest are
sorted by their words; neighbours are compared, which gives the length of their match to the right, and
neighbours in the order of the words before them give its length to the left. A passage of PASSAGE words
around the K words is repeated if another suffix shares its words on both sides; its occurrence of the
smallest (doc_id, position) is the first, all others are later ones.

Suffixes that share their first K words meet in one task, up to SUFFIXES_PER_TASK of them; more are
dealt over several tasks, each of which settles its own repeats, and what a task holds as first is then
settled by hashes of whole passages in a shuffled sum. The result is the same either way. The first K
words are compared as one 64-bit hash, the others as 32-bit hashes, word by word: a false match takes 20
equal words and a collision of every other word that differs.

Defined cases: a null text, or one of fewer than PASSAGE words, has no passage; rows of equal id and
equal text are one document, equal ids with other texts are told apart by text; a null id sorts first;
overlapping repeats merge into one span; a very long text is a block of its own, of which only the retained
suffixes are shuffled; an empty table gives no rows; other columns never take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_map, drop_table, fresh, join_counted, small, table
from ._text import Block, blocks, gram_hashes, mix, ranges, repeats

PASSAGE = 50
K = 20
REACH = PASSAGE - K
SUFFIXES_PER_TASK = 1000
MAX_BROADCAST_SPANS = 1_000_000


def retained(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, word positions and K-word hashes of the retained suffixes of a block."""
    at, grams = gram_hashes(block.word_hashes(), block.word_offsets, K)
    n_grams = np.maximum(block.n_words - K + 1, 0)
    first = np.concatenate(([0], np.cumsum(n_grams)))[:-1]
    windows = ranges(first, np.maximum(n_grams - REACH, 0))
    if not len(windows):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(grams, REACH + 1)
    parts = np.array_split(windows, max(1, len(windows) >> 16))
    least = np.concatenate([part + view[part].argmin(axis=1) for part in parts])
    chosen = np.unique(least)
    doc = np.searchsorted(block.word_offsets, at[chosen], side="right") - 1
    return doc, at[chosen] - block.word_offsets[doc], grams[chosen]


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, doc_id, version, pos) of every retained suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), lower=True):
                doc, pos, key = retained(block)
                rows = pa.array(block.first + doc)
                columns = [pa.array(key.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "version", "pos"])

    return arrow_map(docs.select("doc_id", "version", "text"), run, "key long, doc_id long, version long, pos int")


_CONTEXT = "key long, share int, shares int, ahead binary, behind binary, doc_id long, version long, pos int"


def contexts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept suffixes with the words ahead of their first K words and behind them, nearest first, as 32-bit hashes."""
    names = [f.split()[0] for f in _CONTEXT.split(", ")]
    found = F.array_sort(F.collect_set(F.struct("pos", "key", "shares"))).alias("found")
    by_doc = kept.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(found)
    same = docs["doc_id"].eqNullSafe(F.col("d")) & (docs["version"] == F.col("v"))
    joined = docs.join(by_doc, same).select("doc_id", "version", "text", "found")
    if _repeated(docs):
        joined = joined.dropDuplicates(["doc_id", "version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            pos_all, key_all, shares_all = (lists.values.field(i).to_numpy() for i in range(3))
            for block in blocks(batch.column(2), lower=True):
                rows = np.arange(offsets[block.first], offsets[block.last])
                doc = np.repeat(np.arange(block.n_docs), np.diff(offsets[block.first : block.last + 1]))
                hashes = block.word_hashes()
                words = np.maximum(hashes >> np.uint64(32), np.uint64(1)).astype(np.uint32)
                begin = block.word_offsets[doc] + pos_all[rows]
                step = np.arange(REACH)
                ahead, behind = begin[:, None] + K + step, begin[:, None] - 1 - step
                inside_ahead = ahead < block.word_offsets[doc + 1][:, None]
                inside_behind = behind >= block.word_offsets[doc][:, None]
                ahead = np.where(inside_ahead, words[np.minimum(ahead, max(len(words) - 1, 0))], 0).astype(">u4")
                behind = np.where(inside_behind, words[np.maximum(behind, 0)], 0).astype(">u4")
                own = pa.array(block.first + doc)
                version = batch.column(1).take(own)
                place = mix(pos_all[rows].astype(np.uint64) * np.uint64(31) + hashes[begin] + version.to_numpy().view(np.uint64))
                share = place % np.maximum(shares_all[rows], 1).astype(np.uint64)
                columns = [pa.array(key_all[rows]), pa.array(share.astype(np.int32)), pa.array(shares_all[rows])]
                columns += [_fixed(ahead), _fixed(behind), batch.column(0).take(own), version, pa.array(pos_all[rows])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(joined, run, _CONTEXT)


def _fixed(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * 4
    offsets = (np.arange(len(rows) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of REACH words; big-endian, so that bytes sort as words do."""
    parts = [np.frombuffer(c.buffers()[2], dtype=">u4")[c.offset * REACH : (c.offset + len(c)) * REACH] for c in column.chunks]
    return np.concatenate([p.reshape(-1, REACH) for p in parts])


_FOUND = "doc_id long, version long, pos int, twice long, later long, passage long, reach int"


def common(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each of the sorted rows, how many leading words it shares with the row before it; -1 where a group begins."""
    out = np.full(len(words), -1, dtype=np.int64)
    same = (words[1:] == words[:-1]) & (words[1:] != 0)
    shared = np.where(same.all(axis=1), REACH, same.argmin(axis=1))
    out[1:] = np.where(group[1:] == group[:-1], shared, -1)
    return out


def _settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Compares neighbours of whole groups of sorted suffixes and extends their matches to both sides.

    The rows come in the order of the words ahead; a second order is that of the words behind. In each, a
    run of neighbours that share l words is a class. Two suffixes lie in one passage that begins l words
    before them exactly if they share l words behind and REACH - l ahead, so they are in one class of
    both orders. Bit l of `twice` and `later` is that passage. Where a group is dealt over several tasks,
    passages that aren't later ones here also go out with their hashes.
    """
    names = [f.split()[0] for f in _FOUND.split(", ")]
    n = rows.num_rows
    key, share = rows.column("key").to_numpy(), rows.column("share").to_numpy()
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (share[1:] != share[:-1]))))
    ahead, behind = _matrix(rows.column("ahead")), _matrix(rows.column("behind"))
    version, pos = rows.column("version").to_numpy(), rows.column("pos").to_numpy()
    ids = rows.column("doc_id").combine_chunks()
    doc = pc.fill_null(ids, -(2**63)).to_numpy(zero_copy_only=False)
    several = rows.column("shares").to_numpy() > 1

    marked = np.concatenate((group.astype(">u4")[:, None], behind), axis=1)
    backwards = np.argsort(np.ascontiguousarray(marked).view(f"S{4 * REACH + 4}").ravel(), kind="stable")
    shared_ahead = common(ahead, group)
    shared_behind = common(behind[backwards], group[backwards])
    n_ahead, n_behind = (ahead != 0).sum(axis=1), (behind != 0).sum(axis=1)
    # of passages alike the first in this order is the first occurrence
    place = np.empty(n, dtype=np.int64)
    place[np.lexsort((pos, version, doc))] = np.arange(n)

    twice, later = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    out: list[tuple[np.ndarray, int]] = []
    classes = np.empty(n, dtype=np.int64)
    for left in range(REACH + 1):
        right = REACH - left
        by_ahead = np.cumsum(shared_ahead < right)
        classes[backwards] = np.cumsum(shared_behind < left)
        whole = (n_ahead >= right) & (n_behind >= left)
        # alone in a class of either order: no such passage occurs again
        met = whole & (np.bincount(by_ahead)[by_ahead] > 1) & (np.bincount(classes)[classes] > 1)
        at = np.flatnonzero(met)
        at = at[np.argsort(place[at])]
        again, after = repeats(by_ahead[at] * (n + 1) + classes[at])
        twice[at[again]] |= 1 << left
        later[at[after]] |= 1 << left
        open_ = np.flatnonzero(several & whole & ((later >> left) & 1 == 0))
        if len(open_):
            out.append((open_, left))
    hit = np.flatnonzero(twice)
    none = [pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.int32())]
    own = [ids.take(pa.array(hit)), pa.array(version[hit]), pa.array(pos[hit]), pa.array(twice[hit]), pa.array(later[hit])]
    yield pa.RecordBatch.from_arrays([*own, *none], names)
    if not out:
        return
    dealt = np.flatnonzero(several)
    to_right, to_left = _prefixes(ahead[dealt]), _prefixes(behind[dealt])
    salt = mix(key[dealt].view(np.uint64))
    for at, left in out:
        row = np.searchsorted(dealt, at)
        passage = mix(salt[row] + np.uint64(left) + mix(to_left[left][row]) * np.uint64(3) + to_right[REACH - left][row])
        zero = pa.array(np.zeros(len(at), dtype=np.int64))
        own = [ids.take(pa.array(at)), pa.array(version[at]), pa.array(pos[at]), zero, zero]
        reach = pa.array(np.full(len(at), left, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*own, pa.array(passage.view(np.int64)), reach], names)


def _prefixes(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 0, 1, 2, ... words of each row."""
    out = [np.zeros(len(words), dtype=np.uint64)]
    for i in range(words.shape[1]):
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + words[:, i].astype(np.uint64)))
    return out


def compare(rows: DataFrame) -> DataFrame:
    """Sorts the suffixes and settles each group of those that share their first K words."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "share", "ahead", "behind", "doc_id", "version", "pos")
    ordered = rows.repartition(parts, "key", "share").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            key, share = now.column("key").to_numpy(), now.column("share").to_numpy()
            last = int(np.flatnonzero((key != key[-1]) | (share != share[-1])).max(initial=-1)) + 1
            if last:
                yield from _settle(now.slice(0, last))
            held = now.slice(last)
        if held is not None and held.num_rows:
            yield from _settle(held)

    return arrow_map(ordered, run, _FOUND)


_SPANS = "doc_id long, version long, start int, end int, later boolean"


def _spans(found: DataFrame) -> DataFrame:
    """Maximal runs of words in later occurrences, and of those in first occurrences only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            pos, twice, later = (lists.values.field(i).to_numpy() for i in range(3))
            row, start, end, which = [], [], [], []
            for d in range(batch.num_rows):
                at = slice(offsets[d], offsets[d + 1])
                cover = np.zeros((2, int(pos[at].max()) + PASSAGE + 1), dtype=np.int64)
                for kind, bits in ((0, twice[at]), (1, later[at])):
                    lefts = np.arange(REACH + 1)
                    i, left = np.nonzero((bits[:, None] >> lefts) & 1)
                    begin = pos[at][i] - left
                    np.add.at(cover[kind], begin, 1)
                    np.add.at(cover[kind], begin + PASSAGE, -1)
                inside = np.cumsum(cover, axis=1) > 0
                for kind, mask in ((False, inside[0] & ~inside[1]), (True, inside[1])):
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                    start += edge[::2].tolist()
                    end += edge[1::2].tolist()
                    row += [d] * (len(edge) // 2)
                    which += [kind] * (len(edge) // 2)
            own = pa.array(row, pa.int64())
            columns = [batch.column(0).take(own), batch.column(1).take(own)]
            columns += [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(which, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SPANS.split(", ")])

    by_doc = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("pos", "twice", "later")).alias("all"))
    return arrow_map(by_doc, run, _SPANS)


def _repeated(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count() > 0


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (doc_id, version, start, end, later) in words; later is false for first occurrences."""
    own = versions(docs, id_col, text_col)
    sampled = table(suffixes(own), "suffixes")
    total = sampled.count()
    counts = sampled.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    counts = table(counts, "suffix-counts")
    shares = F.ceil(F.col("n") / SUFFIXES_PER_TASK).cast("int").alias("shares")
    kept = join_counted(sampled, counts, "key", "n", total, ["key", "doc_id", "version", "pos", shares], "k")
    found = table(compare(contexts(own, kept)), "matches")
    drop_table(sampled, counts)

    settled = found.where(F.col("passage").isNull()).select("doc_id", "version", "pos", "twice", "later")
    open_ = found.where(F.col("passage").isNotNull()).select("doc_id", "version", "pos", "passage", "reach")
    n_open = open_.count()
    own_place = F.struct("doc_id", "version", "pos")
    first = open_.groupBy(F.col("passage").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(own_place).alias("first"))
    first = table(first.where(F.col("n") > 1), "first-places")
    bit = F.expr("shiftleft(1L, reach)")
    later = F.when(own_place.eqNullSafe(F.col("first")), F.lit(0).cast("long")).otherwise(bit)
    dealt = join_counted(open_, first, "passage", "n", n_open, ["doc_id", "version", "pos", bit.alias("twice"), later.alias("later")], "p")
    return _spans(settled.unionByName(dealt))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without the later occurrences of repeated passages; rows without a word left go.

    Where length_col exists, it gets the new lengths.
    """
    d, v, cuts_col = fresh(docs, "cut_doc", "cut_version", "cut_spans")
    spans = repeated_passages(docs, id_col, text_col).where("later").select("doc_id", "version", F.struct("start", "end").alias("span"))
    cuts = table(spans.groupBy(F.col("doc_id").alias(d), F.col("version").alias(v)).agg(F.array_sort(F.collect_list("span")).alias(cuts_col)), "cuts")
    n = cuts.agg(F.sum(F.size(cuts_col) + 2)).first()[0] or 0
    same = docs[id_col].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(v))
    marked = docs.join(small(cuts, n, MAX_BROADCAST_SPANS), same, "left").select(*(docs[c] for c in docs.columns), cuts_col)
    names, at = docs.columns, docs.columns.index(text_col)
    sized = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(at)):
                part = batch.slice(block.first, block.n_docs)
                rows = np.flatnonzero(has[block.first : block.last])
                columns = list(part.columns[:-1])
                if not len(rows):
                    yield pa.RecordBatch.from_arrays(columns, names)
                    continue
                texts = {i: _without(block, i, part.column(part.num_columns - 1)[i].as_py()) for i in rows.tolist()}
                columns[at] = pa.array([texts.get(i, t) for i, t in enumerate(columns[at].to_pylist())], columns[at].type)
                if sized is not None:
                    lengths = [len(texts[i]) if i in texts else x for i, x in enumerate(columns[sized].to_pylist())]
                    columns[sized] = pa.array(lengths, columns[sized].type)
                stays = [i not in texts or bool(texts[i].strip(" \t\n\v\f\r")) for i in range(block.n_docs)]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    return arrow_map(marked, run, T.StructType(list(docs.schema.fields)))


def _without(block: Block, d: int, cuts: list[dict[str, int]]) -> str:
    """The text of one document without the words of its cuts and the white space after them."""
    first, last, end = block.word_offsets[d], block.word_offsets[d + 1], int(block.offsets[d + 1])
    place, kept = int(block.offsets[d]), []
    for cut in cuts:
        kept.append(block.data[place : block.starts[first + cut["start"]]])
        place = int(block.starts[first + cut["end"]]) if first + cut["end"] < last else end
    kept.append(block.data[place:end])
    return np.concatenate(kept).tobytes().decode("utf-8", "replace")
