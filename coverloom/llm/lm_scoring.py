"""Operator 10: language-model scores from a weighted backoff automaton over words.

States are histories of one word: the beginning of a text, and every word of the training documents.
Arcs between them carry discounted bigram probabilities; a failure arc carries the state's backoff weight
to the state without history, whose arcs are the smoothed frequencies of all training words. Unknown words
are one event there, as in the base score. A text is read once from left to right: each token follows its
arc or the failure arc, the weights add up, and the token's own state comes next.

Counts of words and of word pairs are shuffled over the whole corpus and are neither collected nor
broadcast. Tokens of the HEAD most frequent words find their counts in memory (a fixed size), all others by
a join with the table of all words, where pairs that end in such a word are counted too. Of the other
pairs, those between words with a share of at least 1 / STATES of all training tokens are a cache in
memory (STATES squared at most); the rest meet in buckets of histories, as many as the tokens ask for, and
a history with over SPLIT tokens is dealt by its successors. Only held-out documents meet pairs without an
arc. Their backoff weights come from the kinds and the smoothed mass of all successors of a history.
With `states` the model itself is cut to histories of that share, and all other words are one successor.

Defined cases: a null or empty text is the end alone; documents with equal ids and equal rows are
scored row by row; without training documents every token is unknown; an empty table gives no rows;
other columns never take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import HEAVY, arrow_map, table
from ._text import Block, blocks, mix, per_doc, ranges, sums

STATES = 2048
HEAD = 1 << 18
BUCKET_TOKENS = 1 << 21
BUCKET_TASKS = 100_000
BATCH_BYTES = 8 << 20
SPLIT = 1 << 16
DISCOUNT = 0.5
FOLDS, HELD_OUT = 7, 2


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as a binary column."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ranges(starts, sizes)]))])


def _distinct(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """First occurrences of the block's distinct words, and each word's number among them."""
    _, first, back = np.unique(block.word_hashes(), return_index=True, return_inverse=True)
    return first, back


def folds(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text, held_out): key tells rows apart by id and text; held out are ids whose crc32 falls in one of FOLDS folds."""
    fold = F.crc32(F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select(F.xxhash64(docs[id_col].cast("long"), docs[text_col]).alias("key"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (fold == HELD_OUT).alias("held_out"))


def word_counts(folded: DataFrame) -> DataFrame:
    """(word, c): every word of the corpus with its count in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for block in blocks(batch.column(0), lower=True, limit=1 << 22):
                first, back = _distinct(block)
                counts = np.bincount(back[np.repeat(train[block.first : block.last], block.n_words)], minlength=len(first))
                yield pa.RecordBatch.from_arrays([_spans(block.data, block.starts[first], block.ends[first]), pa.array(counts.astype(np.int64))], ["word", "c"])

    return arrow_map(folded.select("text", "held_out"), run, "word binary, c long", BATCH_BYTES).groupBy("word").agg(F.sum("c").alias("c"))


class BackoffAutomaton:
    """Arcs between the states of frequent words, and the arcs without history.

    `hashes` are the states' words in ascending order; state len(hashes) is a text's beginning, and as
    a successor its end. `pairs` has (state * width + successor) with counts; the successor width - 1
    stands for all words that aren't states.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_docs: int, n_tokens: int, n_kinds: int, pairs: np.ndarray, pair_counts: np.ndarray) -> None:
        self.hashes, self.n_tokens, self.n_kinds = hashes, n_tokens, max(n_kinds, 1)
        self.width = len(hashes) + 2
        self.begin = len(hashes)
        plain = np.append(counts, n_docs) / (n_tokens + self.n_kinds)
        history, successor = pairs // self.width, pairs % self.width
        total = np.bincount(history, weights=pair_counts, minlength=self.begin + 1)
        arc = successor < self.width - 1
        order = np.argsort(pairs[arc])
        self.arcs = pairs[arc][order]
        own = pair_counts[arc][order]
        self.weights = np.log10((own - DISCOUNT) / total[history[arc][order]])
        self.kinds = np.bincount(history[arc], minlength=self.begin + 1)
        seen = np.bincount(history[arc], weights=pair_counts[arc] - DISCOUNT, minlength=self.begin + 1)
        covered = np.bincount(history[arc], weights=plain[successor[arc]], minlength=self.begin + 1)
        self.covered = covered
        with np.errstate(divide="ignore", invalid="ignore"):
            self.backoff = np.where(total > 0, np.log10((1 - seen / total) / np.maximum(1 - covered, 1e-12)), 0.0)

    def states(self, hashes: np.ndarray) -> np.ndarray:
        """The state of each word; -1 for the state without history."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def plain(self, c: np.ndarray) -> np.ndarray:
        """log10 probability without history of words counted c times; 0 is the unknown word."""
        return np.log10(np.where(c > 0, c, self.n_kinds) / (self.n_tokens + self.n_kinds))

    def walk(self, history: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the weight met on the way, and whether its arc without history is still to come."""
        key = np.where((history >= 0) & (successor >= 0), history * self.width + successor, -1)
        at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
        found = (self.arcs[at] == key) if len(self.arcs) else np.zeros(len(key), dtype=bool)
        weight = np.where(history >= 0, self.backoff[history], 0.0)
        if len(self.arcs):
            weight = np.where(found, self.weights[at], weight)
        return weight, ~found


def paths(block: Block, states: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History and successor of every token of a block, ends included, and the documents' token offsets."""
    ends = block.word_offsets[1:] + np.arange(block.n_docs)
    offsets = np.concatenate(([0], ends + 1))
    successor = np.insert(states, block.word_offsets[1:], begin)
    history = np.concatenate(([begin], successor[:-1]))
    return history, successor, offsets


def pair_counts(folded: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(pair, n) over training documents; a task emits each pair once a batch."""
    width, begin = len(hashes) + 2, len(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = BackoffAutomaton(hashes, np.zeros(len(hashes)), 0, 1, 1, np.zeros(0, dtype=np.int64), np.zeros(0))
        for batch in batches:
            found = []
            for block in blocks(batch.column(0), lower=True):
                history, successor, _ = paths(block, lookup.states(block.word_hashes()), begin)
                use = history >= 0
                found.append(history[use] * width + np.where(successor[use] >= 0, successor[use], width - 1))
            if found:
                pairs, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    train = folded.where(~F.col("held_out")).select("text")
    return arrow_map(train, run, "pair long, n long", BATCH_BYTES).groupBy("pair").agg(F.sum("n").alias("n"))


_PARTS = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, tf long, h long"
_BUCKETS = "bucket long, keys binary, held binary, h binary, n binary, x binary, d binary"
_MET = "key long, h long, n long, v double"


def _bucket_by_bucket(run: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies `run` to the rows of one bucket after the other; batches come sorted by bucket."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
            for low, high in zip(starts, [*starts[1:], len(bucket)], strict=True):
                if held and held[-1].column(0)[0].as_py() != bucket[low]:
                    yield from run(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return all_of


def _pairs_met(counts: np.ndarray, machine: BackoffAutomaton, large: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: (key, -, -, v) scores of documents, (key, h, n, -) pairs without an arc, (-, h, n, v) kinds and mass of histories."""

    def run(t: pa.Table) -> pa.Table:
        col = lambda name, kind: [np.frombuffer(v, dtype=kind) for v in t.column(name).to_pylist()]
        keys, held, d = col("keys", np.int64), col("held", bool), col("d", np.uint32)
        first = np.cumsum([0, *(len(k) for k in keys)])
        doc = np.concatenate([x.astype(np.int64) + o for x, o in zip(d, first, strict=False)])
        keys, held = np.concatenate(keys), np.concatenate(held)
        h = np.repeat(np.concatenate(col("h", np.int64)), np.concatenate(col("n", np.uint32)))
        x = np.concatenate(col("x", np.int32))
        order = np.lexsort((x, h))
        h, x, doc = h[order], x[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        group, gh, gx = np.cumsum(new) - 1, h[new], x[new]
        k = np.bincount(group, weights=~held[doc])
        plain = machine.plain(counts[gx])
        value = np.where(gx < 0, 0.0, np.where(k > 0, np.log10(np.maximum(k, 1) - DISCOUNT), plain))
        score = np.bincount(doc, weights=value[group], minlength=len(keys))
        met = np.flatnonzero(np.bincount(doc, minlength=len(keys)))
        missed = np.flatnonzero(((k == 0) & (gx >= 0))[group])
        own, at = np.unique(gh, return_inverse=True)
        kinds = np.bincount(at, weights=k > 0).astype(np.int64)
        mass = np.bincount(at, weights=np.where(k > 0, 10.0**plain, 0.0))
        # a history that lies in one bucket is asked for only where a held-out document has it without an arc
        wanted = np.flatnonzero((kinds > 0) & ((np.bincount(at, weights=k == 0) > 0) | np.isin(own, large)))
        none = lambda n, kind: pa.nulls(n, kind)
        parts = [
            [pa.array(keys[met]), none(len(met), pa.int64()), none(len(met), pa.int64()), pa.array(score[met])],
            [pa.array(keys[doc[missed]]), pa.array(h[missed]), pa.array(np.ones(len(missed), dtype=np.int64)), none(len(missed), pa.float64())],
            [none(len(wanted), pa.int64()), pa.array(own[wanted]), pa.array(kinds[wanted]), pa.array(mass[wanted])],
        ]
        return pa.concat_tables([pa.table(p, names=["key", "h", "n", "v"]) for p in parts])

    return run


def _weighed(missed: DataFrame, histories: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Pairs without an arc with their history's kinds and mass. Frequent histories, fewer than HEAVY + 1, are broadcast, so that none fills a task."""
    few = F.broadcast(missed.sparkSession.createDataFrame(pa.table({"few": frequent})))
    met = missed.join(F.broadcast(histories.join(few, F.col("of") == F.col("few"), "left_semi")), F.col("h") == F.col("of"))
    return met.unionByName(missed.join(few, F.col("h") == F.col("few"), "left_anti").join(histories, F.col("h") == F.col("of")))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, states: int | None = None, cached: int = STATES, bucket_tokens: int = BUCKET_TOKENS, split: int = SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark, whole = docs.sparkSession, states is None
    share = cached if whole else states
    folded = folds(docs, id_col, text_col)
    n_docs = folded.where(~F.col("held_out")).count()
    words = table(word_counts(folded), "words", release=True)
    totals = words.agg(F.sum("c").alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("kinds")).first()
    train_tokens, kinds = (totals["tokens"] or 0) + n_docs, totals["kinds"] + (n_docs > 0)
    norm = float(np.log10(train_tokens + kinds + 1))

    hashes, counts = _hashed(_head(words, max(head, share)))
    frequent = counts * share >= max(train_tokens, 1)
    pairs = pair_counts(folded, hashes[frequent]).toArrow()  # (share + 2) squared rows at most
    machine = BackoffAutomaton(hashes[frequent], counts[frequent], n_docs, train_tokens, kinds, pairs.column("pair").to_numpy(), pairs.column("n").to_numpy())
    end_base, end_known = float(np.log10(n_docs + 1)) - norm, int(n_docs > 0)
    end_plain = float(machine.plain(np.array([n_docs]))[0])
    n_buckets = -(-train_tokens // bucket_tokens) + 1
    end = len(hashes)  # the successor code of a text's end; its beginning is the history 0
    known_counts = np.append(counts, n_docs).astype(np.int64)
    own_hashes = np.append(hashes, np.uint64(0)).astype(np.uint64).view(np.int64)
    large_ones, frequent = own_hashes[known_counts > split], own_hashes[known_counts > train_tokens // HEAVY]

    def looked_up(block: Block) -> tuple:
        unique, first, back = np.unique(block.word_hashes(), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(hashes, unique), max(end - 1, 0))
        found = hashes[at] == unique if end else np.zeros(len(unique), dtype=bool)
        c = np.where(found, counts[at], 0) if end else np.zeros(len(unique), dtype=np.int64)
        history, successor, offsets = paths(block, machine.states(unique)[back], machine.begin)
        weight, plain = machine.walk(history, successor)
        return unique, first, back, at, found, c, offsets, weight, plain

    def before(block: Block, values: np.ndarray, begin: int) -> np.ndarray:
        """For each token, ends included, the value of its history."""
        return np.concatenate((np.array([begin], dtype=values.dtype), np.insert(values, block.word_offsets[1:], begin)[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), lower=True, limit=1 << 21):
                yield from parts(block, batch)

    def parts(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, names = block.n_docs, [f.split()[0] for f in _PARTS.split(", ")]
        unique, first, back, at, found, c, offsets, weight, plain = looked_up(block)
        if whole:
            # arcs of the cache, else the total of a history in memory; the other weights come after the shuffles
            total = before(block, c[back], n_docs)
            score = np.where(plain, np.where(total > 0, -np.log10(np.maximum(total, 1)), 0.0), weight)
        else:
            # tokens outside the head add their arc without history after the join
            score = weight + np.insert(np.where(found, machine.plain(c), 0.0)[back], block.word_offsets[1:], end_plain) * plain
        base = sums((np.where(found, np.log10(c + 1) - norm, 0.0))[back], block.word_offsets) + end_base
        known = per_doc((c > 0)[back], block.word_offsets) + end_known
        keys, held = batch.column(0).slice(block.first, n), batch.column(3).slice(block.first, n)
        yield pa.RecordBatch.from_arrays([keys, batch.column(1).slice(block.first, n), held, pa.array(np.diff(offsets)), pa.array(known), pa.array(base), pa.array(sums(score, offsets)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        rest = np.flatnonzero(~found[back])
        if not len(rest):
            return
        doc, word = block.word_doc()[rest], back[rest]
        if whole:
            h, tf = before(block, unique[back], 0)[rest + doc].view(np.int64), np.ones(len(rest), dtype=np.int64)
        else:
            key, tf = np.unique(doc * np.int64(len(unique)) + word, return_counts=True)
            doc, word, h = key // len(unique), key % len(unique), np.zeros(len(key), dtype=np.int64)
        spelled = _spans(block.data, block.starts[first[word]], block.ends[first[word]])
        empty = [pa.nulls(len(doc), t) for t in (pa.int64(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.nulls(len(doc), pa.int64()), held.take(pa.array(doc)), pa.nulls(len(doc), pa.int64()), *empty, spelled, pa.array(tf.astype(np.int64)), pa.array(h)], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower=True, limit=1 << 22):
                unique, _, back, at, found, c, offsets, _, rest = looked_up(block)
                held = np.asarray(batch.column(2).slice(block.first, block.n_docs).to_numpy(zero_copy_only=False), dtype=bool)
                keys = batch.column(0).slice(block.first, block.n_docs).to_numpy()
                doc = np.repeat(np.arange(block.n_docs, dtype=np.uint32), np.diff(offsets))
                x = np.insert(np.where(found, at, -1)[back], block.word_offsets[1:], end)
                # a successor outside the head counts in the join with all words; held-out documents still ask for its history
                use = np.flatnonzero(rest & ((x >= 0) | held[doc]))
                if not len(use):
                    continue
                h, x, doc = before(block, unique[back], 0)[use], x[use].astype(np.int32), doc[use]
                large = before(block, c[back], n_docs)[use] > split
                bucket = np.where(large, mix(h ^ mix(x.astype(np.uint64) + np.uint64(1))), h) % np.uint64(n_buckets)
                order = np.lexsort((h, bucket))
                h, x, doc, bucket = h[order].view(np.int64), x[order], doc[order], bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(n_buckets)))
                out: list[list] = [[] for _ in range(7)]
                for low, high in zip(starts, [*starts[1:], len(bucket)], strict=True):
                    turn = low + np.concatenate(([0], np.flatnonzero(np.diff(h[low:high])) + 1))
                    docs_met, d = np.unique(doc[low:high], return_inverse=True)
                    row = (int(bucket[low]), keys[docs_met], held[docs_met], h[turn], np.diff(np.append(turn, high)).astype(np.uint32), x[low:high], d.astype(np.uint32))
                    for to, v in zip(out, row, strict=True):
                        to.append(v if isinstance(v, int) else v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(v, pa.binary()) for v in out[1:])], [f.split()[0] for f in _BUCKETS.split(", ")])

    scored = table(arrow_map(folded, run, _PARTS, BATCH_BYTES), "score-parts")
    local = scored.where(F.col("word").isNull()).drop("word", "tf", "h")
    rare = scored.where(F.col("word").isNotNull()).select("key", "held_out", "word", "tf", "h").join(words.select(F.col("word").alias("w"), "c"), F.col("word") == F.col("w"))
    total = train_tokens + machine.n_kinds
    share_of = F.when(F.col("c") > 0, F.col("c")).otherwise(machine.n_kinds) / F.lit(float(total))
    none = lambda kind: F.lit(None).cast(kind)

    def added(df: DataFrame, score: Column, known: Column | None = None, base: Column | None = None) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select("key", none("long").alias("doc_id"), none("boolean").alias("held_out"), zero.alias("n_tokens"), (zero if known is None else known).alias("n_known"), (F.lit(0.0) if base is None else base).alias("base"), score.alias("score"))

    known, base = F.when(F.col("c") > 0, F.col("tf")).otherwise(0), F.col("tf") * (F.log10(F.col("c") + 1) - norm)
    if whole:
        in_training = F.when(F.col("held_out"), 0).otherwise(F.col("tf"))
        rare = table(rare.withColumn("k", F.sum(in_training).over(Window.partitionBy("word", "h"))).select("key", "held_out", "tf", "h", "c", "k"), "rare-pairs", release=True)
        dealt = arrow_map(folded.select("key", "text", "held_out"), deal, _BUCKETS, BATCH_BYTES)
        # each bucket has a task of its own, so that what a task reads doesn't grow with the input
        dealt = dealt.repartitionById(min(n_buckets, BUCKET_TASKS), (F.col("bucket") % min(n_buckets, BUCKET_TASKS)).cast("int")).sortWithinPartitions("bucket")
        met = table(arrow_map(dealt, _bucket_by_bucket(_pairs_met(known_counts, machine, large_ones)), _MET, BATCH_BYTES), "pair-parts", release=True)
        own_total = F.when(F.col("c") > 0, -F.log10("c")).otherwise(0.0)
        arc = F.when(F.col("k") > 0, F.log10(F.col("k") - DISCOUNT)).otherwise(F.log10(share_of))
        part = in_training / F.col("k")  # the training rows of a pair add up to one kind
        cache = pa.table({"h": np.append(machine.hashes, np.uint64(0)).astype(np.uint64).view(np.int64), "n": machine.kinds.astype(float), "v": machine.covered})
        histories = met.where(F.col("key").isNull()).select("h", F.col("n").cast("double").alias("n"), "v")
        histories = histories.unionByName(rare.where((F.col("k") > 0) & ~F.col("held_out")).select("h", part.alias("n"), (part * share_of).alias("v")))
        histories = histories.unionByName(spark.createDataFrame(cache)).groupBy(F.col("h").alias("of")).agg(F.round(F.sum("n")).alias("kinds"), F.sum("v").alias("mass"))
        missed = met.where(F.col("key").isNotNull() & F.col("h").isNotNull()).select("key", "h", "n").unionByName(rare.where(F.col("k") == 0).select("key", "h", F.col("tf").alias("n")))
        missed = _weighed(missed, table(histories.where("kinds > 0"), "histories", release=True), frequent)
        out = local.unionByName(added(rare, F.col("tf") * (own_total + arc), known, base))
        out = out.unionByName(added(met.where(F.col("h").isNull()), F.col("v")))
        out = out.unionByName(added(missed, F.col("n") * F.log10(F.lit(DISCOUNT) * F.col("kinds") / (F.lit(1.0) - F.col("mass")))))
    else:
        out = local.unionByName(added(rare, F.col("tf") * F.log10(share_of), known, base))
    # rows of equal ids and texts share a key and have equal figures
    copies = F.count("held_out").alias("copies")
    out = out.groupBy("key").agg(copies, F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    per = lambda c: F.col(c) / F.col("copies")
    return out.select("doc_id", "held_out", per("n_tokens").cast("long").alias("n_tokens"), per("n_known").cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), per("base").alias("base_score"), per("score").alias("score"))


def _hashed(words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ascending order, and their counts."""
    hashes = _hash_words(words.column("word").combine_chunks() if words.num_rows else pa.array([], pa.binary()))
    order = np.argsort(hashes)
    return hashes[order], words.column("c").to_numpy()[order]


def _head(words: DataFrame, head: int) -> pa.Table:
    """The most frequent words, `head` at most: whole classes of like counts, found from a histogram of classes."""
    level: Column = F.floor(F.log2("c") * 8)
    sizes = words.where(F.col("c") > 0).groupBy(level.alias("level")).count().collect()  # eight classes for each doubling
    total, least = 0, None
    for r in sorted(sizes, reverse=True):
        total += r["count"]
        if total > head:
            break
        least = r["level"]
    return words.where((F.col("c") > 0) & (level >= least) if least is not None else F.lit(False)).toArrow()


def _hash_words(words: pa.Array) -> np.ndarray:
    """The hashes that Block.word_hashes gives these words."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    listed = words.to_pylist()
    ends = np.cumsum([len(w) for w in listed])
    starts = np.concatenate(([0], ends[:-1]))
    return Block(0, len(listed), np.frombuffer(b"".join(listed), dtype=np.uint8), starts, starts, ends, starts).span_hashes(starts, ends)
