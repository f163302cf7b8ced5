"""Operator 3: near-duplicate components by MinHash with sequential Bayesian verification.

Documents with equal shingle sets form a class, which has a number of its own; ids belong to classes.
Classes that share a band of the signature are candidates. Signatures of a candidate pair are compared
a batch of values at a time, before any text is moved, and the pair is dropped as soon as the posterior
probability of reaching the threshold falls below MISS. Only survivors meet with their texts and are
confirmed on their full shingle sets.

No group's pairs are listed. In each bucket every member is tested against one hub, the member that
shares most buckets with others (such as the text that copies were made from). Only where a bucket
still holds several components are pairs across them considered, all of them, so no link that
candidates allow is lost: pairs never considered lie in one component already. Of these, exact bounds
rule out most within the join: from the shingles that a text shares with no other, and from the
shingles of their hub that the two lack. There the first batch of the sequential test is one bit of each
signature value, under the same MISS; two such bits are equal with probability (1 + similarity) / 2. A
hub's partners are dealt over several tasks.

Defined cases: a text without words, or null, has no shingles and stays alone; a text of fewer words
than a shingle is one shingle; a very long text is a block of its own; rows of equal id and equal text
count as that document again; rows of equal id with other texts are documents of their own and don't link
each other; a null id links with nothing and its component is null; an empty table gives no rows; other
columns never take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import arrow_map, drop_table, fresh, small, table
from ._text import Block, blocks, gram_hashes, mix, repeats
from .components import connected_components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
PARTNERS_PER_TASK = 1000
MAX_BROADCAST_ROWS = 1_000_000

_RNG = np.random.RandomState(75)
_MULTIPLY = _RNG.randint(0, 2**62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.randint(0, 2**62, HASHES, dtype=np.int64).astype(np.uint64)


def least_matches(n: int, percent: float = PERCENT, miss: float = MISS) -> int:
    """The fewest matches among n values for which P(similarity >= threshold) >= miss under a uniform prior."""
    t = percent / 100
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


_LEAST = [least_matches(n) for n in range(BATCH, HASHES + 1, BATCH)]
#: Of one bit of each value.
LEAST_BITS = least_matches(HASHES, (100 + PERCENT) / 2)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block (with repeats) and the documents' offsets; a shorter text is one shingle."""
    words, n = block.word_hashes(), block.n_words
    at, grams = gram_hashes(words, block.word_offsets, SHINGLE)
    counts = np.maximum(n - SHINGLE + 1, 0)
    brief = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(brief):
        own = []
        for d in brief:
            h = np.uint64(n[d])
            for w in words[block.word_offsets[d] : block.word_offsets[d + 1]]:
                h = mix(np.array([h ^ w]))[0]
            own.append(h)
        before = np.concatenate(([0], np.cumsum(counts)))[brief]
        grams = np.insert(grams, before, np.array(own, dtype=np.uint64))
        counts[brief] = 1
    return grams, np.concatenate(([0], np.cumsum(counts)))


_SETS = "doc_id long, version long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>, sketch_a long, sketch_b long"


def shingle_sets(docs: DataFrame) -> DataFrame:
    """For each row of docs the size and fingerprint of its shingle set, its signature and its band keys."""
    names = [f.split()[0] for f in _SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), lower=True):
                own = [batch.column(i).slice(block.first, block.n_docs) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *_signatures(block)], names)

    return arrow_map(docs, run, _SETS)


def _signatures(block: Block) -> list[pa.Array]:
    grams, offsets = shingles(block)
    n = block.n_docs
    doc = np.repeat(np.arange(n), np.diff(offsets))
    _, later = repeats(grams ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(1))[doc])
    first = np.concatenate(([0], np.cumsum(~later)))
    sizes = first[offsets[1:]] - first[offsets[:-1]]
    fingerprint = []
    for salt in (0, 0x5851F42D4C957F2D):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(np.where(later, np.uint64(0), mix(grams ^ np.uint64(salt))))))
        fingerprint.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    some = np.flatnonzero(sizes > 0)
    sig = np.zeros((n, HASHES), dtype=np.uint32)
    starts = offsets[:-1][some]
    if len(some):
        values = np.empty_like(grams)
        for i in range(HASHES):
            np.multiply(grams, _MULTIPLY[i], out=values)
            values += _ADD[i]
            sig[some, i] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    bands = np.zeros((n, BANDS), dtype=np.uint64)
    for r in range(ROWS):
        bands = mix(bands ^ (sig[:, r::ROWS].astype(np.uint64) + (np.arange(BANDS, dtype=np.uint64) << np.uint64(32))))
    # the lowest bit of a minimum is biased by its size; a mixed bit isn't
    bits = np.packbits((mix(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
    at = pa.py_buffer((np.arange(n + 1) * 4 * HASHES).astype(np.int32))
    raw = pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(np.ascontiguousarray(sig))])
    sketches = [pa.array(bits[:, i].copy()) for i in (0, 1)]
    return [pa.array(sizes.astype(np.int64)), *(pa.array(f) for f in fingerprint), raw, lists, *sketches]


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two signature matrices that may still reach the threshold after every batch of values."""
    alive, met = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(_LEAST):
        batch = slice(k * BATCH, (k + 1) * BATCH)
        met[alive] += (a[alive, batch] == b[alive, batch]).sum(axis=1)
        alive = alive[met[alive] >= least]
    return alive


def _dealt(pairs: DataFrame, held: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (hub, share, kind, id, *columns) of pairs (a, b), each hub before its partners, in tasks of bounded size.

    `held` has the columns by `cls`.
    """
    spark = pairs.sparkSession
    sized = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS_PER_TASK).cast("int").alias("shares"))
    sized = sized.withColumnRenamed("a", "hub")
    share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share")
    partners = pairs.join(sized, F.col("a") == F.col("hub")).select("hub", share, F.col("b").alias("id"), F.lit(1).alias("kind"))
    shares = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    hubs = sized.select("hub", shares).select("hub", "share", F.col("hub").alias("id"), F.lit(0).alias("kind"))
    rows = hubs.unionByName(partners).join(held, F.col("id") == F.col("cls")).select("hub", "share", "kind", "id", *columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "hub", "share").sortWithinPartitions("hub", "share", "kind", "id")


def screen(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that survive the sequential test of their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros((1, HASHES), dtype=np.uint32)
        for batch in batches:
            hubs, kinds, ids = (batch.column(i).to_numpy() for i in (0, 2, 3))
            sigs = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            # row 0 is the hub of the batch before, row 1 + i that of row i
            known = np.concatenate((hub, sigs))
            last = np.maximum.accumulate(np.where(kinds == 0, np.arange(1, len(ids) + 1), 0))
            partner = np.flatnonzero(kinds == 1)
            alive = partner[survivors(sigs[partner], known[last[partner]])]
            hub = known[last[-1:]] if len(ids) else hub
            yield pa.RecordBatch.from_arrays([pa.array(hubs[alive]), pa.array(ids[alive])], ["a", "b"])

    return arrow_map(_dealt(pairs, reps.select("cls", "sig"), ["sig"]), run, "a long, b long")


MISSING = 512
MAPS = [f"miss{i}" for i in range(MISSING // 64)]
_FACTS = "a long, b long, n_a long, n_b long, shared long, linked boolean, " + ", ".join(f"{m} long" for m in MAPS)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs (a, b): set sizes, shared shingles, whether they are linked, and a bitmap of a's shingles that b lacks."""
    names = [f.split()[0] for f in _FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = 0, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            kinds, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for block in blocks(batch.column(4), lower=True):
                grams, offsets = shingles(block)
                found: list[tuple] = []
                maps: list[np.ndarray] = []
                for d in range(block.n_docs):
                    i = block.first + d
                    own = np.unique(grams[offsets[d] : offsets[d + 1]])
                    if kinds[i] == 0:
                        hub, hub_set = int(ids[i]), own
                        continue
                    shared = np.isin(hub_set, own, assume_unique=True)
                    n = int(shared.sum())
                    linked = 100 * n >= PERCENT * (len(hub_set) + len(own) - n)
                    found.append((hub, int(ids[i]), len(hub_set), len(own), n, linked))
                    bits = np.zeros(MISSING, dtype=np.uint8)
                    bits[(hub_set[~shared] % np.uint64(MISSING)).astype(np.int64)] = 1
                    maps.append(np.packbits(bits).view(np.int64))
                if found:
                    columns = [pa.array(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c.copy()) for c in np.array(maps).T)], names)

    return arrow_map(_dealt(pairs, texts, ["text"]), run, _FACTS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return _components(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with version (of the text) and stands: whether the row is the one that stands for its component."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text"))
    sets = table(shingle_sets(own), "sets")
    some = sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # written once, so the numbers stay
    source = F.min(F.struct("doc_id", "version")).alias("source")
    classes = some.groupBy("set_a", "set_b").agg(source).withColumn("cls", F.monotonically_increasing_id())
    classes = table(classes.select("cls", "set_a", "set_b", "source"), "classes")
    sources = classes.select("cls", F.col("source.doc_id").alias("d"), F.col("source.version").alias("v"))
    reps = some.join(sources, (F.col("doc_id") == F.col("d")) & (F.col("version") == F.col("v")))
    repeated = _repeats(sets)
    if repeated:
        reps = reps.dropDuplicates(["cls"])
    reps = table(reps.select("cls", "sig", "bands", "sketch_a", "sketch_b"), "reps")

    listed = reps.select("cls", F.explode("bands").alias("key")).distinct()
    shared = table(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "shared")
    buckets = table(listed.join(shared, "key"), "buckets")
    weight = buckets.groupBy(F.col("cls").alias("w_cls")).agg(F.sum("n").alias("weight"))
    weighted = buckets.join(weight, F.col("cls") == F.col("w_cls"))
    top = weighted.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("weight", (-F.col("cls")).alias("minus"))).alias("top"))
    hubs = table(top.select("k", (-F.col("top.minus")).alias("hub")), "hubs")
    stars = buckets.join(hubs, F.col("key") == F.col("k")).where(F.col("cls") != F.col("hub"))
    stars = table(stars.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "stars")

    wanted = sources.join(buckets.select(F.col("cls").alias("c")).distinct(), F.col("cls") == F.col("c"), "left_semi")
    wanted = table(wanted, "wanted")
    same = (F.col("doc_id") == F.col("d")) & (F.col("version") == F.col("v"))
    texts = own.join(small(wanted, wanted.count(), MAX_BROADCAST_ROWS), same).select("cls", "text")
    texts = table(texts.dropDuplicates(["cls"]) if repeated else texts, "texts")

    facts = table(confirm(screen(stars, reps), texts), "facts")
    roots = connected_components(facts.where("linked").select("a", "b"))
    rest = table(_remaining(buckets, hubs, reps, roots, facts, stars, texts), "candidates")
    if rest.limit(1).count():
        linked = confirm(screen(rest, reps), texts).where("linked").select("a", "b")
        hub_roots, roots = roots, connected_components(_stars_of(roots).unionByName(linked))
        drop_table(hub_roots)
    drop_table(shared, buckets, hubs, stars, wanted, texts, facts, rest, reps)

    rooted = _rooted(classes, roots, "cls", "top_cls")
    whole = rooted.groupBy(F.col("top_cls").alias("t")).agg(F.min("source").alias("first"))
    known = rooted.join(whole, F.col("top_cls") == F.col("t")).select(F.col("set_a").alias("ca"), F.col("set_b").alias("cb"), "first")
    in_class = (F.col("set_a") == F.col("ca")) & (F.col("set_b") == F.col("cb")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = sets.select("doc_id", "version", "n_shingles", "set_a", "set_b").join(known, in_class, "left")
    component = F.coalesce("first.doc_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    stands = (F.col("first").isNull() | (F.struct("doc_id", "version") == F.col("first"))).alias("stands")
    return out.select("doc_id", "version", "n_shingles", component.alias("component_id"), kept, stands)


def _repeats(sets: DataFrame) -> bool:
    return sets.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count() > 0


def _stars_of(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("u").alias("a"), F.col("root").alias("b"))


def _rooted(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    out = rows.join(roots.select(F.col("u").alias("_u"), F.col("root").alias("_root")), F.col(node) == F.col("_u"), "left")
    return out.withColumn(name, F.coalesce("_root", node)).drop("_u", "_root")


def own_shingles(texts: DataFrame) -> DataFrame:
    """(cls, n, own): the size of each text's shingle set, and how many of its shingles no other text here has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lower=True):
                grams, offsets = shingles(block)
                doc = np.repeat(np.arange(block.n_docs), np.diff(offsets))
                _, later = repeats(grams ^ mix(np.arange(block.n_docs, dtype=np.uint64) + np.uint64(1))[doc])
                rows = pa.array(block.first + doc[~later])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(grams[~later].view(np.int64))], ["cls", "shingle"])

    listed = arrow_map(texts.select("cls", "text"), run, "cls long, shingle long")
    met = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("cls"))
    sizes = listed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    alone = met.where("n = 1").groupBy(F.col("cls").alias("alone_cls")).agg(F.count(F.lit(1)).alias("own"))
    out = sizes.join(alone, F.col("cls") == F.col("alone_cls"), "left")
    return out.select("cls", "n", F.coalesce("own", F.lit(0)).alias("own"))


def _remaining(buckets: DataFrame, hubs: DataFrame, reps: DataFrame, roots: DataFrame, facts: DataFrame, tested: DataFrame, texts: DataFrame) -> DataFrame:
    """Untested pairs across components in buckets that hold several, without those that bounds rule out in the join.

    Two texts share at most what either shares with others at all. And with their hub's set h, they
    share the part of h that both have, plus at most what both added and share with others; what
    either lacks of h is counted from bitmaps, never too high. Both bounds are exact.
    """
    rooted = _rooted(buckets.select("key", "cls"), roots, "cls", "root")
    mixed = rooted.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = mixed.where(F.col("low") != F.col("high")).select("k")
    rows = table(rooted.join(mixed, F.col("key") == F.col("k"), "left_semi"), "mixed")
    members = rows.select(F.col("cls").alias("m")).distinct()
    bounds = own_shingles(texts.join(members, F.col("cls") == F.col("m"), "left_semi")).withColumnRenamed("cls", "bound_cls")
    known = reps.select(F.col("cls").alias("r"), "sketch_a", "sketch_b").join(bounds, F.col("r") == F.col("bound_cls")).drop("bound_cls")
    # whoever can't reach the threshold with anyone leaves before pairs are looked at; pairs with hubs are tested
    rows = rows.join(known, F.col("cls") == F.col("r")).drop("r").where(100 * (F.col("n") - F.col("own")) >= PERCENT * F.col("n"))
    rows = rows.join(hubs, F.col("key") == F.col("k")).drop("k").where("cls <> hub")
    rows = rows.join(facts.select("a", "b", "n_a", "shared", *MAPS), (F.col("hub") == F.col("a")) & (F.col("cls") == F.col("b")), "left")
    figures = {
        "key": F.col("key"), "cls": F.col("cls"), "root": F.col("root"), "a": F.col("sketch_a"), "b": F.col("sketch_b"), "n": F.col("n"),
        "most": F.col("n") - F.col("own"), "hub": F.col("n_a"), "added": F.col("n") - F.col("shared") - F.col("own"), **{m: F.col(m) for m in MAPS},
    }
    x, y = (rows.select(*(c.alias(f"{side}_{name}") for name, c in figures.items())) for side in ("x", "y"))
    differ = F.bit_count(F.col("x_a").bitwiseXOR(F.col("y_a"))) + F.bit_count(F.col("x_b").bitwiseXOR(F.col("y_b")))
    reach = lambda most: 100 * most >= PERCENT * (F.col("x_n") + F.col("y_n") - most)
    lacked = F.lit(0)
    for m in MAPS:
        lacked = lacked + F.bit_count(F.col(f"x_{m}").bitwiseOR(F.col(f"y_{m}")))
    by_hub = F.coalesce(reach(F.col("x_hub") - lacked + F.least("x_added", "y_added")), F.lit(True))
    by_hub = F.when(F.col("x_hub").isNull() | F.col("y_hub").isNull(), F.lit(True)).otherwise(by_hub)
    across = (F.col("x_key") == F.col("y_key")) & (F.col("x_root") < F.col("y_root"))
    pairs = x.join(y, across & reach(F.least("x_most", "y_most")) & (differ <= HASHES - LEAST_BITS) & by_hub)
    pairs = pairs.select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))
    return pairs.join(done, (F.least("a", "b") == F.col("ta")) & (F.greatest("a", "b") == F.col("tb")), "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component, with all their columns; of equal rows of one id, one."""
    d, v = fresh(docs, "gone_doc", "gone_version")
    found = table(_components(docs, id_col, text_col), "components")
    gone = table(found.where(~F.col("stands")).select(F.col("doc_id").alias(d), F.col("version").alias(v)).distinct(), "gone")
    same = (docs[id_col].cast("long") == F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(v))
    out = docs.join(small(gone, gone.count(), MAX_BROADCAST_ROWS), same, "left_anti")
    return out.dropDuplicates([id_col, text_col]) if _repeats(found.where(F.col("doc_id").isNotNull())) else out
