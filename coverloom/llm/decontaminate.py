"""Operator 9: benchmark decontamination with a distributed positional inverted index.

The index stores postings of training tokens: an adjacent word pair of a document (a biword; a single
word for one-word items) at its position, kept where a benchmark item has that pair. A benchmark
window occurs where the lists of all its terms, adjusted by their offsets, intersect. Windows start
from their rarest term by posting count, so frequent terms are only looked up at the few places that a
rare one leaves. DataFrame operations only; the text is read once and never shuffled.

Proximity matches come from postings of the benchmark's single words: a window is near where SPAN words
of a document hold all of its distinct words but a share of MISSING, in any order. Such a place holds one
of the window's rarest words (one more than may be missing), so only their postings open places, and the
other words are looked up around those. `contamination` judges by exact windows; `matches` has both kinds.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. Defined cases: a null or
empty text has no words and is never contaminated; an item without words has no window, and items with
equal texts or windows all count; rows with equal ids are judged on their own texts; of a very
long text only postings are shuffled; an empty table on either side gives no hits; other columns never take
part, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import fresh, small, table

WINDOW = 10
SPAN = 15
MISSING = 0.2
MAX_BROADCAST_ROWS = 1_000_000
_GAPS = "".join(chr(c) for c in (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)) if c != 0x20)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    spaced = F.translate(text, string.ascii_uppercase + _GAPS, string.ascii_lowercase + " " * len(_GAPS))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def terms(w: Column) -> Column:
    """At each position the hash of the word and the next one; at the last, of the word alone."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(window_id, item_id, size, words): each run of `window` words of an item, or a shorter whole item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, window).alias("words"))
    return cut.select(F.xxhash64(F.array_join("words", " ")).alias("window_id"), "item_id", F.size("words").alias("size"), "words").distinct()


def window_terms(wins: DataFrame) -> DataFrame:
    """(window_id, size, offset, term, single): the terms that an occurrence needs, a single word only where the window is one word."""
    distinct = wins.select("window_id", "size", "words").dropDuplicates(["window_id"])
    pairs = distinct.select("window_id", "size", F.posexplode(terms(F.col("words"))).alias("offset", "term"))
    pairs = pairs.where((F.col("offset") < F.col("size") - 1) | (F.col("size") == 1))
    return pairs.select("window_id", "size", "offset", "term", (F.col("size") == 1).alias("single"))


def build_index(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings (doc_id, version, n_words, pos, term); each document also has one row, with term null, at pos -1.

    `needed` holds the terms worth posting: (term, single). version tells texts of one id apart.
    """
    rows = needed.select("term", "single").distinct()
    n = rows.count()
    # the pair and the word alone stand side by side only where some item is one word
    has_single = rows.where("single").limit(1).count() > 0
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), words(F.col(text_col)).alias("w"))
    if has_single:
        base = base.withColumn("alone", F.transform("w", lambda a: F.xxhash64(a, F.lit(None).cast("string"))))
    exploded = base.select("doc_id", "version", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("long")), terms(F.col("w")))).alias("at", "term"))
    if has_single:
        alone = base.select("doc_id", "version", F.size("w").alias("n_words"), F.posexplode("alone").alias("at", "term")).withColumn("at", F.col("at") + 1)
        alone = alone.join(small(rows.where("single").select("term"), n, MAX_BROADCAST_ROWS), "term", "left_semi").select(exploded.columns)
    wanted = rows.select(F.col("term").alias("known")).distinct()
    kept = exploded.join(small(wanted, n, MAX_BROADCAST_ROWS), F.col("term") == F.col("known"), "left").where((F.col("at") == 0) | F.col("known").isNotNull()).drop("known")
    if has_single:
        kept = kept.unionByName(alone)
    return kept.select("doc_id", "version", "n_words", (F.col("at") - 1).alias("pos"), "term")


def occurrences(postings: DataFrame, wterms: DataFrame) -> DataFrame:
    """(window_id, size, doc_id, version, start) of every exact occurrence, from the rarest terms on."""
    lists = postings.where(F.col("term").isNotNull())
    counts = lists.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = wterms.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_window = W.partitionBy("window_id")
    ranked = ranked.withColumn("rank", F.row_number().over(by_window.orderBy("n", "offset"))).withColumn("least", F.min("n").over(by_window))
    ranked = table(ranked.where(F.col("least") > 0).select("window_id", "size", "offset", "term", "rank"), "window-terms")
    n = ranked.count()
    first = small(ranked.where(F.col("rank") == 1).select("window_id", "size", F.col("offset").alias("first_offset"), "term"), n, MAX_BROADCAST_ROWS)
    starts = lists.join(first, "term").select("window_id", "size", "doc_id", "version", (F.col("pos") - F.col("first_offset")).alias("start"))
    starts = starts.where(F.col("start") >= 0).distinct()
    # the next rarest list thins the starts before all others are asked for
    for low, high in ((2, 2), (3, None)):
        span = (F.col("rank") >= low) & (F.col("rank") <= high if high else F.lit(True))
        rest = ranked.where(span).select(F.col("window_id").alias("wid"), "offset", F.col("term").alias("t"))
        asked = starts.join(small(rest, n, MAX_BROADCAST_ROWS), F.col("window_id") == F.col("wid")).withColumn("p", F.col("start") + F.col("offset"))
        at = lists.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.col("pos").alias("pp"), F.col("term").alias("tt"))
        hit = asked.join(at, (F.col("d").eqNullSafe(F.col("doc_id"))) & (F.col("v") == F.col("version")) & (F.col("pp") == F.col("p")) & (F.col("tt") == F.col("t")), "left_semi")
        met = hit.groupBy("window_id", "size", "doc_id", "version", "start").agg(F.count(F.lit(1)).alias("met"))
        need = F.greatest(F.least(F.col("size") - 1, F.lit(high or 1 << 30)) - (low - 1), F.lit(0))
        short = starts.where(F.greatest(F.col("size") - 1, F.lit(1)) < low)
        starts = met.where(F.col("met") == need).drop("met").unionByName(short)
    return starts


def word_postings(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, pos, word): every place of a word that a benchmark window has."""
    needed = wins.select(F.explode("words").alias("known")).distinct()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), words(F.col(text_col)).alias("w")).dropDuplicates(["doc_id", "version"])
    placed = base.select("doc_id", "version", F.posexplode("w").alias("pos", "word"))
    return placed.join(small(needed, needed.count(), MAX_BROADCAST_ROWS), F.col("word") == F.col("known"), "left_semi")


def proximity(postings: DataFrame, wins: DataFrame, span: int = SPAN, missing: float = MISSING) -> DataFrame:
    """(window_id, doc_id, version, start, end, n_words): places of at most `span` words with enough of a window's distinct words."""
    asked = wins.select("window_id", F.array_distinct("words").alias("words")).dropDuplicates(["window_id"])
    asked = asked.withColumn("free", F.floor(F.size("words") * missing).cast("int")).withColumn("need", F.size("words") - F.col("free"))
    asked = asked.select("window_id", "free", "need", F.explode("words").alias("word"))
    counts = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = asked.join(counts, "word", "left").withColumn("rank", F.row_number().over(W.partitionBy("window_id").orderBy(F.coalesce("n", F.lit(0)), "word")))
    ranked = table(ranked, "window-words")
    n = ranked.count()
    opening = ranked.where(F.col("rank") <= F.col("free") + 1).select("window_id", "word")
    opened = postings.join(small(opening, n, MAX_BROADCAST_ROWS), "word").select("window_id", "doc_id", "version", F.col("pos").alias("at")).distinct()
    around = opened.withColumn("cell", F.explode(F.array(*(F.floor(F.col("at") / span) + k for k in (-1, 0, 1)))))
    rest = ranked.select(F.col("window_id").alias("wid"), F.col("word").alias("wanted"), "need")
    around = around.join(small(rest, n, MAX_BROADCAST_ROWS), F.col("window_id") == F.col("wid"))
    lists = postings.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "pos", "word", F.floor(F.col("pos") / span).alias("c"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("cell") == F.col("c")) & (F.col("wanted") == F.col("word"))
    met = around.join(lists, same & (F.abs(F.col("pos") - F.col("at")) < span))
    # 2 * span - 1 places at most
    met = met.groupBy("window_id", "doc_id", "version", "at", "need").agg(F.array_sort(F.collect_set(F.struct("pos", "word"))).alias("hits"))
    within = lambda s: F.filter("hits", lambda x: (x["pos"] >= s) & (x["pos"] < s + span))
    firsts = F.transform(F.filter("hits", lambda x: (x["pos"] <= F.col("at")) & (x["pos"] > F.col("at") - span)), lambda x: x["pos"])
    held = F.transform(firsts, lambda s: F.struct(F.size(F.array_distinct(F.transform(within(s), lambda x: x["word"]))).alias("n_words"), (-s).alias("back"), F.array_max(F.transform(within(s), lambda x: x["pos"])).alias("last")))
    best = met.withColumn("best", F.array_max(held)).where(F.col("best.n_words") >= F.col("need"))
    return best.select("window_id", "doc_id", "version", (-F.col("best.back")).alias("start"), (F.col("best.last") + 1).alias("end"), "best.n_words").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN, missing: float = MISSING, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, version, item_id, kind, start, end): every exact phrase and every proximity match; end is after the last word."""
    wins = table(windows(benchmark, window, item_id_col, item_text_col), "windows")
    wterms = window_terms(wins)
    exact = occurrences(table(build_index(docs, wterms, id_col, text_col), "postings"), wterms).select("window_id", "doc_id", "version", F.lit("phrase").alias("kind"), "start", (F.col("start") + F.col("size")).alias("end"))
    near = proximity(table(word_postings(docs, wins, id_col, text_col), "word-postings"), wins, span, missing).select("window_id", "doc_id", "version", F.lit("proximity").alias("kind"), "start", "end")
    return exact.unionByName(near).join(wins.select("window_id", "item_id"), "window_id").select("doc_id", "version", "item_id", "kind", "start", "end").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items_sha256, contaminated, version."""
    wins = table(windows(benchmark, window, item_id_col, item_text_col), "windows")
    wterms = window_terms(wins)
    postings = table(build_index(docs, wterms, id_col, text_col), "postings", **{"parquet.writer.version": "PARQUET_2_0"})
    found = table(occurrences(postings, wterms), "occurrences")
    end = F.col("start") + F.col("size")
    before = F.max(end).over(W.partitionBy("doc_id", "version").orderBy("start", "size").rowsBetween(W.unboundedPreceding, -1))
    spans = found.select("doc_id", "version", "start", "size").distinct().withColumn("new", F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0)))
    hits = spans.groupBy("doc_id", "version").agg(F.sum("new").cast("long").alias("n_hit"))
    pairs = found.select("window_id", "doc_id", "version").distinct().join(wins.select("window_id", "item_id"), "window_id")
    items = pairs.groupBy("doc_id", "version").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    both = hits.join(items, hits["doc_id"].eqNullSafe(items["doc_id"]) & (hits["version"] == items["version"])).select(hits["doc_id"].alias("d"), hits["version"].alias("v"), "n_hit", "items")
    rows = postings.where(F.col("pos") == -1).select("doc_id", "version", "n_words")
    out = rows.join(both, rows["doc_id"].eqNullSafe(both["d"]) & (rows["version"] == both["v"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "version")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without any benchmark window, with all their columns."""
    d, v = fresh(docs, "bad_doc", "bad_version")
    found = contamination(docs, benchmark, window, id_col, text_col).where("contaminated")
    bad = found.select(F.col("doc_id").alias(d), F.col("version").alias(v)).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs[text_col]) == F.col(v))
    return docs.join(bad, same, "left_anti")
