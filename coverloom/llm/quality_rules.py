"""Operator 4: repetition rules for text quality.

Rolling hashes of several n-gram lengths give, for each document, how many characters lie inside
n-grams and lines that the document repeats. A document fails the base rules (too few words, or too
many words in repeated 8-word windows) or one of the repetition limits below.

Defined cases: a null or empty text, or one of white space only, has zero counts and fails the base
rules; repeated rows and repeated ids are judged row by row; an empty table gives an empty result;
other columns never take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import arrow_map
from ._text import Block, blocks, covered, gram_hashes, mix, per_doc, repeats

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
#: Limits on the share of word characters in later occurrences of n-grams, and in later equal lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHAR_LIMIT = 0.20

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_line_char_share double, " + ", ".join(f"dup_{n}gram_share double" for n in NGRAM_LIMITS)


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lines, and the first line of each document."""
    after = np.flatnonzero(block.data == 0x0A) + 1
    doc = np.searchsorted(block.offsets, after - 1, side="right") - 1
    starts = np.sort(np.concatenate((block.offsets[:-1], after)), kind="stable")
    breaks = np.bincount(doc, minlength=block.n_docs)
    return starts, np.concatenate(([0], np.cumsum(breaks + 1)))


def measure(block: Block) -> dict[str, np.ndarray]:
    """The figures of SCHEMA for each document of a block."""
    n_words, docs = block.n_words.astype(np.int64), block.word_doc()
    codepoints = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    chars = codepoints[block.ends] - codepoints[block.starts]
    word_chars = per_doc(chars, block.word_offsets)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_doc(_SYMBOL[block.data], block.offsets)}
    own = np.maximum(word_chars, 1)

    hashes = block.word_hashes()
    salt = mix(np.arange(block.n_docs, dtype=np.uint64) + np.uint64(1))
    for n in NGRAM_LIMITS:
        at, grams = gram_hashes(hashes, block.word_offsets, n)
        twice, later = repeats(grams ^ salt[docs[at]])
        if n == WINDOW:
            out["n_repeat_words"] = per_doc(covered(at[twice], n, len(hashes)), block.word_offsets)
        inside = covered(at[later], n, len(hashes))
        out[f"dup_{n}gram_share"] = per_doc(chars * inside, block.word_offsets) / own

    starts, first_line = _lines(block)
    line_doc = np.repeat(np.arange(block.n_docs), np.diff(first_line))
    last = np.zeros(len(starts), dtype=bool)
    last[first_line[1:] - 1] = True
    ends = np.where(last, block.offsets[line_doc + 1], np.concatenate((starts[1:], [0])) - 1)
    first_word = np.searchsorted(block.starts, starts)
    worded = np.searchsorted(block.starts, ends) > first_word
    rows = np.flatnonzero(worded)
    _, again = repeats(block.span_hashes(starts[rows], ends[rows]) ^ salt[line_doc[rows]])
    n_lines = np.bincount(line_doc[rows], minlength=block.n_docs)
    out["n_dup_lines"] = np.bincount(line_doc[rows[again]], minlength=block.n_docs).astype(np.int64)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(n_lines, 1)
    sums = np.concatenate(([0], np.cumsum(chars)))
    dup = rows[again]
    dup_chars = sums[np.searchsorted(block.starts, ends[dup])] - sums[first_word[dup]]
    out["dup_line_char_share"] = np.bincount(line_doc[dup], weights=dup_chars, minlength=block.n_docs) / own

    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * n_words)
    kept = ~out["base_failed"] & (out["dup_line_share"] <= LINE_LIMIT) & (out["dup_line_char_share"] <= LINE_CHAR_LIMIT)
    for n, limit in NGRAM_LIMITS.items():
        kept &= out[f"dup_{n}gram_share"] <= limit
    return out | {"kept": kept}


def repetition_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of figures and the verdict for each row of docs; one pass, no shuffle."""
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for block in blocks(batch.column(1)):
                got = measure(block)
                yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.n_docs), *(pa.array(got[n]) for n in names)], ["doc_id", *names])

    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return arrow_map(slim, run, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                yield batch.slice(block.first, block.n_docs).filter(pa.array(measure(block)["kept"]))

    return arrow_map(docs, run, docs.schema)
