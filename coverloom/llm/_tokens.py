"""Token ids of whole texts, with one encoder call for each distinct unit that a worker meets.

The tokenizer of `word_bpe_49k.json` lower-cases, drops white space, and always splits between a
letter or digit and the punctuation after it. So the ids of a text are the ids, one after another, of
its words without the punctuation at their ends, and of that punctuation. Units are told apart by
64-bit hashes of their bytes. Units of plain letters go straight to the tokenizer's BPE model, which
is where the whole tokenizer sends them unchanged; all others go through the whole tokenizer. The
store of known units is emptied when it exceeds `MAX_KNOWN`.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa

from ._text import _LOWER, Block, blocks, ranges

MAX_KNOWN = 500_000
ENCODE_BYTES = 1 << 19
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(b",.;:!?|)")] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True


def _byte_names() -> list[str]:
    """The characters by which byte-level models name the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in names]
    return [names[b] if b in names else chr(256 + rest.index(b)) for b in range(256)]


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document offsets of words, cut before the punctuation at their ends."""
    data, starts, ends = block.data, block.starts, block.ends
    cut = ends.copy()
    run = np.flatnonzero(_TAIL[data[cut - 1]]) if len(cut) else cut
    while len(run):
        cut[run] -= 1
        run = run[(cut[run] > starts[run]) & _TAIL[data[cut[run] - 1]]]
    split = np.flatnonzero((cut < ends) & (cut > starts))
    before = data[cut[split] - 1]
    lead = data[np.maximum(cut[split] - 2, 0)]
    letter = _ALNUM[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (cut[split] - 2 >= starts[split]))
    split = split[letter]
    more = np.zeros(len(starts) + 1, dtype=np.int64)
    more[split + 1] = 1
    shift = np.cumsum(more)
    total = len(starts) + len(split)
    out_starts, out_ends = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64)
    at = np.arange(len(starts)) + shift[:-1]
    out_starts[at], out_ends[at] = starts, ends
    out_ends[at[split]] = cut[split]
    out_starts[at[split] + 1], out_ends[at[split] + 1] = cut[split], ends[split]
    return out_starts, out_ends, block.word_offsets + shift[block.word_offsets]


class WordEncoder:
    """Ids for the words of a block; keeps the ids of the units it has seen."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.names = dict(enumerate(_byte_names())) | {0x20: " "}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.where = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain units and how many each has: the last id of each ends a word."""
        text = b" ".join(words).decode("latin-1").translate(self.names)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(words):
            raise ValueError("a unit of plain letters isn't one word of the model")
        return ids, np.diff(last, prepend=-1)

    def _ids_of_any(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode([w.decode("utf-8", "replace") for w in words], is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, dtype=np.int32), np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(words))

    def _learn(self, hashes: np.ndarray, words: list[bytes], plain: np.ndarray) -> None:
        order = np.argsort(~plain, kind="stable")
        ranked, n = [words[i] for i in order], int(plain.sum())
        parts = [self._ids(ranked[low : min(low + 2000, n)]) for low in range(0, n, 2000)]
        parts += [self._ids_of_any(ranked[low : low + 2000]) for low in range(n, len(words), 2000)]
        size = np.concatenate([x for _, x in parts])
        where = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *(x for x, _ in parts)])
        hashes = hashes[order]
        order = np.argsort(hashes)
        hashes = hashes[order]
        at = np.searchsorted(self.known, hashes)
        self.known, self.where, self.size = np.insert(self.known, at, hashes), np.insert(self.where, at, where[order]), np.insert(self.size, at, size[order])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and where each document's begin."""
        raw = block.data.tobytes()
        if b"<|" not in raw:  # else a special token's name could arise
            block = replace(block, data=_LOWER[block.data])
            raw = block.data.tobytes()
        starts, ends, offsets = units(block)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(block.n_docs + 1, dtype=np.int64)
        unique, first, back = np.unique(block.span_hashes(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = at >= len(self.known)
        new[~new] = self.known[at[~new]] != unique[~new]
        if new.any():
            if len(self.known) + int(new.sum()) > MAX_KNOWN:
                self.clear()
                new[:] = True
            s, e = starts[first[new]], ends[first[new]]
            plain = self._plain(block.data)
            plain = plain[e] - plain[s] == e - s
            self._learn(unique[new], [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], plain)
            at = np.searchsorted(self.known, unique)
        sizes = self.size[at][back]
        ids = self.ids[ranges(self.where[at][back], sizes)]
        return ids, np.concatenate(([0], np.cumsum(sizes)))[offsets]

    @staticmethod
    def _plain(data: np.ndarray) -> np.ndarray:
        """Running count of bytes of a-z and of the lower-case letters U+00E0 to U+00FF."""
        lead = np.concatenate((data[:-1] == 0xC3, [False])) & np.concatenate(((data[1:] >= 0xA0) & (data[1:] <= 0xBF) & (data[1:] != 0xB7), [False]))
        ok = ((data >= 0x61) & (data <= 0x7A)) | lead
        ok[1:] |= lead[:-1]
        return np.concatenate(([0], np.cumsum(ok)))


_ENCODERS: dict[str, WordEncoder] = {}


def encode_batch(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of documents: first, last, ids with end_id after each document, and where each begins."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    encoder = _ENCODERS[path]
    for block in blocks(texts, limit=ENCODE_BYTES):
        ids, offsets = encoder.encode(block)
        out = np.insert(ids, offsets[1:], end_id)
        yield block.first, block.last, out.astype(np.int32, copy=False), offsets + np.arange(block.n_docs + 1)


def crc32s(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), dtype=np.int64, count=len(offsets) - 1)
