"""Word and hash kernels in numpy over Arrow string buffers.

A word is a maximal run of bytes outside space and 0x09-0x0D. Texts are processed in blocks of whole
documents, so that the working arrays stay within a few megabytes whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.RandomState(20240611)
_BYTE_VALUE = _RNG.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _grow(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up) if len(self.up) < 1 << 22 else n)
            self.up, self.down = (self._grow(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close inputs give unrelated hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Documents `first` to `last` of a batch: bytes, and the words of each document."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return self.last - self.first

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans in ascending order; the length takes part.

        Spans are taken BLOCK_BYTES at a time, so that the 64-bit prefix sums stay small.
        """
        out = np.empty(len(starts), dtype=np.uint64)
        low = 0
        while low < len(starts):
            base = starts[low]
            high = max(low + 1, int(np.searchsorted(starts, base + BLOCK_BYTES)))
            s, e = starts[low:high] - base, ends[low:high] - base
            part = self.data[base : base + int(e.max())]
            up, down = _BYTE_POWERS.upto(len(part) + 1)
            prefix = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[part] * up[:-1], out=prefix[1:])
            out[low:high] = mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
            low = high
        return out

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets, data


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents of about `limit` bytes; a longer document is a block of its own."""
    offsets, data = text_buffers(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        own = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        yield _words(first, last, _LOWER[part] if lower else part, own)
        first = last


def _words(first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> Block:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside[1:] & (~inside[:-1] | edge)
    finishes = inside[:-1] & (~inside[1:] | edge)
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
    return Block(first, last, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def gram_hashes(hashes: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of n words that lies in one document."""
    total = len(hashes)
    up, down = _WORD_POWERS.upto(total + 1)
    prefix = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:-1], out=prefix[1:])
    sizes = np.maximum(np.diff(word_offsets) - n + 1, 0)
    at = ranges(word_offsets[:-1], sizes)
    return at, mix((prefix[at + n] - prefix[at]) * down[at])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers start, start+1, ... of each range, one after another."""
    total = int(sizes.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def covered(starts: np.ndarray, length: int | np.ndarray, total: int) -> np.ndarray:
    """Which of `total` positions lie in a run [start, start + length)."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice, later = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
    twice[order], later[order] = same[1:] | same[:-1], same[:-1]
    return twice, later


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of floating values over [offsets[d], offsets[d+1]), each on its own, so that neighbours don't change its digits."""
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some])
    return out


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[d], offsets[d+1])."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
