"""Operator 7: greedy word-piece lengths from a linear longest-match automaton.

The vocabulary becomes two tries, of pieces that begin a word and of pieces that continue one. Each
node has a failure link and the number of pieces popped when it is followed, both worked out once, so
one pass over a word's bytes counts its pieces without building them. Words of up to LONG_WORD bytes of a
block run through the automaton side by side, longer ones alone; each distinct word of a block runs once.

A word with no such split is one unknown token. Defined cases: a null or empty text has no words and
no tokens; a very long text or word is read whole in one pass; repeated rows and rows of equal id are counted
row by row; a null id stays null; an empty table gives no rows; other columns never take part, whatever
their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import arrow_map
from ._text import blocks, per_doc

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a word; longer ones run alone.
LONG_WORD = 64
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word (written with a leading space in the file) and pieces that continue one."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    to_byte = byte_symbols()
    pieces = [bytes(to_byte[c] for c in t) for t in vocabulary if all(c in to_byte for c in t)]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]


class LongestMatch:
    """Node 0 begins a word, node 1 continues one; arcs are sorted by node * 256 + byte."""

    def __init__(self, begin: list[bytes], inner: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, begin), (1, inner)):
            for piece in pieces:
                at = root
                for b in piece:
                    if b not in children[at]:
                        children[at][b] = len(children)
                        children.append({})
                        final.append(False)
                    at = children[at][b]
                final[at] = at > 1
        n = len(children)
        fail, popped = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        queue = [0, 1]
        for u in queue:
            for b, v in children[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], popped[v] = 1, 1
                    continue
                z, pops = int(fail[u]), int(popped[u])
                while z >= 0 and b not in children[z]:
                    pops += int(popped[z])
                    z = int(fail[z])
                if z >= 0:
                    fail[v], popped[v] = children[z][b], pops
        arcs = sorted((u * 256 + b, v) for u in range(n) for b, v in children[u].items())
        self.keys, self.to = np.array([k for k, _ in arcs], dtype=np.int64), np.array([v for _, v in arcs], dtype=np.int32)
        self.fail, self.popped = fail, popped
        self._arcs: tuple | None = None

    def _child(self, nodes: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = nodes.astype(np.int64) * 256 + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; -1 if it has no split."""
        out = np.empty(len(starts), dtype=np.int64)
        brief = ends - starts <= LONG_WORD
        out[brief] = self._side_by_side(data, starts[brief], ends[brief])
        for i in np.flatnonzero(~brief):
            out[i] = self._alone(data[starts[i] : ends[i]])
        return out

    def _alone(self, word: np.ndarray) -> int:
        """Pieces of one long word, in steps that grow with its bytes alone."""
        if self._arcs is None:
            self._arcs = (dict(zip(self.keys.tolist(), self.to.tolist(), strict=True)), self.fail.tolist(), self.popped.tolist())
        arcs, fail, popped = self._arcs
        node = total = 0
        for b in word.tobytes():
            to = arcs.get(node * 256 + b, -1)
            while to < 0:
                total, node = total + popped[node], fail[node]
                if node < 0:
                    return -1
                to = arcs.get(node * 256 + b, -1)
            node = to
        while node != 1:
            total, node = total + popped[node], fail[node]
            if node < 0:
                return -1
        return total

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        node, total = np.zeros(len(starts), dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
        alive = np.ones(len(starts), dtype=bool)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            run = np.flatnonzero(alive[: np.searchsorted(-lengths, -i, side="left")])
            b = data[starts[run] + i].astype(np.int64)
            while len(run):
                to = self._child(node[run], b)
                node[run[to >= 0]] = to[to >= 0]
                run, b = run[to < 0], b[to < 0]
                run, b = self._pop(run, b, node, total, alive)
        run = np.flatnonzero(alive & (node != 1))
        while len(run):
            run, _ = self._pop(run, run, node, total, alive)
            run = run[node[run] != 1]
        out = np.empty(len(starts), dtype=np.int64)
        out[order] = np.where(alive, total, -1)
        return out

    def _pop(self, run: np.ndarray, b: np.ndarray, node: np.ndarray, total: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follows failure links; words without one die."""
        at = node[run]
        dead = self.fail[at] < 0
        alive[run[dead]] = False
        run, b, at = run[~dead], b[~dead], at[~dead]
        total[run] += self.popped[at]
        node[run] = self.fail[at]
        return run, b


_AUTOMATA: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatch(*word_pieces(path))
    return _AUTOMATA[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, word-piece tokens and unknown words of every whole text; one pass, no shuffle."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for block in blocks(batch.column(1), limit=1 << 22):
                _, first, back = np.unique(block.word_hashes(), return_index=True, return_inverse=True)
                pieces = machine.count(block.data, block.starts[first], block.ends[first])[back]
                sums = [block.n_words.astype(np.int64), per_doc(np.abs(pieces), block.word_offsets), per_doc(pieces < 0, block.word_offsets)]
                columns = [pa.array(x) for x in sums]
                yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.n_docs), *columns], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return arrow_map(slim, run, SCHEMA)
