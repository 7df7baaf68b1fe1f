"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie over bytes. Greedy longest-match splitting of a
word never looks back: where the trie has no edge for the next byte, the failure
link of the node leads to the node of the bytes that stay behind the greedy
pieces now certain, and the node's popped-token count says how many those are. Both are
precomputed, so a word's number of pieces is a sum along its bytes and no piece is
ever built. Here failures are also resolved ahead of time: ``step[node, byte]`` holds the
next node and the pieces popped on the way, so every byte is one look-up, and all
words of a slice go in step.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A
vocabulary marks word ends by a suffix (``</w>``) or continuations by a prefix (``##``).
A word that the pieces can't cover counts as one unknown token.

Cases: null, empty and blank texts have 0 words and tokens; rows that share a doc_id
count each for itself; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import document_batches, lean
from .textkernel import LOWER, Scan, as_bytes, slices

END = 256
SYMBOLS = 257
_COUNT = 20
_NODE = (1 << _COUNT) - 1


def byte_pieces(path: str, suffix: str = "</w>") -> list[tuple[bytes, bool]]:
    """(bytes, ends a word) of a byte-level vocabulary file of the tokenizers library.

    Such files spell every byte as one printable character: those of Latin-1 that
    print as themselves, the others counted up from U+0100.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelling = {chr(b): b for b in shown}
    spelling |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = []
    for piece in vocabulary:
        ends = piece.endswith(suffix) and len(piece) > len(suffix)
        body = piece[: -len(suffix)] if ends else piece
        if body and all(c in spelling for c in body):
            out.append((bytes(spelling[c] for c in body), ends))
    return out


class LongestMatch:
    """The automaton of some pieces.

    ``pieces`` are symbol sequences allowed at a word's begin, ``later`` those allowed
    behind (the same if None). With ``mark_end`` every word is followed by END, and END
    alone is a piece that counts 0: a piece without the mark may end a word too.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]], later: Iterable[tuple[int, ...]] | None = None, mark_end: bool = False):
        self.mark_end = mark_end
        child: list[dict[int, int]] = [{}]
        final = [False]

        def insert(root: int, piece) -> None:
            at = root
            for symbol in piece:
                if symbol not in child[at]:
                    child[at][symbol] = len(child)
                    child.append({})
                    final.append(False)
                at = child[at][symbol]
            final[at] = True

        for piece in pieces:
            insert(0, piece)
        if mark_end:
            insert(0, (END,))
        self.later = 0
        if later is not None:
            self.later = len(child)
            child.append({})
            final.append(False)
            for piece in later:
                insert(self.later, piece)
        n = len(child)
        if n >= _NODE:
            raise ValueError("the vocabulary has too many nodes")
        dead = self.dead = n
        fail, pops = np.full(n + 1, dead, np.int64), np.zeros(n + 1, np.int64)
        step = np.full((n + 1, SYMBOLS), dead, np.int32)
        roots = {0, self.later}
        level = [r for r in roots]
        edges = [(r, s, c) for r in roots for s, c in child[r].items()]
        for r in level:
            for symbol, c in child[r].items():
                step[r, symbol] = c
        # Level by level: a failure leads to a shallower node, whose row is ready.
        while edges:
            following = []
            for u, symbol, v in edges:
                if final[v]:
                    fail[v], pops[v] = self.later, int((u, symbol) != (0, END))
                elif u not in roots and fail[u] != dead:
                    packed = int(step[fail[u], symbol])
                    if packed & _NODE != dead:
                        fail[v], pops[v] = packed & _NODE, pops[u] + (packed >> _COUNT)
                if fail[v] != dead:
                    row = step[fail[v]]
                    step[v] = np.where(row & _NODE == dead, dead, row + (pops[v] << _COUNT))
                for s, c in child[v].items():
                    step[v, s] = c
                    following.append((v, s, c))
            edges = following
        # Pieces left in a node when its word ends; -1: they don't cover it.
        left = np.full(n + 1, -1, np.int64)
        for r in roots:
            left[r] = 0
        for v in range(n):
            at, total, path = v, 0, 0
            while at not in roots and fail[at] != dead and path <= n:
                total, at, path = total + int(pops[at]), int(fail[at]), path + 1
            if at in roots:
                left[v] = total
        self.step, self.left, self.fail, self.pops = step, left, fail, pops

    def count(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of every word, and whether it is unknown."""
        node, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        flat = self.step.ravel()
        live, at = np.arange(len(start)), start.copy()
        size = end - start
        i = 0
        while len(live):
            packed = flat[node[live] * SYMBOLS + buf[at[live] + i]]
            node[live] = packed & _NODE
            total[live] += packed >> _COUNT
            i += 1
            live = live[(size[live] > i) & (node[live] != self.dead)]
        if self.mark_end:
            packed = flat[node * SYMBOLS + END]
            node, total = (packed & _NODE).astype(np.int64), total + (packed >> _COUNT)
        rest = self.left[node]
        unknown = (rest < 0) | (node == self.dead)
        return np.where(unknown, 1, total + rest), unknown


def from_suffix_vocabulary(pieces: Iterable[tuple[bytes, bool]]) -> LongestMatch:
    """Automaton of (bytes, ends a word) pieces."""
    return LongestMatch([(*body, END) if ends else tuple(body) for body, ends in pieces], mark_end=True)


def from_prefix_vocabulary(pieces: Iterable[str], prefix: str = "##") -> LongestMatch:
    """Automaton of pieces whose continuations are spelled with a prefix."""
    pieces = list(pieces)
    return LongestMatch([tuple(p.encode()) for p in pieces if not p.startswith(prefix)], [tuple(p[len(prefix) :].encode()) for p in pieces if p.startswith(prefix) and len(p) > len(prefix)])


_CACHE: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    """This Python worker's automaton of a vocabulary file."""
    if path not in _CACHE:
        _CACHE[path] = from_suffix_vocabulary(byte_pieces(path))
    return _CACHE[path]


def counts(machine: LongestMatch, texts: list[bytes]) -> np.ndarray:
    """(words, tokens, unknown words) of each text."""
    out = np.zeros((len(texts), 3), np.int64)
    for lo, hi in slices(texts):
        scan = Scan(texts[lo:hi])
        tokens, unknown = machine.count(LOWER[scan.buf], scan.start, scan.end)
        edge = np.concatenate([[0], np.cumsum(tokens)])[scan.first]
        missing = np.concatenate([[0], np.cumsum(unknown)])[scan.first]
        out[lo:hi, 0], out[lo:hi, 1], out[lo:hi, 2] = np.diff(scan.first), np.diff(edge), np.diff(missing)
    return out


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        machine = automaton(path)
        for batch in batches:
            got = counts(machine, as_bytes(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, i]) for i in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    document_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long, n_unknown long")
