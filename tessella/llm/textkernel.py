"""Vectorised word scanning over UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words are
hashed without building Python strings: with byte weights ``W`` and an odd base
``B``, the hash of bytes ``s..e`` is ``sum(W[b_i] * B^(i-s)) mod 2^64``, which is
one cumulative sum, one difference and one multiplication with ``B^-s``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
INK = np.ones(256, bool)
INK[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SIGN = np.zeros(256, bool)
SIGN[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
SLICE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


WEIGHT = seeded(256, 7)
WEIGHT_LOWER = WEIGHT[LOWER]
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least ``n``."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            step = np.full(size, _BASE, U64)
            step[0] = 1
            _POW = np.cumprod(step, dtype=U64)
            step[1:] = pow(_BASE, -1, 1 << 64)
            _INV = np.cumprod(step, dtype=U64)
    return _POW, _INV


def as_bytes(values: Sequence) -> list[bytes]:
    """Texts or byte strings (null: empty) as UTF-8."""
    return [b"" if v is None else v if isinstance(v, bytes) else v.encode("utf-8", "surrogatepass") for v in values]


def slices(texts: Sequence[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``limit`` bytes (or one text), so that temporaries stay small."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Scan:
    """Words of some texts: ``buf`` holds the texts with a blank behind each,
    ``start``/``end`` each word's bytes, ``first[d]..first[d+1]`` the words of text d."""

    __slots__ = ("buf", "base", "start", "end", "first")

    def __init__(self, texts: Sequence[bytes]):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        ink = np.empty(len(self.buf) + 1, bool)
        ink[0] = False
        np.take(INK, self.buf, out=ink[1:])
        edges = np.flatnonzero(ink[1:] != ink[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.base)

    def hashes(self, start=None, end=None, lower: bool = True):
        """64-bit hashes of the byte ranges (the words), A-Z lower-cased if ``lower``.
        A list of ends gives a list of hashes, from one pass over the bytes."""
        start = self.start if start is None else start
        many = isinstance(end, list)
        ends = end if many else [self.end if end is None else end]
        outs = [np.empty(len(start), U64) for _ in ends]
        table = WEIGHT_LOWER if lower else WEIGHT
        lo, n = 0, len(start)
        with np.errstate(over="ignore"):
            while lo < n:  # a text of any length passes in pieces that end at words
                at = int(start[lo])
                hi = max(lo + 1, int(np.searchsorted(start, at + 2 * SLICE)))
                stop = max(int(e[lo:hi].max()) for e in ends)
                power, inverse = powers(stop - at + 1)
                total = np.zeros(stop - at + 1, U64)
                np.cumsum(table[self.buf[at:stop]] * power[: stop - at], out=total[1:])
                s = start[lo:hi] - at
                for out, stops in zip(outs, ends, strict=True):
                    e = stops[lo:hi] - at
                    out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
                lo = hi
        return outs if many else outs[0]

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes without ASCII signs at either end (a word of signs stays as it is)."""
        s, e = self.start.copy(), self.end.copy()
        for at, step in ((e, -1), (s, 1)):
            live = np.flatnonzero(SIGN[self.buf[at - 1 if step < 0 else at]]) if len(s) else s
            while len(live):
                at[live] += step
                live = live[e[live] > s[live]]
                live = live[SIGN[self.buf[at[live] - 1 if step < 0 else at[live]]]]
        bare = e <= s
        s[bare], e[bare] = self.start[bare], self.end[bare]
        return s, e

    def text(self, i: int, start=None, end=None) -> bytes:
        s = self.start if start is None else start
        e = self.end if end is None else end
        return self.buf[s[i] : e[i]].tobytes()


_SHINGLE = seeded(64, 11) | U64(1)


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; with fewer words, the
    whole sequence as one; without words, none."""
    n = len(word)
    run = np.zeros(max(0, n - k + 1), U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            run += word[j : j + len(run)] * _SHINGLE[j % 64]
        run = mix(run)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(run[a : b - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s if keep.all() else s[keep])
            elif b > a:
                whole = (word[a:b] * _SHINGLE[: b - a]).sum(dtype=U64) + U64(b - a)
                out.append(mix(np.array([whole], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def doc_sets(texts: Sequence[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, shingle set) of each text."""
    for lo, hi in slices(texts):
        scan = Scan(texts[lo:hi])
        yield from enumerate(shingles(scan.hashes(), scan.first, k), lo)
