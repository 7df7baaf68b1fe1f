"""A minimal acyclic transducer from words to numbers, in one file that tasks map into memory.

Words come in sorted order; states that accept the same suffixes with the same outputs are one
state. An arc carries a part of the output, pushed as far towards the start as
words agree on it, and the sum along a word's arcs is its output. The states stand in a double array: arc ``byte`` of a state lies at
``base[state] + byte`` and belongs to it if ``owner`` says so, so a step is one look-up and many words
go in step. The file is one array of 32-bit integers; workers on a machine share its pages.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_PARTS = ("base", "last", "owner", "target", "output", "offset", "pool")


class _State:
    __slots__ = ("arcs", "last")

    def __init__(self):
        self.arcs: list[list[int]] = []  # [byte, state, output]
        self.last = -1  # what is added where a word ends here; -1: none does


def _minimal(words: Iterable[tuple[bytes, int]]) -> list[tuple[int, tuple[tuple[int, int, int], ...]]]:
    """(last, arcs) of the states, the start last."""
    states: list[tuple[int, tuple]] = []
    known: dict[tuple, int] = {}
    open_: list[_State] = [_State()]  # along the word added last
    before = b""

    def close(depth: int) -> None:
        while len(open_) > depth + 1:
            s = open_.pop()
            key = (s.last, tuple(tuple(a) for a in s.arcs))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            open_[-1].arcs[-1][1] = known[key]

    for word, output in words:
        if word <= before and (before or open_[0].last >= 0):
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        close(same)
        for i in range(same):
            arc, below = open_[i].arcs[-1], open_[i + 1]
            keep = min(arc[2], output)
            more = arc[2] - keep
            if more:  # words that are already below get it back
                for a in below.arcs:
                    a[2] += more
                if below.last >= 0:
                    below.last += more
                arc[2] = keep
            output -= keep
        for byte in word[same:]:
            open_[-1].arcs.append([byte, -1, output])
            open_.append(_State())
            output = 0
        open_[-1].last = output
        before = word
    close(0)
    states.append((open_[0].last, tuple(tuple(a) for a in open_[0].arcs)))
    return states


def _placed(states: list[tuple[int, tuple]]) -> tuple[np.ndarray, int]:
    """A base for each state such that no two arcs meet, and the slots in use."""
    total = sum(len(arcs) for _, arcs in states)
    free = np.ones(2 * total + 4096, bool)
    base = np.zeros(len(states), np.int32)
    order = sorted((i for i in range(len(states)) if states[i][1]), key=lambda i: -len(states[i][1]))
    low = 256
    for i in order:
        labels = np.array([a[0] for a in states[i][1]], np.int64)
        at = low
        while True:
            slots = np.flatnonzero(free[at : at + 2048]) + at - labels[0]
            if len(labels) > 1:
                slots = slots[slots + labels[-1] < len(free)]
                slots = slots[free[slots[:, None] + labels].all(axis=1)]
            if len(slots):
                base[i] = slots[0]
                free[slots[0] + labels] = False
                break
            at += 2048
            if at + 4096 > len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
        while not free[low]:
            low += 1
    used = int(np.flatnonzero(~free).max()) + 257 if total else 257
    return base, used


def compile_lexicon(words: list[tuple[bytes, list[int]]], vocabulary: int) -> np.ndarray:
    """The file's content for words and their ids. A single id is its own output, longer sequences are numbered from ``vocabulary``."""
    several = [ids for _, ids in words if len(ids) != 1]
    number = iter(range(vocabulary, vocabulary + len(several)))
    states = _minimal((w, ids[0] if len(ids) == 1 else next(number)) for w, ids in words)
    base, used = _placed(states)
    n = len(states)
    owner, target, output = np.full(used, -1, np.int32), np.full(used, n, np.int32), np.zeros(used, np.int32)
    for i, (_, arcs) in enumerate(states):
        for byte, state, out in arcs:
            at = base[i] + byte
            owner[at], target[at], output[at] = i, state, out
    last = np.array([s[0] for s in states] + [-1], np.int32)
    offset = np.concatenate([np.arange(vocabulary), vocabulary + np.concatenate([[0], np.cumsum([len(x) for x in several], dtype=np.int64)])]).astype(np.int32)
    pool = np.concatenate([np.arange(vocabulary), np.array([i for x in several for i in x], np.int64)]).astype(np.int32)
    parts = [np.append(base, np.int32(0)), last, owner, target, output, offset, pool]
    return np.concatenate([np.array([max((len(w) for w, _ in words), default=0), *map(len, parts)], np.int32), *parts]).astype("<i4")


class Lexicon:
    """Look-ups in such a file (an array, mapped or not)."""

    def __init__(self, data: np.ndarray):
        at = 1 + len(_PARTS)
        self.longest = int(data[0])
        for name, size in zip(_PARTS, data[1:at].tolist(), strict=True):
            setattr(self, name, data[at : at + size])
            at += size
        self.start, self.dead = len(self.base) - 2, len(self.base) - 1

    def outputs(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each byte range's output, -1 for words that aren't in the lexicon."""
        size = end - start
        out = np.full(len(start), -1, np.int64)
        order = np.argsort(-np.minimum(size, self.longest + 1), kind="stable")
        order = order[int((size > self.longest).sum()) :]
        begin, rising = start[order], size[order][::-1]
        state, total = np.full(len(order), self.start, np.int32), np.zeros(len(order), np.int64)
        for i in range(int(rising[-1]) if len(rising) else 0):
            live = len(rising) - int(np.searchsorted(rising, i, side="right"))
            s = state[:live]
            slot = self.base[s] + buf[begin[:live] + i]
            state[:live] = np.where(self.owner[slot] == s, self.target[slot], self.dead)
            total[:live] += self.output[slot]
        final = self.last[state]
        out[order] = np.where(final >= 0, total + final, -1)
        return out
