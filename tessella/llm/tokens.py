"""Token ids by the tokenizers library, word by word through a bounded cache.

With the word-level vocabulary used here white space always ends a token, and a
run of ``.,!?;:`` behind an ASCII letter or digit begins a new one. A text's ids
are therefore the ids of its words in order, and A-Z may be lower-cased first.
Only words that the cache misses go to the tokenizer. Texts that hold ``<|`` (the
spelling of special tokens) go to it whole.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import chain

import numpy as np

from .textkernel import LOWER, Scan, as_bytes, slices

END_ID = 1
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:")] = True


class WordEncoder:
    """Ids of whole texts with ``end_id`` behind each. ``slots`` bounds the cache:
    it is direct-mapped, a conflict only costs another call of the tokenizer."""

    def __init__(self, path: str, end_id: int = END_ID, slots: int = 1 << 21, pool: int = 3 << 22):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end_id, self.shift, self.slots, self.most = end_id, np.uint64(65 - slots.bit_length()), slots, 3 * pool // 4
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.pool = np.zeros(pool, self.dtype)
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int32)
        self.size = np.zeros(self.slots, np.uint16)  # longer ones are not kept
        self.pool[0] = self.end_id
        self.used = 1

    def _ids(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and each word's number of ids. Plain words (ASCII
        letters) are one token with one word-end piece each, so they go in joined lines."""
        size = np.zeros(len(words), np.int32)
        lines, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        flat: list[np.ndarray] = []
        if len(lines):
            texts = [b" ".join([words[i] for i in lines[lo : lo + 512]]).decode() for lo in range(0, len(lines), 512)]
            got = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), self.dtype)
            ends = np.flatnonzero(self.ends[got])
            if len(ends) != len(lines):  # another vocabulary: word by word
                return self._ids(words, np.zeros(len(words), bool))
            size[lines] = np.diff(ends, prepend=-1)
            flat.append(got)
        if len(odd):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in odd], add_special_tokens=False)]
            size[odd] = np.fromiter(map(len, ids), np.int32, len(ids))
            flat.append(np.fromiter(chain.from_iterable(ids), self.dtype))
        return np.concatenate(flat), size

    def _fill(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, size = self._ids(words, plain)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(ids), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        order = np.argsort(~plain, kind="stable") if len(ids) else np.zeros(0, np.int64)
        at = np.empty(len(words), np.int64)
        run = size[order]
        at[order] = self.used + np.cumsum(run, dtype=np.int64) - run
        self.used += len(ids)
        return at.astype(np.int32), size

    def _units(self, scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with their closing punctuation set apart, and each text's first unit."""
        start, end, buf = scan.start, scan.end, scan.buf
        cut = end.copy()
        live = np.flatnonzero(_STOP[buf[end - 1]]) if len(end) else np.zeros(0, np.int64)
        while len(live):
            cut[live] -= 1
            live = live[(cut[live] > start[live])]
            live = live[_STOP[buf[cut[live] - 1]]]
        apart = (cut < end) & (cut > start)
        apart[apart] = _ALNUM[buf[cut[apart] - 1]]
        cut = np.where(apart, cut, end)
        where = np.arange(len(start)) + np.cumsum(apart) - apart
        n = len(start) + int(apart.sum())
        s, e = np.empty(n, np.int64), np.empty(n, np.int64)
        s[where], e[where] = start, cut
        tail = where[apart] + 1
        s[tail], e[tail] = cut[apart], end[apart]
        before = np.concatenate([[0], np.cumsum(apart)])
        return s, e, scan.first + before[scan.first]

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.used > self.most:
            self._reset()
        scan = Scan(texts)
        s, e, first = self._units(scan)
        h = scan.hashes(s, e)
        slot = (h >> self.shift).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int32)
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, index, back = np.unique(h[miss], return_index=True, return_inverse=True)
            low = LOWER[scan.buf]
            take = miss[index]
            odd = np.concatenate([[0], np.cumsum(~_LETTER[low], dtype=np.int32)])
            raw = low.tobytes()
            a, n = self._fill([raw[i:j] for i, j in zip(s[take].tolist(), e[take].tolist(), strict=True)], odd[e[take]] == odd[s[take]])
            at[miss], size[miss] = a[back], n[back]
            short = np.flatnonzero(n < 1 << 16)
            put, one = np.unique((new[short] >> self.shift).astype(np.int64), return_index=True)
            one = short[one]
            self.key[put], self.at[put], self.size[put] = new[one], a[one], n[one]
        return self._emit(at, size, first)

    def _emit(self, at, size, first):
        at, size = np.insert(at, first[1:], 0), np.insert(size, first[1:], 1)
        total = int(size.sum())
        begin = np.cumsum(size, dtype=np.int64) - size
        ids = self.pool[np.repeat(at - begin, size) + np.arange(total)]
        ends = np.concatenate([begin, [total]])[first[1:] + np.arange(1, len(first))]
        return ids, np.diff(ends, prepend=0)

    def _whole(self, text: bytes) -> np.ndarray:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array([*ids, self.end_id], self.dtype)

    def __call__(self, values: Sequence) -> list[np.ndarray]:
        """Each text's ids (null: empty), the end id last."""
        texts = as_bytes(values)
        out: list[np.ndarray] = []
        for lo, hi in slices(texts, 1 << 20):
            part = texts[lo:hi]
            whole = {i: self._whole(t) for i, t in enumerate(part) if b"<|" in t}
            ids, n = self._slice([b"" if i in whole else t for i, t in enumerate(part)])
            split = np.split(ids, np.cumsum(n)[:-1])
            out += [whole.get(i, x) for i, x in enumerate(split)]
        return out


_CACHE: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """This Python worker's encoder: its cache lives as long as the worker."""
    key = (path, end_id)
    if key not in _CACHE:
        _CACHE[key] = WordEncoder(path, end_id)
    return _CACHE[key]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
