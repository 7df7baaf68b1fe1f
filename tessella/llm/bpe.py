"""Byte-level BPE, encoding and decoding, with a transducer lexicon for frequent words.

Texts fall into words as the tokenizer's pattern cuts them: contractions, and runs of letters, digits or other signs, each with
at most one blank before it; white space before a word keeps its last character apart. Here this is done for all
characters of a slice at once, from their classes. The words of all documents are counted, the most frequent ones
(up to ``WORDS``, of at most ``WORD_BYTES`` bytes) are encoded once and compiled into a minimal acyclic transducer (``lexicon``) whose file
goes to every executor and is mapped into memory. Words that it doesn't know are merged exactly: in rounds, each merging a word's
pair of least rank everywhere, for many words at once; very long ones by a heap. Which words
are in the lexicon changes the speed, never the ids.

Special tokens spelled out in a text become their ids, as in the tokenizers library. Decoding lays the tokens' bytes end to end; bytes that are no
UTF-8 become U+FFFD.

Cases: a null or empty text has no ids and decodes to the empty text; long texts are cut where a word is certain to begin; rows
that share a doc_id are encoded each for itself; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import io
import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import Lexicon, compile_lexicon
from .storage import discard, document_batches, lean, materialize, own_folder
from .textkernel import WEIGHT, as_bytes, mix, powers

WORDS = 1 << 16
WORD_BYTES = 64
SLICE = 1 << 20
#: Words of the lexicon's complement that a worker remembers, and counts that a task holds before it passes them on.
REMEMBERED = 1 << 17
#: Symbols up to which words are merged in rounds.
ROUNDS = 256
OTHER, LETTER, DIGIT, SPACE, ASK = range(5)
_BLANKS = (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
_NONE = np.iinfo(np.int32).max
#: A word surely begins at the blank.
_CERTAIN = re.compile(rb"[0-9A-Za-z.,;:] [A-Za-z]")


class Vocabulary:
    """Bytes of every token, merges by rank and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens") or []
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens with rules of their own are not supported")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ids = model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in added)]) + 1
        tokens = [b""] * self.size
        for piece, i in ids.items():
            tokens[i] = bytes(spelled[c] for c in piece)
        for t in added:
            tokens[t["id"]] = t["content"].encode()
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.split = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if added else None
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ids[c] for c, _ in sorted(spelled.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort((left << 32) | right, kind="stable")
        self.pairs, self.ranks, self.made = ((left << 32) | right)[order], order.astype(np.int32), made[order]
        self.table = dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        # Rounds are exact if a merge only makes pairs of higher rank.
        born = np.full(self.size, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        self.in_rounds = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        total = int(size.sum())
        return self.bytes[np.repeat(self.offset[ids] - np.cumsum(size) + size, size) + np.arange(total)].tobytes()

    def _by_heap(self, word: bytes) -> list[int]:
        symbols = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def look(i: int) -> None:
            j = after[i]
            if j < n and (hit := self.table.get((symbols[i] << 32) | symbols[j])):
                heapq.heappush(heap, (hit[0], i, hit[1]))

        for i in range(n - 1):
            look(i)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else n
            if j >= n or self.table.get((symbols[i] << 32) | symbols[j]) != (rank, made):
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [s for s in symbols if s >= 0]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Each word's ids."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= ROUNDS and self.in_rounds]
        for i in set(range(len(words))) - set(short):
            out[i] = np.array(self._by_heap(words[i]), np.int64)
        if not short:
            return out
        symbol = self.single[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        who = np.repeat(np.array(short), [len(words[i]) for i in short])
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            size = np.diff(np.append(begin, len(who)))
            pair = (symbol << 32) | np.append(symbol[1:], 0)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == pair, self.ranks[at], _NONE)
            rank[np.append(begin[1:], len(who)) - 1] = _NONE  # a word's last symbol has no right neighbour
            least = np.minimum.reduceat(rank, begin)
            for w in np.flatnonzero(least == _NONE).tolist():
                out[who[begin[w]]] = symbol[begin[w] : begin[w] + size[w]]
            least = np.repeat(least, size)
            hit = (rank == least) & (rank != _NONE)
            # In a run of overlapping hits (aaa) every second one counts, from the left.
            edge = hit & ~np.concatenate([[False], hit[:-1]])
            where = np.arange(len(hit))
            hit &= (where - np.maximum.accumulate(np.where(edge, where, 0))) % 2 == 0
            symbol = np.where(hit, self.made[at], symbol)
            keep = (least != _NONE) & ~np.concatenate([[False], hit[:-1]])
            symbol, who = symbol[keep], who[keep]
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """This Python worker's copy of a tokenizer file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Classes:
    """Letter, digit, white space or other, of every code point. Those that this Python doesn't know yet are looked up in the tokenizer once they occur."""

    def __init__(self, path: str):
        kinds = {"L": LETTER, "N": DIGIT}
        self.of = np.fromiter((ASK if (k := unicodedata.category(chr(c))) == "Cn" else kinds.get(k[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        self.of[list(_BLANKS)] = SPACE
        self.path, self.tokenizer = path, None

    def __call__(self, points: np.ndarray) -> np.ndarray:
        got = self.of[points]
        if (got == ASK).any():
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path).pre_tokenizer
            for c in np.unique(points[got == ASK]).tolist():
                alone = [len(self.tokenizer.pre_tokenize_str(lead + chr(c))) == 1 for lead in ("!", "a", "1")]
                self.of[c] = alone.index(True) if any(alone) else SPACE
            got = self.of[points]
        return got


_CLASSES: dict[str, Classes] = {}


def classes(path: str) -> Classes:
    if path not in _CLASSES:
        _CLASSES[path] = Classes(path)
    return _CLASSES[path]


def words_of(units: list[bytes], kind: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts (UTF-8), their words' begins and ends, and each text's first word."""
    text = b"".join(units).decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    buf = np.frombuffer(b"".join(units), np.uint8)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    begin = np.searchsorted(byte, np.concatenate([[0], np.cumsum([len(u) for u in units])]))  # of the units, in characters
    if not n:
        return buf, byte[:0], byte[:0], np.zeros(len(units) + 1, np.int64)
    c = kind(points)
    head = np.zeros(n + 1, bool)
    head[begin] = True
    new = head[:n].copy()
    new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    word = np.append(new, True)
    # White space before a word: its last character stands apart, a blank goes with the word.
    gap = np.flatnonzero((c[start] == SPACE) & ~head[end])
    word[end[gap] - 1] = True
    word[end[gap[points[end[gap] - 1] == 32]]] = False
    # Contractions: an apostrophe alone, with no blank before it, and letters right behind.
    mark = np.flatnonzero((points[start] == 39) & (end - start == 1) & word[start] & ~head[end])
    mark = mark[c[end[mark]] == LETTER]
    a = points[end[mark]]
    b = np.where(end[mark + 1] - end[mark] > 1, points[np.minimum(end[mark] + 1, n - 1)], 0)
    size = np.where(np.isin(a, [115, 116, 109, 100]), 1, np.where(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108), 2, 0))
    mark, size = mark[size > 0], size[size > 0]
    word[end[mark]] = False
    rest = end[mark] + size
    word[rest[rest < end[mark + 1]]] = True
    edge = np.flatnonzero(word)
    return buf, byte[edge[:-1]], byte[edge[1:]], np.searchsorted(edge[:-1], begin)


def parts_of(text: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """A long text in parts that begin where a word surely does."""
    at = 0
    while len(text) - at > limit:
        m = _CERTAIN.search(text, at + limit)
        if m is None:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


class Encoder:
    """Ids of texts by a vocabulary and a lexicon (or none)."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.vocabulary, self.kind, self.lexicon = vocabulary(path), classes(path), lexicon
        self.known: dict[bytes, np.ndarray] = {}

    def _unseen(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words beyond the lexicon, in a row: (ids, each word's offset, each word's size)."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        merged = self.vocabulary.merge(new)
        self.known.update(zip(new, merged, strict=True))
        got = [self.known[w] for w in words]
        for w in new:
            if len(w) > WORD_BYTES:  # not worth keeping
                del self.known[w]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.concatenate([*got, np.zeros(0, np.int64)]), np.cumsum(size) - size, size

    def plain(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        buf, start, end, first = words_of(units, self.kind)
        pool = np.zeros(0, np.int64)
        offset, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        seen = np.zeros(len(start), bool)
        if self.lexicon is not None:
            number = self.lexicon.outputs(buf, start, end)
            seen = number >= 0
            pool = self.lexicon.pool
            offset[seen] = self.lexicon.offset[number[seen]]
            size[seen] = self.lexicon.offset[number[seen] + 1] - offset[seen]
        miss = np.flatnonzero(~seen)
        if len(miss):
            raw = buf.tobytes()
            ids, at, n = self._unseen([raw[i:j] for i, j in zip(start[miss].tolist(), end[miss].tolist(), strict=True)])
            offset[miss], size[miss] = at + len(pool), n
            pool = np.concatenate([pool, ids])
        total = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(offset - total[:-1], size) + np.arange(total[-1])]
        return np.split(ids.astype(np.int64), total[first[1:-1]])

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        v = self.vocabulary
        if v.split is None or not any(s in t for s in v.special for t in texts):
            return self.plain(texts)
        pieces = [v.split.split(t) for t in texts]  # special tokens stand at odd places
        plain = iter(self.plain([p for parts in pieces for p in parts[::2]]))
        return [np.concatenate([np.array([v.special[p]]) if i % 2 else next(plain) for i, p in enumerate(parts)]) for parts in pieces]


def _valid(values) -> list[bytes]:
    """UTF-8 of texts, with U+FFFD for bytes that are none."""
    return [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in as_bytes(values)]


def slices_of(texts: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) of whole texts, or (i, i, [part]) of a long one's parts, all of about ``SLICE`` bytes."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total + len(t) > SLICE and lo < i:
            yield lo, i, texts[lo:i]
            lo, total = i, 0
        total += len(t)
        if len(t) > SLICE:
            for part in parts_of(t):
                yield i, i, [part]
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) over all texts, of words up to ``WORD_BYTES`` bytes."""

    def run(batches):
        import pyarrow as pa

        kind, v = classes(path), vocabulary(path)
        held: dict[bytes, int] = {}

        def give():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, _, texts in slices_of(_valid(batch.column(0).to_pylist())):
                if v.split is not None:
                    texts = [p for t in texts for p in v.split.split(t)[::2]]
                buf, start, end, _ = words_of(texts, kind)
                short = end - start <= WORD_BYTES
                start, end = start[short], end[short]
                key = _hashes(buf, start, end)
                _, index, n = np.unique(key, return_index=True, return_counts=True)
                raw = buf.tobytes()
                for i, j, k in zip(start[index].tolist(), end[index].tolist(), n.tolist(), strict=True):
                    w = raw[i:j]
                    held[w] = held.get(w, 0) + k
                if len(held) > REMEMBERED:
                    yield give()
                    held = {}
        yield give()

    document_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).where("text != ''").mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    power, inverse = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(WEIGHT[buf] * power[: len(buf)], dtype=np.uint64)])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def learn(docs: DataFrame, path: str, words: int = WORDS) -> np.ndarray:
    """The lexicon's file content: the most frequent words of all texts with their ids, as many as reach a count that ``words`` at most do.
    The count is found by eighths of powers of two, so the driver sees some hundred rows and then the words themselves."""
    counts = materialize(word_counts(docs, path), "words")
    tally = {int(r["step"]): int(r["words"]) for r in counts.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()}
    total, least = 0, None
    for step in sorted(tally, reverse=True):
        total += tally[step]
        if total > words:
            break
        least = step
    top = [] if least is None else sorted(bytes(r["word"]) for r in counts.where(F.floor(8 * F.log2("n")) >= least).select("word").collect())
    discard(counts)
    v = vocabulary(path)
    return compile_lexicon(list(zip(top, (ids.tolist() for ids in v.merge(top)), strict=True)), v.size)


def publish(spark: SparkSession, content: np.ndarray) -> str:
    """Write the lexicon below the shared folder and have every executor fetch it; the file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    held = io.BytesIO()
    np.save(held, content)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{own_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, name: str) -> Encoder:
    """This Python worker's encoder, its lexicon mapped from the executor's file."""
    if (path, name) not in _ENCODERS:
        from pyspark import SparkFiles

        _ENCODERS.clear()  # lexicons of earlier queries
        _ENCODERS[path, name] = Encoder(path, Lexicon(np.load(SparkFiles.get(name), mmap_mode="r")))
    return _ENCODERS[path, name]


def encode(docs: DataFrame, path: str, name: str) -> DataFrame:
    """doc_id, ids array<int> of every row."""

    def run(batches):
        import pyarrow as pa

        e = encoder(path, name)
        for batch in batches:
            ids: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, _, texts in slices_of(_valid(batch.column(1).to_pylist())):
                for i, x in enumerate(e(texts), lo):
                    ids[i].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.concatenate(x) if x else [] for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    document_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row (doc_id, ids); null ids are none."""

    def run(batches):
        import pyarrow as pa

        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    document_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(lean(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str, name: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, part by part."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        import pyarrow as pa

        e = encoder(path, name)
        v = e.vocabulary
        for batch in batches:
            rows = batch.num_rows
            n, seen, back = np.zeros(rows, np.int64), [hashlib.sha256() for _ in range(rows)], [hashlib.sha256() for _ in range(rows)]
            utf8 = [codecs.getincrementaldecoder("utf-8")("replace") for _ in range(rows)]
            for lo, _, texts in slices_of(_valid(batch.column(1).to_pylist())):
                for i, ids in enumerate(e(texts), lo):
                    n[i] += len(ids)
                    seen[i].update(ids.astype("<u4").tobytes())
                    back[i].update(utf8[i].decode(v.decode(ids)).encode())
            for i in range(rows):
                back[i].update(utf8[i].decode(b"", True).encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array([h.hexdigest() for h in s], pa.string()) for s in (seen, back))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    document_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def encode_documents(docs: DataFrame, path: str, words: int = WORDS) -> DataFrame:
    """Compile the lexicon of ``docs`` and give :func:`digests`."""
    return digests(docs, path, publish(docs.sparkSession, learn(docs, path, words)))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
