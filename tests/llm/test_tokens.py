"""op1, op6, op10 and the encoder against the tokenizers library and plain loops."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing, tokens, wavelet, wordpiece

PATH = tokens.vocabulary_path()
ORDER = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")


@pytest.fixture(scope="module")
def truth(rows):
    """(doc_id, ids with the end id) in ascending order of doc_id, then text."""
    t = Tokenizer.from_file(PATH)
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in sorted(rows, key=ORDER)]


def test_encoder(rows):
    t = Tokenizer.from_file(PATH)
    small = tokens.WordEncoder(PATH, slots=64, pool=512)  # conflicts and resets all the time
    texts = [r[1] for r in rows]
    for encode in (tokens.encoder(PATH), small):
        for _ in range(2):
            got = encode(texts)
            assert [x.tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_op1(docs, truth, spark):
    got = wavelet.token_shards(spark, docs, PATH, shard_tokens=1000).orderBy("start").collect()
    start = 0
    assert len(got) == len(truth)
    for r, (d, ids) in zip(got, truth, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op1_empty_and_clashing(empty, clashing, docs, spark):
    assert wavelet.token_shards(spark, empty, PATH).count() == 0
    assert wavelet.token_shards(spark, clashing, PATH).count() == docs.count()


def test_wavelet_queries():
    rng = np.random.default_rng(3)
    ids = [np.minimum(rng.zipf(1.4, n), 49_000).astype(np.uint16) for n in (0, 1, 70_000, 200_000, 5)]
    w = wavelet.WaveletShard(wavelet.encode_shard([5, None, 7, 8, 9], ids), cached_blocks=4)
    flat = np.concatenate(ids)
    assert (w.decode() == flat).all() and w.doc_ids == [5, None, 7, 8, 9]
    for i in rng.integers(0, len(flat), 25).tolist():
        t = int(flat[i])
        k = int((flat[:i] == t).sum())
        assert w.access(i) == t and w.rank(t, i) == k and w.select(t, k) == i
    assert w.count(1, 100, 5000) == (flat[100:5000] == 1).sum()
    assert w.occurrences(3, 1000, 2000) == (1000 + np.flatnonzero(flat[1000:2000] == 3)).tolist()
    assert w.count(65_000) == 0
    with pytest.raises(IndexError):
        w.select(1, len(flat))


def test_wavelet_of_one_symbol():
    w = wavelet.WaveletShard(wavelet.encode_shard([1], [np.zeros(10, np.uint16)]))
    assert w.count(0) == 10 and w.select(0, 9) == 9


def test_op6(docs, truth):
    got = packing.pack_documents(docs, PATH).collect()
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in truth)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    want = Counter((d, i, at, zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for d, x in truth for i, at in enumerate(range(0, len(x), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in got) == want
    total = sum(len(x) for _, x in truth)
    assert len(by) <= -(-total // 4096) + 1


def test_op6_empty(empty, clashing, docs):
    assert packing.pack_documents(empty, PATH).count() == 0
    assert packing.pack_documents(clashing, PATH).count() == packing.pack_documents(docs, PATH).count()
    assert packing.pieces(clashing, PATH).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_constraint(rule):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 3000)
    limits = packing.Limits(100, 4, 5200, (1.0, 0.5, 0.5), rule)
    lengths = lengths[lengths * lengths <= limits.attention]
    rows = packing.plan(dict(Counter(lengths.tolist())), limits)
    held, ranks = {}, {}
    for length, a, b, s, offset in rows.tolist():
        for k in range(b - a):
            held.setdefault(s + k, []).append((offset, length))
            ranks.setdefault(length, []).append(a + k)
    assert {n: len(r) for n, r in ranks.items()} == Counter(lengths.tolist())
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts][:-1]]).tolist()
        assert sum(n for _, n in parts) <= 100 and len(parts) <= 4 and sum(n * n for _, n in parts) <= 5200


def naive(lengths, limits):
    """Best fit, piece by piece: the contents of every sequence."""
    cap = (limits.tokens, limits.documents, limits.attention)
    bins = []
    for n in sorted(lengths, reverse=True):
        item = (n, 1, n * n)
        best = None
        for b in bins:
            left = [c - u for c, u in zip(cap, b["used"], strict=True)]
            if any(x > y for x, y in zip(item, left, strict=True)) or left[0] == 0 or left[1] == 0:
                continue
            if limits.rule == "dot":
                score = -sum(w * x / c * y / c for w, x, y, c in zip(limits.weights, item, left, cap, strict=True))
            else:
                score = sum(w * ((y - x) / c) ** 2 for w, x, y, c in zip(limits.weights, item, left, cap, strict=True))
            if best is None or score < best[0] - 1e-15:
                best = (score, b)
        b = best[1] if best else None
        if b is None:
            b = {"used": [0, 0, 0], "held": []}
            bins.append(b)
        b["held"].append(n)
        b["used"] = [u + x for u, x in zip(b["used"], item, strict=True)]
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_against_naive_best_fit(rule):
    """Decisions for whole runs of equal lengths use as few sequences as those for single pieces (a few more at most)."""
    rng = np.random.default_rng(8)
    for limits in (packing.Limits(rule=rule), packing.Limits(4096, 6, 9_000_000, (1.0, 1.0, 1.0), rule)):
        lengths = [int(min(3000, x)) for x in rng.lognormal(6, 1, 400)]
        rows = packing.plan(dict(Counter(lengths)), limits)
        used = int((rows[:, 3] + rows[:, 2] - rows[:, 1]).max())
        assert used <= len(naive(lengths, limits)) + 2


def test_weights_decide():
    """The query's weights give another packing than tokens alone, in as many sequences."""
    rng = np.random.default_rng(9)
    histogram = dict(Counter(int(min(4096, x)) for x in rng.lognormal(5.5, 1.2, 5000)))
    vector, plain = packing.plan(histogram), packing.plan(histogram, packing.Limits(weights=(1.0, 0.0, 0.0)))
    assert vector.shape != plain.shape or (vector != plain).any()
    bound = -(-sum(k * v for k, v in histogram.items()) // 4096)
    assert int((vector[:, 3] + vector[:, 2] - vector[:, 1]).max()) <= bound + 1


def test_plan_rejects_what_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan({10: 1}, packing.Limits(8, 8, 64))


def greedy(word: bytes, first: set, later: set) -> int:
    """Pieces by longest match, or 1 for a word that can't be covered."""
    at, n = 0, 0
    while at < len(word):
        pool = later if at else first
        to = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if to is None:
            return 1
        at, n = to, n + 1
    return n


def test_prefix_automaton():
    rng = np.random.default_rng(9)
    letters = np.array(list("abc"))
    for _ in range(30):
        pick = lambda: "".join(rng.choice(letters, rng.integers(1, 5)))
        pieces = {pick() for _ in range(8)} | {"##" + pick() for _ in range(10)}
        machine = wordpiece.from_prefix_vocabulary(pieces)
        first, later = {p.encode() for p in pieces if p[:2] != "##"}, {p[2:].encode() for p in pieces if p[:2] == "##"}
        text = [" ".join("".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(40)).encode()]
        want = sum(greedy(w, first, later) for w in text[0].split())
        assert wordpiece.counts(machine, text)[0, 1] == want


def test_op10(docs, rows, empty, clashing):
    pieces = wordpiece.byte_pieces(PATH)
    ends, plain = {p for p, e in pieces if e}, {p for p, e in pieces if not e}

    def count(word: bytes) -> int:
        at, n = 0, 0
        while at < len(word):
            if word[at:] in ends:
                return n + 1
            to = next((e for e in range(len(word), at, -1) if word[at:e] in plain), None)
            if to is None:
                return 1
            at, n = to, n + 1
        return n

    seen: dict[bytes, int] = {}
    want = Counter()
    for d, t, *_ in rows:
        ws = (t or "").encode().translate(bytes(i + 32 if 65 <= i < 91 else i for i in range(256))).split()
        want[d, len(ws), sum(seen.setdefault(w, count(w)) if w not in seen else seen[w] for w in ws)] += 1
    got = wordpiece.count_tokens(docs, PATH).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in got) == want
    assert wordpiece.count_tokens(empty, PATH).count() == 0
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in wordpiece.count_tokens(clashing, PATH).collect()) == want
