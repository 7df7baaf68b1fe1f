"""op12 against plain Python and DuckDB."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(rows, aims):
    """(doc_id, n_features, weight, score, rank) of every row."""
    source, target = Counter(), Counter()
    found = [features(r[1]) for r in rows]
    for _, f in found:
        source.update(f)
    for t in aims:
        target.update(features(t)[1])
    s, t = sum(source.values()) + 10_000, sum(target.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * s / ((source[b] + 1) * t))) for b in source}
    out = []
    for r, (n, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is not None, o[0] or 0, o[1]))
    for i, o in enumerate(able[: 5 * len(able) // 100]):
        o[4] = i + 1
    return sorted((tuple(o[:5]) for o in out), key=repr)


@pytest.fixture(scope="module")
def aims(rows):
    return [None, "", "a b", *[r[1] for r in rows if r[1] and len(r[1]) < 2000][:9]]


def test_op12_plain(spark, clashing, rows, aims):
    got = importance.resample(clashing, spark.createDataFrame([(t,) for t in aims], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, aims)


def test_op12_oracle(spark, docs, rows, aims):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1]) for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame({"text": aims}))
    want = sorted((tuple(r) for r in con.execute(importance.ORACLE).fetchall()), key=repr)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in aims], "text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_op12_empty(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    assert importance.resample(docs, none).where(F.col("rank") == 1).count() == 1


def test_long_text_in_pieces():
    rng = random.Random(3)
    text = ". ".join(rng.choice(["a", "Bc", "déf", "x" * 300, "0123456789abcdef" * 5]) for _ in range(6000)).encode()
    whole, sizes, words = importance.bucket_streams([text])
    got, n = [], 0
    for piece, own in importance.cuts(text, 700):
        buckets, size, w = importance.bucket_streams([piece], own)
        got.append(buckets)
        n += int(w[0])
        assert size[0] == len(buckets)
    assert n == words[0] == 6000
    assert (np.sort(np.concatenate(got)) == np.sort(whole)).all() and sizes[0] == len(whole)
    assert Counter(whole.tolist()) == Counter(features(text.decode())[1])


def test_long_document(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(500_000))
    rows = [(1, long), (2, "short one " * 12), (3, None), (1, "x y z")]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, ["w1 w2"])


def test_crc32_joined():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 2, 3, 63, 64, 65, 1000, 7, 100_000)]
    end = np.cumsum([len(p) for p in parts])
    start = end - [len(p) for p in parts]
    sums = importance.crc32_of(np.frombuffer(b"".join(parts), np.uint8), start, end)
    assert sums.tolist() == [zlib.crc32(p) for p in parts]
    assert importance.joined(sums[:-1], sums[1:], (end - start)[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(parts[:-1], parts[1:], strict=True)]
