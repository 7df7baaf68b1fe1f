"""op3, op5, op9, components and the reducer against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import components, itq, jaccard, reducer, simhash


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def brute_components(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text, k):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_jaccard(rows, k, threshold):
    sets = [shingle_set(r[1], k) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    root = brute_components(len(rows), edges)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root[i]) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,threshold", [(4, 85), (5, 80), (1, 60)])
def test_op3(docs, rows, k, threshold):
    got = jaccard.join(docs, k, threshold).collect()
    assert Counter(tuple(r) for r in got) == brute_jaccard(rows, k, threshold)


def test_op3_wide_families(spark, monkeypatch):
    """Blocks, delegates and the second round."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.join(df, 4, 85).collect()
    assert Counter(tuple(r) for r in got) == brute_jaccard(rows, 4, 85)


def test_op3_short_salted_runs(spark, monkeypatch):
    """Linked texts that share only common shingles, and lie in different salts of them."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", 4)
    rng = random.Random(9)
    rows = []
    for i in range(100):
        w = rng.sample([f"w{j}" for j in range(60)], 30)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[1:], f"w{60 + i % 3}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.join(df, 1, 85).collect()
    assert Counter(tuple(r) for r in got) == brute_jaccard(rows, 1, 85)


def test_op3_empty(empty, clashing, rows):
    assert jaccard.join(empty).count() == 0
    assert Counter(tuple(r) for r in jaccard.join(clashing).collect()) == brute_jaccard(rows, 4, 85)


def batches(rows, size):
    names = ["token", "node", "info", "salt"]
    for at in range(0, len(rows), size):
        t, s, n, i = zip(*rows[at : at + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int32())], names=names)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs_over_batches(size, monkeypatch):
    monkeypatch.setattr(jaccard, "RUN_PAIRS", 4)
    rng = random.Random(size)
    info = 100 << 24 | 2
    rows = sorted((t, 1 if t == 5 else 0, n, info) for t in range(30) for n in rng.sample(range(50), rng.choice([1, 2, 3, 9])))
    rows = sorted(rows + rows[::3])  # repeats from other tasks
    pairs, stars = set(), set()
    for b in jaccard._runs(85)(batches(rows, size)):
        for a, c, hot, salted in zip(*(b.column(x).to_pylist() for x in ("a", "b", "hot", "salted")), strict=True):
            (stars if hot else pairs).add((a, c)) if not salted else stars.add(("head", a, c))
    want_pairs, want_stars = set(), set()
    for t in range(30):
        nodes = sorted({r[2] for r in rows if r[0] == t})
        if len(nodes) > 4:
            want_stars |= {(nodes[0], n) for n in nodes[1:]}
        else:
            want_pairs |= {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]}
        if t == 5:
            want_stars.add(("head", t, nodes[0]))
    assert pairs == want_pairs and stars == want_stars


def test_prefixes_keep_every_link():
    """Every linked pair shares min(l) prefix shingles, whatever their frequencies."""
    rng = np.random.default_rng(4)
    tested = 0
    for _ in range(400):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.08], rng.integers(0, 1 << 62, rng.integers(0, 5)).astype(np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if not inter or 100 * inter < 85 * (len(x) + len(y) - inter):
            continue
        tested += 1
        df = {int(t): 1 for t in np.union1d(x, y)}
        for t in np.intersect1d(x, y).tolist():
            df[t] = int(rng.choice([2, 5, 500, jaccard.SALT_ROWS * 3, jaccard.HOT + jaccard.SALT_ROWS * 2]))
        for t in df:
            if df[t] == 1 and rng.random() < 0.3:
                df[t] = 4  # a third class has it
        got = []
        for node, s in ((1, x), (2, y)):
            f = np.array([df[int(t)] for t in s], np.int64)
            more = f > 1
            order = np.lexsort((s[more], f[more]))
            got.append(jaccard.prefix(s[more][order], f[more][order], node, len(s), 85))
        shared = len(np.intersect1d(got[0][0], got[1][0]))
        least = min(got[0][1], got[1][1])
        assert shared >= least >= max(jaccard.asked_match(len(x), 85), jaccard.asked_match(len(y), 85), 1)
    assert tested > 100


@pytest.mark.parametrize("salt", [1, 4, 16])
def test_op3_forced_salting(spark, monkeypatch, salt):
    """Texts of shared passages, with every common shingle salted or hot."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", salt)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 4 * salt)
    monkeypatch.setattr(jaccard, "RUN_PAIRS", 4)
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "SEND_SHINGLES", 300)
    rng = random.Random(salt)
    passages = [words(rng, 12, 90) for _ in range(25)]
    rows = []
    for i in range(150):
        picked = rng.sample(passages, rng.randrange(3, 7))
        rows.append((2 * i, " ".join(picked)))
        if i % 3 == 0:
            w = " ".join(picked).split()
            w[rng.randrange(len(w))] = "changed"
            rows.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in jaccard.join(df, 4, 85).collect()) == brute_jaccard(rows, 4, 85)


def test_op3_one_id(spark):
    """Two hundred texts under one id, and as many without: each is a class of its own, none meets all others."""
    rng = random.Random(2)
    rows = []
    for i in range(200):
        t = words(rng, 30)
        rows += [(7 if i % 2 else None, t), (7 if i % 2 else None, t + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in jaccard.join(df, 4, 85).collect()) == brute_jaccard(rows, 4, 85)


def brute_kept(rows, k, threshold):
    """Groups of rows (positions) that one row each must stay of."""
    sets = [shingle_set(r[1], k) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    root = brute_components(len(rows), edges)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i] if sets[i] else (r[0], r[1]), []).append(i)
    return list(groups.values())


def check_kept(kept, rows, k, threshold):
    left = Counter((r["doc_id"], r["text"]) for r in kept)
    for group in brute_kept(rows, k, threshold):
        members = {(rows[i][0], rows[i][1]) for i in group}
        stayed = [m for m in members if left.get(m)]
        assert len(stayed) == 1 and left.pop(stayed[0]) == 1
        ids = [i for i, _ in members if i is not None]
        assert stayed[0][0] == (min(ids) if ids else None)
    assert not left


def test_deduplicate(docs, rows):
    kept = jaccard.deduplicate(docs).collect()
    check_kept(kept, rows, 5, 80)
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_deduplicate_repeated_ids(spark, clashing, rows, empty):
    """Near copies under repeated and null ids go; clashing columns stay."""
    rng = random.Random(5)
    more = []
    for i in range(40):
        t = words(rng, 40)
        more += [(i % 4, t, 1), (None, t + " x", 2), (i % 4, t + " y", 3), (None, t, 4), (None, t, 4)]
    more += [(None, None, 1), (None, None, 2), (3, "", 1), (3, " ", 1)]
    df = spark.createDataFrame(more, "doc_id long, text string, extra int").repartition(3)
    check_kept(jaccard.deduplicate(df).collect(), more, 5, 80)
    got = jaccard.deduplicate(clashing)
    assert got.columns == clashing.columns
    check_kept(got.collect(), rows, 5, 80)
    assert jaccard.deduplicate(empty).count() == 0


def test_components(spark):
    rng = random.Random(8)
    n = 400
    edges = [(i, i + 1) for i in range(0, 120)] + [(200, j) for j in range(201, 260)] + [(rng.randrange(260, n), rng.randrange(260, n)) for _ in range(60)] + [(5, 5)]
    rng.shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    want = brute_components(n, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}


def test_reducer(spark):
    df = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    keys = spark.createDataFrame([(None,), (7,), (1999,)], "k long")
    bits = reducer.bits_of(keys, "k")
    inside = [r[0] for r in reducer.maybe(df, "k", bits).collect()]
    assert {None, 7, 1999} <= set(inside) and len(inside) < 10
    assert reducer.maybe(df, "k", bits, member=False).count() == 2000 - len(inside)


M64 = (1 << 64) - 1


def slow_mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def slow_fingerprint(text):
    """Votes one by one, from the words' hashes alone."""
    from tessella.llm.textkernel import Scan

    scan = Scan([text.encode("utf-8", "surrogatepass")])
    word = [int(x) for x in scan.hashes()]
    size = [min(8, int(e - s)) * simhash.WORD / 4 for s, e in zip(scan.start, scan.end, strict=True)]
    terms = Counter(word)
    weight = {}
    for h, z in zip(word, size, strict=True):
        weight.setdefault(h, z)
    for a, b in zip(word, word[1:], strict=False):
        pair = slow_mix((a * 0x9FB21C651E98DF25 + b * 0xC2B2AE3D27D4EB4F) & M64)
        terms[pair] += 1
        weight.setdefault(pair, simhash.PAIR)
    seeds = [int(x) for x in simhash._SEED]
    total = [0.0] * simhash.BITS
    for h, n in terms.items():
        raw = b"".join(slow_mix((h * s) & M64).to_bytes(8, "little") for s in seeds)
        bits = "".join(f"{byte:08b}" for byte in raw)
        for i, bit in enumerate(bits):
            total[i] += (1 if bit == "1" else -1) * weight[h] * (1 + math.log(n))
    return total


def test_fingerprints_are_votes(rows):
    texts = [r[1] or "" for r in rows if len(r[1] or "") < 3000]
    got = simhash.fingerprints([t.encode() for t in texts])
    for t, f in zip(texts, got, strict=True):
        total, bits = slow_fingerprint(t), np.unpackbits(f)
        assert all((v > 0) == bool(b) for v, b in zip(total, bits, strict=True) if abs(v) > 1e-9)


def test_op5(docs, rows):
    import xxhash

    h = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64)  # noqa: E731  signed order
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1] or ""), r[1] or ""))
    texts = [r[1] or "" for r in order]
    new = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    own, other = (simhash.fingerprints([t.encode() for t in x]) for x in (texts, new))
    following = np.roll(own, -1, axis=0)
    want = Counter(
        (r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), 1 - int(np.unpackbits(a ^ b).sum()) / 256, 1 - int(np.unpackbits(a ^ c).sum()) / 256)
        for r, t, e, a, b, c in zip(order, texts, new, own, other, following, strict=True)
    )
    for parts in (1, 2, 7, 500, None):
        assert Counter(tuple(r) for r in simhash.compare_neighbours(docs, parts).collect()) == want


def test_op5_edges(spark, empty, clashing, docs):
    assert simhash.near_groups(simhash.compare_neighbours(empty)).count() == 0
    assert simhash.near_groups(simhash.compare_neighbours(clashing)).count() == docs.count()
    one = simhash.compare_neighbours(spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"alpha bealpha be").hexdigest()
    many = spark.createDataFrame([(None, f"text number {i} of no id") for i in range(300)], "doc_id long, text string").repartition(3)
    assert simhash.compare_neighbours(many).count() == 300


@pytest.mark.parametrize("radius,whole", [(7, 1), (3, 2)])
def test_block_tables_find_all(spark, radius, whole, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    rows = [b.tobytes().hex() for b in base]
    for b in base[:20]:
        for flips in (1, 2, radius, radius + 1):
            bits = np.unpackbits(b)
            bits[rng.choice(256, flips, replace=False)] ^= 1
            rows.append(np.packbits(bits).tobytes().hex())
    rows = [(i, x) for i, x in enumerate(rows)] + [(900, rows[0]), (None, rows[0]), (None, rows[5]), (7, "0" * 64), (8, "0" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(3)
    value = np.array([np.frombuffer(bytes.fromhex(x), np.uint8) for _, x in rows])
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if value[i].any() and value[j].any() and simhash.hamming(value[i], value[j]) <= radius]
    root, least = brute_components(len(rows), edges), {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    links = Counter(i for e in edges for i in e)
    want = Counter((r[0], r[1], links[i], least.get(root[i])) for i, r in enumerate(rows))
    for group in (2048, 8):  # hot keys in blocks
        monkeypatch.setattr(simhash, "GROUP", group)
        assert Counter(tuple(r) for r in simhash.near_groups(df, radius, whole).collect()) == want


def brute_links(rows, threshold=0.93):
    ok = {}
    for i, (_, e, label) in enumerate(rows):
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, float) / max(abs(x) for x in e)
            ok[i] = v / np.linalg.norm(v)
    keys = list(ok)
    links, edges = Counter(), []
    for x, i in enumerate(keys):
        for j in keys[:x]:
            if rows[i][2] == rows[j][2] and ok[i] @ ok[j] >= threshold:
                links.update((i, j))
                edges.append((i, j))
    root = brute_components(len(rows), edges)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return {i: (rows[i][0], links[i], least[root[i]] if i in ok else rows[i][0]) for i in range(len(rows))}


@pytest.mark.parametrize("group", [1024, 5])
def test_op9(spark, group, monkeypatch):
    monkeypatch.setattr(itq, "GROUP", group)
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(60)]
    for i in range(12):
        for _ in range(4):
            rows.append((len(rows), (np.array(rows[i][1]) + rng.normal(0, 0.03, 16)).tolist(), rows[i][2]))
        rows.append((len(rows), rows[i][1], rows[i][2]))
        rows.append((len(rows), rows[i][1], None))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, [], 1), (205, [float("inf")] * 16, 1), (206, [1e300] * 16, 1), (207, [1e-300] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["vec_id"], r["n_links"], r["component_id"]) for r in itq.links(df).collect()}
    want = {v[0]: v for v in brute_links(rows).values()}
    assert all(got[k][1] <= want[k][1] for k in want) and len(got) == len(want)
    assert sum(v[1] for v in got.values()) >= 0.9 * sum(v[1] for v in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want)


def test_op9_common_component(spark):
    """Vectors around a large mean: pairs at the threshold still meet."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(500, 64))
    x = 0.85 * np.eye(64)[0] + math.sqrt(1 - 0.85**2) * x / np.linalg.norm(x, axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = [b for _, b in itq.partners(x, 0.9301)]
    v = np.concatenate([x, y[0][:1500], y[1][:1500]])
    df = spark.createDataFrame([(i, e.tolist(), 0) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = itq.links(df).agg(F.sum("n_links")).first()[0]
    true = int((v @ v.T >= 0.93).sum() - len(v))
    assert 0.98 * true <= got <= true


def test_op9_lengths(spark):
    rng = np.random.default_rng(15)
    rows = []
    for d, n in ((16, 20), (5, 3), (2, 1)):
        for v in rng.normal(size=(n, d)):
            rows += [(len(rows) + i, e.tolist(), 1) for i, e in enumerate((v, v, v + rng.normal(0, 0.01, d)))]
    rows += [(500, None, 1), (501, [], 1), (502, rows[0][1], None), (503, [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["vec_id"], r["n_links"], r["component_id"]) for r in itq.links(df).collect()}
    want = {r[0]: (r[0], 0, r[0]) for r in rows}
    for d in (16, 5, 2):
        part = [r for r in rows if r[1] and len(r[1]) == d]
        want.update({v[0]: v for v in brute_links(part).values()})
    assert got == want


def test_sketches_drop_no_link():
    rng = np.random.default_rng(14)
    for d in (1, 3, 64, 700):
        x = rng.normal(size=(200, d)) * rng.exponential(size=d)
        x /= np.linalg.norm(x, axis=1)[:, None]
        v = np.concatenate([x, *[b for _, b in itq.partners(x, 0.93)]])[:600]
        close = itq.may_link(itq.sketches(v), 0.93)
        assert not ((v @ v.T >= 0.93) & ~close).any() and (d < 64 or close.mean() < 0.2)


def test_op9_empty(spark):
    schema = "vec_id long, embedding array<float>, label int, key long, size long"
    assert itq.links(spark.createDataFrame([], schema)).count() == 0
    got = itq.links(spark.createDataFrame([(1, None, None, 1, 1)], schema)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True)]


@pytest.mark.parametrize("substring", [8, 14, 20])
@pytest.mark.parametrize("norm", [0.0, 0.7, 0.85])
def test_op9_recall(substring, norm):
    """Of pairs at 0.93 to 0.95 at least 99 % share a key in some table, whatever their common part and the keys' length."""
    rng = np.random.default_rng(17)
    d = 64
    x = rng.normal(size=(3000, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = norm * np.eye(d)[0] + math.sqrt(1 - norm**2) * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    projection, tables = itq.fit_tables(x, 0.93, substring)
    fresh = rng.normal(size=(2000, d))
    fresh /= np.linalg.norm(fresh, axis=1)[:, None]
    fresh = norm * np.eye(d)[0] + math.sqrt(1 - norm**2) * fresh
    fresh /= np.linalg.norm(fresh, axis=1)[:, None]
    found = total = 0
    for a, b in itq.partners(fresh, 0.935, seed=23):
        keys = [itq.table_keys(itq.codes(v, projection), substring, tables) for v in (a, b)]
        found += int((keys[0] == keys[1]).any(axis=1).sum())
        total += len(a)
    assert found >= 0.985 * total


def test_op9_whole_table(spark):
    """The driver's table against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r[0], r[1], r[2]) for r in df.select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["vec_id"], r["n_links"], r["component_id"]) for r in itq.links(df).collect()}
    want = {v[0]: v for v in brute_links(rows).values()}
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
