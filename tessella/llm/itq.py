"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

Unit vectors are projected on their principal axes and turned by a learned rotation that
brings them close to the corners of the cube (alternating: codes = signs, rotation =
orthogonal Procrustes). They are not centred, which would widen the angles of pairs. Several
rotations from different starts give as many bits as the tables need. A table's key is a
substring of the code; pairs that share a key in any table, and the label, are compared by
cosine in double precision with their original vectors.

Substring length follows the largest label's size n: log2(n / 32) bits (8 to 24), so
random company in a key stays at some dozens, and at more where the vectors are all alike. The
number of tables comes from the codes themselves: at most 0.5 % of pairs made at the threshold, from
sampled vectors and random or sampled directions, share no table. The projection and rotations are
fitted on half of at most about ``SAMPLE`` vectors, the tables on the other half (a bounded, documented sample); every vector is indexed.

Equal vectors of a label are one class first. A key with many classes is dealt in blocks of
``GROUP``; tasks hold two blocks. A table's row is a key and a class; codes and sketches go only where several
classes share a key. There a class goes on, with its vector, to those blocks in which some other sketch may be within the threshold. A sketch is the
vector in bytes, with the length of what that leaves out, so the bound on a cosine is proven and
drops no link. There links become counts and spanning edges;
pairs are never written. A pair is counted only in the first table it shares.

Cases: vectors that are null, zero or empty, or hold null or non-finite
components, and null labels, link with nothing (their component is their own vec_id); rows that share a vec_id are vectors
of their own; vectors of several lengths are indexed length by length and never link across; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .mixing import uniform
from .reducer import bits_of, maybe
from .storage import discard, lean, materialize

SAMPLE = 8192
ITERATIONS = 30
MISS = 0.005
PAIRS = 4096
GROUP = 1024


def tables_for(threshold: float, substring: int) -> int:
    p = math.acos(threshold) / math.pi
    return max(1, math.ceil(math.log(MISS) / math.log(1 - (1 - p) ** substring)))


def fit(vectors: np.ndarray, bits: int, learned: int, seed: int = 3) -> np.ndarray:
    """Projection of unit vectors: signs of x @ projection are the code. More bits only add
    columns. From the ``learned``-th on, rotations are random ones."""
    d = vectors.shape[1]
    _, _, axes = np.linalg.svd(vectors.T @ vectors)
    rng = np.random.default_rng(seed)
    v = vectors @ axes.T
    parts = []
    for part in range(-(-bits // d)):
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(ITERATIONS if part < learned else 0):
            code = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(v.T @ code)
            r = u @ w
        parts.append(axes.T @ r)
    return np.concatenate(parts, axis=1)[:, :bits]


def codes(vectors: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Bits of unit vectors."""
    return vectors @ projection >= 0


def partners(vectors: np.ndarray, threshold: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold's cosine: from sampled vectors in random directions, and towards others."""
    rng = np.random.default_rng(seed)
    x = vectors[rng.integers(0, len(vectors), PAIRS)]
    out = []
    for way in (rng.normal(size=x.shape), vectors[rng.integers(0, len(vectors), PAIRS)]):
        way = way - (way * x).sum(axis=1)[:, None] * x
        norm = np.linalg.norm(way, axis=1)
        ok = norm > 1e-6
        if ok.any():
            out.append((x[ok], threshold * x[ok] + math.sqrt(1 - threshold**2) * way[ok] / norm[ok, None]))
    return out


def fit_tables(vectors: np.ndarray, threshold: float, substring: int) -> tuple[np.ndarray, int]:
    """(projection, tables): as many tables as made pairs need to miss all with at most ``MISS``."""
    # Codes fit the vectors they were learned from too well: pairs come from the others.
    learn, judge = (vectors[::2], vectors[1::2]) if len(vectors) >= 4 * vectors.shape[1] else (vectors, vectors)
    pairs = partners(judge, threshold)
    most = 2 * tables_for(threshold, substring)
    learned = -(-most * substring // vectors.shape[1])
    while True:
        projection = fit(learn, most * substring, learned)
        tables = 1
        for a, b in pairs:
            same = table_keys(codes(a, projection), substring, most) == table_keys(codes(b, projection), substring, most)
            missed = 1 - np.logical_or.accumulate(same, axis=1).mean(axis=0)
            enough = np.flatnonzero(missed <= MISS)
            tables = max(tables, int(enough[0]) + 1 if len(enough) else most + 1)
        if tables <= most:
            return projection[:, : tables * substring], tables
        most *= 2


def sketches(vectors: np.ndarray) -> np.ndarray:
    """Each unit vector in bytes: its scale and the length of the rest (4 each), one byte a component."""
    scale = (np.abs(vectors).max(axis=1) / 127).astype(np.float32)
    q = np.rint(vectors / scale[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    rest = np.linalg.norm(vectors - q * scale[:, None].astype(np.float64), axis=1).astype(np.float32)
    return np.concatenate([scale[:, None].view(np.uint8), rest[:, None].view(np.uint8), q.view(np.uint8)], axis=1)


def may_link(held: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of the pairs of sketches whose cosine can reach the threshold: with rests r and s
    the product of sketches is short of it by r + s + r s at most."""
    number = np.ascontiguousarray(held[:, :8]).view(np.float32)
    v = held[:, 8:].view(np.int8) * number[:, :1]
    rest = 1 + number[:, 1]
    return v @ v.T + rest[:, None] * rest[None, :] - 1 >= threshold - 1e-5 - 1e-6 * v.shape[1]


def table_keys(bits: np.ndarray, substring: int, tables: int) -> np.ndarray:
    """(vectors, tables) substring values."""
    power = 1 << np.arange(substring, dtype=np.int64)
    out = np.zeros((len(bits), tables), np.int64)
    for t in range(tables):
        out[:, t] = bits[:, t * substring : (t + 1) * substring] @ power
    return out


def _unit(batch_column, dim: int | None):
    """Unit vectors of a list column in double precision, and which rows are valid."""
    rows = batch_column.to_pylist()
    ok = np.zeros(len(rows), bool)
    out = []
    for i, r in enumerate(rows):
        if r is None or not len(r) or (dim is not None and len(r) != dim) or any(x is None for x in r):
            continue
        v = np.array(r, np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            continue
        v = v / top
        out.append(v / np.sqrt(v @ v))
        ok[i] = True
    return out, ok


def _sample(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Unit vectors of a bounded sample by hash, and the largest label's size."""
    labelled = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if not sizes["all"]:
        return np.zeros((0, 1)), 0
    rate = min(1.0, SAMPLE / sizes["all"])
    # The draw reads the vector too: rows without a vec_id, or with the same, draw each for themselves.
    drawn = uniform(F.lit("itq"), F.col("vec_id").cast("string"), F.xxhash64("embedding").cast("string"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    dims: dict[int, list[np.ndarray]] = {}
    for chosen in (labelled.where(drawn < rate).where(good).limit(4 * SAMPLE), labelled.where(good).limit(SAMPLE)):
        for r in chosen.select("embedding").toLocalIterator():
            v = np.array(r["embedding"], np.float64)
            v /= np.abs(v).max()
            dims.setdefault(len(v), []).append(v / np.sqrt(v @ v))
        if dims:  # else all valid vectors are copies of few, and the draw missed them
            break
    if not dims:
        return np.zeros((0, 1)), int(sizes["most"])
    most = max(dims.values(), key=len)
    return np.stack(most), int(sizes["most"])


def links(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (vec_id, embedding, label)."""
    length = F.coalesce(F.size("embedding"), F.lit(0))
    rows = vectors.where(F.col("label").isNotNull()).groupBy(length.alias("d")).count().where("d > 0").orderBy("d").collect()
    lengths = [r["d"] for r in rows]
    if len(lengths) < 2:
        return _links(vectors, threshold)
    out = _links(vectors.where(~length.isin(lengths)), threshold)
    for d in lengths:
        out = out.unionByName(_links(vectors.where(length == d), threshold))
    return out


def _links(vectors: DataFrame, threshold: float) -> DataFrame:
    """links() of vectors of one length."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    sample, most = _sample(vectors)
    alone = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(sample):
        return alone
    dim = sample.shape[1]
    substring = min(24, max(8, math.ceil(math.log2(max(2, most / 32)))))
    projection, tables = fit_tables(sample, threshold, substring)
    held = spark.sparkContext.broadcast(projection)

    def classify(batches):
        import pyarrow as pa

        for batch in batches:
            label = batch.column(2).to_pylist()
            unit, ok = _unit(batch.column(1), dim)
            at = iter(unit)
            one, two, vector = [], [], []
            for good, name in zip(ok.tolist(), label, strict=True):
                v = next(at) if good else None
                if v is None or name is None:
                    one.append(None), two.append(None), vector.append(None)
                    continue
                digest = np.frombuffer(hashlib.md5(name.encode() + b"\0" + v.tobytes()).digest(), "<i8")
                one.append(int(digest[0])), two.append(int(digest[1])), vector.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(vector, pa.binary())], names=["vec_id", "label", "k1", "k2", "vector"])

    rows = materialize(vectors.mapInArrow(lean(classify), "vec_id long, label string, k1 long, k2 long, vector binary"), "itq-rows")
    # Copies of one vector meet in a partial aggregate; a class is named by its 64-bit key.
    classes = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialize(classes, "itq-classes")

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)
            packed = np.packbits(codes(unit, held.value), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array([x.tobytes() for x in sketches(unit)], pa.binary())], names=["k1", "code", "sketch"])

    coded = materialize(classes.select("k1", "vector").mapInArrow(lean(encode), "k1 long, code binary, sketch binary"), "itq-codes")

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
            keys = table_keys(bits, substring, tables)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]), batch.column(0), batch.column(1)], names=["table", "key", "label", "k1"])

    labelled = coded.join(classes.select(F.col("k1").alias("_l1"), "label"), F.col("k1") == F.col("_l1")).select("label", "k1", "code")
    keyed = materialize(labelled.mapInArrow(lean(index), "table int, key long, label string, k1 long"), "itq-keyed")
    slot = F.xxhash64("label", "table", "key")
    sizes = keyed.groupBy("label", "table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select(slot.alias("_s"), F.col("label").alias("_l"), F.col("table").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("n") / GROUP).cast("int").alias("blocks")), "itq-sizes")
    # Codes and sketches go only where several classes share a key.
    some = maybe(keyed.withColumn("slot", slot), "slot", bits_of(sizes, "_s"))
    dealt = some.join(sizes, (F.col("label") == F.col("_l")) & (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k"))).select("label", "table", "key", "blocks", F.col("k1").alias("_k1"))
    dealt = dealt.join(coded, F.col("_k1") == F.col("k1"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["label", "table", "key", "lo", "hi"]
    dealt = dealt.select("label", "table", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "k1", "code", "sketch")
    dealt = dealt.repartition(*place).sortWithinPartitions(*place, "k1")
    n_bits = substring * tables

    def groups(batches):
        """Rows of each (label, table, key, lo, hi), as columns."""
        now, rows = None, None
        for batch in batches:
            for first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first[:5] != now:
                    if now is not None:
                        yield now, rows
                    now, rows = first[:5], [[] for _ in first[5:]]
                for column, x in zip(rows, first[5:], strict=True):
                    column.append(x)
        if now is not None:
            yield now, rows

    def near(batches):
        import pyarrow as pa

        for now, (block, k1, code, sketch) in groups(batches):
            if len(k1) < 2:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(k1), -1), axis=1)[:, :n_bits]
            close = may_link(np.frombuffer(b"".join(sketch), np.uint8).reshape(len(k1), -1), threshold)
            np.fill_diagonal(close, False)
            if now[3] != now[4]:
                b = np.array(block)
                close &= b[:, None] != b[None, :]
            keys = table_keys(bits, substring, now[1]) if now[1] else None
            if keys is not None:  # an earlier table has the pair
                for t in range(now[1]):
                    close &= keys[:, t][:, None] != keys[:, t][None, :]
            at = np.flatnonzero(close.any(axis=1))
            if len(at):
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * m, pa.string()), *(pa.array([x] * m, t) for x, t in zip(now[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)), pa.array([block[i] for i in at], pa.int32()), pa.array([k1[i] for i in at], pa.int64()), pa.array([code[i] for i in at], pa.binary())], names=[*place, "block", "k1", "code"])

    going = materialize(dealt.mapInArrow(lean(near), "label string, table int, key long, lo int, hi int, block int, k1 long, code binary"), "itq-near")
    vectors_of = classes.select(F.col("k1").alias("_c1"), "size", "vector")
    dealt = going.join(vectors_of, going["k1"] == vectors_of["_c1"]).select(*place, "block", "k1", "code", "size", "vector")
    dealt = dealt.repartition(*place).sortWithinPartitions(*place, "k1")

    def meet(batches):
        import pyarrow as pa

        def flush(now, block, k1, code, size, vector):
            if len(k1) < 2:
                return None
            v = np.frombuffer(b"".join(vector), np.float64).reshape(-1, dim)
            close = v @ v.T >= threshold
            np.fill_diagonal(close, False)
            if now[3] != now[4]:
                b = np.array(block)
                close &= b[:, None] != b[None, :]
            i, j = np.nonzero(np.triu(close))
            if not len(i):
                return None
            bits = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(k1), -1), axis=1)
            keys = table_keys(bits, substring, now[1])
            first = ~(keys[i] == keys[j]).any(axis=1)  # else an earlier table has counted the pair
            i, j = i[first], j[first]
            weight = np.array(size)
            count = np.bincount(i, weight[j], len(k1)) + np.bincount(j, weight[i], len(k1))
            # Spanning edges: every row to the first row of its component here.
            near = np.arange(len(k1))
            while True:
                low = near.copy()
                np.minimum.at(low, i, near[j])
                np.minimum.at(low, j, near[i])
                low = low[low]
                if (low == near).all():
                    break
                near = low
            at = np.flatnonzero(count > 0)
            ids = np.array(k1, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[near[at]]), pa.array(count[at].astype(np.int64))], names=["k1", "head", "links"])

        for now, rows in groups(batches):
            if (out := flush(now, *rows)) is not None:
                yield out

    found = materialize(dealt.mapInArrow(lean(meet), "k1 long, head long, links long"), "itq-links")
    counts = found.groupBy("k1").agg(F.sum("links").alias("links")).select(F.col("k1").alias("_c"), "links")
    roots = components(found.select(F.col("k1").alias("a"), F.col("head").alias("b")), "itq-components").select(F.col("node").alias("_n"), "component")
    named = classes.join(counts, classes["k1"] == counts["_c"], "left").join(roots, classes["k1"] == roots["_n"], "left")
    named = named.select("k1", "k2", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "k1").alias("g"))
    named = materialize(named, "itq-named")
    smallest = named.groupBy("g").agg(F.min("least").alias("component_id")).withColumnRenamed("g", "_g")
    named = named.join(smallest, named["g"] == smallest["_g"]).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "n_links", "component_id")
    out = rows.select("vec_id", "k1", "k2").join(named, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left")
    component = F.when(F.col("_1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    discard(found, keyed, going, coded, sizes)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
