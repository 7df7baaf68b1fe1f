"""SimHash fingerprints, and the search for near ones by permuted block tables.

A text's terms are its words (weight ``WORD``) and its pairs of neighbouring
words (weight ``PAIR``), A-Z lower-cased, weighted by 1 + ln(occurrences) and, for
words, by their length up to 8 bytes, so that short common words weigh little. Each
term's ``BITS``-bit hash votes its weight for every set bit and against every other;
the fingerprint has the bits with a positive sum. Likeness is the share of equal bits.

Block tables: cut into r + s blocks, two fingerprints within Hamming distance r agree
wholly on at least s blocks. There is a table for every choice of s blocks, keyed
by them; every near pair meets in some table, so the search is exact. Equal
fingerprints are one class first. Only keys that several classes share go on with their fingerprints; a key
that many share is dealt in blocks of rows, so that no task holds more than two of them. There
links become counts and spanning edges: pairs are never written. A pair is counted in the first table it shares.

Cases: null and empty texts have the fingerprint of no terms (all zero bits), as have blank ones, and are
near to nothing; equal texts have equal fingerprints; a null doc_id comes first in the order of documents,
rows that share a doc_id (or have none) follow each other by a hash of the text, then the text, so no doc_id fills a task; further
columns are ignored; a single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .reducer import bits_of, maybe
from .storage import discard, document_batches, lean, materialize
from .textkernel import Scan, as_bytes, mix, seeded, slices

BITS = 256
WORD = 0.25
PAIR = 1.0
GROUP = 2048
#: Bits in which near fingerprints differ at most.
RADIUS = 7
_WORDS = BITS // 64
_SEED = seeded(_WORDS, 31) | np.uint64(1)
#: bits of every byte value as votes, most significant first
_VOTES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1).reshape(256, 8)


def _sums(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Votes of weighted terms on every bit, some thousand terms at a time."""
    tally = np.zeros(256 * (BITS // 8))
    place_of = (np.arange(BITS // 8) * 256)[None, :]
    for at in range(0, len(term), 1 << 13):
        with np.errstate(over="ignore"):
            wide = mix(term[at : at + (1 << 13), None] * _SEED[None, :])
        place = wide.view(np.uint8).reshape(len(wide), BITS // 8) + place_of
        tally += np.bincount(place.ravel(), np.repeat(weight[at : at + (1 << 13)], BITS // 8), len(tally))
    return (tally.reshape(BITS // 8, 256) @ _VOTES).ravel()


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(texts, BITS / 8) bytes."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for lo, hi in slices(texts):
        scan = Scan(texts[lo:hi])
        word = scan.hashes()
        size = np.minimum(scan.end - scan.start, 8) * (WORD / 4)
        with np.errstate(over="ignore"):
            pair = mix(word[:-1] * np.uint64(0x9FB21C651E98DF25) + word[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(word) else word
        for d, (a, b) in enumerate(zip(scan.first[:-1].tolist(), scan.first[1:].tolist(), strict=True), lo):
            if a == b:
                continue
            total = np.zeros(BITS)
            for at in range(a, b, 1 << 16):  # texts of any length in bounded steps
                to = min(b, at + (1 << 16))
                terms = np.concatenate([word[at:to], pair[at : min(to, b - 1)]])
                base = np.concatenate([size[at:to], np.full(min(to, b - 1) - at, PAIR)])
                term, index, count = np.unique(terms, return_index=True, return_counts=True)
                total += _sums(term, base[index] * (1 + np.log(count)))
            out[d] = np.packbits(total > 0)
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by as many first ones of the next."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def _compared(ids: list, texts: list[str]):
    """Arrays of all but the last text, each against its next."""
    import pyarrow as pa

    own = fingerprints(as_bytes(texts))
    new = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    raw = as_bytes(new)
    other = fingerprints(raw)
    near, following = 1 - hamming(own[:-1], other) / BITS, 1 - hamming(own[:-1], own[1:]) / BITS
    return [
        pa.array(ids[:-1], pa.int64()),
        pa.array(list(map(len, texts[:-1])), pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
        pa.array([x.tobytes().hex() for x in own[:-1]]),
        pa.array([x.tobytes().hex() for x in other]),
        pa.array(near),
        pa.array(following),
    ]


def _inside(batches):
    """Sorted rows (doc_id, text) of a partition: all but its last against their next. Its first and last text go
    out too, marked, since their company is in other partitions."""
    from pyspark import TaskContext

    import pyarrow as pa

    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [*COLUMNS, "part", "edge", "text"]

    def edge(which, d, t):
        return pa.RecordBatch.from_arrays([pa.array([d], kinds[0]), *[pa.nulls(1, k) for k in kinds[1:]], pa.array([part], pa.int32()), pa.array([which], pa.int32()), pa.array([t], pa.string())], names=names)

    def emit():
        m = len(ids) - 1
        return pa.RecordBatch.from_arrays([*_compared(ids, texts), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string())], names=names)

    ids, texts, held, began = [], [], 0, False
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not began:
                yield edge(0, d, t)
                began = True
            ids.append(d)
            texts.append(t)
            held += len(t)
            if len(ids) > 1 and held >= 1 << 21:
                yield emit()
                ids, texts = ids[-1:], texts[-1:]
                held = len(texts[0])
    if began:
        if len(ids) > 1:
            yield emit()
        yield edge(1, ids[-1], texts[-1])


def _across(batches):
    """Rows (doc_id, text, next text): the last of a partition against the first of the next."""
    import pyarrow as pa

    for batch in batches:
        for d, t, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays(_compared([d, None], [t, following]), names=COLUMNS)


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likenesses.

    One shuffle puts the documents in order of doc_id, range by range. The last text of a
    range meets the first of the next in a second, small step: two texts a range.
    """
    spark = docs.sparkSession
    document_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("text")]
    # The number is stated, so that small partitions aren't merged into large sorts.
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(parts, *order[:2])
    rows = ranged.sortWithinPartitions(*order).select("doc_id", "text")
    found = materialize(rows.mapInArrow(lean(_inside), SCHEMA + ", part int, edge int, text string"), "simhash-compared")
    edges = found.where("edge IS NOT NULL").select("part", "edge", "doc_id", "text")
    filled = sorted(r["part"] for r in edges.where("edge = 1").select("part").collect())  # a number for each range
    follows = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "part int, _next int")
    first = edges.where("edge = 0").select(F.col("part").alias("_next"), F.col("text").alias("_following"))
    last = edges.where("edge = 1").join(follows, "part").join(first, "_next").select("doc_id", "text", "_following")
    joined = materialize(last.mapInArrow(lean(_across), SCHEMA), "simhash-edges")
    return found.where("edge IS NULL").select(*COLUMNS).unionByName(joined)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = fingerprints(as_bytes(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in got], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, fingerprint string")


def block_keys(value: np.ndarray, radius: int, whole: int) -> list[np.ndarray]:
    """Keys of every table for fingerprints (n, BITS / 8): one array of 64-bit keys each."""
    bits = np.unpackbits(value, axis=1)
    edges = np.linspace(0, BITS, radius + whole + 1).astype(int)
    with np.errstate(over="ignore"):
        place = seeded(BITS, 41)
        part = np.stack([(bits[:, a:b] * place[a:b]).sum(axis=1, dtype=np.uint64) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1)
        return [mix(part[:, list(pick)].sum(axis=1, dtype=np.uint64) + np.uint64(t + 1)) for t, pick in enumerate(combinations(range(radius + whole), whole))]


def _links(classes: DataFrame, radius: int, whole: int) -> DataFrame:
    """(name, head, links) of classes (name, size, fp): links counted by rows, and spanning edges, for every table."""

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            value = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for t, key in enumerate(block_keys(value, radius, whole)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(key.view(np.int64)), batch.column(0)], names=["table", "key", "name"])

    keyed = classes.select("name", "fp").mapInArrow(lean(keys), "table int, key long, name long")
    sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select(F.col("table").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("n") / GROUP).cast("int").alias("blocks")), "simhash-shared")
    some = maybe(keyed, "key", bits_of(sizes, "_k"))  # most keys have one class and never move again
    dealt = some.join(sizes, (some["table"] == sizes["_t"]) & (some["key"] == sizes["_k"])).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    # Blocks i <= j of a key meet once: a row goes to the pairs that hold its block.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["table", "key", "lo", "hi"]
    dealt = dealt.select("table", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", F.col("name").alias("_name"))
    dealt = dealt.join(classes, F.col("_name") == classes["name"]).select(*place, "block", "name", "size", "fp")
    dealt = dealt.repartition(*place).sortWithinPartitions(*place, "name")

    def meet(batches):
        import pyarrow as pa

        def flush(now, rows):
            if len(rows) < 2:
                return None
            block, name, size, fp = zip(*rows, strict=True)
            value = np.frombuffer(b"".join(fp), np.uint8).reshape(len(rows), -1)
            block, weight, own = np.array(block), np.array(size), np.stack(block_keys(value, radius, whole), axis=1)
            links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for i in range(len(rows) - 1):
                j = i + 1 + np.flatnonzero((hamming(value[i + 1 :], value[i]) <= radius) & ((block[i + 1 :] != block[i]) | (now[2] == now[3])))
                if not len(j):
                    continue
                # Only the first table in which a pair meets counts it.
                j = j[(own[j] == own[i]).argmax(axis=1) == now[0]]
                if not len(j):
                    continue
                links[j] += weight[i]
                links[i] += int(weight[j].sum())
                group = np.unique(np.append(root[j], root[i]))
                root[np.isin(root, group)] = group[0]
            at = np.flatnonzero(links)
            if not len(at):
                return None
            names = np.array(name, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[root[at]]), pa.array(links[at])], names=["name", "head", "links"])

        now, rows = None, []
        for batch in batches:
            for t, k, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, k, lo, hi) != now:
                    if (out := flush(now, rows)) is not None:
                        yield out
                    now, rows = (t, k, lo, hi), []
                rows.append(row)
        if (out := flush(now, rows)) is not None:
            yield out

    return materialize(dealt.mapInArrow(lean(meet), "name long, head long, links long"), "simhash-links")


def near_groups(prints: DataFrame, radius: int = RADIUS, whole: int = 1) -> DataFrame:
    """``prints`` (doc_id, fingerprint as hex, more columns) with n_near, the number of other rows within the radius,
    and near_id, the smallest doc_id reachable over them (the row's own without any)."""
    blank = "0" * (BITS // 4)
    classes = prints.where(F.col("fingerprint") != blank).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least"))
    classes = materialize(classes.select(F.xxhash64("fingerprint").alias("name"), "size", "least", F.unhex("fingerprint").alias("fp")), "simhash-classes")
    links = _links(classes, radius, whole)
    counts = links.groupBy("name").agg(F.sum("links").alias("links")).select(F.col("name").alias("_c"), "links")
    roots = components(links.select(F.col("name").alias("a"), F.col("head").alias("b")), "simhash-groups").select(F.col("node").alias("_n"), "component")
    named = classes.join(counts, classes["name"] == counts["_c"], "left").where("size > 1 OR links IS NOT NULL").join(roots, F.col("name") == roots["_n"], "left")
    named = materialize(named.select("name", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_near"), F.coalesce("component", "name").alias("_g")), "simhash-named")
    # Both sides of a join with a small table of its own, so that a hot group can be split.
    smallest = materialize(named.groupBy(F.col("_g").alias("_s")).agg(F.min("least").alias("near_id")), "simhash-least")
    named = materialize(named.join(smallest, F.col("_g") == F.col("_s")).select("name", "n_near", "near_id"), "simhash-near")
    keyed = prints.withColumn("_name", F.xxhash64("fingerprint"))
    bits = bits_of(named, "name")
    alone = maybe(keyed, "_name", bits, member=False).select(*prints.columns, F.lit(0).cast("long").alias("n_near"), F.col("doc_id").alias("near_id"))
    rest = maybe(keyed, "_name", bits).join(named, F.col("_name") == F.col("name"), "left")
    rest = rest.select(*prints.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("near_id")).alias("near_id"))
    discard(classes, links)
    return alone.unionByName(rest)
