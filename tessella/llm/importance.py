"""Importance resampling towards a target distribution by external sort-count.

Features are all runs of 1 to ``LENGTHS`` words; a feature's bucket is the crc32 of its bytes modulo ``BUCKETS``. One pass over
the texts writes every document's buckets as packed 16-bit numbers, with the documents' offsets beside
them, in blocks of bounded size. Counts come from these streams: each block is sorted and run-length
encoded, and the runs (at most ``BUCKETS`` a block) are summed by bucket. A bucket's gain is the log ratio of its
smoothed shares in target and source. The second pass reads the streams again, two bytes a feature and no text, gathers the gains
and adds them up between offsets (``np.add.reduceat``). Gumbel noise by a hash of doc_id then makes
the highest scores a weighted sample without replacement.

Crc32 is linear: the sum of joined byte strings follows from their sums and lengths, so every word is read once for all its features.
Scores are ranked in one order over all parts (``ordered``): equal scores spread over tasks as well.

Cases: null, empty and wordless texts have no features and weight 0; a text whose stream is longer than a block takes
several, its parts' sums are added; rows that share a doc_id count and are drawn each for itself (equal scores: fewer features first), a null doc_id is
hashed as ``null`` and comes first among ties; target texts that are null have no features; further columns are ignored; empty tables on
either side count as 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .storage import document_batches, lean, materialize
from .textkernel import LOWER, as_bytes, slices

BUCKETS = 10_000
LENGTHS = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Bytes of text behind one block of the streams, which holds at most 1.5 features a byte.
BLOCK = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_AHEAD = re.compile(rb"(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[0-9A-Za-z\x80-\xFF]+){0,%d}" % (LENGTHS - 1))
#: Bytes up to which words are summed in step.
_STEPS = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0))
    return t


_TABLE = _crc_table()
_FULL = np.uint32(0xFFFFFFFF)


def _behind(levels: int = 31) -> np.ndarray:
    """[k, byte of the sum, its value]: what the sum becomes when 2^k zero bytes follow. XOR of the four gives it."""
    out = np.empty((levels, 4, 256), np.uint32)
    for i in range(4):
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        out[0, i] = (v >> np.uint32(8)) ^ _TABLE[v & np.uint32(255)]
    for k in range(1, levels):
        for i in range(4):
            out[k, i] = _moved(out[k - 1], out[k - 1, i])
    return out


def _moved(shift: np.ndarray, v: np.ndarray) -> np.ndarray:
    return shift[0][v & 255] ^ shift[1][(v >> 8) & 255] ^ shift[2][(v >> 16) & 255] ^ shift[3][v >> 24]


_ZEROS = _behind()


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of byte strings laid end to end, from their sums and the second ones' sizes."""
    out = first.copy()
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        at = np.flatnonzero((size >> k) & 1)
        out[at] = _moved(_ZEROS[k], out[at])
    return out ^ second


def crc32_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of many byte ranges: short ones all in step, the few long ones one by one."""
    size = end - start
    order = np.argsort(-size, kind="stable")  # longest first: those still under way are always the first
    long = int((size > _STEPS).sum())
    out = np.full(len(start), _FULL)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(buf[start[i] : end[i]]) ^ 0xFFFFFFFF
    order = order[long:]
    begin, rising = start[order], size[order][::-1]
    part = out[order]
    for i in range(int(rising[-1]) if len(rising) else 0):
        live = len(rising) - int(np.searchsorted(rising, i, side="right"))
        v = part[:live]
        part[:live] = _TABLE[(v ^ buf[begin[:live] + i]) & 255] ^ (v >> np.uint32(8))
    out[order] = part
    return out ^ _FULL


_BLANK = np.uint32(0xE96CCF45)  # crc32 of one blank


def cuts(text: bytes, limit: int = BLOCK) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces that end between words: (piece with the next words that its features need, bytes of its own)."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(at + limit, len(text)))
        end = gap.start() if gap else len(text)
        yield text[at : _AHEAD.match(text, end).end()], end - at
        at = end


def bucket_streams(texts: list[bytes], own: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features as uint16, documents' features and words; with ``own`` only of words that begin before that byte.
    A document's runs of one length come together."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    ink = np.zeros(len(buf) + 1, bool)
    np.take(_WORD, buf, out=ink[1:])
    turns = np.flatnonzero(ink[1:] != ink[:-1])
    start, end = turns[::2], turns[1::2]
    first = np.searchsorted(start, edge)
    n = np.diff(first)
    one, size = crc32_of(buf, start, end), end - start
    last = np.repeat(first[1:], n)  # behind the last word of each word's document
    runs, here = [one], np.arange(len(one))
    owners = [np.repeat(np.arange(len(texts)), n)]
    run, heads = one, [here]
    for k in range(1, LENGTHS):
        keep = here[here + k < last[here]]
        spaced = joined(run[np.searchsorted(here, keep)], np.full(len(keep), _BLANK), np.ones(len(keep), np.int64))
        run, here = joined(spaced, one[keep + k], size[keep + k]), keep
        runs.append(run)
        owners.append(owners[0][keep])
        heads.append(keep)
    owner, bucket = np.concatenate(owners), (np.concatenate(runs) % np.uint32(BUCKETS)).astype(np.uint16)
    if own is not None:
        mine = start[np.concatenate(heads)] < own
        return bucket[mine], np.array([mine.sum()]), np.array([(start < own).sum()])
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(texts)), n


_STREAM = "row long, doc_ids array<long>, words array<int>, sizes array<long>, buckets binary"


def write_streams(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Blocks of packed buckets: ``sizes`` says how many belong to each of ``doc_ids``. A long document has several blocks of its own,
    which share a ``row`` (null: whole documents)."""

    def block(row, ids, words, sizes, buckets):
        import pyarrow as pa

        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((row, ids, words, sizes, buckets.astype("<u2").tobytes()), kinds, strict=True)], names=[c.split()[0] for c in _STREAM.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                ids = batch.column(0).slice(lo, 4096).to_pylist()
                texts = as_bytes(batch.column(1).slice(lo, 4096).to_pylist())
                for a, b in slices(texts, BLOCK):
                    if len(texts[a]) <= BLOCK:
                        buckets, sizes, words = bucket_streams(texts[a:b])
                        yield block(None, ids[a:b], words.tolist(), sizes.tolist(), buckets)
                        continue
                    for piece, own in cuts(texts[a]):
                        buckets, sizes, words = bucket_streams([piece], own)
                        yield block(seen, ids[a:b], words.tolist(), sizes.tolist(), buckets)
                    seen += 1

    document_batches(docs.sparkSession)
    return materialize(docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _STREAM), "buckets")


def sort_count(streams: DataFrame) -> np.ndarray:
    """How often each bucket occurs: blocks sorted and run-length encoded, runs summed."""

    def run(batches):
        import pyarrow as pa

        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                values = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                if len(values):
                    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
                    held[values[begin]] += np.diff(np.append(begin, len(values)))
        bucket = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(held[bucket])], names=["bucket", "n"])

    document_batches(streams.sparkSession)
    runs = streams.select("buckets").mapInArrow(lean(run), "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, both smoothed by one."""
    s, t = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words, weight of every document, from its stream."""
    held = streams.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        import pyarrow as pa

        names = ["row", "doc_id", "n_features", "n_words", "weight"]
        kinds = [pa.int64()] * len(names)
        for batch in batches:
            for row, ids, words, sizes, stream in zip(*(batch.column(i) for i in range(5)), strict=True):
                values = held.value[np.frombuffer(stream.as_buffer(), "<u2")]
                n = np.array(sizes.as_py(), np.int64)
                weight = np.zeros(len(n), np.int64)
                some = np.flatnonzero(n)
                if len(some):  # reduceat has no empty ranges
                    weight[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some])
                columns = ([row.as_py()] * len(n), ids.as_py(), n, words.as_py(), weight)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    document_batches(streams.sparkSession)
    out = streams.mapInArrow(lean(run), "row long, doc_id long, n_features long, n_words long, weight long")
    whole = out.where("row IS NULL").drop("row")
    parts = out.where("row IS NOT NULL").groupBy("row").agg(*[f(c).alias(c) for c, f in (("doc_id", F.max), ("n_features", F.sum), ("n_words", F.sum), ("weight", F.sum))])
    return whole.unionByName(parts.drop("row"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every row of ``docs``; ``target`` has a column text."""
    streams = write_streams(docs)
    aim = write_streams(target.select("text").withColumn("_none", F.lit(None).cast("long")), "_none")
    weighed = weigh(streams, gains(sort_count(streams), sort_count(aim)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= least_words
    ranked = numbered(scored.where(able), "score-order", [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")])
    most = scored.where(able).count() * percent // 100
    drawn = ranked.withColumn("rank", F.when(F.col("_place") < most, F.col("_place") + 1))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(columns).unionByName(rest.select(columns))


#: DuckDB: every feature as a string, its crc32 byte by byte over a table of 256.
ORACLE = f"""
WITH tab AS (SELECT list(list_reduce([i] || [0::BIGINT for k in range(8)], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wd AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d), wb AS (SELECT q, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM (SELECT row_number() OVER () AS q, w FROM b)),
fd AS (SELECT rid, unnest([x, x || ' ' || lead(x) OVER o, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o]) AS f FROM wd WINDOW o AS (PARTITION BY rid ORDER BY i)),
fb AS (SELECT unnest([x, x || ' ' || lead(x) OVER o, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o]) AS f FROM wb WINDOW o AS (PARTITION BY q ORDER BY i)),
names AS (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb) WHERE f IS NOT NULL),
coded AS (SELECT f, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), (2 * i - 1)::INT, 2))::BIGINT) AS c FROM names),
crc AS (SELECT f, xor(4294967295, list_reduce([4294967295::BIGINT] || c, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % {BUCKETS} AS bucket FROM coded, tab),
bd AS (SELECT rid, bucket FROM fd JOIN crc USING (f)),
s AS (SELECT bucket, count(*) AS s FROM bd GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM fb JOIN crc USING (f) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM bd JOIN g USING (bucket) GROUP BY rid),
z AS (SELECT d.rid, doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM z WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (rid)
"""
