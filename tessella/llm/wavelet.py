"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as one wavelet matrix: plane j has
bit (top - j) of every id, in the order that stable partitions by the planes
above leave. Planes are cut in blocks of ``BLOCK`` bits, each compressed by
itself, with the number of ones before every block. ``access``, ``rank``,
``select``, ``count`` and ``occurrences`` decode only the blocks that they touch;
``decode`` restores all ids by undoing one partition after another.

File: magic ``TWM1``; header (documents, ids, bits, blocks a plane); the compressed
table of documents (ids, null flags, lengths); for every plane its zeros, the ones
before each block and the blocks' byte offsets; then the blocks.

Cases: a null or empty text is a document with the end id alone; a null doc_id is
kept and sorts first; rows that share a doc_id are ordered by text and all kept;
an empty table gives no shard; further columns are ignored. A shard ends at
``shard_tokens`` ids; one document never spans shards, so a longer one is a shard
by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import document_batches, lean, materialize
from .tokens import END_ID, encoder

MAGIC = b"TWM1"
HEADER = struct.Struct("<4sIQBII")
BLOCK = 1 << 17
SHARD_TOKENS = 1 << 21

SHARD_SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def encode_shard(doc_ids: list[int | None], ids: list[np.ndarray], level: int = 1) -> bytes:
    """One shard's file."""
    press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
    seq = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    bits = max(1, int(seq.max()).bit_length()) if len(seq) else 1
    n, blocks = len(seq), -(-len(seq) // BLOCK)
    table = press.compress(
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], "u1").tobytes()
        + np.fromiter(map(len, ids), "<i8", len(ids)).tobytes()
    )
    heads, body = [], []
    for shift in range(bits - 1, -1, -1):
        plane = (seq >> seq.dtype.type(shift)) & seq.dtype.type(1) != 0
        packed = np.packbits(plane)
        files = [press.compress(packed[i : i + BLOCK // 8].tobytes()) for i in range(0, len(packed), BLOCK // 8)]
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        total = int(ones.sum())
        heads.append(struct.pack("<Q", n - total) + (np.cumsum(ones) - ones).astype("<u8").tobytes() + np.fromiter(map(len, files), "<u4", blocks).tobytes())
        body += files
        seq = np.concatenate([seq[~plane], seq[plane]])
    return b"".join([HEADER.pack(MAGIC, len(doc_ids), n, bits, blocks, len(table)), table, *heads, *body])


class WaveletShard:
    """Reader of one shard: a bytes-like file (a memory map will do)."""

    def __init__(self, file, cached_blocks: int = 256):
        self.file = memoryview(file)
        magic, docs, self.n, self.bits, self.blocks, table = HEADER.unpack_from(self.file)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.open = zstandard.ZstdDecompressor()
        at = HEADER.size
        raw = self.open.decompress(self.file[at : at + table])
        null = np.frombuffer(raw, "u1", docs, 8 * docs)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", docs).tolist(), null.tolist(), strict=True)]
        self.sizes = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.starts = np.cumsum(self.sizes) - self.sizes
        at += table
        self.zeros, self.ones, sizes = [], [], []
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", self.file, at)[0])
            self.ones.append(np.frombuffer(self.file, "<u8", self.blocks, at + 8).astype(np.int64))
            sizes.append(np.frombuffer(self.file, "<u4", self.blocks, at + 8 + 8 * self.blocks).astype(np.int64))
            at += 8 + 12 * self.blocks
        flat = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.at = at + np.concatenate([[0], np.cumsum(flat)])
        self.cache: dict[int, np.ndarray] = {}
        self.cached_blocks = cached_blocks

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The block's bits."""
        key = plane * self.blocks + block
        if key not in self.cache:
            if len(self.cache) >= self.cached_blocks:
                self.cache.pop(next(iter(self.cache)))
            raw = self.open.decompress(self.file[self.at[key] : self.at[key + 1]])
            self.cache[key] = np.unpackbits(np.frombuffer(raw, np.uint8))
        return self.cache[key]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the plane's first i bits."""
        block, rest = divmod(i, BLOCK)
        if block >= self.blocks:
            return self.n - self.zeros[plane]
        return int(self.ones[plane][block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of the plane."""
        before = self.ones[plane] if bit else np.arange(self.blocks) * BLOCK - self.ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        hits = np.flatnonzero(self._block(plane, block)[: min(BLOCK, self.n - block * BLOCK)] == bit)
        return block * BLOCK + int(hits[k - int(before[block])])

    def _bit(self, plane: int, token: int) -> int:
        return token >> (self.bits - 1 - plane) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane in range(self.bits):
            bit = int(self._block(plane, i // BLOCK)[i % BLOCK])
            ones = self._rank1(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for plane in range(self.bits):
            a, b = self._rank1(plane, lo), self._rank1(plane, hi)
            lo, hi = (self.zeros[plane] + a, self.zeros[plane] + b) if self._bit(plane, token) else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the id before position i."""
        return self.count(token, 0, i)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the id in positions lo..hi-1."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id."""
        if token < 0 or token >> self.bits:
            raise IndexError(k)
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for plane in range(self.bits - 1, -1, -1):
            bit = self._bit(plane, token)
            i = self._select(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> list[int]:
        """Positions of the id in lo..hi-1."""
        first = self.rank(token, lo)
        return [self.select(token, first + k) for k in range(self.count(token, lo, hi))]

    def decode(self) -> np.ndarray:
        """All ids in order."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            bits = np.concatenate([np.frombuffer(self.open.decompress(self.file[self.at[k] : self.at[k + 1]]), np.uint8) for k in range(plane * self.blocks, (plane + 1) * self.blocks)]) if self.n else np.zeros(0, np.uint8)
            one = np.unpackbits(bits)[: self.n].view(bool)
            up = np.empty_like(out)
            up[~one], up[one] = out[: self.zeros[plane]], out[self.zeros[plane] :]
            up |= one.astype(out.dtype) << out.dtype.type(self.bits - 1 - plane)
            out = up
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of each document."""
        ids = self.decode()
        for d, a, n in zip(self.doc_ids, self.starts.tolist(), self.sizes.tolist(), strict=True):
            yield d, a, ids[a : a + n]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write documents (doc_id, text) as shards in ascending doc_id order, one file
    each, and return the table of the written files. ``part``, ``seq`` order them."""

    def build(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        part, seq, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer_path, end_id)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([encode_shard(doc_ids, ids)], pa.binary())], names=SHARD_SCHEMA.names)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo in range(0, len(keys), 256):
                for d, x in zip(keys[lo : lo + 256], encode(batch.column(1).slice(lo, 256).to_pylist()), strict=True):
                    if ids and held + len(x) > shard_tokens:
                        yield flush()
                        seq, doc_ids, ids, held = seq + 1, [], [], 0
                    doc_ids.append(d)
                    ids.append(x)
                    held += len(x)
        if ids:
            yield flush()

    document_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialize(ordered.mapInArrow(lean(build), SHARD_SCHEMA), "wavelet", compression="none", maxRecordsPerFile=1)


DIGEST_SCHEMA = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"


def read_digests(shards: DataFrame) -> DataFrame:
    """Read shard files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                got = [(row["part"], row["seq"], d, a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in WaveletShard(row["payload"]).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    # One row a shard: the only table in one task, a two-millionth of the ids.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return shards.select("part", "seq", "payload").mapInArrow(lean(read), DIGEST_SCHEMA).join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write and read back: see :func:`write_shards` and :func:`read_digests`."""
    return read_digests(write_shards(docs, tokenizer_path, **options))
