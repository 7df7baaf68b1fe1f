"""Best-fit packing of token pieces into sequences, under several capacities.

A piece has a vector (tokens, documents = 1, attention cost = tokens^2) and a
sequence a capacity in each dimension. Pieces come in descending order of length. Each
goes to the open sequence that takes it in every dimension and scores best: the least
weighted norm of what would be left (``norm``), or the greatest weighted product of
its vector and the sequence's residual (``dot``). If none takes it, a new one opens.

All pieces of one length are alike, so the decisions need only the histogram of
lengths (at most ``capacity`` rows, whatever the corpus). Open sequences with the same
content are one class with a count; a decision moves as many pieces into as many
sequences of the best class as both have. The plan says, for runs of pieces of one length
by rank, which run of sequences they go to and at which offset. A piece's rank
is its number among pieces of its length in its own task plus those of earlier tasks: a sum
over a table of (task, length), so no length gathers in one place, however common.

Cases: a null or empty text is one piece with the end id alone; a document longer than
the capacity is cut into full pieces and a rest; null doc_ids and rows that share
a doc_id are packed like others; further columns are ignored by ``pieces``; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import document_batches, lean, materialize
from .tokens import END_ID, encoder

CAPACITY = 4096


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weights of its dimensions. With the default
    documents and attention the token capacity binds alone (4096 tokens allow no more of either), but
    which sequence a piece goes to depends on all three residuals alike."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Rows (length, rank_from, rank_to, sequence_from, offset) that place every piece.

    Rank r in [rank_from, rank_to) goes to sequence sequence_from + r - rank_from.
    """
    cap = np.array([limits.tokens, limits.documents, limits.attention], float)
    weights = np.array(limits.weights)
    left = np.zeros((0, 3))  # residuals of each class
    number = np.zeros(0, np.int64)  # its sequences
    runs: list[list[tuple[int, int]]] = []  # their ids as [from, to)
    where: dict[tuple[int, int, int], int] = {}
    opened, rows = 0, []

    def add(residual: tuple[int, int, int], ids: list[tuple[int, int]]) -> None:
        nonlocal left, number
        n = sum(b - a for a, b in ids)
        if residual[0] == 0 or residual[1] == 0:
            return
        at = where.get(residual)
        if at is None:
            free = np.flatnonzero(number == 0)
            if len(free) > 64:  # reuse rows of classes that are used up
                at = int(free[0])
                where.pop(tuple(int(x) for x in left[at]), None)
            else:
                at = len(number)
                left = np.concatenate([left, np.zeros((1, 3))])
                number = np.append(number, 0)
                runs.append([])
            left[at], where[residual] = residual, at
            runs[at] = []
        number[at] += n
        runs[at] += ids

    def take(at: int, n: int) -> list[tuple[int, int]]:
        got = []
        while n:
            a, b = runs[at].pop()
            if b - a > n:
                runs[at].append((a + n, b))
                b = a + n
            got.append((a, b))
            n -= b - a
        number[at] -= sum(b - a for a, b in got)
        return got

    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens fits in no sequence")
        todo, rank = histogram[length], 0
        while todo:
            fits = np.flatnonzero((number > 0) & (left >= item).all(axis=1)) if len(number) else np.zeros(0, np.int64)
            if len(fits):
                if limits.rule == "dot":
                    score = -(weights * (item / cap) * (left[fits] / cap)).sum(axis=1)
                else:
                    score = (weights * ((left[fits] - item) / cap) ** 2).sum(axis=1)
                best = int(fits[np.lexsort((fits, score))[0]])
                n = min(todo, int(number[best]))
                residual = tuple(int(x) for x in left[best])
                ids = take(best, n)
            else:
                # New sequences that pieces of this length alone may fill come at once.
                n = -(-todo // max(1, int(np.floor(cap / item).min())))
                residual, ids = tuple(int(x) for x in cap), [(opened, opened + n)]
                opened += n
            for a, b in ids:
                rows.append((length, rank, rank + b - a, a, limits.tokens - residual[0]))
                rank += b - a
            todo -= n
            add((residual[0] - length, residual[1] - 1, residual[2] - length * length), ids)
    return np.array(rows, np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise documents and cut the long ones. ``_rank`` counts the pieces of one
    length inside task ``_part``; the table is written, so both stay what they are."""

    def run(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path, end_id)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(lo, 256).to_pylist()
                for d, x in zip(ids, encode(batch.column(1).slice(lo, 256).to_pylist()), strict=True):
                    for i, at in enumerate(range(0, len(x), capacity)):
                        cut = x[at : at + capacity]
                        rows.append((d, i, at, len(cut), zlib.crc32(cut.astype("<u4").tobytes()), part, int(seen[len(cut)])))
                        seen[len(cut)] += 1
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])

    document_batches(docs.sparkSession)
    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES), "pieces")


def pack(cut: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Place the rows of :func:`pieces`: its columns with sequence_id and offset."""
    spark = cut.sparkSession
    tally = cut.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each task and length, never a row for each piece.
    base = tally.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("_part").alias("_p"), F.col("length").alias("_l"), "_base")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, limits)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    held = spark.sparkContext.broadcast(rows)

    def run(batches):
        import pyarrow as pa

        table = held.value
        first = np.searchsorted(table[:, 0], np.arange(limits.tokens + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() + batch.column("_base").to_numpy()
            row = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                here = np.flatnonzero(length == n)
                a, b = first[n], first[n + 1]
                row[here] = a + np.searchsorted(table[a:b, 1], rank[here], side="right") - 1
            sequence = table[row, 3] + rank - table[row, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(table[row, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = cut.join(base, (cut["_part"] == base["_p"]) & (cut["length"] == base["_l"]))
    joined = joined.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_base")
    return joined.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits()) -> DataFrame:
    """Tokenise, cut and pack."""
    return pack(pieces(docs, tokenizer_path, limits.tokens), limits)
