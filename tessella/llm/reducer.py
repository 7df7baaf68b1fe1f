"""Semi-join reduction by a bitmap of fixed size.

``bits_of`` hashes keys into a bitmap of 2^24 bits, kept as at most 266,306 words of 63
bits: 4 MB, whatever the number of keys, so it may be broadcast. A row whose bit
isn't set has none of the keys; the others go on to an exact join. With very many keys the
bitmap fills up and saves less, but nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

BITS = 1 << 24
WORD = 63


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(BITS))


def bits_of(keys: DataFrame, column: str) -> DataFrame:
    """(_block, _word) of the keys in a column (null is a key)."""
    at = keys.select(_place(F.col(column)).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / WORD).alias("_block")).agg(F.bit_or(F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(at % {WORD} AS INT))")).alias("_word"))
    return materialize(words, "bits")


def maybe(df: DataFrame, column: str, bits: DataFrame, member: bool = True) -> DataFrame:
    """Rows that may have one of the keys (``member``), or those that have none for sure."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), _place(F.col(column)).alias("_at"))
    joined = rows.join(F.broadcast(bits), F.floor(F.col("_at") / WORD) == F.col("_block"), "left")
    hit = F.coalesce(F.expr(f"_word & shiftleft(CAST(1 AS BIGINT), CAST(_at % {WORD} AS INT))") != 0, F.lit(False))
    return joined.where(hit if member else ~hit).select("_row.*")
