"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Source s has size S_s (characters), weight w_s and the corpus a target of T
characters: a document of s is repeated Poisson(r_s) times, r_s = T w_s / S_s.
The count inverts the distribution function at a uniform number that MD5 draws from
(seed, doc_id, MD5 of the text, rank among rows equal in both): the same document has the same count in every run, task and retry, and
rows that share a doc_id, or have none, draw each for themselves, equal ones too. Only rows that may have an equal one are ranked: a bitmap
tells the others, and ranks are numbers inside blocks of ``RANK_ROWS`` rows plus those of earlier blocks, so no text gathers in one task.
A rate above ``PIECE`` is a sum of equal rates below it, each with a draw of its
own, so no term of a distribution function underflows. Copies then go to the
partition and place that MD5 of the same and the copy names: a shuffle of all rows.

Cases: a null source is a source; a null or empty text has size 0, and a source of
size 0 gets rate 0 (it can't change the mix), or 1 if the whole corpus is empty. All null doc_ids count as equal, as do a null and an
empty text; equal rows are ranked in the order in which the table is read. A source that ``weights`` doesn't name gets weight 0. Further columns pass
through; columns named mix_rate, mix_copy or mix_order give way to ours, but for :func:`mix_documents`,
which returns the input's columns only. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reducer import bits_of, maybe
from .storage import materialize

SEED = 20240607
ALPHA = 0.5
PIECE = 16.0
#: Sources beyond this many are joined by shuffle, salted, instead of broadcast.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Rows of one block in which equal rows are numbered.
RANK_ROWS = 1024


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the MD5 of the parts: 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _terms(rate: Column) -> Column:
    """Distribution function of Poisson(rate <= PIECE) at 0, 1, ... as far as doubles tell it from 1."""
    most = int(PIECE + 12 * math.sqrt(PIECE) + 12)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf")),
    )
    return step["cdf"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, target_chars: float | None = None) -> DataFrame:
    """(source, size, rate, pieces, cdf) of every source. Without ``weights`` a
    source weighs as its size to the power ``alpha``; the target is the corpus' size."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(float(alpha)))).otherwise(F.lit(0.0))
    else:
        named = F.lit(0.0)
        for key, value in weights.items():
            named = F.when(F.col("source").eqNullSafe(F.lit(key)), F.lit(float(value))).otherwise(named)
        weight = F.when(F.col("size") > 0, named).otherwise(F.lit(0.0))
    sizes = materialize(sizes.withColumn("weight", weight), "mix-sizes")
    total, weighed = sizes.agg(F.sum("size").cast("double"), F.sum("weight")).first()
    target = float(total or 0.0) if target_chars is None else float(target_chars)
    if total and not weighed:
        raise ValueError("no source with text has a weight")
    rate = F.when(F.col("size") > 0, F.lit(target) * F.col("weight") / F.lit(weighed or 1.0) / F.col("size")).otherwise(F.lit(0.0 if total else 1.0))
    pieces = F.greatest(F.lit(1), F.ceil(rate / F.lit(PIECE)).cast("int"))
    return sizes.withColumn("rate", rate).withColumn("pieces", pieces).withColumn("cdf", _terms(F.col("rate") / F.col("pieces")))


OURS = ("mix_rate", "mix_copy", "mix_order")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with the rank behind the ``_key`` of those that equal an earlier row."""
    hashed = rows.withColumn("_hash", F.xxhash64("_key"))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = bits_of(again, "_hash")
    some = materialize(maybe(hashed, "_hash", bits).withColumn("_at", F.monotonically_increasing_id()), "mix-equal")
    some = some.withColumn("_cut", F.floor(F.col("_at") / RANK_ROWS))
    sizes = some.groupBy("_key", "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = some.withColumn("_i", F.row_number().over(Window.partitionBy("_key", "_cut").orderBy("_at")) - 1)
    rank = F.col("_i") + F.col("_base")
    placed = inside.join(base, ["_key", "_cut"]).withColumn("_key", F.when(rank > 0, F.concat_ws("#", "_key", rank.cast("string"))).otherwise(F.col("_key")))
    return maybe(hashed, "_hash", bits, member=False).select(rows.columns).unionByName(placed.select(rows.columns))


def _copies(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Every document once for each copy: its row as a struct, its id and source, our columns."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), key.alias("_key"))
    rows = _ranked(rows)
    held = rates.select(F.col("source").alias("_name"), F.col("rate").alias("mix_rate"), F.col("pieces").alias("_pieces"), F.col("cdf").alias("_cdf"))
    if rates.select("source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(held), F.col("_source").eqNullSafe(F.col("_name")))
    else:  # a hot source is dealt over SALTS tasks
        salted = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (F.col("_deal") == F.col("_salt")) & F.col("_source").eqNullSafe(F.col("_name")))
    key = F.col("_key")
    below = lambda u: F.size(F.filter(F.col("_cdf"), lambda c: c <= u))
    # One draw decides unless the rate is above PIECE.
    several = F.aggregate(F.sequence(F.lit(1), F.col("_pieces")), F.lit(0), lambda n, j: n + below(uniform(F.lit(str(seed)), key, j.cast("string"))))
    drawn = joined.withColumn("_u", uniform(F.lit(str(seed)), key, F.lit("1")))
    count = drawn.withColumn("_n", F.when(F.col("_pieces") == 1, below(F.col("_u"))).otherwise(several))
    copies = count.where("_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    order = uniform(F.lit(str(seed)), F.lit("order"), key, F.col("mix_copy").cast("string"))
    return copies.select("_row", "_key", *OURS[:2], order.alias("mix_order"))


def _plain(copies: DataFrame, columns: list[str]) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in columns]


def replicate(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """Every document once for each copy, with mix_rate, mix_copy (from 0) and mix_order; not shuffled."""
    copies = _copies(docs, rates, seed)
    return copies.select(*_plain(copies, [c for c in docs.columns if c not in OURS]), *OURS)


def _shuffled(docs: DataFrame, weights, alpha: float, target_chars: float | None, seed: int) -> DataFrame:
    copies = _copies(docs, source_rates(docs, weights, alpha, target_chars), seed)
    return copies.repartition("mix_order").sortWithinPartitions("mix_order", "_key")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, target_chars: float | None = None, seed: int = SEED) -> DataFrame:
    """Replicated documents, shuffled over all partitions; ``mix_order`` is their order inside one."""
    copies = _shuffled(docs, weights, alpha, target_chars, seed)
    return copies.select(*_plain(copies, [c for c in docs.columns if c not in OURS]), *OURS)


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, target_chars: float | None = None, seed: int = SEED) -> DataFrame:
    """:func:`mix`, with the input's columns only."""
    copies = _shuffled(docs, weights, alpha, target_chars, seed)
    return copies.select(*_plain(copies, docs.columns))


#: DuckDB: the same counts and order for weights by size to the power ALPHA.
ORACLE = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, {ALPHA}) ELSE 0 END AS weight FROM sizes),
r AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM w)::DOUBLE * weight / (SELECT sum(weight) FROM w) / size
        ELSE CASE WHEN (SELECT sum(size) FROM w) > 0 THEN 0.0 ELSE 1.0 END END AS rate FROM w),
p AS (SELECT *, greatest(1, ceil(rate / {PIECE}))::INT AS pieces FROM r),
k AS (SELECT source, rate, pieces, unnest(range(0, 77)) AS k FROM p),
f AS (SELECT source, k, sum(exp(-rate / pieces + k * CASE WHEN rate > 0 THEN ln(rate / pieces) ELSE 0 END - lgamma(k + 1))
        * CASE WHEN rate = 0 AND k > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
draws AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, p.rate, unnest(range(1, p.pieces + 1)) AS j
    FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM draws),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.rate, count(f.k) AS n
    FROM u LEFT JOIN f ON u.source IS NOT DISTINCT FROM f.source AND f.cdf <= u.u GROUP BY ALL),
c AS (SELECT *, unnest(range(0, n)) AS copy FROM n WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, copy::INT AS mix_copy,
  ('0x' || substr(md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_order
FROM c
"""
