"""Bounded samples of labelled documents for the classifiers trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .mixing import uniform


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int | None = None) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """About ``per_class`` documents of each label (at most twice that), the first
    ``max_chars`` of each text (all without it), from the training fold only, and the fold's count of
    each label. The sample's size doesn't grow with the tables, so its join is broadcast.

    Rows whose label is neither 0 nor 1, or without text, are left out; a document with several
    labels or rows counts as often as it appears. The order is fixed by a hash of doc_id.
    """
    fold = labels.select("doc_id", label).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("_y"))
    counts = {int(y): int(n) for y, n in fold.groupBy("_y").count().collect()}
    drawn = uniform(F.lit(label), F.col("doc_id").cast("string"))
    cut = F.lit(0.0)
    for y, n in counts.items():
        cut = F.when(F.col("_y") == y, F.lit(min(1.0, per_class / n))).otherwise(cut)
    picked = fold.withColumn("_u", drawn).where(F.col("_u") < cut)
    few = picked.orderBy("_u", "doc_id").limit(4 * per_class)
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars).alias("text")
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").select("_u", "_y", text).orderBy("_u", "text").limit(8 * per_class).collect()
    return [(r["text"], int(r["_y"])) for r in rows], counts
