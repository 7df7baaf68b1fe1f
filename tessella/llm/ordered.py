"""Global order without a single task: sorted tables, and sums carried from one part to the next.

A table sorted by ranges is written once with ``_part``, the number of the task that wrote it. Running
sums inside a part come from one pass behind its sort; what has to be added to them
is a sum over earlier parts, one row a part. These rows (as many as the
sort had tasks, whatever the number of rows) are all that the driver ever sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import document_batches, lean, materialize


def sort_written(df: DataFrame, name: str, ranges: list[Column], order: list[Column] | None = None, scan: Callable[[Iterator], Iterator] | None = None, schema: str | None = None) -> DataFrame:
    """``df`` sorted by ``order`` (``ranges`` if None), cut by ``ranges`` only, with ``_part``. ``scan`` passes over
    every part's Arrow batches in order and gives the columns of ``schema``. ``df`` is read twice (once to find the cuts)."""
    out = df.repartitionByRange(*ranges).sortWithinPartitions(*(order or ranges))
    if scan is not None:
        document_batches(df.sparkSession)
        out = out.mapInArrow(lean(scan), schema)
    return materialize(out.withColumn("_part", F.spark_partition_id()), name)


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Rows with ``_place``: their number from 0 in ``order``, over all parts."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The written id is (task << 33) + number inside the task.
    table = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    base = carried(counts, lambda before, row: before + row["n"], 0, {"_base": "long"}, lambda state: (state,))
    out = table.withColumn("_part", part).join(F.broadcast(base), "_part")
    return out.withColumn("_place", F.col("_at") - F.shiftleft(F.col("_part"), 33) + F.col("_base")).drop("_part", "_at", "_base")


def carried(summary: DataFrame, step: Callable, start, schema: dict[str, str], value: Callable) -> DataFrame:
    """(_part, ...) of every part: ``value`` of the state that ``step`` reached over the parts before it."""
    state, rows = start, []
    for row in sorted(summary.collect(), key=lambda r: r["_part"]):
        rows.append((row["_part"], *value(state)))
        state = step(state, row)
    return summary.sparkSession.createDataFrame(rows, "_part int, " + ", ".join(f"{k} {t}" for k, t in schema.items()))


def carried_runs(table: DataFrame, key: list[str], at: str, values: list[str], combine: Callable, names: list[str]) -> DataFrame:
    """For running values inside runs of equal ``key``: (_part, names...), to be combined with the rows of a part's
    first run. 0 where that run begins in the part. ``at`` grows inside a run; ``combine`` adds two numbers."""
    first = F.struct(*key)
    summary = table.groupBy("_part").agg(F.min(first).alias("first"), F.max(F.struct(first.alias("k"), F.col(at).alias("at"), *[F.col(v) for v in values])).alias("last"))
    zero = tuple(0 for _ in values)

    def step(state, row):
        run, sums = state
        got = tuple(int(row["last"][v]) for v in values)
        if row["first"] == row["last"]["k"] == run:
            got = tuple(combine(a, b) for a, b in zip(sums, got, strict=True))
        return row["last"]["k"], got

    # The state of the parts before says what to add only if the run goes on.
    rows, state = [], (None, zero)
    for row in sorted(summary.collect(), key=lambda r: r["_part"]):
        rows.append((row["_part"], *(state[1] if row["first"] == state[0] else zero)))
        state = step(state, row)
    return table.sparkSession.createDataFrame(rows, "_part int, " + ", ".join(f"{n} long" for n in names))
