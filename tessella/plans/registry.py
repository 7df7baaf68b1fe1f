"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.functions.stats import round6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r(expr: str) -> str:
    """A double rounded as :func:`round6` does it."""
    return f"round(({expr}) + 1e-9::DOUBLE, 6) + 0::DOUBLE"


def odd(expr: str, key: str, sql: bool, infinite: bool = True) -> str:
    """A number that is missing in some rows: NaN, infinity or NULL for Spark, NULL alone in the oracle, where missing is one thing."""
    if sql:
        return f"CASE WHEN {key} % 23 = 7 OR {key} % 31 = 3{f' OR {key} % 29 = 5' if infinite else ''} THEN NULL ELSE {expr} END"
    endless = f" WHEN {key} % 29 = 5 THEN double('Infinity')" if infinite else ""
    return f"CASE WHEN {key} % 23 = 7 THEN double('NaN'){endless} WHEN {key} % 31 = 3 THEN NULL ELSE {expr} END"


def query(name: str, sql: str | None = None):
    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round6(build(spark, sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add
