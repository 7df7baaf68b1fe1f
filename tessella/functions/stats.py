"""Missing-aware numeric expressions. NULL means missing; NaN never enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def finite(c) -> Column:
    """The number, or NULL for NaN and infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def without_nan(df, infinite: bool = False):
    """``df`` with NULL for NaN in its double and float columns, and for infinities too if ``infinite``: Spark takes NaN for the greatest number."""
    clean = finite if infinite else (lambda c: F.when(~F.isnan(c), F.col(c)))
    return df.withColumns({c: clean(c) for c, t in df.dtypes if t in ("double", "float")})


def bounded(c) -> Column:
    """1 - exp(-max(0, v)): a residual in [0, 1)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), 1 - F.exp(-F.greatest(c, F.lit(0.0))))


def weighted(value, weight) -> Column:
    """Aggregate: mean of ``value`` by ``weight``, none below TINY."""
    w = F.greatest(F.col(weight) if isinstance(weight, str) else weight, F.lit(TINY))
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def sigmoid(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


def array_median(a: Column) -> Column:
    """Median of the non-null numbers of an array; NULL if there are none."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(s)
    half = F.floor((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(s, half) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def interval_distance(value: Column, low: Column, high: Column) -> Column:
    """How far a value lies outside [low, high]."""
    return F.greatest(low - value, F.lit(0.0), value - high)


def log_interval_distance(value: Column, low: Column, high: Column) -> Column:
    return interval_distance(F.ln(value), F.ln(low), F.ln(high))


def round6(df, *skip: str):
    """Every double column rounded to 6 decimals, for comparisons across engines: halves go up, -0 becomes 0."""
    return df.select(*[(F.round(F.col(c) + F.lit(1e-9), 6) + F.lit(0.0)).alias(c) if t in ("double", "float") and c not in skip else F.col(c) for c, t in df.dtypes])
