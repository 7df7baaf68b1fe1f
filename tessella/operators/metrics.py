"""Binary metrics and curves. Input: group columns, label (0/1), score.

Curves first count rows of every distinct score, so their running sums are over
scores, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    out = rows.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    one = lambda c: F.greatest(c, F.lit(1))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = tp / one(tp + fp), tp / one(tp + fn)
    return out.select(*keys, "tp", "tn", "fp", "fn", ((tp + tn) / one(tp + tn + fp + fn)).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), (tn / one(tn + fp)).alias("specificity"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"))


#: Ranges of scores that a group's running sums are cut into.
RANGES = 256


def _cumulative(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp at every distinct score (rows at or above it), its own counts p, n, and the totals.

    Running sums come in two levels, so no group fills a task: sums of ranges of scores (at most ``RANGES`` rows a group, cut at
    quantiles of the distinct scores), then scores inside each range.
    """
    steps = rows.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    cuts = steps.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)])).alias("_cuts"))
    named = lambda df: df.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *[c for c in df.columns if c not in keys])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_{i}"))
    ranged = steps.join(named(cuts), match).select(*keys, "score", "p", "n", F.size(F.filter("_cuts", lambda c: c <= F.col("score"))).alias("_range"))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above, every = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    z = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(*keys, F.col("_range").alias("_own"), z(F.sum("_p").over(above)).alias("_tp"), z(F.sum("_n").over(above)).alias("_fp"), F.sum("_p").over(every).alias("pos"), F.sum("_n").over(every).alias("neg"))
    joined = ranged.join(named(sums), match & (F.col("_range") == F.col("_own")))
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*keys, "score", "p", "n", (F.col("_tp") + F.sum("p").over(down)).alias("tp"), (F.col("_fp") + F.sum("n").over(down)).alias("fp"), "pos", "neg")


def roc_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A point at every distinct score, and before the first (threshold NULL: nothing predicted)."""
    c = _cumulative(rows, keys).drop("p", "n")
    ends = c.groupBy(*keys).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg")).select(*keys, F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "pos", "neg")
    u = c.unionByName(ends)
    return u.select(*keys, F.col("score").alias("threshold"), (F.col("fp") / F.greatest("neg", F.lit(1))).alias("false_positive_rate"), (F.col("tp") / F.greatest("pos", F.lit(1))).alias("true_positive_rate"), "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"))


def pr_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Precision 1 where nothing is predicted."""
    r = roc_curve(rows, keys)
    return r.select(*keys, "threshold", (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(1.0)).alias("precision"), "tp", "tn", "fp", "fn")


def threshold_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics at every distinct score and at 0, 0.5 and 1."""
    fixed = rows.select(*keys).distinct().withColumn("score", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))).withColumn("label", F.lit(None).cast("int"))
    c = _cumulative(rows.select(*keys, "score", F.col("label").cast("int").alias("label")).unionByName(fixed.select(*keys, "score", "label")), keys)
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("pos") - tp, F.col("neg") - fp
    one = lambda x: F.greatest(x, F.lit(1))
    precision, recall = tp / one(tp + fp), tp / one(tp + fn)
    return c.select(*keys, F.col("score").alias("threshold"), ((tp + tn) / one(F.col("pos") + F.col("neg"))).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), (tn / one(tn + fp)).alias("specificity"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"))


def auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoids under both curves; NULL unless both labels occur.

    The point before a score has the counts without the score's own; before the first it is (0, 0), with precision 1.
    """
    c = _cumulative(rows, keys).where("p + n > 0")
    pos, neg = F.greatest("pos", F.lit(1)), F.greatest("neg", F.lit(1))
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    precision = lambda tp, fp: F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
    roc = F.col("n") / neg * (F.col("tp") / pos + tp0 / pos) / 2
    pr = F.col("p") / pos * (precision(F.col("tp"), F.col("fp")) + precision(tp0, fp0)) / 2
    out = c.groupBy(*keys).agg(F.sum(roc).alias("roc"), F.sum(pr).alias("pr"), ((F.max("pos") > 0) & (F.max("neg") > 0)).alias("both"))
    return out.select(*keys, F.when(F.col("both"), F.col("roc")).alias("roc_auc"), F.when(F.col("both"), F.col("pr")).alias("pr_auc"))
