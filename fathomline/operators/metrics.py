"""Evaluation queries: confusion, calibration, rank statistics, segmentation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn")]


def balanced_accuracy() -> Column:
    """Mean of both classes' recall; an absent class counts 0."""
    return (share(F.col("tp"), F.col("tp") + F.col("fn")) + share(F.col("tn"), F.col("tn") + F.col("fp"))) / 2


def calibration_curve(scores: DataFrame, steps: int = 100) -> DataFrame:
    """t, tp, fn, fp, tn, ba for steps + 1 even thresholds from the least to the greatest score (columns s, good).

    Scores are first counted by the interval between thresholds they fall in; running sums over the intervals give the
    confusion counts, so rows are read once and not once a threshold.
    """
    ends = scores.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"), "lo", "hi").select("k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / steps).alias("t"))
    listed = grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("ts"))  # steps + 1 numbers
    below = F.size(F.filter("ts", lambda t: t <= F.col("s")))  # thresholds at which the row is predicted good
    counted = scores.crossJoin(F.broadcast(listed)).groupBy(below.alias("upto")).agg(F.count_if(F.col("good") == 1).alias("p"), F.count_if(F.col("good") != 1).alias("q"))
    over = grid.join(F.broadcast(counted), F.col("upto") > F.col("k")).groupBy("k").agg(F.sum("p").alias("tp"), F.sum("q").alias("fp"))
    whole = counted.agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rows = grid.join(over, "k", "left").crossJoin(whole).select("t", F.coalesce("tp", F.lit(0)).alias("tp"), (F.col("p") - F.coalesce("tp", F.lit(0))).alias("fn"), F.coalesce("fp", F.lit(0)).alias("fp"), (F.col("q") - F.coalesce("fp", F.lit(0))).alias("tn"))
    return rows.withColumn("ba", balanced_accuracy())


def calibrated(scores: DataFrame, steps: int = 100) -> DataFrame:
    """The threshold of greatest balanced accuracy; the lowest of equal ones."""
    return calibration_curve(scores, steps).orderBy(F.col("ba").desc(), "t").limit(1)


def auroc(scores: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve by the rank sum with average ranks for ties (columns s, good); null without both classes.

    Equal scores are counted first, so ranks are running sums over distinct scores.
    """
    counts = scores.groupBy(*by, "s").agg(F.count_if(F.col("good") == 1).alias("p"), F.count_if(F.col("good") != 1).alias("q"))
    order = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("q_below", F.coalesce(F.sum("q").over(order), F.lit(0)))
    return below.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auroc"))


def segmentation(counts: DataFrame, *by: str) -> DataFrame:
    """IoU and F1 of the positive class from columns tp, fp, fn, with 1e-9 added to both parts of each fraction."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return counts.groupBy(*by).agg(((tp + 1e-9) / (tp + fp + fn + 1e-9)).alias("iou"), ((2 * tp + 1e-9) / (2 * tp + fp + fn + 1e-9)).alias("f1"))


def mean_by_origin(rows: DataFrame, real: list[str]) -> DataFrame:
    """Mean of ap50 over the real classes and over the others; null for none."""
    return rows.agg(F.avg(F.when(F.col("class").isin(real), F.col("ap50"))).alias("real"), F.avg(F.when(~F.col("class").isin(real), F.col("ap50"))).alias("other"))


def threshold_grid(values: DataFrame, every: int = 53) -> DataFrame:
    """Distinct quantiles, to 4 places, of every ``every``-th value (columns i, v)."""
    at = [0.50, 0.70, 0.80, 0.90, 0.95, 0.97, 0.99, 0.995, 0.999]
    found = values.filter(F.pmod("i", F.lit(every)) == 0).agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
    return found.select(F.explode(F.array_distinct(F.transform("q", lambda x: F.round(x, 4)))).alias("thr"))
