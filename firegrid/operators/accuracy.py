"""Pixel, class and polygon accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts() -> list:
    hit = lambda d, r: F.count_if((F.col("det") == d) & (F.col("ref") == r))
    return [hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, IoU, error rate, commission, omission; null where a denominator is 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return df.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r), "iou": F.try_divide(tp, tp + fp + fn), "error_rate": F.try_divide(fp + fn, tp + fp + fn + tn), "commission": 1 - p, "omission": 1 - r})


def confusion(cells: DataFrame) -> DataFrame:
    return rates(cells.agg(*counts()))


def confusion_by_class(cells: DataFrame) -> DataFrame:
    """A row for each class and one, with null class, for all cells: one pass with grouping sets."""
    return rates(cells.groupingSets([["cls"], []], "cls").agg(*counts()))


def confusion_code(det, ref):
    """1 TN, 2 FN, 3 FP, 4 TP."""
    return det * 2 + ref + 1


def coverage(reference: DataFrame, detected: DataFrame, least: float, complete: float) -> DataFrame:
    """Coverage of each reference feature by detected cells, in percent, with its flags."""
    cells = detected.select("r", "c").distinct().withColumn("hit", F.lit(1))
    each = reference.join(cells, ["r", "c"], "left").groupBy("fid").agg(F.count("*").alias("n"), F.count("hit").alias("n_hit"))
    pct = 100 * F.col("n_hit") / F.col("n")
    return each.select("fid", "n", "n_hit", pct.alias("coverage"), (pct >= least).alias("detected"), (pct >= complete).alias("completely"))
