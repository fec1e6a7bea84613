"""Polygons as feature-to-cell bridges: zonal statistics, overlaps, erasing and shape of rectangles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zonal(bridge: DataFrame, cells: DataFrame, q: float) -> DataFrame:
    """Median, mean, count and exceedance fraction of finite values by feature; no cell gives count 0 and nulls."""
    return bridge.join(cells.select("r", "c", "value"), ["r", "c"], "left").groupBy("fid").agg(
        F.percentile("value", 0.5).alias("median"), F.avg("value").alias("mean"), F.count("value").alias("n_pix"), F.avg((F.col("value") > q).cast("double")).alias("p_above")
    )


def na_fraction(bridge: DataFrame, cells: DataFrame) -> DataFrame:
    return bridge.join(cells.select("r", "c", F.lit(1).alias("v")), ["r", "c"], "left").groupBy("fid").agg((1 - F.count("v") / F.count("*")).alias("na_frac"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): shared cells of features of two layers."""
    return a.select("r", "c", F.col("fid").alias("a")).join(b.select("r", "c", F.col("fid").alias("b")), ["r", "c"]).groupBy("a", "b").agg(F.count("*").alias("n"))


def best_match(overlaps: DataFrame) -> DataFrame:
    """The b of the largest overlap of each a, the smallest b on ties."""
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return overlaps.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def safe_erase(layer: DataFrame, drop: DataFrame, keep: DataFrame) -> DataFrame:
    """Ids of features that stay: not (hits drop and misses keep)."""
    ids = layer.select("fid").distinct()
    cells = lambda x: x.select("r", "c")
    hit = layer.join(cells(drop), ["r", "c"], "left_semi").select("fid").distinct()
    safe = layer.join(cells(keep), ["r", "c"], "left_semi").select("fid").distinct()
    return ids.join(hit.join(safe, "fid", "left_anti"), "fid", "left_anti")


def rectangle_shape(bridge: DataFrame, cell: float) -> DataFrame:
    """Metrics of each feature's bounding rectangle of square cells."""
    box = bridge.groupBy("fid").agg(
        ((F.max("c") - F.min("c") + 1) * cell).alias("w"), ((F.max("r") - F.min("r") + 1) * cell).alias("h"), F.count("*").alias("n")
    )
    area, perimeter = F.col("w") * F.col("h"), 2 * (F.col("w") + F.col("h"))
    return box.select(
        "fid", "n", (area / 10000).alias("area_ha"), perimeter.alias("perimeter_m"),
        (F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1e-6))).alias("elong"),
        (4 * math.pi * area / F.greatest(perimeter * perimeter, F.lit(1e-12))).alias("compact_pp"),
        (perimeter / F.greatest(2 * F.sqrt(math.pi * area), F.lit(1e-12))).alias("shape_index"),
        (F.col("n") * cell * cell / F.greatest(area, F.lit(1e-12))).alias("rect_fill"),
    )
