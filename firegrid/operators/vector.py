"""Polygons as arrays of closed rings of {x, y}: the outer ring, then its holes. Measures are column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring(*points: tuple) -> Column:
    """A closed ring through points (x, y) of columns or numbers."""
    each = [F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in [*points, points[0]]]
    return F.array(*each)


def _edges(line: Column) -> Column:
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def area(rings: Column) -> Column:
    """Outer ring less holes, whatever their direction."""
    each = F.transform(rings, lambda g: F.abs(_total(F.transform(_edges(g), lambda e: e.a.x * e.b.y - e.b.x * e.a.y))) / 2)
    return 2 * F.get(each, F.lit(0)) - _total(each)


def perimeter(rings: Column) -> Column:
    """Length of all rings, holes included."""
    return _total(F.transform(F.flatten(F.transform(rings, _edges)), lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)))


def bounds(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings."""
    crossed = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < F.try_divide((e.b.x - e.a.x) * (y - e.a.y), e.b.y - e.a.y) + e.a.x)
    return F.size(F.filter(F.flatten(F.transform(rings, _edges)), crossed)) % 2 == 1


def rasterize(layer: DataFrame, cell: float) -> DataFrame:
    """(fid, r, c): cells whose centre lies in the polygon. Rows are cut out of each polygon, then columns between
    crossings, so only covered cells are ever made."""
    box = layer.select("fid", F.flatten(F.transform("rings", _edges)).alias("edges"), bounds(F.col("rings")).alias("box")).where("size(edges) > 0")
    first, last = F.floor(F.col("box.y0") / cell), F.floor(F.col("box.y1") / cell)
    rows = box.select("fid", "edges", F.explode(F.sequence(first, last)).alias("r"))
    y = (F.col("r") + 0.5) * cell
    cut = F.filter("edges", lambda e: (e.a.y > y) != (e.b.y > y))
    xs = F.array_sort(F.transform(cut, lambda e: e.a.x + F.try_divide((e.b.x - e.a.x) * (y - e.a.y), e.b.y - e.a.y)))
    pairs = rows.withColumn("xs", xs).where("size(xs) > 1").select("fid", "r", "xs", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))).alias("k"))
    low, high = F.ceil(F.get("xs", F.col("k")) / cell - 0.5), F.ceil(F.get("xs", F.col("k") + 1) / cell - 0.5) - 1
    spans = pairs.select("fid", "r", low.alias("low"), high.alias("high")).where("low <= high")
    return spans.select("fid", F.col("r").cast("int").alias("r"), F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("c"))


def rotated_rectangle(points: np.ndarray) -> tuple[float, float]:
    """Short and long side of the smallest rectangle around points: one of its sides lies on the convex hull."""
    p = np.unique(points, axis=0)
    if len(p) < 2:
        return 0.0, 0.0
    half = []
    for order in (p, p[::-1]):
        line: list[np.ndarray] = []
        for q in order:
            while len(line) > 1 and (line[-1][0] - line[-2][0]) * (q[1] - line[-2][1]) <= (line[-1][1] - line[-2][1]) * (q[0] - line[-2][0]):
                line.pop()
            line.append(q)
        half += line[:-1]
    hull = np.array(half)
    step = np.roll(hull, -1, 0) - hull
    along = step / np.linalg.norm(step, axis=1)[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    w, h = np.ptp(along @ hull.T, axis=1), np.ptp(across @ hull.T, axis=1)
    k = int(np.argmin(w * h))
    return float(min(w[k], h[k])), float(max(w[k], h[k]))


def with_rotated_rectangle(layer: DataFrame) -> DataFrame:
    """Adds mrr_w and mrr_l. Hulls are not to be had from column functions, so rings pass through Arrow batches."""

    @F.pandas_udf("mrr_w double, mrr_l double")
    def sides(rings: pd.Series) -> pd.DataFrame:
        found = [rotated_rectangle(np.array([[p["x"], p["y"]] for p in g[0]])) if g is not None and len(g) else (None, None) for g in rings]
        return pd.DataFrame(found, columns=["mrr_w", "mrr_l"])

    return layer.withColumn("mrr__", sides("rings")).select("*", "mrr__.mrr_w", "mrr__.mrr_l").drop("mrr__")


def shape_metrics(layer: DataFrame) -> DataFrame:
    """Areas, lengths and ratios of each polygon of layer (fid, rings)."""
    a, p = F.col("area"), F.col("perimeter_m")
    box = layer.withColumns({"area": area(F.col("rings")), "perimeter_m": perimeter(F.col("rings")), "box": bounds(F.col("rings"))})
    return with_rotated_rectangle(box).select(
        "fid", (a / 10000).alias("area_ha"), "perimeter_m", (F.col("box.x1") - F.col("box.x0")).alias("bbox_w_m"), (F.col("box.y1") - F.col("box.y0")).alias("bbox_h_m"),
        F.col("mrr_w").alias("mrr_w_m"), F.col("mrr_l").alias("mrr_l_m"), (F.col("mrr_l") / F.greatest("mrr_w", F.lit(1e-6))).alias("elong_mrr"),
        (4 * math.pi * a / F.greatest(p * p, F.lit(1e-12))).alias("compact_pp"), (p / F.greatest(2 * F.sqrt(math.pi * a), F.lit(1e-12))).alias("shape_index"),
        (a / F.greatest(F.col("mrr_w") * F.col("mrr_l"), F.lit(1e-12))).alias("rect_fill"),
    )


def outline(bridge: DataFrame, cell: float) -> DataFrame:
    """(fid, x0, y0, x1, y1): boundary of each feature's cells. Sides that two cells of a feature share cancel."""
    side = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    c, r = F.col("c"), F.col("r")
    sides = F.array(side(c, r, c + 1, r), side(c, r + 1, c + 1, r + 1), side(c, r, c, r + 1), side(c + 1, r, c + 1, r + 1))
    once = bridge.select("fid", "r", "c").distinct().select("fid", F.explode(sides).alias("s")).groupBy("fid", "s").agg(F.count("*").alias("k")).where("k = 1")
    return once.select("fid", *[(F.col(f"s.{x}") * cell).alias(x) for x in ("x0", "y0", "x1", "y1")])


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point; 3857 where it has none."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    usable = lon.between(-180, 180) & lat.between(-80, 84)
    return F.when(usable, F.when(lat >= 0, 32600).otherwise(32700) + zone).otherwise(3857).cast("int")


def aoi_box(box: Column, by: float, limit: Column) -> Column:
    """A bounding box widened and clamped to limit; null where nothing is left."""
    x0, y0 = F.greatest(box.x0 - by, limit.x0), F.greatest(box.y0 - by, limit.y0)
    x1, y1 = F.least(box.x1 + by, limit.x1), F.least(box.y1 + by, limit.y1)
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
