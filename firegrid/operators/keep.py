"""Which polygons are kept: flags of reference polygons, the keep pool, promotion, and bounded samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.operators.rules import thresholds


def reference_flag(na_frac: Column, most_na: float, burnable: Column) -> Column:
    """`ref`, unless too little of the polygon has a land-cover class, or none of it can burn."""
    return F.when(na_frac > most_na, "drop_corine_na").when(~F.coalesce(burnable, F.lit(False)), "drop_unburnable").otherwise("ref")


def cross_flag(layer: str, own: Column, hit: Column) -> Column:
    """Flags after both layers are compared. Reference polygons that are kept: keep_ref or review_ref; internal ones that
    are kept: keep_common or review_int_no_effis; others keep the flag they have."""
    found, alone, kept = {"reference": ("keep_ref", "review_ref", "ref"), "internal": ("keep_common", "review_int_no_effis", "keep")}[layer]
    return F.when(own != kept, own).when(hit, found).otherwise(alone)


def keep_pool(polygons: DataFrame, flag: str, common: str = "keep_common", fallback: str = "keep") -> DataFrame:
    """The polygons with the common flag; if there are none, those with the fallback; if there are none either, an error."""
    for wanted in (common, fallback):
        pool = polygons.where(F.col(flag) == wanted)
        if not pool.isEmpty():
            return pool
    raise ValueError(f"no polygon has the flag {common} or {fallback}")


def least_pixels(least_ha: float, cell_ha: float, floor: int = 13) -> int:
    return max(math.ceil(least_ha / cell_ha), floor)


def keep_like(least_ha: float, cell_ha: float, promote_pct: float, promote_share: float) -> Column:
    """Large enough, in area and in cells, and as severe as the pool: by its percentile and by its share above the pool's
    reference quantile. Null values fail."""
    return thresholds({"area_ha": least_ha, "n_pix": least_pixels(least_ha, cell_ha), "pct": promote_pct, "p_above_ref": promote_share})


def recombined(dropped: DataFrame, erased: DataFrame, flag: str, kept: tuple[str, ...]) -> DataFrame:
    """Polygons whose flag drops them as they were, and of the erased ones those still kept."""
    return dropped.where(~F.col(flag).isin(*kept)).unionByName(erased.where(F.col(flag).isin(*kept)), allowMissingColumns=True)


def sample_by_hash(df: DataFrame, n: int, keys: list[str], by: list[str] | None = None, seed: int = 7) -> DataFrame:
    """At most n rows, or n rows of each group, those of the least hashes of keys: a random sample that can be repeated.

    A large group is cut down in 64 parts first, so no task orders more than one part of it. A sample, and nothing else,
    is what this operator gives."""
    by = by or []
    hashed = df.withColumn("hash__", F.xxhash64(F.lit(seed), *keys)).withColumn("part__", F.pmod(F.col("hash__"), F.lit(64)))
    order = ["hash__", *keys]
    some = hashed.withColumn("k__", F.row_number().over(Window.partitionBy(*by, "part__").orderBy(*order))).where(F.col("k__") <= n)
    if not by:
        return some.orderBy(*order).limit(n).drop("hash__", "part__", "k__")
    return some.withColumn("k__", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k__") <= n).drop("hash__", "part__", "k__")


def top_by_area(df: DataFrame, n: float, area: str = "area_ha", key: str = "fid") -> DataFrame:
    """The n largest, ties by key; infinity keeps all."""
    return df if math.isinf(n) else df.orderBy(F.desc(area), key).limit(int(n))


def top_with_reason(steps: list[tuple[str, DataFrame]], n: float, area: str = "area_ha", key: str = "fid") -> DataFrame:
    """The n largest of the first table that has rows, with the reason of that step; the last table if none has."""
    for reason, df in steps:
        if not df.isEmpty():
            break
    return top_by_area(df, n, area, key).withColumn("reason", F.lit(reason))


def largest_piece(df: DataFrame, key: str = "fid", area: str = "area_ha", tie: str = "piece") -> DataFrame:
    """The largest row of each key, the least tie on equal areas: an aggregation, not a window."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.struct(F.col(area), -F.col(tie))).alias("row")).select("row.*")


def first_of(df: DataFrame, key: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in order."""
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.max_by(row, order) if last else F.min_by(row, order)
    return df.groupBy(*key).agg(pick.alias("row")).select("row.*")


def point_match(hits: DataFrame, key: str = "sub_uid", area: str = "area_ha", target: str = "fid") -> DataFrame:
    """Of the polygons that hold a point the largest (the least id on ties), and whether there was more than one."""
    best = F.max_by(target, F.struct(F.col(area), -F.col(target)))
    return hits.groupBy(key).agg(best.alias(target), (F.count("*") > 1).alias("join_ambiguous"))


def copied_attributes(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left with those columns of its match in right that it does not have yet."""
    have = {c.lower() for c in left.columns}
    return left.join(right.select(on, *[c for c in right.columns if c.lower() not in have]), on, "left")
