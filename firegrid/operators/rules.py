"""Overrides, notes, filters and transforms of attributes, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(key: Column, table: dict) -> Column:
    """The entry of key, null where there is none; table is a parameter of a few entries."""
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(key == k, float(v)).otherwise(out)
    return out


def first_override(default: float, *by: tuple[Column, dict]) -> Column:
    """The entry of the first table that has one."""
    return F.coalesce(*[lookup(k, t) for k, t in by], F.lit(float(default)))


def highest_floor(default: float | None, *by: tuple[Column, dict]) -> Column:
    """The largest of the default and all entries; null if there is none at all."""
    return F.greatest(F.lit(default).cast("double"), F.lit(None).cast("double"), *[lookup(k, t) for k, t in by])


def unit_note(n_cells: Column, n_sample: Column, otsu_note: Column, least_cells: int, least_sample: int, fallback: bool = True) -> Column:
    head = "fallback" if fallback else "skip"
    failed = F.concat(F.lit(f"{head}_otsu_fail_"), otsu_note)
    return F.when(n_cells < least_cells, f"{head}_small_unit").when(n_sample < least_sample, f"{head}_low_sample").when(otsu_note != "ok", failed).otherwise("ok")


def otsu_note(n: Column, n_trimmed: Column, low: Column, high: Column) -> Column:
    return F.when(n == 0, "no_values").when(n_trimmed == 0, "no_values_after_trim").when(low >= high, "degenerate_range").otherwise("ok")


def run_matrix(cells: DataFrame, runs: list[float]) -> DataFrame:
    """Each cell once a run (lb); runs are parameters, so no join takes place."""
    return cells.withColumn("lb", F.explode(F.array(*[F.lit(float(x)) for x in runs])))


#: Last year of use and year of the land-cover map.
MASK_YEARS = [(1999, 1990), (2005, 2000), (2011, 2006), (2017, 2012)]


def mask_year(year: Column) -> Column:
    out = F.lit(2018)
    for last, map_year in reversed(MASK_YEARS):
        out = F.when(year <= last, map_year).otherwise(out)
    return out


def day_window(day: Column, first: int = 152, last: int = 274) -> Column:
    """Days inside the window; null and what is no number fail."""
    return F.coalesce(day.cast("string").try_cast("int").between(first, last), F.lit(False))


def thresholds(limits: dict[str, float | None], slack: frozenset[str] = frozenset(), all_of: bool = True) -> Column:
    """At least the limit in all (or any) columns that have one; null values fail; columns of slack have 1e-6 to spare."""
    tests = [F.coalesce(F.col(c) >= v - (1e-6 if c in slack else 0), F.lit(False)) for c, v in limits.items() if v is not None]
    return reduce(lambda a, b: a & b if all_of else a | b, tests) if tests else F.lit(True)


def transform(x: Column, kind: str, eps: float = 1e-9) -> Column:
    """none, log10, ln, log1p or sqrt; null outside a function's domain."""
    if kind == "none":
        return x
    if kind in ("log10", "ln"):
        return F.when(x > 0, getattr(F, kind)(F.greatest(x, F.lit(eps))))
    return F.when(x >= 0, {"log1p": F.log1p, "sqrt": F.sqrt}[kind](x))


def without_columns(df: DataFrame, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c, re.I) and c not in keep])


def rounded_by_name(df: DataFrame, area_digits: int, digits: dict[str, int]) -> DataFrame:
    """Half-even rounding: columns of areas by their name, others as listed."""
    of = lambda c: area_digits if c.endswith("_ha") or "Area_" in c else digits.get(c)
    return df.select(*[F.bround(c, of(c)).alias(c) if t == "double" and of(c) is not None else F.col(c) for c, t in df.dtypes])


def dissolve(df: DataFrame, by: str, order: str) -> DataFrame:
    """A row for each value of by: of numbers and dates the first that is not null, of texts all, joined by `;`."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return df.groupBy(by).agg(*[(text(c) if t == "string" else first(c)).alias(c) for c, t in df.dtypes if c not in (by, order)])


def keep_all(lut: DataFrame, counts: DataFrame, key: str, zero: list[str]) -> DataFrame:
    """Every row of lut; where counts has none, the columns of zero are 0 and the others null."""
    return lut.join(counts, key, "left").fillna(0, zero)
