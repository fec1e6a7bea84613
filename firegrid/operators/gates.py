"""Masks, filters and checks on cells and attributes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators.raster import CELL, clean, clean_report

#: Codes of burnt land, by grid code and by land-cover code, which no burnable mask holds unless asked.
BURNT = {"grid": 33, "clc": 334}


def choose(test: Column, then, otherwise=None) -> Column:
    """Cell-wise: then where test holds, else otherwise; null where test is null."""
    return F.when(test.isNull(), None).when(test, then).otherwise(otherwise)


def of_classes(cells: DataFrame, classes: list[int], column: str = "cls") -> DataFrame:
    return cells.where(F.col(column).isin(*classes)) if classes else cells.limit(0)


def burnable_mask(cells: DataFrame, classes: list[int] | None = None, column: str = "cls", coding: str = "grid", keep_burnt: bool = False) -> DataFrame:
    """(r, c, mask = 1) of burnable cells: of the given classes without burnt land, or, without classes, those of a binary
    raster above 0.5."""
    if classes is None:
        own = cells.where(F.col(column) > 0.5)
    else:
        own = of_classes(cells, [x for x in classes if keep_burnt or x != BURNT[coding]], column)
    return own.select(*CELL, F.lit(1).alias("mask"))


def masked(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select(*CELL).distinct(), CELL, "left_semi")


def is_binary(cells: DataFrame, column: str) -> bool:
    """Whether all finite values are 0 or 1, and there is one."""
    finite = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.abs(F.col(column).cast("double")) < float("inf"))
    row = cells.where(finite).agg(F.count("*").alias("n"), F.count_if(~F.col(column).isin(0, 1)).alias("other")).first()
    return row.n > 0 and row.other == 0


def unit_key(cls: Column, eco: Column) -> Column:
    return cls * 10000 + eco


def unit_parts(unit: Column) -> tuple[Column, Column]:
    """(class, ecoregion) of a key."""
    return F.floor(unit / 10000).cast("int"), (unit % 10000).cast("int")


def clean_cells(cells: DataFrame, cap: float, action: str = "clean") -> DataFrame:
    """`clean`: cleaned cells; `fail`: an error if there is anything to clean; `report`: the counts."""
    if action == "report":
        return clean_report(cells, cap)
    if action == "fail":
        row = clean_report(cells, cap).first()
        if row.n_bad or row.n_below:
            raise ValueError(f"{row.n_bad} cells are no finite number, {row.n_below} lie below {cap}")
        return cells
    return cells.withColumn("value", clean(F.col("value"), cap))


def floored(value: Column) -> Column:
    """Rounded down, as a 16-bit integer; null outside its range."""
    return F.floor(value).try_cast("smallint")


def in_first_present(df: DataFrame, candidates: list[str], values: list) -> DataFrame:
    """Rows whose value in the first of candidates that df has is one of values, compared as text."""
    have = {c.lower(): c for c in df.columns}
    column = next((have[c.lower()] for c in candidates if c.lower() in have), None)
    if column is None:
        raise ValueError(f"none of {candidates} is a column")
    return df.where(F.col(column).cast("string").isin(*[str(v) for v in values]))


def composed(*filters: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
    """One filter after the other; None leaves all rows."""

    def run(df: DataFrame) -> DataFrame:
        for f in filters:
            df = df if f is None else f(df)
        return df

    return run


def of_year(df: DataFrame, year: int, pattern: str = r"^(year|anio|yr)$") -> DataFrame:
    """Rows of a year if there is a column that looks like one; else all."""
    column = next((c for c in df.columns if re.search(pattern, c, re.I)), None)
    return df if column is None else df.where(F.col(column).cast("string").try_cast("int") == year)


def at_least(df: DataFrame, least_ha: float | None, area: str = "area_ha") -> DataFrame:
    return df if least_ha is None else df.where(F.col(area) >= least_ha)


def kept_columns(df: DataFrame, columns: list[str], always: tuple[str, ...] = ("sub_uid",)) -> DataFrame:
    """The columns asked for that df has, in its own order, and those always kept."""
    wanted = {c.lower() for c in (*columns, *always)}
    return df.select(*[c for c in df.columns if c.lower() in wanted])


def stripped_of(df: DataFrame, names: list[str], width: int = 10) -> DataFrame:
    """df without columns called like one of names, or like its first `width` characters, as shapefiles cut them."""
    gone = {n.lower() for n in names} | {n.lower()[:width] for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def renamed_bands(df: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Cells and the bands picked, under new names."""
    return df.select(*CELL, *[F.col(old).alias(new) for old, new in bands.items()])


def require_same_grid(a: dict, b: dict) -> None:
    """Raises unless origin, size, cell width and reference system of two grids agree."""
    wrong = [k for k in sorted({*a, *b}) if a.get(k) != b.get(k)]
    if wrong:
        raise ValueError("grids differ in " + ", ".join(f"{k} ({a.get(k)} and {b.get(k)})" for k in wrong))


def extent(cells: DataFrame) -> DataFrame:
    """(r0, r1, c0, c1) of the cells that there are, one row."""
    return cells.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def day_flags(zones: DataFrame, days: DataFrame, limits: list[int]) -> DataFrame:
    """fid, median_day, mode_day and, for each limit, the share of the zone's cells within that many days of the median.

    Medians are exact, from counts by day (at most 366 a zone)."""
    each = zones.join(days.select(*CELL, F.col("day").cast("int").alias("day")), CELL).where("day is not null").groupBy("fid", "day").agg(F.count("*").alias("n"))
    listed = each.groupBy("fid").agg(F.percentile("day", 0.5, F.col("n")).alias("median_day"), F.max_by("day", F.struct("n", -F.col("day"))).alias("mode_day"), F.sum("n").alias("n_cells"))
    near = [(F.sum(F.when(F.abs(F.col("day") - F.col("median_day")) <= k, F.col("n")).otherwise(0)) / F.max("n_cells")).alias(f"within_{k}") for k in limits]
    return each.join(listed, "fid").groupBy("fid", "median_day", "mode_day").agg(*near)


def regenerated(burned: DataFrame, growth: dict[str, DataFrame], least: dict[str, float]) -> DataFrame:
    """fid and, for each period, the share of burned cells (fid, r, c) that regrow (ratio_P) and whether it reaches the
    least ratio (regen_P); all holds if every period does."""
    out = burned.groupBy("fid").agg(F.count("*").alias("n"))
    for period, cells in growth.items():
        hit = burned.join(cells.select(*CELL).distinct(), CELL, "left_semi").groupBy("fid").agg(F.count("*").alias("k"))
        ratio = F.coalesce(F.col("k"), F.lit(0)) / F.col("n")
        out = out.join(hit, "fid", "left").withColumns({f"ratio_{period}": ratio, f"regen_{period}": ratio >= least.get(period, 0.0)}).drop("k")
    every = [F.col(f"regen_{p}") for p in growth]
    return out.withColumn("regen_all", F.array_min(F.array(*every)) if every else F.lit(True)).drop("n")
