"""Accuracy by class and by polygon, error layers, shares of an overlay, and what preparation dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators.accuracy import counts, rates
from firegrid.operators.raster import CELL, dilate


def class_confusion(cells: DataFrame, domain: str = "class", na_as_zero: bool = True, least_ref_ha: float = 0.0, cell_ha: float = 1.0, labels: dict[int, str] | None = None) -> DataFrame:
    """Confusion of each class and, with null cls, of all cells; areas in ha, class_label from labels (a legend).

    domain `class`: cells that have a class; `complete`: cells that have class, det and ref. na_as_zero: null det and ref
    count as not burned, else such a cell counts for nothing. Classes with less reference than least_ref_ha are left out.
    """
    inside = F.col("cls").isNotNull() & ((F.col("det").isNotNull() & F.col("ref").isNotNull()) if domain == "complete" or not na_as_zero else F.lit(True))
    own = cells.where(inside).withColumns({"det": F.coalesce("det", F.lit(0)), "ref": F.coalesce("ref", F.lit(0))})
    each = own.groupingSets([["cls"], []], "cls").agg(*counts()).where(F.col("cls").isNull() | ((F.col("tp") + F.col("fn")) * cell_ha >= least_ref_ha))
    area = lambda *cs: sum((F.col(c) for c in cs), F.lit(0)) * F.lit(float(cell_ha))
    out = rates(each).withColumns({"area_reference_ha": area("tp", "fn"), "area_detected_ha": area("tp", "fp"), "area_common_ha": area("tp")})
    legend = F.create_map(*[F.lit(x) for kv in (labels or {0: ""}).items() for x in kv])
    return out.withColumn("class_label", F.when(F.col("cls").isNull(), "all").otherwise(F.coalesce(legend[F.col("cls")], F.col("cls").cast("string"))))


def error_area(cells: DataFrame, kind: str, by: str = "cls", cell_ha: float = 1.0) -> DataFrame:
    """Cells and area by class of omission (reference, not detected) or commission (detected, not reference)."""
    wrong = {"omission": "ref = 1 and coalesce(det, 0) = 0", "commission": "det = 1 and coalesce(ref, 0) = 0"}[kind]
    return cells.where(wrong).groupBy(by).agg(F.count("*").alias("n"), (F.count("*") * F.lit(float(cell_ha))).alias("area_ha"))


def polygon_summary(reference: DataFrame, detected: DataFrame, least: float = 10.0, complete: float = 90.0, cell_ha: float = 1.0) -> DataFrame:
    """One row on reference and detected features (fid, r, c): how many are found, and areas. Coverage is in percent; cells
    that several detections share count once."""
    hit = detected.select(*CELL).distinct().withColumn("hit", F.lit(1))
    each = reference.join(hit, CELL, "left").groupBy("fid").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    pct = 100 * F.col("k") / F.col("n")
    found = each.agg(F.count("*").alias("n_reference"), F.count_if(pct >= complete).alias("n_completely_detected"), F.count_if(pct >= least).alias("n_detected"))
    areas = reference.select(*CELL).distinct().withColumn("ref", F.lit(1)).join(hit, CELL, "full").agg(
        F.count("ref").alias("ref"), F.count("hit").alias("det"), F.count_if((F.col("ref") == 1) & (F.col("hit") == 1)).alias("both")
    )
    ha = lambda c: F.col(c) * F.lit(float(cell_ha))
    return found.crossJoin(areas).select(  # one row each
        "n_reference", "n_completely_detected", "n_detected", (F.col("n_reference") - F.col("n_detected")).alias("n_not_detected"), (100 * F.try_divide("n_detected", "n_reference")).alias("perc_detected"),
        ha("ref").alias("area_reference_ha"), ha("det").alias("area_detected_ha"), ha("both").alias("area_common_ha"),
        (ha("ref") - ha("both")).alias("area_missed_ha"), (100 * F.try_divide("both", "ref")).alias("recall_area_percent"), (100 * F.try_divide("both", "det")).alias("precision_area_percent"),
    )


def polygon_labels(reference: DataFrame, detected: DataFrame, least: float = 10.0, cell_ha: float = 1.0) -> DataFrame:
    """(layer, fid, label, overlap_ha, overlap_percent): a reference feature is TP if at least `least` percent of it is
    detected, else FN; a detected one is TP if it touches the reference at all, else FP."""

    def side(own: DataFrame, other: DataFrame, layer: str, right: Column, wrong: str) -> DataFrame:
        each = own.join(other.select(*CELL).distinct().withColumn("hit", F.lit(1)), CELL, "left").groupBy("fid").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
        pct = 100 * F.col("k") / F.col("n")
        label = F.when(right(pct, F.col("k")), "TP").otherwise(wrong)
        return each.select(F.lit(layer).alias("layer"), "fid", label.alias("label"), (F.col("k") * F.lit(float(cell_ha))).alias("overlap_ha"), pct.alias("overlap_percent"))

    ref = side(reference, detected, "reference", lambda pct, k: pct >= least, "FN")
    return ref.unionByName(side(detected, reference, "detected", lambda pct, k: k > 0, "FP"))


def burnable_ratio(features: DataFrame, burnable: DataFrame, cell_ha: float = 1.0) -> DataFrame:
    """area_before_ha, area_after_ha, burnable_ratio and nonburn_ratio of each feature (fid, r, c); none burnable gives 0."""
    each = features.join(burnable.select(*CELL).distinct().withColumn("hit", F.lit(1)), CELL, "left").groupBy("fid").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    ha = lambda c: F.col(c) * F.lit(float(cell_ha))
    ratio = F.col("k") / F.col("n")
    return each.select("fid", ha("n").alias("area_before_ha"), ha("k").alias("area_after_ha"), ratio.alias("burnable_ratio"), (1 - ratio).alias("nonburn_ratio"))


def omission_layer(reference: DataFrame, detected: DataFrame, reach: int = 0) -> DataFrame:
    """Reference cells without a detected one, widened by reach cells."""
    left = reference.select(*CELL).distinct().join(detected.select(*CELL).distinct(), CELL, "left_anti")
    return dilate(left, reach) if reach else left


def touching(features: DataFrame, layer: DataFrame) -> DataFrame:
    """The fid of features with a cell in layer."""
    return features.join(layer.select(*CELL).distinct(), CELL, "left_semi").select("fid").distinct()


def overlay_percent(features: DataFrame, overlay: DataFrame, of: str = "feature") -> DataFrame:
    """Percent of each feature that lies in overlay, or of all of overlay that lies in the feature; none gives 0."""
    marked = overlay.select(*CELL).distinct().withColumn("hit", F.lit(1))
    each = features.join(marked, CELL, "left").groupBy("fid").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    if of == "overlay":
        each = each.crossJoin(F.broadcast(marked.agg(F.count("*").alias("all"))))  # one row
    whole = F.col("n") if of == "feature" else F.col("all")
    return each.select("fid", F.coalesce(100 * F.try_divide(F.col("k"), whole), F.lit(0.0)).alias("percent"))


def drop_counts(ids: DataFrame, kept: dict[str, DataFrame], key: str = "fid") -> DataFrame:
    """(step, n_dropped): distinct keys of ids that a step's table no longer has, each step against the one before."""
    out, before = None, ids.select(key).distinct()
    for step, table in kept.items():
        now = table.select(key).distinct()
        row = before.join(now, key, "left_anti").agg(F.count("*").alias("n_dropped")).select(F.lit(step).alias("step"), "n_dropped")
        out, before = row if out is None else out.unionByName(row), now
    return out


def common_years(a: DataFrame, b: DataFrame, year: str = "year") -> DataFrame:
    """Years that both tables have; null is none. An aggregation that starts in each scan's task: an intersection joins all
    rows of a year in one task before it makes them distinct."""
    seen = a.select(year, F.lit(1).alias("side__")).unionByName(b.select(year, F.lit(2).alias("side__"))).where(F.col(year).isNotNull())
    return seen.groupBy(year).agg(F.bit_or("side__").alias("sides__")).where("sides__ = 3").select(year)
