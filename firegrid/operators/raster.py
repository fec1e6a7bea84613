"""Map algebra on grid tables (r, c, value ...): every operator is a projection, an equi-join or a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.operators import links as linked
from firegrid.storage import Scratch, stored

CELL = ["r", "c"]


def index_difference(pre: Column, post: Column) -> Column:
    return (pre - post) * 1000


def index_ratio(pre: Column, post: Column) -> Column:
    return (pre - post) * 1000 / (pre + 1.001)


def reclass(cells: DataFrame, lut: list[tuple[int, int]], column: str = "cls", excluded: tuple[int, ...] = ()) -> DataFrame:
    """Two-column reclass by lut, a list of (old, new): of entries with one old code the last wins, excluded old codes are
    taken out first. Cells without an entry drop out. The list is a parameter, so no join takes place."""
    codes = {old: new for old, new in lut if old not in excluded}
    new = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col(column)] if codes else F.lit(None).cast("int")
    return cells.withColumn("new", new).where("new is not null")


def reclass_ranges(value: Column, ranges: list[tuple[float, float, int]]) -> Column:
    """Three-column reclass: [from, to), the last range closed; others null."""
    out = F.lit(None).cast("int")
    for k, (low, high, new) in reversed(list(enumerate(ranges))):
        inside = (value >= low) & ((value <= high) if k == len(ranges) - 1 else (value < high))
        out = F.when(inside, new).otherwise(out)
    return out


def clean_report(cells: DataFrame, cap: float = -1000.0) -> DataFrame:
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return cells.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), F.count_if(~bad & (F.col("value") < cap)).alias("n_below"))


def clean(value: Column, cap: float) -> Column:
    """Non-finite values become null, values below the cap become the cap."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.greatest(value, F.lit(cap)))


def mosaic_max(*tiles: DataFrame) -> DataFrame:
    whole = tiles[0]
    for t in tiles[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy(*CELL).agg(F.max("value").alias("value"))


def erode(cells: DataFrame, n: int = 1) -> DataFrame:
    """Cells whose whole (2n+1)-square is there: a run count along rows, then along columns."""
    full = 2 * n + 1
    along = Window.partitionBy("r").orderBy("c").rangeBetween(-n, n)
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-n, n)
    rows = cells.select(*CELL).withColumn("k", F.count("*").over(along)).where(F.col("k") == full)
    return rows.withColumn("k", F.count("*").over(down)).where(F.col("k") == full).select(*CELL)


def dilate(cells: DataFrame, n: int = 1) -> DataFrame:
    steps = F.sequence(F.lit(-n), F.lit(n))
    wide = cells.select("r", F.explode(F.transform(steps, lambda d: F.col("c") + d)).alias("c")).distinct()
    return wide.select(F.explode(F.transform(steps, lambda d: F.col("r") + d)).alias("r"), "c").distinct()


def histogram255(cells: DataFrame) -> DataFrame:
    """Counts of values scaled to 0..255 in right-closed unit bins, the first with 0; by unit."""
    w = Window.partitionBy("unit")
    low, high = F.min("value").over(w), F.max("value").over(w)
    scaled = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * 255
    return cells.withColumns({"low": low, "high": high}).where("high > low").withColumn("bin", F.greatest(F.ceil(scaled), F.lit(1)).cast("int")).groupBy("unit", "low", "high", "bin").agg(F.count("*").alias("n"))


def otsu(cells: DataFrame, window: int = 5) -> DataFrame:
    """Threshold of each unit: centred moving average of its 255 counts, then the bin of the largest between-class
    variance, the first on ties, mapped back to values."""
    h = histogram255(cells)
    units = h.select("unit", "low", "high").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(255))))
    half = window // 2
    order = Window.partitionBy("unit").orderBy("bin")
    near = order.rowsBetween(-half, half)
    full = units.join(h.select("unit", "bin", "n"), ["unit", "bin"], "left").fillna(0, ["n"])
    inside = F.col("bin").between(half + 1, 255 - half)
    p = full.withColumn("s", F.when(inside, F.sum("n").over(near) / window).otherwise(0.0))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("unit")
    q = p.withColumns({"w0": F.sum("s").over(upto), "m0": F.sum(F.col("s") * (F.col("bin") - 0.5)).over(upto), "w": F.sum("s").over(whole), "m": F.sum(F.col("s") * (F.col("bin") - 0.5)).over(whole)})
    w1 = F.col("w") - F.col("w0")
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.round(F.col("w0") * w1 * F.pow(F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1, 2), 3))
    best = q.withColumn("v", between).where("v is not null").groupBy("unit", "low", "high").agg(F.min_by("bin", F.struct(-F.col("v"), "bin")).alias("bin"))
    return best.select("unit", "bin", ((F.col("bin") - 0.5) / 255 * (F.col("high") - F.col("low")) + F.col("low")).alias("threshold"))


def components(cells: DataFrame, diagonal: bool = True, most_rounds: int = 200) -> DataFrame:
    """(r, c, label): label is the least r * 2^31 + c of the patch. Rows are cut into runs; runs that touch are linked;
    patches are the components of the links, in about log(runs) rounds. Links that don't settle in most_rounds raise."""
    held = Scratch(cells.sparkSession)
    own = F.col("r").cast("long") * (1 << 31) + F.col("c")
    seen = cells.select(*CELL).distinct().withColumn("g", F.col("c") - F.row_number().over(Window.partitionBy("r").orderBy("c")))
    tagged = held.stored(seen.withColumn("run", F.min(own).over(Window.partitionBy("r", "g"))), "runs")
    runs = tagged.groupBy("run", "r").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    reach = 1 if diagonal else 0
    # a run and each column it reaches in the next row: an equi-join on cells, not a range join
    reached = runs.select("run", (F.col("r") + 1).alias("r"), F.explode(F.sequence(F.col("a") - reach, F.col("b") + reach)).alias("c"))
    touching = reached.join(tagged.select("r", "c", F.col("run").alias("to")), CELL).select(F.col("run").alias("a"), F.col("to").alias("b"))
    labels = linked.components(touching, most_rounds).select(F.col("id").alias("run"), F.col("component").alias("label"))
    out = stored(tagged.join(labels, "run", "left").select("r", "c", F.coalesce("label", "run").alias("label")), "patches")
    held.clear()
    return out
