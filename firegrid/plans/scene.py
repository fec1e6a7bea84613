"""A burned-area scene from the driver's tables: cells with strata, indices, reference and detected masks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_M = 100.0

#: Cells of the grid for each row of lineitem: sides of 60, 200 and 600 at scale factors 0.001, 0.01 and 0.1.
DENSITY = 0.61

#: The same scene as common table expressions.
SCENE_SQL = f"""
WITH side AS (SELECT CAST(greatest(20, 20 * round(sqrt({DENSITY} * count(*)) / 20)) AS BIGINT) AS n_side FROM lineitem),
scene AS (
  SELECT CAST(l_orderkey % n_side AS INTEGER) AS r, CAST((l_partkey * 7 + l_linenumber) % n_side AS INTEGER) AS c,
         avg(l_extendedprice) / 100 AS value, avg(l_discount) AS pre, avg(l_tax) AS post,
         CAST(avg(l_quantity) > 26 AS INTEGER) AS ref, CAST(avg(l_extendedprice) / 100 >= 550 AS INTEGER) AS det,
         min(p_size % 7 + 1) AS cls, min(n_regionkey) AS eco
  FROM lineitem CROSS JOIN side JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2),
cells AS (SELECT *, cls * 10000 + eco AS unit FROM scene),
dets AS (SELECT r, c, CAST((r // 5) * 1000 + c // 5 AS INTEGER) AS fid FROM cells WHERE det = 1),
refs AS (SELECT r, c, CAST((r // 7) * 1000 + c // 7 AS INTEGER) AS fid FROM cells WHERE ref = 1)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_of(n_rows: int) -> int:
    """Cells along a side of the grid; it grows with the table, so that more rows are more cells."""
    return max(20, 20 * int(math.sqrt(DENSITY * n_rows) / 20 + 0.5))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene's cells. Sums of doubles follow the order of their rows, so the rows of a cell are added in the order of
    lineitem's files, whatever the partitions: plans that build the scene twice get equal values."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    side = side_of(line.count())  # from the files' footers
    file = F.col("_metadata.file_path") if len(line.inputFiles()) > 1 else F.lit("")
    line = line.withColumns({"file": file, "row": F.col("_metadata.row_index")})
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    r, c = (F.col("l_orderkey") % side).cast("int"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % side).cast("int")
    placed = joined.withColumns({"r": r, "c": c}).repartition("r", "c").sortWithinPartitions("r", "c", "file", "row")
    grid = placed.groupBy("r", "c").agg(
        (F.avg("l_extendedprice") / 100).alias("value"), F.avg("l_discount").alias("pre"), F.avg("l_tax").alias("post"), F.avg("l_quantity").alias("qty"),
        F.min(F.col("p_size") % 7 + 1).alias("cls"), F.min("n_regionkey").alias("eco"),
    )
    return grid.select("r", "c", "value", "pre", "post", (F.col("qty") > 26).cast("int").alias("ref"), (F.col("value") >= 550).cast("int").alias("det"), "cls", "eco", (F.col("cls") * 10000 + F.col("eco")).alias("unit"))


def features(grid: DataFrame, mask: str, side: int) -> DataFrame:
    return grid.where(F.col(mask) == 1).select("r", "c", (F.floor(F.col("r") / side) * 1000 + F.floor(F.col("c") / side)).cast("int").alias("fid"))
