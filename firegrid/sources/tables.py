"""Sources and sinks: legends, GeoJSON, grids, layers and the manifest of finished work, all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def year_of(name: Column) -> Column:
    """The first year 1900 to 2099 in a name, else null."""
    return F.nullif(F.regexp_extract(name, "((?:19|20)[0-9]{2})", 1), F.lit("")).try_cast("int")


def scan(spark: SparkSession, path: str, include: str, exclude: str | None = None) -> DataFrame:
    """(path, length, year) of files below path whose name matches include and not exclude; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", "true").load(path).select("path", "length")
    if exclude:
        files = files.join(spark.read.format("binaryFile").option("pathGlobFilter", exclude).option("recursiveFileLookup", "true").load(path).select("path"), "path", "left_anti")
    return files.withColumn("year", year_of(F.element_at(F.split("path", "/"), -1)))


def legend(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A legend in CSV with `;`, `,` or tab, whichever its header has most of; a byte order mark is dropped."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    sep = max((";", ",", "\t"), key=line.count)
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"legend without {', '.join(missing)}")
    return df


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """(properties, part, rings): polygons of a feature collection, a row for each part of a multipolygon.

    properties is the schema of the attributes. A feature without a polygon gives no row.
    """
    kind = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    each = spark.read.schema(kind).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    text, single = F.col("f.geometry.coordinates"), F.col("f.geometry.type") == "Polygon"
    nested = F.when(single, F.concat(F.lit("["), text, F.lit("]"))).when(F.col("f.geometry.type") == "MultiPolygon", text)
    parts = each.select("f.properties.*", F.posexplode(F.from_json(nested, "array<array<array<array<double>>>>")).alias("part", "raw"))
    rings = F.transform("raw", lambda g: F.transform(g, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return parts.withColumn("rings", rings).drop("raw")


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Layers of one schema as a folder for each, a table partitioned by layer."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/layer={name}")


def read_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("layer") == name).drop("layer")


def write_grid(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Cells sorted within tiles, so that a window of rows and columns reads few row groups."""
    tiled = cells.withColumns({"tr": F.floor(F.col("r") / tile).cast("int"), "tc": F.floor(F.col("c") / tile).cast("int")})
    tiled.repartitionByRange("tr", "tc").sortWithinPartitions("tr", "tc", "r", "c").write.mode("overwrite").parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], tile: int = 256) -> DataFrame:
    """Cells of a window, ends included; the tile columns prune what is read."""
    near = F.col("tr").between(rows[0] // tile, rows[1] // tile) & F.col("tc").between(cols[0] // tile, cols[1] // tile)
    return spark.read.parquet(path).where(near & F.col("r").between(*rows) & F.col("c").between(*cols)).drop("tr", "tc")


def pending(tasks: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Tasks that the manifest (key, status) doesn't list as done; failed ones come again."""
    return tasks.join(manifest.where("status = 'done'").select(key).distinct(), key, "left_anti")
