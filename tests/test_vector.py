import json
import math

import pytest
from pyspark.sql import functions as F

from firegrid.operators import ranks, rules, vector
from firegrid.sources import tables


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def square(side=100.0, hole=False):
    outer = vector.ring((0, 0), (side, 0), (side, side), (0, side))
    return F.array(outer, vector.ring((10, 10), (10, 20), (20, 20), (20, 10))) if hole else F.array(outer)


def test_square_has_known_measures(spark):
    m = vector.shape_metrics(spark.range(1).select(F.col("id").alias("fid"), square().alias("rings"))).first()
    assert (m.area_ha, m.perimeter_m, m.bbox_w_m, m.mrr_w_m, m.mrr_l_m, m.elong_mrr, m.rect_fill) == pytest.approx((1, 400, 100, 100, 100, 1, 1))
    assert (m.compact_pp, m.shape_index) == pytest.approx((math.pi / 4, 2 / math.sqrt(math.pi)))


def test_hole_and_containment(spark):
    g = square(hole=True)
    m = row(spark, area=vector.area(g), length=vector.perimeter(g), inside=vector.contains(g, F.lit(50.0), F.lit(50.0)), hole=vector.contains(g, F.lit(15.0), F.lit(15.0)), out=vector.contains(g, F.lit(150.0), F.lit(50.0)))
    assert (m.area, m.length, m.inside, m.hole, m.out) == (9900, 440, True, False, False)


def test_rotated_rectangle_of_a_diamond():
    import numpy as np

    assert vector.rotated_rectangle(np.array([[0, 1], [1, 0], [0, -1], [-1, 0], [0, 0]], float)) == pytest.approx((math.sqrt(2), math.sqrt(2)))
    assert vector.rotated_rectangle(np.array([[0, 0], [3, 4]], float)) == pytest.approx((0, 5))
    assert vector.rotated_rectangle(np.zeros((3, 2))) == (0, 0)


def test_rasterize_agrees_with_containment(spark):
    layer = spark.range(1).select(F.col("id").alias("fid"), F.array(vector.ring((3, 2), (97, 31), (55, 88), (41, 40))).alias("rings"))
    got = {(x.r, x.c) for x in vector.rasterize(layer, 4.0).collect()}
    grid = spark.range(900).select((F.col("id") / 30).cast("int").alias("r"), (F.col("id") % 30).cast("int").alias("c")).crossJoin(layer)
    want = grid.where(vector.contains(F.col("rings"), (F.col("c") + 0.5) * 4, (F.col("r") + 0.5) * 4))
    assert got == {(x.r, x.c) for x in want.collect()} and got


def test_empty_polygons_give_no_cells(spark):
    layer = spark.createDataFrame([(1, []), (2, None)], "fid int, rings array<array<struct<x:double,y:double>>>")
    assert vector.rasterize(layer, 1.0).collect() == []


def test_zone_and_box(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    m = row(spark, north=vector.utm_zone(F.lit(-3.7), F.lit(40.4)), south=vector.utm_zone(F.lit(180.0), F.lit(-10.0)), none=vector.utm_zone(F.lit(0.0), F.lit(89.0)), box=vector.aoi_box(box(1, 1, 2, 2), 3, box(0, 0, 4, 9)), gone=vector.aoi_box(box(1, 1, 2, 2), 0, box(5, 5, 6, 6)))
    assert (m.north, m.south, m.none, tuple(m.box), m.gone) == (32630, 32760, 3857, (0, 0, 4, 5), None)


def test_filters_and_columns(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (2, None, 9.0), (3, 9.9999995, 9.0)], "id int, a double, b double")
    keep = lambda **k: [x.id for x in df.where(rules.thresholds(**k)).collect()]
    assert keep(limits={"a": 10, "b": None}) == [1] and keep(limits={"a": 10}, slack=frozenset({"a"})) == [1, 3]
    assert keep(limits={"a": 10, "b": 6}, all_of=False) == [1, 2, 3] and keep(limits={}) == [1, 2, 3]
    assert rules.without_columns(df, "^[ab]$", keep=("b",)).columns == ["id", "b"]
    m = row(spark, text=rules.day_window(F.lit("x")), inside=rules.day_window(F.lit("152")), none=rules.day_window(F.lit(None)), floor=rules.highest_floor(None, (F.lit(1), {2: 3})))
    assert (m.text, m.inside, m.none, m.floor) == (False, True, False, None)
    halves = spark.createDataFrame([(2.5, 2.5)], "x_ha double, other double")
    assert rules.rounded_by_name(halves, 0, {}).first() == (2.0, 2.5)


def test_rank_sum_and_dunn(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (5, 6, 7, 8)], "g string, v double")
    assert ranks.rank_sum(df, "g", "v").first().p is None  # fewer than min_n values
    got = ranks.rank_sum(df, "g", "v", min_n=4).first()
    assert (got.n1, got.n2, got.cliff_delta, got.ks) == (4, 4, -1, 1)
    assert abs(got.z) == pytest.approx(7.5 / math.sqrt(12)) and got.p == pytest.approx(0.030383, abs=1e-5)
    assert ranks.dunn(df, "g", "v").first().z == pytest.approx(-4 / math.sqrt(3))


def test_sources(spark, tmp_path):
    (tmp_path / "legend.csv").write_text("﻿code;name\n1;forest, old\n2;shrub\n")
    got = tables.legend(spark, str(tmp_path / "legend.csv"), ("code",))
    assert [tuple(x) for x in got.collect()] == [(1, "forest, old"), (2, "shrub")]
    with pytest.raises(ValueError):
        tables.legend(spark, str(tmp_path / "legend.csv"), ("other",))
    box = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [("Polygon", box), ("MultiPolygon", [box, box]), ("Point", [0, 0])]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": i}, "geometry": {"type": k, "coordinates": c}} for i, (k, c) in enumerate(features)]}
    (tmp_path / "fires_2019.geojson").write_text(json.dumps(body))
    parts = tables.geojson(spark, str(tmp_path / "fires_2019.geojson"), "id int")
    assert sorted((x.id, x.part, x.a) for x in parts.select("id", "part", vector.area(F.col("rings")).alias("a")).collect()) == [(0, 0, 4), (1, 0, 4), (1, 1, 4)]
    found = tables.scan(spark, str(tmp_path), "*", "*.csv").collect()
    assert [(x.path.rsplit("/", 1)[1], x.year) for x in found] == [("fires_2019.geojson", 2019)]


def test_grid_window_layers_and_manifest(spark, tmp_path):
    cells = spark.range(10000).select((F.col("id") / 100).cast("int").alias("r"), (F.col("id") % 100).cast("int").alias("c"), F.col("id").alias("value"))
    tables.write_grid(cells, str(tmp_path / "grid"), 16)
    assert tables.read_window(spark, str(tmp_path / "grid"), (10, 12), (3, 40), 16).count() == 3 * 38
    tables.write_layers({"keep": cells.where("value < 5"), "drop": cells.where("value >= 5")}, str(tmp_path / "layers"))
    assert tables.read_layer(spark, str(tmp_path / "layers"), "keep").count() == 5
    manifest = spark.createDataFrame([(1, "done"), (2, "failed")], "id int, status string")
    assert sorted(x.id for x in tables.pending(spark.createDataFrame([(1,), (2,), (3,)], "id int"), manifest, "id").collect()) == [2, 3]
