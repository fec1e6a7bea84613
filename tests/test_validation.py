import math

import pytest

from firegrid.operators import gates, keep, prefix, ranks, raster, validation


def square(spark, fid, low, high):
    return spark.createDataFrame([(fid, r, c) for r in range(low, high) for c in range(low, high)], "fid int, r int, c int")


def test_squares_that_overlap_by_a_quarter(spark):
    # cells of 100 m: reference 200 to 1000 m, detected 600 to 1400 m, on a grid of 20 x 20
    ref, det = square(spark, 1, 2, 10), square(spark, 7, 6, 14)
    grid = spark.createDataFrame([(r, c, 1, int(6 <= r < 14 and 6 <= c < 14), int(2 <= r < 10 and 2 <= c < 10)) for r in range(20) for c in range(20)], "r int, c int, cls int, det int, ref int")
    row = validation.class_confusion(grid).where("cls is null").first()
    assert (row.tp, row.fp, row.fn, row.tn) == (16, 48, 48, 288)
    assert (row.precision, row.recall, row.iou) == (0.25, 0.25, pytest.approx(1 / 7))
    got = validation.polygon_summary(ref, det).first()
    assert (got.n_reference, got.n_detected, got.n_completely_detected, got.area_reference_ha, got.area_detected_ha, got.area_common_ha) == (1, 1, 0, 64, 64, 16)
    assert (got.recall_area_percent, got.precision_area_percent) == (25, 25)
    assert {(r.layer, r.label, r.overlap_percent) for r in validation.polygon_labels(ref, det, least=30).collect()} == {("reference", "FN", 25), ("detected", "TP", 25)}
    off = validation.polygon_summary(square(spark, 1, 3, 11), square(spark, 2, 8, 15)).first()
    assert (off.recall_area_percent, off.precision_area_percent) == (14.0625, pytest.approx(900 / 49))
    none = validation.polygon_summary(ref.limit(0), det.limit(0)).first()
    assert (none.n_reference, none.perc_detected, none.recall_area_percent) == (0, None, None)
    assert [(r.fid, r.burnable_ratio) for r in validation.burnable_ratio(ref, det.limit(0)).collect()] == [(1, 0)]
    assert validation.omission_layer(ref, det).count() == 48
    assert [r.percent for r in validation.overlay_percent(ref, det, "overlay").collect()] == [25]


def test_holes_in_det_and_ref(spark):
    grid = spark.createDataFrame([(0, 0, 1, None, 1), (0, 1, 1, 1, None), (0, 2, None, 1, 1), (0, 3, 2, 1, 1)], "r int, c int, cls int, det int, ref int")
    zero = validation.class_confusion(grid).where("cls = 1").first()
    assert (zero.tp, zero.fp, zero.fn) == (0, 1, 1)
    assert validation.class_confusion(grid, domain="complete").where("cls is not null").count() == 1
    assert validation.class_confusion(grid, least_ref_ha=2).where("cls is not null").count() == 0


def test_keep_rules(spark):
    df = spark.createDataFrame([(1, "keep", 20.0, 20, 0.5, 0.6), (2, "review", 20.0, 5, 0.9, 0.9), (3, "keep", None, 30, 0.9, 0.9)], "fid int, flag string, area_ha double, n_pix int, pct double, p_above_ref double")
    assert sorted(r.fid for r in keep.keep_pool(df, "flag").collect()) == [1, 3]
    with pytest.raises(ValueError, match="no polygon"):
        keep.keep_pool(df.where("flag = 'review'"), "flag")
    assert keep.least_pixels(10, 0.81) == 13
    assert keep.least_pixels(20, 0.81) == 25
    assert [r.k for r in df.orderBy("fid").select(keep.keep_like(10, 1, 0.4, 0.5).alias("k")).collect()] == [True, False, False]
    assert keep.top_by_area(df, math.inf).count() == 3
    assert keep.top_with_reason([("a", df.limit(0)), ("b", df)], 1).first().reason == "b"
    joined = keep.copied_attributes(df.select("fid", "flag"), df.withColumnRenamed("pct", "own"), "fid")
    assert joined.columns == ["fid", "flag", "area_ha", "n_pix", "own", "p_above_ref"]
    assert keep.recombined(df, df.select("fid", "flag"), "flag", ("keep",)).count() == 3


def test_samples_repeat_and_are_whole_where_they_can_be(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as g")
    a, b = (sorted(r.id for r in keep.sample_by_hash(df.repartition(k), 100, ["id"]).collect()) for k in (3, 7))
    assert a == b
    assert len(a) == 100
    each = keep.sample_by_hash(df, 50, ["id"], ["g"]).groupBy("g").count().collect()
    assert sorted(r["count"] for r in each) == [50, 50, 50]
    assert keep.sample_by_hash(df, 10**6, ["id"], ["g"]).count() == 5000


def test_gates(spark):
    cells = spark.createDataFrame([(0, 0, 33, 0.0), (0, 1, 1, 1.0), (1, 1, 2, float("nan")), (2, 2, 1, None)], "r int, c int, cls int, value double")
    assert gates.is_binary(cells, "value")
    assert not gates.is_binary(cells, "cls")
    assert not gates.is_binary(cells.limit(0), "value")
    assert sorted((r.r, r.c) for r in gates.burnable_mask(cells, [1, 33]).collect()) == [(0, 1), (2, 2)]
    assert gates.burnable_mask(cells, [1, 33], keep_burnt=True).count() == 3
    assert [(r.r, r.c) for r in gates.burnable_mask(cells, None, "value").collect()][0] == (0, 1)
    assert tuple(gates.extent(cells).first()) == (0, 2, 0, 2)
    with pytest.raises(ValueError, match="no finite number"):
        gates.clean_cells(cells, -1, "fail")
    assert gates.clean_cells(cells, -1, "report").first().n_bad == 2
    with pytest.raises(ValueError, match="grids differ in epsg"):
        gates.require_same_grid({"epsg": 1, "w": 2}, {"epsg": 3, "w": 2})
    with pytest.raises(ValueError, match="none of"):
        gates.in_first_present(cells, ["x"], [1])
    assert gates.of_year(cells, 2000).count() == 4
    assert gates.stripped_of(spark.createDataFrame([(1, 2, 3)], "ecoregion_name int, ecoregion_ int, b int"), ["ecoregion_name"]).columns == ["b"]
    lut = raster.reclass(cells, [(1, 5), (33, 9), (1, 7)], excluded=(33,))
    assert sorted(r.new for r in lut.collect()) == [7, 7]


def test_running_sums_do_not_depend_on_ranges(spark):
    rows = [(g, float(v), (v * 7) % 5 + 1) for g in "ab" for v in range(200)]
    got = {(r.g, r.v): r.s for r in prefix.running_sums(spark.createDataFrame(rows, "g string, v double, t long"), ["g"], "v", {"s": "t"}).collect()}
    for g in "ab":
        total = 0
        for v in range(200):
            total += (v * 7) % 5 + 1
            assert got[g, float(v)] == total


def test_tails_and_panels(spark):
    assert ranks.kolmogorov_tail(1.36) == pytest.approx(0.049, abs=1e-3)
    df = spark.createDataFrame([(p, g, float(v + (20 if g == "b" and p == 1 else 0))) for p in (1, 2) for g in "ab" for v in range(12)] + [(3, "a", 1.0)], "p int, g string, v double")
    got = {r.p: r for r in ranks.kruskal_by(df.withColumnRenamed("p", "panel"), "panel", "g", "v").withColumnRenamed("p", "pval").withColumnRenamed("panel", "p").collect()}
    assert set(got) == {1, 2}
    assert got[1].pval < 0.001
    assert got[2].pval == pytest.approx(1.0)
    assert ranks.dunn_if_apart(df.where("p = 1"), "g", "v").count() == 1
    assert ranks.dunn_if_apart(df.where("p = 2"), "g", "v").count() == 0


def test_common_years_join_no_rows(spark):
    years = lambda *ys: spark.createDataFrame([(y,) for y in ys], "year int")
    got = validation.common_years(years(1999, 1999, 2001, None), years(2001, 2001, 1999, 2003, None))
    assert sorted(r.year for r in got.collect()) == [1999, 2001]
    assert validation.common_years(years(1999), years(1999).limit(0)).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
