import pytest
from pyspark.sql import functions as F

from firegrid.operators import accuracy, ranks, raster, scoring, zonal


def test_erode_five_by_five(spark):
    grid = spark.createDataFrame([(r, c) for r in range(5) for c in range(5)], "r int, c int")
    assert raster.erode(grid).count() == 9


def test_corner_touch_is_one_patch_of_eight_and_two_of_four(spark):
    grid = spark.createDataFrame([(0, 0), (1, 1)], "r int, c int")
    assert raster.components(grid).select("label").distinct().count() == 1
    assert raster.components(grid, diagonal=False).select("label").distinct().count() == 2


def test_two_long_prongs_are_one_patch(spark):
    u = [(r, c) for r in range(400) for c in (0, 2)] + [(400, c) for c in range(3)]
    grid = spark.createDataFrame([*u, (500, 7)], "r int, c int")
    for diagonal in (True, False):
        assert {(r.r, r.c): r.label for r in raster.components(grid, diagonal=diagonal).collect()} == {**dict.fromkeys(u, 0), (500, 7): (500 << 31) + 7}


def test_links_that_do_not_settle_raise(spark):
    grid = spark.createDataFrame([(r, 0) for r in range(50)], "r int, c int")
    with pytest.raises(RuntimeError, match="settle"):
        raster.components(grid, most_rounds=1)


def test_square_of_one_hectare(spark):
    one = zonal.rectangle_shape(spark.createDataFrame([(0, 0, 1)], "r int, c int, fid int"), 100.0).first()
    assert (one.area_ha, one.perimeter_m, one.elong, one.rect_fill) == (1, 400, 1, 1)
    assert one.compact_pp == pytest.approx(0.7853981633974483)


def test_rates_are_null_without_cells(spark):
    got = accuracy.confusion(spark.createDataFrame([], "det int, ref int")).first()
    assert (got.tp, got.precision, got.recall) == (0, None, None)


def test_holm_and_cliff(spark):
    p = spark.createDataFrame([("f", 0.01), ("f", 0.02), ("f", 0.03)], "family string, p double")
    assert [round(r.adjusted, 9) for r in ranks.holm(p, "p", ["family"]).orderBy("p").collect()] == [0.03, 0.04, 0.04]
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    assert ranks.pair_statistics(v, "g", "v").first().cliff_delta == -1


def test_tails():
    assert ranks.normal_tail(1.959963985) == pytest.approx(0.05, abs=1e-6)
    assert ranks.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-6)
    assert ranks.chi2_tail(18.30703805, 10) == pytest.approx(0.05, abs=1e-6)


def test_letters():
    assert ranks.letters(["x", "y", "z"], {frozenset("xz")}) == {"x": "a", "y": "ab", "z": "b"}
    assert ranks.letters(["x", "y"], set()) == {"x": "a", "y": "a"}


def test_thresholds_class3_and_labels(spark):
    seed = scoring.seed_threshold(F.lit(250), F.lit(300), F.lit(350))
    grow, clamped = scoring.grow_threshold(seed, F.lit(100), F.lit(300))
    row = spark.range(1).select(seed.alias("s"), grow.alias("g"), clamped.alias("k")).first()
    assert (row.s, row.g) == (350, 300)
    x = spark.createDataFrame([(0.01,), (0.03,), (0.05,)], "p double").select(scoring.class3(F.col("p"), 0.01, 0.05, F.lit(False)).alias("k"))
    assert [r.k for r in x.collect()] == ["bad_identified", "ambiguous", "good_identified"]
    m = spark.range(1).select(scoring.merge_labels(F.lit("ambiguous"), F.lit("good_identified"), {"good_identified": 1, "ambiguous": 2}).alias("k")).first()
    assert m.k == "good_identified"


def test_admin_key(spark):
    got = spark.createDataFrame([("Región de Murcia",), ("Castilla y León",)], "n string").select(scoring.admin_key(F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == ["murcia", "castillaleon"]


#: Prices of three rows of one cell; their mean is 55,000, and what doubles give depends on the order of adding.
UP, DOWN = [(15854.77, 83420.75, 65724.48), (4547.78, 77514.54, 82937.68), (16326.08, 79965.14, 68708.78)], [(86882.56, 60424.42, 17693.02), (87546.8, 71497.18, 5956.02), (82527.87, 71897.92, 10574.21)]


@pytest.mark.parametrize("name", ["ecdf_class3", "keep_like_flags", "whole_values"])
def test_rows_of_a_cell_are_added_in_the_order_of_the_files(spark, tmp_path, name):
    import os

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from firegrid.plans.validated import ORACLES, QUERIES

    small = "/root/testdata/sf0.001"
    for t, key in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", None)):  # smaller than lineitem, so that DuckDB reads lineitem last
        pq.write_table(pq.read_table(f"{small}/{t}.parquet", filters=[(key, "=", 0)] if key else None), tmp_path / f"{t}.parquet")
    row = lambda r, c, price: dict(l_orderkey=r, l_partkey=0, l_suppkey=0, l_linenumber=c, l_quantity=30.0, l_extendedprice=price, l_discount=0.01, l_tax=0.02)
    first = [row(r, c, 60000.0 + 100 * r + c) for r in range(5) for c in range(5)] + [row(10, 10, 70000.0)]
    second = []
    for k, three in enumerate(UP + DOWN):
        first.append(row(11 + k % 2, 10 + k, three[0]))
        second += [row(11 + k % 2, 10 + k, price) for price in three[1:]]
    os.mkdir(tmp_path / "lineitem.parquet")
    for k, rows in enumerate((first, second)):
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # so that the SQL adds in the order of the files, too
    for t in ("part", "supplier", "nation", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'lineitem' else ''}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
