"""Registered queries over polygons, rules and rank tests; they join those of the scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.operators import ranks, rules, vector
from firegrid.plans.catalogue import ORACLES, QUERIES, RANKED, query, rounded
from firegrid.plans.scene import CELL_M, cells, features, table

__all__ = ["ORACLES", "QUERIES"]

UNIT, CLS, ECO = {10001: 620}, {3: 560, 5: 540}, {2: 530}


@query("""SELECT DISTINCT unit, CAST(CASE WHEN unit = 10001 THEN 620 WHEN cls = 3 THEN 560 WHEN cls = 5 THEN 540 WHEN eco = 2 THEN 530 ELSE 500 END AS DOUBLE) AS lb,
CAST(greatest(545, CASE WHEN unit = 10001 THEN 620 END, CASE cls WHEN 3 THEN 560 WHEN 5 THEN 540 END, CASE WHEN eco = 2 THEN 530 END) AS DOUBLE) AS floor FROM cells""")
def override_precedence(spark, sf_dir):
    keys = cells(spark, sf_dir).select("unit", "cls", "eco").distinct()
    by = [(F.col("unit"), UNIT), (F.col("cls"), CLS), (F.col("eco"), ECO)]
    return keys.select("unit", rules.first_override(500, *by).alias("lb"), rules.highest_floor(545, *by).alias("floor"))


@query("""x AS (SELECT unit, count(*) AS n, min(value) AS low, max(value) AS high FROM cells GROUP BY unit)
SELECT unit, n, CASE WHEN n < 700 THEN 'fallback_small_unit' WHEN n // 2 < 450 THEN 'fallback_low_sample' WHEN low >= high THEN 'fallback_otsu_fail_degenerate_range' ELSE 'ok' END AS note FROM x""")
def unit_notes(spark, sf_dir):
    x = cells(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    n = F.col("n")
    return x.select("unit", "n", rules.unit_note(n, F.floor(n / 2), rules.otsu_note(n, n, F.col("low"), F.col("high")), 700, 450).alias("note"))


@query("SELECT lb, unit, count(*) FILTER (value >= lb) AS n_seed, count(*) FILTER (value >= least(greatest(lb - 100, 450), lb)) AS n_grow FROM cells, (VALUES (500.0::DOUBLE), (600.0), (700.0)) v(lb) GROUP BY 1, 2")
def run_matrix(spark, sf_dir):
    x = rules.run_matrix(cells(spark, sf_dir).select("unit", "value"), [500, 600, 700])
    grow = F.least(F.greatest(F.col("lb") - 100, F.lit(450.0)), F.col("lb"))
    return x.groupBy("lb", "unit").agg(F.count_if(F.col("value") >= F.col("lb")).alias("n_seed"), F.count_if(F.col("value") >= grow).alias("n_grow"))


@query("SELECT y, CASE WHEN y <= 1999 THEN 1990 WHEN y <= 2005 THEN 2000 WHEN y <= 2011 THEN 2006 WHEN y <= 2017 THEN 2012 ELSE 2018 END AS map_year, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) GROUP BY 1, 2", scene=False)
def mask_year(spark, sf_dir):
    y = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"))
    return y.groupBy("y").agg(F.count("*").alias("n")).select("y", rules.mask_year(F.col("y")).alias("map_year"), "n")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE dayofyear(o_orderdate) BETWEEN 152 AND 274 GROUP BY 1", scene=False)
def day_window(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(rules.day_window(F.dayofyear("o_orderdate"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS lg, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS ln, round(CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END, 6) AS l1, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sq FROM customer", scene=False)
def transforms(spark, sf_dir):
    x = F.col("c_acctbal")
    return rounded(table(spark, sf_dir, "customer").select("c_custkey", *[rules.transform(x, k).alias(a) for k, a in (("log10", "lg"), ("ln", "ln"), ("log1p", "l1"), ("sqrt", "sq"))]))


@query("SELECT p_size, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS p_brand, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY 1", scene=False)
def dissolve_by_field(spark, sf_dir):
    return rules.dissolve(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice"), "p_size", "p_partkey")


@query("SELECT id, coalesce(n, 0) AS n, mean FROM (SELECT CAST(range AS INTEGER) AS id FROM range(1, 11)) LEFT JOIN (SELECT cls AS id, count(*) AS n, round(avg(value), 6) AS mean FROM cells WHERE det = 1 GROUP BY cls) USING (id)")
def lut_preserving(spark, sf_dir):
    counts = cells(spark, sf_dir).where("det = 1").groupBy(F.col("cls").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rules.keep_all(spark.range(1, 11).select(F.col("id").cast("int")), counts, "id", ["n"])


@query("SELECT DISTINCT fid FROM refs WHERE fid NOT IN (SELECT refs.fid FROM refs JOIN dets USING (r, c))")
def reference_only(spark, sf_dir):
    x = cells(spark, sf_dir)
    ref = features(x, "ref", 7)
    hit = ref.join(x.where("det = 1").select("r", "c"), ["r", "c"], "left_semi").select("fid").distinct()
    return ref.select("fid").distinct().join(hit, "fid", "left_anti")


@query("""x AS (SELECT fid, (max(c) - min(c) + 1) * 100.0::DOUBLE AS w, (max(r) - min(r) + 1) * 100.0::DOUBLE AS h FROM dets GROUP BY fid)
SELECT fid, round(w * h / 10000, 6) AS area_ha, round(2 * (w + h), 6) AS perimeter_m, w AS bbox_w_m, h AS bbox_h_m, least(w, h) AS mrr_w_m, greatest(w, h) AS mrr_l_m, round(greatest(w, h) / least(w, h), 6) AS elong_mrr,
round(4 * pi() * w * h / power(2 * (w + h), 2), 6) AS compact_pp, round((w + h) / sqrt(pi() * w * h), 6) AS shape_index, 1.0::DOUBLE AS rect_fill FROM x""")
def polygon_metrics(spark, sf_dir):
    box = features(cells(spark, sf_dir), "det", 5).groupBy("fid").agg(*[(e * CELL_M).alias(a) for e, a in ((F.min("c"), "x0"), (F.max("c") + 1, "x1"), (F.min("r"), "y0"), (F.max("r") + 1, "y1"))])
    x0, x1, y0, y1 = (F.col(x) for x in ("x0", "x1", "y0", "y1"))
    return rounded(vector.shape_metrics(box.select("fid", F.array(vector.ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))).alias("rings"))))


@query("SELECT s_suppkey AS fid, CAST(s_suppkey % 50 + i AS INTEGER) AS r, CAST(s_nationkey + j AS INTEGER) AS c FROM supplier, range(10) a(i), range(10) b(j) WHERE i + j < 9", scene=False)
def rasterize_polygons(spark, sf_dir):
    x, y = F.col("s_nationkey") * 100, F.col("s_suppkey") % 50 * 100
    layer = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), F.array(vector.ring((x, y), (x + 1000, y), (x, y + 1000))).alias("rings"))
    return vector.rasterize(layer, 100.0)


@query("SELECT a.fid, 4 * count(*) - count(b.r) - count(b2.r) - count(b3.r) - count(b4.r) AS n_sides FROM dets a LEFT JOIN dets b ON b.fid = a.fid AND b.r = a.r + 1 AND b.c = a.c LEFT JOIN dets b2 ON b2.fid = a.fid AND b2.r = a.r - 1 AND b2.c = a.c LEFT JOIN dets b3 ON b3.fid = a.fid AND b3.r = a.r AND b3.c = a.c + 1 LEFT JOIN dets b4 ON b4.fid = a.fid AND b4.r = a.r AND b4.c = a.c - 1 GROUP BY a.fid")
def cell_outline(spark, sf_dir):
    return vector.outline(features(cells(spark, sf_dir), "det", 5), CELL_M).groupBy("fid").agg(F.count("*").alias("n_sides"))


TIES = "t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM x GROUP BY v))"


@query(f"WITH {RANKED}, s AS (SELECT g, avg(k) AS m, count(*)::DOUBLE AS n FROM x GROUP BY g), {TIES}, a AS (SELECT sum(n) AS n FROM s) SELECT p.g AS a, q.g AS b, round((p.m - q.m) / sqrt((a.n * (a.n + 1) / 12 - ties / (12 * (a.n - 1))) * (1 / p.n + 1 / q.n)), 5) AS z FROM s p JOIN s q ON p.g < q.g, t, a", scene=False)
def dunn_z(spark, sf_dir):
    found = ranks.dunn(table(spark, sf_dir, "events").where("value is not null"), "event_type", "value")
    return found.select("a", "b", F.round("z", 5).alias("z"))
