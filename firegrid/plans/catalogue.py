"""Registered queries over the scene, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from firegrid.operators import accuracy, ranks, raster, scoring, zonal
from firegrid.plans.scene import CELL_M, SCENE_SQL, cells, features, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, scene: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (SCENE_SQL.replace("WITH", "WITH RECURSIVE", 1) + (", " if sql.lstrip().startswith("x AS") else "") if scene else "") + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


RATES = """tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fp + fn, 0), 6) AS iou,
  round((fp + fn) / nullif(tp + fp + fn + tn, 0), 6) AS error_rate, round(1 - tp / nullif(tp + fp, 0), 6) AS commission, round(1 - tp / nullif(tp + fn, 0), 6) AS omission"""
COUNTS = """count(*) FILTER (det = 1 AND ref = 1) AS tp, count(*) FILTER (det = 1 AND ref = 0) AS fp,
  count(*) FILTER (det = 0 AND ref = 1) AS fn, count(*) FILTER (det = 0 AND ref = 0) AS tn"""


@query(f"x AS (SELECT {COUNTS} FROM cells) SELECT {RATES} FROM x")
def confusion(spark, sf_dir):
    return rounded(accuracy.confusion(cells(spark, sf_dir)))


@query(f"x AS (SELECT cls, {COUNTS} FROM cells GROUP BY GROUPING SETS ((cls), ())) SELECT cls, {RATES} FROM x")
def class_confusion(spark, sf_dir):
    return rounded(accuracy.confusion_by_class(cells(spark, sf_dir)))


@query("SELECT r, c, det * 2 + ref + 1 AS code FROM cells")
def confusion_raster(spark, sf_dir):
    return cells(spark, sf_dir).select("r", "c", accuracy.confusion_code(F.col("det"), F.col("ref")).alias("code"))


@query("SELECT r, c, round((pre - post) * 1000, 6) AS dnbr, round((pre - post) * 1000 / (pre + 1.001), 6) AS rbr FROM cells")
def spectral_indices(spark, sf_dir):
    a, b = F.col("pre"), F.col("post")
    return rounded(cells(spark, sf_dir).select("r", "c", raster.index_difference(a, b).alias("dnbr"), raster.index_ratio(a, b).alias("rbr")))


LUT = [(1, 311), (2, 312), (3, 313), (5, 324)]


@query("SELECT r, c, CASE cls WHEN 1 THEN 311 WHEN 2 THEN 312 WHEN 3 THEN 313 WHEN 5 THEN 324 END AS new FROM cells WHERE cls IN (1, 2, 3, 5)")
def reclass_lut(spark, sf_dir):
    return raster.reclass(cells(spark, sf_dir), LUT).select("r", "c", "new")


@query("SELECT r, c, CASE WHEN value >= 0 AND value < 300 THEN 1 WHEN value >= 300 AND value < 600 THEN 2 WHEN value >= 600 AND value <= 900 THEN 3 END AS band FROM cells")
def reclass_range(spark, sf_dir):
    return cells(spark, sf_dir).select("r", "c", raster.reclass_ranges(F.col("value"), [(0, 300, 1), (300, 600, 2), (600, 900, 3)]).alias("band"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_bad, count(*) FILTER (value < 100) AS n_below FROM cells")
def clean_report(spark, sf_dir):
    return raster.clean_report(cells(spark, sf_dir), 100.0)


@query("SELECT r, c, round(greatest(value, 100), 6) AS value FROM cells")
def clean_apply(spark, sf_dir):
    return rounded(cells(spark, sf_dir).select("r", "c", raster.clean(F.col("value"), 100.0).alias("value")))


@query("SELECT r, c, round(max(v), 6) AS value FROM (SELECT r, c, value AS v FROM cells WHERE eco <= 2 UNION ALL SELECT r, c, value + 1 FROM cells WHERE eco >= 2) GROUP BY r, c")
def mosaic_max(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(raster.mosaic_max(x.where("eco <= 2").select("r", "c", "value"), x.where("eco >= 2").select("r", "c", (F.col("value") + 1).alias("value"))))


@query("SELECT unit, cls, eco, count(*) AS n FROM cells GROUP BY 1, 2, 3")
def unit_freq(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("unit", "cls", "eco").agg(F.count("*").alias("n"))


@query("SELECT unit, round(quantile_cont(value, 0.02), 6) AS q02, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.98), 6) AS q98 FROM cells GROUP BY 1")
def quantile_trim(spark, sf_dir):
    q = lambda p: F.percentile("value", p)
    return rounded(cells(spark, sf_dir).groupBy("unit").agg(q(0.02).alias("q02"), q(0.5).alias("q50"), q(0.98).alias("q98")))


HIST = "h AS (SELECT unit, low, high, CAST(greatest(ceil((value - low) / (high - low) * 255), 1) AS INTEGER) AS bin, count(*) AS n FROM (SELECT unit, value, min(value) OVER (PARTITION BY unit) AS low, max(value) OVER (PARTITION BY unit) AS high FROM cells) WHERE high > low GROUP BY ALL)"


@query(f"x AS (SELECT 1), {HIST} SELECT unit, bin, n FROM h")
def hist255(spark, sf_dir):
    return raster.histogram255(cells(spark, sf_dir)).select("unit", "bin", "n")


@query(
    f"""x AS (SELECT 1), {HIST}, f AS (SELECT u.unit, low, high, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit, low, high FROM h) u CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 256)) b LEFT JOIN (SELECT unit, bin, n FROM h) h USING (unit, bin)),
s AS (SELECT *, CASE WHEN bin BETWEEN 3 AND 253 THEN sum(n) OVER (PARTITION BY unit ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 ELSE 0.0 END AS s FROM f),
q AS (SELECT *, sum(s) OVER o AS w0, sum(s * (bin - 0.5)) OVER o AS m0, sum(s) OVER p AS w, sum(s * (bin - 0.5)) OVER p AS m FROM s WINDOW o AS (PARTITION BY unit ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY unit)),
v AS (SELECT *, round(w0 * (w - w0) * power(m0 / w0 - (m - m0) / (w - w0), 2), 3) AS v FROM q WHERE w0 > 0 AND w - w0 > 0)
SELECT unit, bin, round((bin - 0.5) / 255 * (high - low) + low, 4) AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY unit ORDER BY v DESC, bin) = 1"""
)
def otsu_unit_threshold(spark, sf_dir):
    return rounded(raster.otsu(cells(spark, sf_dir)), 4)


@query("x AS (SELECT unit, greatest(avg(value), 500.0, CASE WHEN min(cls) = 3 THEN 560.0 ELSE 0.0 END) AS seed FROM cells GROUP BY unit) SELECT unit, round(seed, 6) AS seed, round(least(greatest(seed - 100, 450.0), seed), 6) AS grow, greatest(seed - 100, 450.0) > seed AS clamped FROM x")
def threshold_resolution(spark, sf_dir):
    raw = cells(spark, sf_dir).groupBy("unit").agg(F.avg("value").alias("raw"), F.min("cls").alias("k"))
    x = raw.select("unit", scoring.seed_threshold(F.col("raw"), F.lit(500.0), F.when(F.col("k") == 3, 560.0).otherwise(0.0)).alias("seed"))
    grow, clamped = scoring.grow_threshold(F.col("seed"), F.lit(100.0), F.lit(450.0))
    return rounded(x.select("unit", "seed", grow.alias("grow"), clamped.alias("clamped")))


@query("SELECT a.r, a.c FROM (SELECT r, c FROM cells WHERE value >= 200) a JOIN (SELECT r, c FROM cells WHERE value >= 200) b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2 HAVING count(*) = 9")
def erode_mask(spark, sf_dir):
    return raster.erode(cells(spark, sf_dir).where("value >= 200"))


@query("SELECT DISTINCT CAST(r + i AS INTEGER) AS r, CAST(c + j AS INTEGER) AS c FROM cells, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j) WHERE value >= 800")
def dilate_mask(spark, sf_dir):
    return raster.dilate(cells(spark, sf_dir).where("value >= 800"))


def _patches(touch: str) -> str:
    return f"""x AS (SELECT r, c, CAST(r AS BIGINT) * 2147483648 + c AS id FROM cells WHERE value >= 800),
e AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON {touch}),
walk AS (SELECT id, id AS reach FROM x UNION SELECT walk.id, e.b FROM walk JOIN e ON walk.reach = e.a)
SELECT r, c, min(reach) AS label FROM walk JOIN x USING (id) GROUP BY r, c"""


@query(_patches("abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"))
def components8(spark, sf_dir):
    return raster.components(cells(spark, sf_dir).where("value >= 800"))


@query(_patches("abs(a.r - b.r) + abs(a.c - b.c) <= 1"))
def components4(spark, sf_dir):
    return raster.components(cells(spark, sf_dir).where("value >= 800"), diagonal=False)


@query(_patches("abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1").replace("SELECT r, c, min(reach) AS label FROM walk JOIN x USING (id) GROUP BY r, c", "SELECT label, count(*) AS n, count(*) FILTER (value >= 900) AS n_seed FROM (SELECT r, c, min(reach) AS label FROM walk JOIN x USING (id) GROUP BY r, c) JOIN cells USING (r, c) GROUP BY label HAVING count(*) FILTER (value >= 900) >= 1"))
def grow_keep(spark, sf_dir):
    grid = cells(spark, sf_dir).where("value >= 800")
    patches = raster.components(grid).join(grid.select("r", "c", "value"), ["r", "c"])
    return patches.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 900).alias("n_seed")).where("n_seed >= 1")


@query("SELECT fid, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, count(value) AS n_pix, round(avg(CAST(value > 700 AS DOUBLE)), 6) AS p_above FROM dets JOIN cells USING (r, c) GROUP BY fid")
def zonal_stats(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(zonal.zonal(features(x, "det", 5), x, 700))


@query("SELECT fid, round(1 - count(b.r) / count(*), 6) AS na_frac FROM dets LEFT JOIN (SELECT r, c FROM cells WHERE cls <= 4) b USING (r, c) GROUP BY fid")
def na_fraction(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(zonal.na_fraction(features(x, "det", 5), x.where("cls <= 4")))


OVER = "x AS (SELECT a.fid AS a, b.fid AS b, count(*) AS n FROM dets a JOIN refs b USING (r, c) GROUP BY 1, 2)"


@query(f"{OVER} SELECT a, b, n FROM x QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1")
def max_overlap_match(spark, sf_dir):
    x = cells(spark, sf_dir)
    return zonal.best_match(zonal.overlap(features(x, "det", 5), features(x, "ref", 7)))


@query("SELECT DISTINCT fid FROM dets WHERE fid NOT IN (SELECT fid FROM dets JOIN cells USING (r, c) WHERE cls = 7) OR fid IN (SELECT fid FROM dets JOIN cells USING (r, c) WHERE eco = 4)")
def safe_erase(spark, sf_dir):
    x = cells(spark, sf_dir)
    return zonal.safe_erase(features(x, "det", 5), x.where("cls = 7"), x.where("eco = 4"))


@query("SELECT r, c FROM cells WHERE det = 1 AND ref = 0")
def cell_difference(spark, sf_dir):
    x = cells(spark, sf_dir)
    return x.where("det = 1").select("r", "c").join(x.where("ref = 1").select("r", "c"), ["r", "c"], "left_anti")


@query("x AS (SELECT fid, count(*) AS n, count(d.r) AS n_hit FROM refs LEFT JOIN (SELECT DISTINCT r, c FROM dets) d USING (r, c) GROUP BY fid) SELECT fid, n, n_hit, round(100 * n_hit / n, 6) AS coverage, 100 * n_hit / n >= 10 AS detected, 100 * n_hit / n >= 90 AS completely FROM x")
def coverage_summary(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(accuracy.coverage(features(x, "ref", 7), features(x, "det", 5), 10, 90))


@query("SELECT cls, count(*) AS n, round(CAST(count(*) AS DOUBLE), 6) AS area_ha FROM cells WHERE ref = 1 AND det = 0 GROUP BY cls")
def omission_by_class(spark, sf_dir):
    return cells(spark, sf_dir).where("ref = 1 AND det = 0").groupBy("cls").agg(F.count("*").alias("n"), F.round(F.count("*") * (CELL_M * CELL_M / 10000), 6).alias("area_ha"))


@query("SELECT fid, count(*) AS before, count(*) FILTER (cls <= 4) AS after, round(count(*) FILTER (cls <= 4) / count(*), 6) AS burnable_ratio FROM dets JOIN cells USING (r, c) GROUP BY fid")
def burnable_ratio(spark, sf_dir):
    x = cells(spark, sf_dir)
    each = features(x, "det", 5).join(x.select("r", "c", "cls"), ["r", "c"]).groupBy("fid").agg(F.count("*").alias("before"), F.count_if(F.col("cls") <= 4).alias("after"))
    return each.withColumn("burnable_ratio", F.round(F.col("after") / F.col("before"), 6))


@query("""x AS (SELECT fid, (max(c) - min(c) + 1) * 100.0::DOUBLE AS w, (max(r) - min(r) + 1) * 100.0::DOUBLE AS h, count(*) AS n FROM dets GROUP BY fid)
SELECT fid, n, round(w * h / 10000, 6) AS area_ha, round(2 * (w + h), 6) AS perimeter_m, round(greatest(w, h) / least(w, h), 6) AS elong, round(4 * pi() * w * h / power(2 * (w + h), 2), 6) AS compact_pp,
round(2 * (w + h) / (2 * sqrt(pi() * w * h)), 6) AS shape_index, round(n * 10000 / (w * h), 6) AS rect_fill FROM x""")
def shape_metrics(spark, sf_dir):
    return rounded(zonal.rectangle_shape(features(cells(spark, sf_dir), "det", 5), CELL_M))


@query("SELECT fid, count(*) AS n FROM dets GROUP BY fid ORDER BY n DESC, fid LIMIT 20")
def top_n_area(spark, sf_dir):
    return features(cells(spark, sf_dir), "det", 5).groupBy("fid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fid").limit(20)


@query("x AS (SELECT fid, quantile_cont(value, 0.5) AS median, count(*) AS n FROM dets JOIN cells USING (r, c) GROUP BY fid), p AS (SELECT median FROM x WHERE n >= 15) SELECT fid, round((SELECT count(*) FROM p WHERE p.median <= x.median) / (SELECT count(*) FROM p), 6) AS pct, CASE WHEN n < 5 THEN 'ambiguous' WHEN (SELECT count(*) FROM p WHERE p.median <= x.median) / (SELECT count(*) FROM p) <= 0.3 THEN 'bad_identified' WHEN (SELECT count(*) FROM p WHERE p.median <= x.median) / (SELECT count(*) FROM p) >= 0.6 THEN 'good_identified' ELSE 'ambiguous' END AS class3_id FROM x")
def ecdf_class3(spark, sf_dir):
    x = cells(spark, sf_dir)
    each = zonal.zonal(features(x, "det", 5), x, 700).select("fid", "median", "n_pix")
    scored = scoring.ecdf(each, each.where("n_pix >= 15"), "median")
    return rounded(scored.select("fid", "pct", scoring.class3(F.col("pct"), 0.3, 0.6, F.col("n_pix") < 5).alias("class3_id")))


@query("x AS (SELECT d.fid, bool_or(ref = 1) AS hit, 1 - count(*) FILTER (cls <= 5) / count(*) AS na, bool_or(cls <= 2) AS burnable FROM dets d JOIN cells USING (r, c) GROUP BY d.fid) SELECT fid, CASE WHEN hit THEN 'keep' WHEN na > 0.5 THEN 'drop_corine_na' WHEN burnable THEN 'review' ELSE 'drop_unburnable' END AS flag FROM x")
def support_flags(spark, sf_dir):
    x = cells(spark, sf_dir)
    each = features(x, "det", 5).join(x.select("r", "c", "ref", "cls"), ["r", "c"]).groupBy("fid").agg(F.bool_or(F.col("ref") == 1).alias("hit"), (1 - F.count_if(F.col("cls") <= 5) / F.count("*")).alias("na"), F.bool_or(F.col("cls") <= 2).alias("burnable"))
    return each.select("fid", scoring.support_flag(F.col("hit"), F.col("na"), 0.5, F.col("burnable")).alias("flag"))


@query("SELECT fid, bool_or(ref = 1) AS hit, CASE WHEN bool_or(ref = 1) THEN 'keep_common' ELSE 'review_int_no_effis' END AS flag FROM dets JOIN cells USING (r, c) GROUP BY fid")
def cross_flags(spark, sf_dir):
    x = cells(spark, sf_dir)
    d = features(x, "det", 5)
    hit = d.join(x.where("ref = 1").select("r", "c"), ["r", "c"], "left_semi").select("fid").distinct().withColumn("hit", F.lit(True))
    return d.select("fid").distinct().join(hit, "fid", "left").select("fid", F.coalesce("hit", F.lit(False)).alias("hit"), F.when(F.col("hit"), "keep_common").otherwise("review_int_no_effis").alias("flag"))


@query("""SELECT o_orderkey, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN coalesce(rb, 99) < coalesce(ra, 99) THEN b ELSE a END AS label FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'good' WHEN 'F' THEN 'bad' ELSE '' END AS a, CASE WHEN o_totalprice > 100000 THEN 'good' WHEN o_totalprice > 50000 THEN 'odd' ELSE 'ambiguous' END AS b FROM orders) LEFT JOIN (VALUES ('good', 1), ('ambiguous', 2), ('bad', 3)) x(a, ra) USING (a) LEFT JOIN (VALUES ('good', 1), ('ambiguous', 2), ('bad', 3)) y(b, rb) USING (b)""", scene=False)
def label_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = F.when(F.col("o_orderstatus") == "O", "good").when(F.col("o_orderstatus") == "F", "bad").otherwise("")
    b = F.when(F.col("o_totalprice") > 100000, "good").when(F.col("o_totalprice") > 50000, "odd").otherwise("ambiguous")
    return o.select("o_orderkey", scoring.merge_labels(a, b, {"good": 1, "ambiguous": 2, "bad": 3}).alias("label"))


RANKED = "x AS (SELECT event_type AS g, value AS v, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM events WHERE value IS NOT NULL)"


@query(f"WITH {RANKED}, s AS (SELECT g, sum(k) AS s, count(*) AS n FROM x GROUP BY g), t AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM x GROUP BY v)), n AS (SELECT sum(n)::DOUBLE AS n, sum(s * s / n) AS q, count(*) - 1 AS df FROM s) SELECT CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, df FROM n, t", scene=False)
def kw_stat(spark, sf_dir):
    return rounded(ranks.kruskal(table(spark, sf_dir, "events").where("value is not null"), "event_type", "value"), 4)


@query("WITH x AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL), c AS (SELECT g, v, count(*) AS t FROM x GROUP BY 1, 2), m AS (SELECT a.g AS a, b.g AS b FROM (SELECT DISTINCT g FROM x) a JOIN (SELECT DISTINCT g FROM x) b ON a.g < b.g), j AS (SELECT a, b, v, sum(CASE WHEN g = a THEN t ELSE 0 END) AS ta, sum(CASE WHEN g = b THEN t ELSE 0 END) AS tb FROM m JOIN c ON g IN (a, b) GROUP BY 1, 2, 3), w AS (SELECT *, sum(ta) OVER o AS ca, sum(tb) OVER o AS cb, sum(ta) OVER p AS na, sum(tb) OVER p AS nb FROM j WINDOW o AS (PARTITION BY a, b ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY a, b)) SELECT a, b, round(2 * sum(ta::DOUBLE * (2 * cb - tb) / 2) / (max(na) * max(nb)) - 1, 6) AS cliff_delta, round(max(abs(ca / na - cb / nb)), 6) AS ks FROM w GROUP BY 1, 2", scene=False)
def cliff_and_ks(spark, sf_dir):
    return rounded(ranks.pair_statistics(table(spark, sf_dir, "events").where("value is not null").select("event_type", "value"), "event_type", "value"))


@query("SELECT family, id, round(max(s) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p) AS s FROM (SELECT n_regionkey AS family, n_nationkey AS id, (n_nationkey * 37 % 101) / 1000.0::DOUBLE AS p FROM nation))", scene=False)
def holm_adjust(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 37 % 101 / 1000).alias("p"))
    return rounded(ranks.holm(n, "p", ["family"]).select("family", "id", "adjusted"))


@query("SELECT a.n_name AS name, b.n_name AS other, levenshtein(lower(a.n_name), lower(b.n_name)) AS distance FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey WHERE levenshtein(lower(a.n_name), lower(b.n_name)) <= 3 QUALIFY row_number() OVER (PARTITION BY a.n_name ORDER BY distance, b.n_name) = 1", scene=False)
def fuzzy_origin_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = n.select("n_nationkey", F.col("n_name").alias("name"), scoring.admin_key(F.col("n_name")).alias("k"))
    other = key.toDF("id", "other", "k2")  # names of administrative units: 25 rows
    near = key.join(F.broadcast(other), (F.col("id") != F.col("n_nationkey")) & (F.levenshtein(F.lower("name"), F.lower("other")) <= 3))
    w = Window.partitionBy("name").orderBy("distance", "other")
    return near.select("name", "other", F.levenshtein(F.lower("name"), F.lower("other")).alias("distance")).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@query("SELECT p_size % 7 + 1 AS id, count(*) AS n, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS brands FROM part GROUP BY 1", scene=False)
def group_lut(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy((F.col("p_size") % 7 + 1).alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), ";").alias("brands"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, s_name, NULL, s_acctbal FROM supplier", scene=False)
def harmonized_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return scoring.harmonized_union(a, b)
