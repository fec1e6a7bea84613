"""Registered queries on validation, keeping and gates, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.operators import gates, keep, ranks, scoring, validation, zonal
from firegrid.plans.catalogue import COUNTS, RATES, query, rounded
from firegrid.plans.extended import ORACLES, QUERIES  # noqa: F401
from firegrid.plans.scene import cells, features, table

LEGEND = {1: "forest", 2: "scrub", 3: "grass"}


@query(f"""x AS (SELECT cls, {COUNTS} FROM cells GROUP BY GROUPING SETS ((cls), ()))
SELECT cls, {RATES}, round((tp + fn) * 1.0::DOUBLE, 6) AS area_reference_ha, round((tp + fp) * 1.0::DOUBLE, 6) AS area_detected_ha, round(tp * 1.0::DOUBLE, 6) AS area_common_ha,
CASE WHEN cls IS NULL THEN 'all' WHEN cls = 1 THEN 'forest' WHEN cls = 2 THEN 'scrub' WHEN cls = 3 THEN 'grass' ELSE CAST(cls AS VARCHAR) END AS class_label FROM x WHERE cls IS NULL OR tp + fn >= 100""")
def class_areas(spark, sf_dir):
    return rounded(validation.class_confusion(cells(spark, sf_dir), least_ref_ha=100, labels=LEGEND))


@query(f"""y AS (SELECT CASE WHEN cls < 6 THEN cls END AS cls, CASE WHEN cls <> 2 THEN det END AS det, CASE WHEN cls <> 3 THEN ref END AS ref FROM cells),
x AS (SELECT cls, {COUNTS} FROM y WHERE cls IS NOT NULL AND det IS NOT NULL AND ref IS NOT NULL GROUP BY GROUPING SETS ((cls), ())) SELECT cls, tp, fp, fn, tn FROM x""".replace("y AS", "x AS (SELECT 1), y AS", 1).replace("\nx AS", "\nz AS").replace("FROM x", "FROM z"))
def class_complete_cases(spark, sf_dir):
    x = cells(spark, sf_dir)
    holes = x.select("r", "c", F.when(F.col("cls") < 6, F.col("cls")).alias("cls"), F.when(F.col("cls") != 2, F.col("det")).alias("det"), F.when(F.col("cls") != 3, F.col("ref")).alias("ref"))
    return validation.class_confusion(holes, domain="complete").select("cls", "tp", "fp", "fn", "tn")


@query("SELECT cls, count(*) AS n, count(*) * 1.0::DOUBLE AS area_ha FROM cells WHERE det = 1 AND ref = 0 GROUP BY cls")
def commission_by_class(spark, sf_dir):
    return validation.error_area(cells(spark, sf_dir), "commission")


@query("""x AS (SELECT fid, count(*) AS n, count(d.r) AS k FROM refs LEFT JOIN (SELECT DISTINCT r, c FROM dets) d USING (r, c) GROUP BY fid),
p AS (SELECT count(*) AS n_reference, count(*) FILTER (100.0 * k / n >= 90) AS n_completely_detected, count(*) FILTER (100.0 * k / n >= 10) AS n_detected FROM x),
a AS (SELECT count(*) FILTER (ref = 1)::DOUBLE AS ref, count(*) FILTER (det = 1)::DOUBLE AS det, count(*) FILTER (ref = 1 AND det = 1)::DOUBLE AS shared FROM cells)
SELECT n_reference, n_completely_detected, n_detected, n_reference - n_detected AS n_not_detected, round(100.0 * n_detected / n_reference, 6) AS perc_detected, ref AS area_reference_ha, det AS area_detected_ha, shared AS area_common_ha,
ref - shared AS area_missed_ha, round(100 * shared / ref, 6) AS recall_area_percent, round(100 * shared / det, 6) AS precision_area_percent FROM p, a""")
def polygon_summary(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(validation.polygon_summary(features(x, "ref", 7), features(x, "det", 5)))


@query("""x AS (SELECT fid, count(*) AS n, count(d.r) AS k FROM refs LEFT JOIN (SELECT DISTINCT r, c FROM dets) d USING (r, c) GROUP BY fid),
y AS (SELECT fid, count(*) AS n, count(d.r) AS k FROM dets LEFT JOIN (SELECT DISTINCT r, c FROM refs) d USING (r, c) GROUP BY fid)
SELECT 'reference' AS layer, fid, CASE WHEN 100.0 * k / n >= 40 THEN 'TP' ELSE 'FN' END AS label, k::DOUBLE AS overlap_ha, round(100.0 * k / n, 6) AS overlap_percent FROM x
UNION ALL SELECT 'detected', fid, CASE WHEN k > 0 THEN 'TP' ELSE 'FP' END, k::DOUBLE, round(100.0 * k / n, 6) FROM y""")
def polygon_labels(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(validation.polygon_labels(features(x, "ref", 7), features(x, "det", 5), least=40))


@query("SELECT fid, count(*)::DOUBLE AS area_before_ha, count(b.r)::DOUBLE AS area_after_ha, round(count(b.r) / count(*), 6) AS burnable_ratio, round(1 - count(b.r) / count(*), 6) AS nonburn_ratio FROM dets LEFT JOIN (SELECT r, c FROM cells WHERE cls <= 2) b USING (r, c) GROUP BY fid")
def burnable_share(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(validation.burnable_ratio(features(x, "det", 5), gates.burnable_mask(x, [1, 2])))


@query("""x AS (SELECT DISTINCT fid FROM dets), a AS (SELECT DISTINCT fid FROM dets JOIN cells USING (r, c) WHERE cls <= 2), b AS (SELECT DISTINCT fid FROM dets JOIN cells USING (r, c) WHERE cls <= 2 AND eco = 1)
SELECT 'class' AS step, (SELECT count(*) FROM x WHERE fid NOT IN (SELECT fid FROM a)) AS n_dropped UNION ALL SELECT 'region', (SELECT count(*) FROM a WHERE fid NOT IN (SELECT fid FROM b))""")
def dropped_by_step(spark, sf_dir):
    x = cells(spark, sf_dir)
    d = features(x, "det", 5).join(x.select("r", "c", "cls", "eco"), ["r", "c"])
    return validation.drop_counts(d, {"class": d.where("cls <= 2"), "region": d.where("cls <= 2 and eco = 1")})


OMITTED = "o AS (SELECT r, c FROM cells WHERE ref = 1 AND det = 0 AND cls = 1)"


@query(f"x AS (SELECT 1), {OMITTED} SELECT DISTINCT CAST(r + i AS INTEGER) AS r, CAST(c + j AS INTEGER) AS c FROM o, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)")
def omission_layer(spark, sf_dir):
    x = cells(spark, sf_dir)
    return validation.omission_layer(x.where("ref = 1 and cls = 1"), x.where("det = 1"), 1)


@query(f"x AS (SELECT 1), {OMITTED}, w AS (SELECT DISTINCT r + i AS r, c + j AS c FROM o, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j)) SELECT DISTINCT fid FROM dets JOIN w USING (r, c)")
def omission_neighbours(spark, sf_dir):
    x = cells(spark, sf_dir)
    return validation.touching(features(x, "det", 5), validation.omission_layer(x.where("ref = 1 and cls = 1"), x.where("det = 1"), 1))


@query("""x AS (SELECT r, c FROM cells WHERE value >= 700), y AS (SELECT fid, count(*) AS n, count(x.r) AS k FROM refs LEFT JOIN x USING (r, c) GROUP BY fid)
SELECT fid, round(100.0 * k / n, 6) AS of_feature, round(100.0 * k / (SELECT count(*) FROM x), 6) AS of_overlay FROM y""")
def overlay_percent(spark, sf_dir):
    x = cells(spark, sf_dir)
    ref, hot = features(x, "ref", 7), x.where("value >= 700")
    a = validation.overlay_percent(ref, hot).withColumnRenamed("percent", "of_feature")
    return rounded(a.join(validation.overlay_percent(ref, hot, "overlay").withColumnRenamed("percent", "of_overlay"), "fid"))


@query("""x AS (SELECT fid, bool_or(det = 1) AS hit, 1 - count(*) FILTER (cls <= 5) / count(*) AS na, bool_or(cls <= 2) AS burnable FROM refs JOIN cells USING (r, c) GROUP BY fid),
y AS (SELECT fid, hit, CASE WHEN na > 0.4 THEN 'drop_corine_na' WHEN NOT burnable THEN 'drop_unburnable' ELSE 'ref' END AS flag FROM x)
SELECT fid, flag, CASE WHEN flag <> 'ref' THEN flag WHEN hit THEN 'keep_ref' ELSE 'review_ref' END AS cross_flag FROM y""")
def reference_flags(spark, sf_dir):
    x = cells(spark, sf_dir)
    each = features(x, "ref", 7).join(x.select("r", "c", "det", "cls"), ["r", "c"]).groupBy("fid").agg(
        F.bool_or(F.col("det") == 1).alias("hit"), (1 - F.count_if(F.col("cls") <= 5) / F.count("*")).alias("na"), F.bool_or(F.col("cls") <= 2).alias("burnable")
    )
    flagged = each.withColumn("flag", keep.reference_flag(F.col("na"), 0.4, F.col("burnable")))
    return flagged.select("fid", "flag", keep.cross_flag("reference", F.col("flag"), F.col("hit")).alias("cross_flag"))


@query("""x AS (SELECT fid, quantile_cont(value, 0.5) AS median, count(*) AS n_pix, avg(CAST(value > 700 AS DOUBLE)) AS p_above_ref, bool_or(ref = 1) AS hit FROM dets JOIN cells USING (r, c) GROUP BY fid),
p AS (SELECT median FROM x WHERE hit), y AS (SELECT *, (SELECT count(*) FROM p WHERE p.median <= x.median) / (SELECT count(*) FROM p) AS pct FROM x)
SELECT fid, round(pct, 6) AS pct, n_pix >= 14 AND pct >= 0.3 AND p_above_ref >= 0.1 AS keep_like FROM y""")
def keep_like_flags(spark, sf_dir):
    x = cells(spark, sf_dir)
    d = features(x, "det", 5)
    hit = d.join(x.select("r", "c", "ref"), ["r", "c"]).groupBy("fid").agg(F.bool_or(F.col("ref") == 1).alias("hit"))
    each = zonal.zonal(d, x, 700).join(hit, "fid").withColumns({"area_ha": F.col("n_pix").cast("double"), "p_above_ref": F.col("p_above"), "flag": F.when(F.col("hit"), "keep_common").otherwise("keep")})
    scored = scoring.ecdf(each, keep.keep_pool(each, "flag"), "median")
    return rounded(scored.select("fid", "pct", keep.keep_like(14, 1, 0.3, 0.1).alias("keep_like")))


PIECES = "x AS (SELECT fid, eco AS piece, count(*) AS n FROM dets JOIN cells USING (r, c) GROUP BY 1, 2)"


@query(f"{PIECES} SELECT fid, piece, n FROM x QUALIFY row_number() OVER (PARTITION BY fid ORDER BY n DESC, piece) = 1")
def largest_piece(spark, sf_dir):
    x = cells(spark, sf_dir)
    pieces = features(x, "det", 5).join(x.select("r", "c", F.col("eco").alias("piece")), ["r", "c"]).groupBy("fid", "piece").agg(F.count("*").alias("n"))
    return keep.largest_piece(pieces, area="n").select("fid", "piece", "n")


@query("SELECT a.fid AS sub_uid, arg_max(b.fid, (b.n, -b.fid)) AS fid, count(*) > 1 AS join_ambiguous FROM (SELECT DISTINCT d.fid, f.fid AS ref FROM dets d JOIN refs f USING (r, c)) a JOIN (SELECT fid, count(*) AS n FROM refs GROUP BY fid) b ON a.ref = b.fid GROUP BY a.fid")
def point_match(spark, sf_dir):
    x = cells(spark, sf_dir)
    d, ref = features(x, "det", 5).withColumnRenamed("fid", "sub_uid"), features(x, "ref", 7)
    hits = d.join(ref, ["r", "c"]).select("sub_uid", "fid").distinct().join(ref.groupBy("fid").agg(F.count("*").alias("area_ha")), "fid")
    return keep.point_match(hits)


@query("""SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first_key, arg_min(o_orderstatus, o_orderkey) AS first_status, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1""", scene=False)
def first_and_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    first = keep.first_of(o, ["o_custkey"], "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("first_key"), F.col("o_orderstatus").alias("first_status"))
    return first.join(keep.first_of(o, ["o_custkey"], "o_orderkey", last=True).select("o_custkey", F.col("o_orderstatus").alias("last_status")), "o_custkey")


@query("SELECT fid, count(*) AS area_ha, 'all' AS reason FROM dets GROUP BY fid ORDER BY area_ha DESC, fid LIMIT 15")
def top_with_reason(spark, sf_dir):
    each = features(cells(spark, sf_dir), "det", 5).groupBy("fid").agg(F.count("*").alias("area_ha"))
    return keep.top_with_reason([("huge", each.where("area_ha > 1000")), ("all", each)], 15)


@query("SELECT r, c, 1 AS mask FROM cells WHERE cls IN (1, 3, 4)")
def burnable_cells(spark, sf_dir):
    return gates.burnable_mask(cells(spark, sf_dir), [1, 3, 4, 33])


@query("SELECT r, c, CAST(floor(value) AS SMALLINT) AS whole, CAST(unit // 10000 AS INTEGER) AS cls, CAST(unit % 10000 AS INTEGER) AS eco, CASE WHEN value > 600 THEN 1 ELSE 0 END AS high FROM cells")
def whole_values(spark, sf_dir):
    cls, eco = gates.unit_parts(F.col("unit"))
    return cells(spark, sf_dir).select("r", "c", gates.floored(F.col("value")).alias("whole"), cls.alias("cls"), eco.alias("eco"), gates.choose(F.col("value") > 600, F.lit(1), F.lit(0)).alias("high"))


@query("SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells WHERE ref = 1 AND cls = 2")
def extent_of_reference(spark, sf_dir):
    x = cells(spark, sf_dir)
    return gates.extent(gates.masked(x, gates.of_classes(x, [2])).where("ref = 1"))


@query("SELECT o_orderkey, o_totalprice AS area_ha FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND year(o_orderdate) = 1996 AND o_totalprice >= 100000", scene=False)
def composed_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("area_ha"), "o_orderpriority", F.year("o_orderdate").alias("YEAR"))
    chain = gates.composed(lambda d: gates.in_first_present(d, ["priority", "O_ORDERPRIORITY"], ["1-URGENT", "2-HIGH"]), None, lambda d: gates.of_year(d, 1996), lambda d: gates.at_least(d, 100000))
    return gates.kept_columns(chain(o), ["o_orderkey", "AREA_HA"])


@query("""x AS (SELECT d.fid, CAST(cls * 30 + eco * 3 AS INTEGER) AS day FROM dets d JOIN cells USING (r, c)), m AS (SELECT fid, quantile_cont(day, 0.5) AS median_day, count(*) AS n FROM x GROUP BY fid),
k AS (SELECT fid, day AS mode_day FROM (SELECT fid, day, count(*) AS n FROM x GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY fid ORDER BY n DESC, day) = 1)
SELECT fid, round(median_day, 6) AS median_day, mode_day, round(count(*) FILTER (abs(day - median_day) <= 10) / count(*), 6) AS within_10, round(count(*) FILTER (abs(day - median_day) <= 40) / count(*), 6) AS within_40
FROM x JOIN m USING (fid) JOIN k USING (fid) GROUP BY fid, median_day, mode_day""")
def day_flags(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(gates.day_flags(features(x, "det", 5), x.select("r", "c", (F.col("cls") * 30 + F.col("eco") * 3).alias("day")), [10, 40]))


@query("""x AS (SELECT fid, count(*) AS n, count(*) FILTER (value >= 700) AS k1, count(*) FILTER (cls <= 2) AS k2 FROM dets JOIN cells USING (r, c) GROUP BY fid)
SELECT fid, round(k1 / n, 6) AS ratio_P1, k1 / n >= 0.01 AS regen_P1, round(k2 / n, 6) AS ratio_P2, k2 / n >= 0.5 AS regen_P2, k1 / n >= 0.01 AND k2 / n >= 0.5 AS regen_all FROM x""")
def regenerated(spark, sf_dir):
    x = cells(spark, sf_dir)
    return rounded(gates.regenerated(features(x, "det", 5), {"P1": x.where("value >= 700"), "P2": x.where("cls <= 2")}, {"P1": 0.01, "P2": 0.5}))


@query("""WITH x AS (SELECT user_id % 3 AS panel, event_type AS g, value AS v FROM events WHERE value IS NOT NULL),
k AS (SELECT panel, g, rank() OVER (PARTITION BY panel ORDER BY v) + (count(*) OVER (PARTITION BY panel, v) - 1) / 2.0 AS k FROM x),
s AS (SELECT panel, g, sum(k) AS s, count(*) AS n FROM k GROUP BY 1, 2), t AS (SELECT panel, sum(t * t * t - t) AS ties FROM (SELECT panel, count(*)::DOUBLE AS t FROM x GROUP BY panel, v) GROUP BY panel),
n AS (SELECT panel, sum(n)::DOUBLE AS n, sum(s * s / n) AS q, count(*) - 1 AS df FROM s GROUP BY panel)
SELECT panel, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, df FROM n JOIN t USING (panel)""", scene=False)
def kruskal_panels(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("panel", F.col("user_id") % 3)
    return rounded(ranks.kruskal_by(e, "panel", "event_type", "value").drop("p"), 4)


@query("SELECT DISTINCT year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) IN (SELECT year(l_shipdate) FROM lineitem)", scene=False)
def common_years(spark, sf_dir):
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return validation.common_years(o.select(F.year("o_orderdate").alias("year")), i.select(F.year("l_shipdate").alias("year")))
