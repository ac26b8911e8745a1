"""Detections, threat, growth, harvest and constraint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import bindings as B
from harness.q_catalog import day
from harness.q_pixels import rr
from harness.registry import query
from harness.sqltext import r
from marshgrid import contract as C
from marshgrid.functions import decision as D
from marshgrid.functions import geo as G
from marshgrid.functions import keys as K
from marshgrid.functions import pixels as P
from marshgrid.operators import decisions as Dec
from marshgrid.sources import detections as Det
from marshgrid.sources import geojson as GJ

DT = f"dt AS ({B.DETECTIONS})"
TH = f"th AS ({B.THREAT_IN})"
OB = f"ob AS ({B.OBSERVATIONS})"
_W = "CASE WHEN canal_width_m <= 8 THEN 1.0 WHEN canal_width_m >= 120 THEN 0.0 ELSE 1 - sqrt((canal_width_m - 8) / 112.0) END"
_SCORE = f"""100 * (0.55::DOUBLE * greatest(0.0, least(1.0, coverage)) + 0.25::DOUBLE * ({_W})
  + 0.20::DOUBLE * greatest(0.0, least(1.0, upstream_priority)))"""


# --- detections ---------------------------------------------------------------------

@query("b12_detections_query", f"""WITH {DT} SELECT detection_id, strftime(scene_date, '%Y-%m-%d') AS scene_date, {r('area_m2')} AS area_m2
  FROM dt WHERE area_key = 'R' AND scene_date = DATE '1995-06-15'""")
def b12(spark, sf):
    out = Dec.detections_query(B.detections(spark, sf), "R", "1995-06-15")
    return out.select("detection_id", day("scene_date"), rr("area_m2"))


@query("h9_class_name", f"""WITH {DT} SELECT detection_id, class_code * 2 AS code, CASE class_code WHEN 0 THEN 'open_water'
  WHEN 1 THEN 'mixed_halophytes' ELSE concat('class_', class_code * 2) END AS class_name FROM dt""")
def h9(spark, sf):
    code = F.col("class_code") * 2
    return B.detections(spark, sf).select("detection_id", code.alias("code"), P.class_name(code).alias("class_name"))


@query("d21_coverage_trend", f"""WITH {DT} SELECT area_key, strftime(scene_date, '%Y-%m-%d') AS scene_date, count(*) AS patch_count,
  {r('sum(area_m2)', 3)} AS total_area_m2, {r('sum(area_m2) / 10000')} AS total_area_ha, {r('avg(confidence)')} AS mean_confidence
  FROM dt WHERE class_code = 3 GROUP BY area_key, scene_date""")
def d21(spark, sf):
    out = Dec.coverage_view(B.detections(spark, sf))
    return out.select("area_key", day("scene_date"), "patch_count", rr("total_area_m2", 3), rr("total_area_ha"),
                      rr("mean_confidence"))


@query("d21_coverage_summary", f"""WITH {DT} SELECT strftime(scene_date, '%Y-%m-%d') AS scene_date, count(*) AS patch_count,
  {r('sum(area_m2)', 3)} AS total_area_m2 FROM dt WHERE class_code = 3 AND area_key = 'N' GROUP BY scene_date""")
def d21_one(spark, sf):
    return Dec.coverage_summary(B.detections(spark, sf), "N").select(day("scene_date"), "patch_count", rr("total_area_m2", 3))


def detection_rings(spark, sf):
    """Detections with a small lon/lat triangle each, inside the study areas' UTM zone."""
    d = B.detections(spark, sf)
    k = F.col("detection_id")
    x, y = 30.5 + (k % 997) / 2000.0, 31.0 + (k % 491) / 1000.0
    side = 0.001 + (k % 7) / 1000.0
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(pt(x, y), pt(x + side, y), pt(x, y + side), pt(x, y))
    return d.withColumn("rings", F.array(ring)).withColumn("area_key", F.when(k % 10 == 0, "unknown").otherwise(
        F.element_at(F.array(*[F.lit(a[0]) for a in C.STUDY_AREAS]), (k % 3 + 1).cast("int")))) \
        .withColumn("area_m2", F.when(k % 4 == 0, F.col("area_m2")))


@query("c10_detection_area")
def c10(spark, sf):
    out = Dec.detection_area(detection_rings(spark, sf), C.area_dim(spark))
    return out.select("detection_id", "area_key", rr("area_m2", 3))


@query("h15_polygon_area_m2")
def h15(spark, sf):
    d = detection_rings(spark, sf)
    return d.select("detection_id", rr(G.polygon_area_m2(F.col("rings"), F.lit(32636)), 3, "area_m2"))


@query("h15_ring_area", f"""WITH {DT} SELECT detection_id, {r("abs((detection_id % 13 + 1) * (detection_id % 17 + 1)) / 2.0")} AS area FROM dt""")
def h15_planar(spark, sf):
    k = F.col("detection_id")
    w, h = (k % 13 + 1).cast("double"), (k % 17 + 1).cast("double")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    z = F.lit(0.0)
    ring = F.array(pt(z, z), pt(w, z), pt(z, h))
    return B.detections(spark, sf).select("detection_id", rr(G.ring_area(ring), alias="area"))


@query("a11_detection_geojson")
def a11_detections(spark, sf):
    return detection_rings(spark, sf).select("detection_id", GJ.detection_feature(F.col("rings")).alias("geojson"))


@query("a10_upsert_latest", f"""WITH {DT} SELECT detection_id, {r('area_m2 + CASE WHEN detection_id % 3 = 0 THEN 2 WHEN detection_id % 2 = 0 THEN 1 ELSE 0 END')} AS score
  FROM dt""")
def a10(spark, sf):
    d = B.detections(spark, sf).select("detection_id", "area_m2")
    def version(v, step):
        hit = d if step == 1 else d.where(F.col("detection_id") % step == 0)
        return hit.select("detection_id", (F.col("area_m2") + v).alias("score"), F.lit(v).alias("version"))
    log = version(0, 1).union(version(1, 2)).union(version(2, 3))
    return Det.latest_by_key(log, ["detection_id"]).select("detection_id", rr("score"))


@query("a10_upsert_merge", f"""WITH {DT} SELECT detection_id, {r('CASE WHEN detection_id % 3 = 0 THEN -area_m2 ELSE area_m2 END')} AS score FROM dt""")
def a10_merge(spark, sf):
    d = B.detections(spark, sf).select("detection_id", F.col("area_m2").alias("score"))
    ups = d.where(F.col("detection_id") % 3 == 0).select("detection_id", (-F.col("score")).alias("score"))
    return Det.upsert(d, ups, ["detection_id"]).select("detection_id", rr("score"))


# --- threat -------------------------------------------------------------------------

@query("h17_width_urgency", f"WITH {TH} SELECT id, {r(_W)} AS urgency FROM th")
def h17(spark, sf):
    return B.threat_in(spark, sf).select("id", rr(D.width_urgency(F.col("canal_width_m")), alias="urgency"))


@query("h18_threat_score", f"""WITH {TH}, s AS (SELECT *, {_SCORE} AS core FROM th)
  SELECT id, {r('core')} AS score, {r('greatest(0.0, least(100.0, core + 5 * (upstream_priority - 0.5) + 5 * (greatest(0.0, least(1.0, coverage)) - 0.5)))')} AS adjusted,
   CAST((CASE WHEN coverage > 1 THEN 1 ELSE 0 END) + (CASE WHEN ({_W}) < 0.15 THEN 1 ELSE 0 END) AS INT) AS notes FROM s""")
def h18(spark, sf):
    t = Dec.score_threats(B.threat_in(spark, sf))
    cov, prio = F.col("coverage"), F.col("upstream_priority")
    adjusted = D.threat_score(cov, F.col("canal_width_m"), prio, prio, cov)
    return t.select("id", rr("score"), rr(adjusted, alias="adjusted"), F.size("notes").alias("notes"))


@query("h19_threat_band", f"""WITH {TH}, s AS (SELECT id, {_SCORE} AS v FROM th)
  SELECT id, CASE WHEN v >= 75 THEN 'critical' WHEN v >= 50 THEN 'high' WHEN v >= 25 THEN 'moderate' ELSE 'low' END AS band FROM s""")
def h19(spark, sf):
    return Dec.score_threats(B.threat_in(spark, sf)).select("id", "band")


@query("e3_rank_by_threat", f"""WITH {TH}, s AS (SELECT id, coverage, {r(_SCORE, 9)} AS v FROM th)
  SELECT id, row_number() OVER (ORDER BY v DESC, coverage DESC, id) AS rank FROM s""")
def e3(spark, sf):
    t = Dec.score_threats(B.threat_in(spark, sf))
    return Dec.rank_by_threat(t.withColumn("score", rr("score", 9))).select("id", "rank")


@query("e3_rank_by_threat_per_area", f"""WITH {TH}, s AS (SELECT id, id % 3 AS area, coverage, {r(_SCORE, 9)} AS v FROM th)
  SELECT area, id, row_number() OVER (PARTITION BY area ORDER BY v DESC, coverage DESC, id) AS rank FROM s""")
def e3_area(spark, sf):
    t = Dec.score_threats(B.threat_in(spark, sf)).withColumn("area", F.col("id") % 3)
    return Dec.rank_by_threat(t.withColumn("score", rr("score", 9)), ["area"]).select("area", "id", "rank")


# --- growth -------------------------------------------------------------------------

RATE = f"""WITH {OB}, e AS (SELECT area, count(*) AS n, date_diff('day', min(observed_on), max(observed_on)) AS span,
   arg_min(value, observed_on) AS a, arg_max(value, observed_on) AS z FROM ob GROUP BY area),
 rt AS (SELECT *, CASE WHEN a > 0 AND z > 0 THEN ln(z / a) / span ELSE (z - a) / span END AS rate, a > 0 AND z > 0 AS pos FROM e)"""


@query("e5_expansion_rate", RATE + f""" SELECT area, n, CAST(span AS INT) AS span_days, {r('a')} AS first_value, {r('z')} AS last_value,
  {r('rate')} AS daily_rate, {r("CASE WHEN pos AND rate > 0 THEN ln(2) / rate ELSE 'inf'::DOUBLE END", 3)} AS doubling_time_days,
  {r("CASE WHEN a <> 0 THEN z / a ELSE 'inf'::DOUBLE END", 4)} AS relative_gain FROM rt""")
def e5(spark, sf):
    out = Dec.expansion_rate(B.observations(spark, sf), ["area"])
    return out.select("area", "n", "span_days", rr("first_value"), rr("last_value"), rr("daily_rate"),
                      _r_inf("doubling_time_days", 3), _r_inf("relative_gain", 4))


def _r_inf(name, digits):
    c = F.col(name)
    return F.when(c == D.INF, c).otherwise(F.round(c, digits) + F.lit(0.0)).alias(name)


@query("h20_time_to_blockage", RATE + f""", v AS (SELECT area, a / 100.0::DOUBLE AS cov, rate FROM rt)
  SELECT area, CASE WHEN cov > 0 AND cov <= 1 AND cov >= 0.75 THEN 0.0 WHEN cov > 0 AND cov <= 1 AND rate > 0 THEN {r('ln(0.75 / cov) / rate', 1)} END AS days,
   coalesce(cov > 0 AND cov <= 1 AND cov >= 0.75, false) AS already_blocked,
   CASE WHEN cov IS NULL OR NOT (cov > 0 AND cov <= 1) THEN 'coverage outside (0, 1]' WHEN cov < 0.75 AND rate <= 0 THEN 'coverage is not growing' END AS reason FROM v""")
def h20(spark, sf):
    e = Dec.expansion_rate(B.observations(spark, sf), ["area"])
    out = e.withColumn("b", D.time_to_blockage(F.col("first_value") / 100.0, F.col("daily_rate")))
    return out.select("area", rr("b.days", 1, "days"), "b.already_blocked", "b.reason")


@query("h21_project_coverage", RATE + f" SELECT area, {r('least(1.0, a / 100.0::DOUBLE * exp(rate * 10))')} AS projected FROM rt")
def h21(spark, sf):
    e = Dec.expansion_rate(B.observations(spark, sf), ["area"])
    return e.select("area", rr(D.project_coverage(F.col("first_value") / 100.0, F.col("daily_rate"), F.lit(10)), alias="projected"))


@query("h22_logistic_curve", f"""WITH {OB}, v AS (SELECT area, observed_on, kind, value, day(observed_on) AS t FROM ob)
  SELECT area, strftime(observed_on, '%Y-%m-%d') AS observed_on, {r('value / (1 + exp(-0.05::DOUBLE * (t - 15)))')} AS predicted,
  {r('t + ln(0.95::DOUBLE / 0.05::DOUBLE) / 0.05::DOUBLE', 4)} AS peak_day, {r('ln(2) / (t / 100.0)')} AS doubling, CAST(t AS DOUBLE) AS inflection FROM v""")
def h22(spark, sf):
    t = F.dayofmonth("observed_on")
    return B.observations(spark, sf).select(
        "area", day("observed_on"), rr(D.logistic_predict(t, F.col("value"), F.lit(0.05), F.lit(15.0)), alias="predicted"),
        rr(D.day_at_fraction(F.lit(0.95), F.lit(0.05), t), 4, "peak_day"), rr(D.doubling_time(t / 100.0), alias="doubling"),
        D.max_growth_day(t.cast("double")).alias("inflection"))


_KN = ", ".join(f"({x}, {y})" for x, y in D._knots())


@query("h23_nutrient_content", f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
  k AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM (VALUES {_KN}) t(x, y))
  SELECT strftime(d, '%Y-%m-%d') AS day, {r('y + (y1 - y) * (dayofyear(d) % 365 - x) / (x1 - x)', 5)} AS fraction
  FROM d JOIN k ON dayofyear(d) % 365 > x AND dayofyear(d) % 365 <= x1""")
def h23(spark, sf):
    d = B.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select(day("d", "day"), rr(D.nutrient_content(F.col("d")), 5, "fraction"))


@query("h24_senescence_curve", f"""WITH {OB}, s AS (SELECT area, min(observed_on) AS d0 FROM ob GROUP BY area),
  d AS (SELECT area, d0 + CAST(i AS INT) AS d FROM s, (SELECT unnest(range(0, 400)) AS i)),
  k AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM (VALUES {_KN}) t(x, y))
  SELECT area, strftime(d, '%Y-%m-%d') AS date, {r('y + (y1 - y) * (dayofyear(d) % 365 - x) / (x1 - x)', 4)} AS nutrient_fraction
  FROM d JOIN k ON dayofyear(d) % 365 > x AND dayofyear(d) % 365 <= x1""")
def h24(spark, sf):
    starts = B.observations(spark, sf).groupBy("area").agg(F.min("observed_on").alias("start"))
    return Dec.senescence_curve(starts).select("area", day("date"), rr("nutrient_fraction", 4))


@query("j1_fit_growth_curves")
def j1(spark, sf):
    return Dec.fit_growth_curves(B.observations(spark, sf), ["area"]).withColumn("origin", day("origin"))


@query("j1_daily_sums", f"""SELECT user_id AS area, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS observed_on, count(*) AS n, {r('sum(value)', 4)} AS s,
  {r('sum(value * value)', 4)} AS ss, {r('min(value)')} AS vmin, {r('max(value)')} AS vmax, min(event_type) AS kmin, max(event_type) AS kmax
  FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def j1_sums(spark, sf):
    ev = B.table(spark, sf, "events").select(F.col("user_id").alias("area"), F.to_date("ts").alias("observed_on"), "value",
                                             F.col("event_type").alias("kind"))
    return Dec.daily_sums(ev, ["area"]).select("area", day("observed_on"), "n", rr("s", 4), rr("ss", 4), rr("vmin"), rr("vmax"),
                                               "kmin", "kmax")


@query("j2_harvest_windows")
def j2(spark, sf):
    out = Dec.harvest_windows(B.observations(spark, sf), ["area"])
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("window_start", "window_end", "peak_date")}) \
              .withColumn("warnings", F.array_join("warnings", "; "))


# --- constraints --------------------------------------------------------------------

@query("b16_check_constraints", f"""WITH {DT}, d2 AS (SELECT detection_id, area_key, CASE WHEN detection_id % 101 = 0 THEN 4 ELSE class_code END AS class_code,
   confidence * CASE WHEN detection_id % 97 = 0 THEN 5 ELSE 1 END AS confidence, strftime(scene_date, '%Y-%m-%d') AS scene_date FROM dt),
 areas AS (SELECT * FROM (VALUES ('A', 'wetland'), ('N', 'canal'), ('X', 'river')) t(key, role))
 SELECT 'areas.role' AS "constraint", key FROM areas WHERE role NOT IN ('wetland', 'canal')
 UNION ALL SELECT 'detections.class_code', CAST(detection_id AS VARCHAR) FROM d2 WHERE class_code NOT BETWEEN 0 AND 3
 UNION ALL SELECT 'detections.confidence', CAST(detection_id AS VARCHAR) FROM d2 WHERE confidence NOT BETWEEN 0 AND 1
 UNION ALL SELECT 'detections.area_key', area_key FROM d2 WHERE area_key NOT IN (SELECT key FROM areas)
 UNION ALL SELECT 'biomass.unique', concat_ws('|', area_key, scene_date, CAST(class_code AS VARCHAR)) FROM d2 GROUP BY area_key, scene_date, class_code HAVING count(*) > 1
 UNION ALL SELECT 'biomass.area_key', area_key FROM d2 WHERE area_key NOT IN (SELECT key FROM areas)""")
def b16(spark, sf):
    k = F.col("detection_id")
    d = B.detections(spark, sf)
    d = d.withColumn("class_code", F.when(k % 101 == 0, 4).otherwise(F.col("class_code"))) \
         .withColumn("confidence", F.col("confidence") * F.when(k % 97 == 0, 5).otherwise(1))
    areas = spark.createDataFrame([("A", "wetland"), ("N", "canal"), ("X", "river")], "key string, role string")
    biomass = d.select("area_key", day("scene_date", "observed_on"), F.col("class_code").cast("string").alias("proxy_kind"))
    return Dec.check_constraints(areas=areas, detections=d, biomass=biomass)


@query("h16_keys", f"""WITH {DT} SELECT detection_id, concat(strftime(scene_date, '%Y-%m-%d'), '/c0/r', class_code * 128, '_c', detection_id % 7 * 128) AS store_key,
  concat('tile/', strftime(scene_date, '%Y-%m-%d'), '/EPSG:32636/20x20/s256/r', class_code * 128, '_c', detection_id % 7 * 128, '/B04+B03+B02') AS tile_key,
  concat(strftime(scene_date, '%Y-%m-%d'), '__c0__r', class_code * 128, '_c', detection_id % 7 * 128) AS safe,
  concat('mosaic/', strftime(scene_date, '%Y-%m-%d'), '/EPSG:32636/12.5x12.5/', class_code + 100, 'x', detection_id % 7 + 200, '/B08+B04') AS mosaic_key FROM dt""")
def h16(spark, sf):
    d = B.detections(spark, sf)
    row, col = F.col("class_code") * 128, F.col("detection_id") % 7 * 128
    key = K.store_key(F.date_format("scene_date", "yyyy-MM-dd"), row, col)
    return d.select("detection_id", key.alias("store_key"),
                    K.tile_key(F.col("scene_date"), F.lit("EPSG:32636"), F.lit(20.0), F.lit(256), row, col, C.BANDS_RGB).alias("tile_key"),
                    K.safe_name(key).alias("safe"),
                    K.mosaic_key(F.col("scene_date"), F.lit("EPSG:32636"), F.lit(12.5), F.col("class_code") + 100,
                                 F.col("detection_id") % 7 + 200, ["B08", "B04"]).alias("mosaic_key"))
