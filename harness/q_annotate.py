"""Confusion, annotation, rendering, resampling and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import bindings as B
from harness import sqltext as S
from harness.q_pixels import BANDS, PIX, SIZE, STRIDE, rr, tallies
from harness.q_split import footprints
from harness.registry import query
from harness.sqltext import r
from marshgrid import contract as C
from marshgrid.functions import geo as G
from marshgrid.operators import annotate as A
from marshgrid.operators import classify as K
from marshgrid.operators import metrics as M
from marshgrid.operators import raster as R
from marshgrid.operators import render as V
from marshgrid.operators import resample as Z
from marshgrid.operators import split as Sp
from marshgrid.operators import tiles as T
from marshgrid.operators.labels import weak_label
from marshgrid.session import materialise

N = len(C.CLASS_NAMES)

# A scene's mask is the target; the next scene's label at the same pixel is the prediction.
PT = S.LABELS + """, pt2 AS (SELECT a.r, a.c, a.scene, CASE WHEN a.trainable THEN a.label ELSE -1 END AS target,
   coalesce(b.label, -1) AS prediction, CAST(floor(a.r / 32.0) * 32 AS INT) AS tr, CAST(floor(a.c / 32.0) * 32 AS INT) AS tc
  FROM lab a LEFT JOIN lab b ON b.r = a.r AND b.c = a.c AND b.scene = a.scene + 1)"""
CONF = PT + """, cf AS (SELECT target, prediction, count(*) AS n FROM pt2 WHERE target BETWEEN 0 AND 3 AND prediction BETWEEN 0 AND 3
  GROUP BY target, prediction)"""
SCORES = CONF + ", ks AS (" + " UNION ALL ".join(
    f"SELECT {c} AS class_code, '{C.CLASS_NAMES[c]}' AS class_name, coalesce(sum(n) FILTER (WHERE target = {c} AND prediction = {c}), 0) AS d, "
    f"coalesce(sum(n) FILTER (WHERE target = {c}), 0) AS t, coalesce(sum(n) FILTER (WHERE prediction = {c}), 0) AS p FROM cf"
    for c in range(N)) + "), sc2 AS (SELECT *, CASE WHEN t + p > 0 THEN d / (t + p - d) END AS iou, CASE WHEN t + p > 0 THEN 2 * d / (t + p) END AS f1 FROM ks)"


def pred_target(spark, sf):
    lab = T.with_mask(B.labelled(spark, sf)).select("row", "col", "scene", "mask", "label")
    nxt = lab.select("row", "col", (F.col("scene") - 1).alias("scene"), F.col("label").alias("prediction"))
    out = lab.join(nxt, ["row", "col", "scene"], "left")
    return out.select("row", "col", "scene", F.col("mask").alias("target"),
                      F.coalesce("prediction", F.lit(C.IGNORE)).alias("prediction"),
                      (F.floor(F.col("row") / 32.0) * 32).cast("int").alias("tile_row"),
                      (F.floor(F.col("col") / 32.0) * 32).cast("int").alias("tile_col"))


def scores(spark, sf):
    return M.class_scores(M.confusion(pred_target(spark, sf)))


@query("d15_confusion_matrix", f"WITH {CONF} SELECT target, prediction, n FROM cf")
def d15(spark, sf):
    return M.confusion(pred_target(spark, sf))


@query("d15_merged_confusion", f"WITH {CONF} SELECT target, prediction, n FROM cf")
def d15_merge(spark, sf):
    pt = pred_target(spark, sf)
    return M.merge_confusions(*[M.confusion(pt.where(F.col("scene") % 2 == k)) for k in (0, 1)])


@query("d16_segmentation_metrics", f"""WITH {SCORES} SELECT class_code, class_name, CAST(t AS BIGINT) AS support_px, CAST(p AS BIGINT) AS predicted_px,
  {r('iou')} AS iou, {r('f1')} AS f1 FROM sc2""")
def d16(spark, sf):
    return scores(spark, sf).select("class_code", "class_name", "support_px", "predicted_px", rr("iou"), rr("f1"))


REPORT = SCORES + f""", rp AS (SELECT {r('avg(iou)', 4)} AS mean_iou, {r('sum(d) / sum(t)', 4)} AS pixel_accuracy,
  {r('max(iou) FILTER (WHERE class_code = 3)', 4)} AS reed_iou, {r('max(f1) FILTER (WHERE class_code = 3)', 4)} AS reed_f1,
  CAST(sum(t) AS BIGINT) AS support_px FROM sc2)"""


@query("d17_segmentation_report", f"WITH {REPORT} SELECT *, CAST(4 AS INT) AS classes FROM rp")
def d17(spark, sf):
    rep = M.segmentation_report(scores(spark, sf))
    return rep.select(*[rr(c, 4) for c in ("mean_iou", "pixel_accuracy", "reed_iou", "reed_f1")], "support_px",
                      F.size("per_class").alias("classes"))


@query("d18_target_verdict", f"""WITH {REPORT} SELECT reed_iou, reed_f1, coalesce(reed_iou >= 0.82, false) AS iou_met, coalesce(reed_f1 >= 0.85, false) AS f1_met,
  coalesce(reed_iou >= 0.82 AND reed_f1 >= 0.85, false) AS both_met, true AS assessable FROM rp""")
def d18(spark, sf):
    v = M.target_verdict(M.segmentation_report(scores(spark, sf)))
    return v.select(rr("reed_iou", 4), rr("reed_f1", 4), "iou_met", "f1_met", "both_met", "assessable")


@query("d19_tile_agreement", f"""WITH {PT} SELECT scene, tr AS tile_row, tc AS tile_col, count(*) AS labelled_px,
  {r('avg(CASE WHEN prediction = target THEN 1.0::DOUBLE ELSE 0 END)', 4)} AS agreement FROM pt2 WHERE target >= 0 GROUP BY scene, tr, tc""")
def d19(spark, sf):
    out = M.tile_agreement(pred_target(spark, sf), ["scene", "tile_row", "tile_col"])
    return out.withColumn("agreement", rr("agreement", 4))


OVER = PT + """, ov AS (SELECT scene, tr, tc, count(*) FILTER (WHERE target = 3 AND prediction = 3) AS i,
  count(*) FILTER (WHERE target >= 0 AND (target = 3 OR prediction = 3)) AS u, count(*) FILTER (WHERE target = 3) AS s FROM pt2 GROUP BY scene, tr, tc)"""


@query("d23_reed_overlap", f"""WITH {OVER} SELECT scene, tr AS tile_row, tc AS tile_col, i AS inter, u AS union_px, s AS support,
  {r('CASE WHEN u > 0 THEN i / u END')} AS iou FROM ov""")
def d23(spark, sf):
    return M.reed_overlap(pred_target(spark, sf), ["scene", "tile_row", "tile_col"]).withColumn("iou", rr("iou"))


@query("d23_pooled_reed_iou", f"""WITH {OVER} SELECT CAST(sum(i) AS BIGINT) AS inter, CAST(sum(u) AS BIGINT) AS union_px, CAST(sum(s) AS BIGINT) AS support,
  count(*) FILTER (WHERE u > 0) AS tiles_with_reed, {r('sum(i) / sum(u)')} AS pooled_iou FROM ov""")
def d23_pooled(spark, sf):
    out = M.pooled_reed_iou(M.reed_overlap(pred_target(spark, sf), ["scene", "tile_row", "tile_col"]))
    return out.withColumn("pooled_iou", rr("pooled_iou"))


@query("e6_representative_tile", f"""WITH {OVER}, fx AS (SELECT scene, tr, tc, avg(CASE WHEN target = 0 THEN 1.0 ELSE 0 END) AS f0,
   avg(CASE WHEN target = 3 THEN 1.0 ELSE 0 END) AS f3 FROM pt2 WHERE target >= 0 GROUP BY scene, tr, tc),
  cd AS (SELECT scene, tr, tc, round(i / u, 9) AS iou, row_number() OVER (ORDER BY round(i / u, 9), scene, tr, tc) AS k, count(*) OVER () AS n FROM ov JOIN fx USING (scene, tr, tc)
    WHERE u > 0 AND f0 >= 0.02 AND f3 BETWEEN 0.05 AND 0.60)
  SELECT scene, tr AS tile_row, tc AS tile_col, {r('iou')} AS iou FROM cd WHERE k = floor(n / 2.0) + 1""")
def e6(spark, sf):
    pt = pred_target(spark, sf)
    key = ["scene", "tile_row", "tile_col"]
    seen = pt.where(F.col("target") >= 0).groupBy(*key).agg(
        F.avg((F.col("target") == 0).cast("double")).alias("fraction_0"),
        F.avg((F.col("target") == 3).cast("double")).alias("fraction_3"))
    ov = M.reed_overlap(pt, key).withColumn("iou", F.round("iou", 9)).join(seen, key)
    return M.representative_tile(ov, key).select(*key, rr("iou"))


@query("g4_classes_with_support", f"WITH {SCORES} SELECT class_code, class_name, t > 0 AS present FROM sc2")
def g4(spark, sf):
    s = scores(spark, sf)
    return M.classes_with_support(s).withColumn("present", F.lit(True)).union(
        M.classes_with_support(s, False).withColumn("present", F.lit(False)))


# --- annotation ---------------------------------------------------------------------

def keyed_tallies(spark, sf):
    t = tallies(spark, sf)
    return t.withColumn("key", F.concat(F.col("scene").cast("string"), F.lit("/r"), F.col("top").cast("string"),
                                        F.lit("_c"), F.col("left").cast("string")))


_KEY = "concat(scene, '/r', top, '_c', lft)"


@query("e4_ranking_uncertainty", f"""WITH {S.TALLY} SELECT {_KEY} AS key, {r('review / usable')} AS score,
  row_number() OVER (ORDER BY review / usable DESC, scene, top, lft) AS rank FROM ta WHERE usable > 0 AND review > 0""")
def e4(spark, sf):
    out = A.annotation_ranking(keyed_tallies(spark, sf), ["scene", "top", "left"])
    return out.select("key", rr("score"), "rank")


@query("e4_ranking_reed", f"""WITH {S.TALLY} SELECT {_KEY} AS key, CAST(mask_3 AS DOUBLE) AS score,
  row_number() OVER (ORDER BY mask_3 DESC, scene, top, lft) AS rank FROM ta WHERE mask_3 > 0""")
def e4_reed(spark, sf):
    return A.annotation_ranking(keyed_tallies(spark, sf), ["scene", "top", "left"], "reed").select("key", "score", "rank")


@query("e4_ranking_random")
def e4_random(spark, sf):
    return A.annotation_ranking(keyed_tallies(spark, sf), ["scene", "top", "left"], "random", 7).select("key", "rank")


@query("f1_annotation_topk", f"""WITH {S.TALLY}, t AS (SELECT *, review / usable AS score FROM ta WHERE usable > 0 AND review > 0)
  SELECT {_KEY} AS key, CAST(row_number() OVER (ORDER BY score DESC, scene, top, lft) AS INT) AS rank, {r('score', 5)} AS score, mask_3 AS reed_px
  FROM t WHERE score >= 0.1 ORDER BY score DESC, scene, top, lft LIMIT 20""")
def f1(spark, sf):
    out = A.annotation_topk(keyed_tallies(spark, sf), ["scene", "top", "left"], 20, 0.1)
    return out.select("key", "rank", rr("score", 5), "reed_px")


# Human labels of every seventh pixel row: class of the pixel two scenes later, odd codes unusable.
HUMAN = PT + """, hl AS (SELECT r, c, scene, CASE WHEN (r + c) % 3 = 0 THEN 7 ELSE target END AS code FROM pt2 WHERE tr % 64 = 0)"""


def human_labels(spark, sf):
    pt = pred_target(spark, sf).where(F.col("tile_row") % 64 == 0)
    code = F.when((F.col("row") + F.col("col")) % 3 == 0, 7).otherwise(F.col("target"))
    return pt.select("scene", "tile_row", "tile_col", "row", "col", code.alias("class_code"))


@query("c8_join_predictions", f"""WITH {HUMAN} SELECT p.r AS "row", p.c AS col, p.scene, p.prediction, hl.code AS target FROM pt2 p
  JOIN hl ON hl.r = p.r AND hl.c = p.c AND hl.scene = p.scene WHERE hl.code BETWEEN 0 AND 3""")
def c8(spark, sf):
    pred = pred_target(spark, sf).drop("target")
    out = A.join_predictions(pred, human_labels(spark, sf), ["scene", "tile_row", "tile_col"])
    return out.select("row", "col", "scene", "prediction", "target")


@query("c8_still_unlabelled", f"""WITH {HUMAN} SELECT DISTINCT scene, tr AS tile_row, tc AS tile_col FROM pt2 p WHERE NOT EXISTS (
   SELECT 1 FROM pt2 q JOIN hl ON hl.r = q.r AND hl.c = q.c AND hl.scene = q.scene WHERE hl.code BETWEEN 0 AND 3
     AND q.scene = p.scene AND q.tr = p.tr AND q.tc = p.tc)""")
def c8_missing(spark, sf):
    key = ["scene", "tile_row", "tile_col"]
    return A.still_unlabelled(pred_target(spark, sf).select(*key).distinct(), human_labels(spark, sf), key)


@query("c9_check_independence", """WITH k AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM orders)
  SELECT p.pack, CASE WHEN count(*) FILTER (WHERE split = 'train') > 0 THEN 'trained_on' WHEN count(*) FILTER (WHERE split = 'val') > 0 THEN 'used_for_selection' ELSE 'verified' END AS status,
   count(*) AS annotated FROM k JOIN (SELECT unnest([6, 7, 8]) AS pack) p ON k.key % 10 >= p.pack GROUP BY p.pack""")
def c9(spark, sf):
    k = F.col("o_orderkey")
    o = B.table(spark, sf, "orders").select(k.alias("key"), F.when(k % 10 < 7, "train").when(k % 10 == 7, "val")
                                            .otherwise("test").alias("split"))
    out = None
    for pack in (6, 7, 8):
        one = A.check_independence(o.where(F.col("key") % 10 >= pack), o).select(
            F.lit(pack).alias("pack"), "status", "annotated")
        out = one if out is None else out.union(one)
    return out


@query("g5_key_intersection", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def g5(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    c = B.table(spark, sf, "customer").where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("key"))
    return A.key_intersection(o, c)


@query("d20_assess_score", f"""WITH {SCORES} SELECT count(*) FILTER (WHERE t > 0) >= 2 AND coalesce(sum(t) FILTER (WHERE class_code = 3), 0) >= 500
   AND (count(*) FILTER (WHERE p > 0) >= 2 OR count(*) FILTER (WHERE t > 0) < 2) AS assessable,
  CAST(count(*) FILTER (WHERE t > 0) AS INT) AS present, CAST(count(*) FILTER (WHERE t = 0) AS INT) AS absent,
  CAST(coalesce(sum(t) FILTER (WHERE class_code = 3), 0) AS BIGINT) AS reed_support_px, CAST(count(*) FILTER (WHERE p > 0) AS INT) AS predicted FROM sc2""")
def d20(spark, sf):
    from pyspark.sql import types as Ty
    seen = spark.createDataFrame([("verified", "unseen ground")], Ty.StructType(
        [Ty.StructField("status", Ty.StringType()), Ty.StructField("detail", Ty.StringType())]))
    out = M.assess(scores(spark, sf), seen)
    return out.select("assessable", F.size("classes_present").alias("present"), F.size("classes_absent").alias("absent"),
                      "reed_support_px", F.size("predicted_classes").alias("predicted"))


# --- polygons -----------------------------------------------------------------------

def label_documents(spark, sf):
    """One GeoJSON document per order: two overlapping boxes in chip pixels."""
    k = F.col("o_orderkey")
    x, y = (k % 10).cast("double"), (k % 7).cast("double")
    def box(x0, y0, x1, y1):
        ring = F.array(*[F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
        return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    def feature(geom, props):
        return F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geom.alias("geometry"))
    by_code = F.struct((k % 3).alias("class_code"), F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("string").alias("class"))
    by_name = F.struct(F.lit(None).cast("long").alias("class_code"),
                       F.when(k % 2 == 0, "phragmites_australis").alias("class_name"),
                       F.when(k % 2 == 1, "crops_soil").alias("class"))
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(
        feature(box(x, y, x + 8, y + 6), by_code), feature(box(x + 4, y + 3, x + 10, y + 9), by_name)).alias("features")))
    return B.spread(spark, B.table(spark, sf, "orders"), "o_orderkey").select(k.alias("key"), doc.alias("document"))


@query("a8_parse_annotations", """SELECT o_orderkey AS key, f AS feature_pos, CASE WHEN f = 0 THEN CAST(o_orderkey % 3 AS INT)
   WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS class_code, 5 AS vertices FROM orders, (SELECT unnest([0, 1]) AS f)""")
def a8(spark, sf):
    out = A.parse_annotations(label_documents(spark, sf))
    return out.select("key", "feature_pos", "class_code", F.size(F.get("rings", F.lit(0))).alias("vertices"))


def drawn(spark, sf):
    return A.parse_annotations(label_documents(spark, sf)).withColumns({"height": F.lit(16), "width": F.lit(16)})


def burnt(spark, sf):
    return A.rasterize_polygons(drawn(spark, sf))


@query("c7_rasterize_polygons", """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 10 AS x, o_orderkey % 7 AS y, o_orderkey % 3 AS c0,
    CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS c1 FROM orders),
  g AS (SELECT i AS r, j AS c FROM (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 16)) AS j)),
  h AS (SELECT key, r, c, c + 0.5 > x + 4 AND c + 0.5 < x + 10 AND r + 0.5 > y + 3 AND r + 0.5 < y + 9 AS second,
     c + 0.5 > x AND c + 0.5 < x + 8 AND r + 0.5 > y AND r + 0.5 < y + 6 AS first, c0, c1 FROM o, g)
  SELECT key, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(CASE WHEN second THEN c1 ELSE c0 END AS INT) AS class_code FROM h WHERE first OR second""")
def c7(spark, sf):
    return burnt(spark, sf)


@query("a8_read_annotations", """WITH o AS (SELECT o_orderkey AS key FROM orders)
  SELECT CASE WHEN key % 4 = 0 THEN 'raster' ELSE 'polygon' END AS source, count(*) AS tiles FROM o GROUP BY 1""")
def a8_read(spark, sf):
    keys = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    chips = keys.withColumns({"height": F.lit(16), "width": F.lit(16)})
    raster = keys.where(F.col("key") % 4 == 0).withColumns({"row": F.lit(0), "col": F.lit(0), "class_code": F.lit(200)})
    out = A.read_annotations(raster, None, chips, polygons=drawn(spark, sf))
    per = out.groupBy("key").agg((F.max("class_code") == 200).alias("raster"))
    return per.groupBy(F.when(F.col("raster"), "raster").otherwise("polygon").alias("source")).agg(F.count(F.lit(1)).alias("tiles"))


# --- rendering ----------------------------------------------------------------------

_LO, _HI = C.INDEX_RANGES["ndvi"]
_AN = C.COLOUR_ANCHORS["ndvi"]


def _ramp_sql(i: int) -> str:
    parts = []
    for (x0, c0), (x1, c1) in zip(_AN, _AN[1:]):
        parts.append(f"WHEN x <= {x1}::DOUBLE THEN {c0[i]} + ({c1[i] - c0[i]}) / ({x1}::DOUBLE - {x0}::DOUBLE) * (x - {x0}::DOUBLE)")
    return f"CAST(floor(CASE {' '.join(parts)} END) AS INT)"


@query("b19_colormap_pixels", f"""WITH {S.INDICES}, lut AS (SELECT slot, {', '.join(f'{_ramp_sql(i)} AS {n}' for i, n in enumerate(V.CHANNELS))}
   FROM (SELECT CAST(i AS INT) AS slot, i / 511.0::DOUBLE AS x FROM (SELECT unnest(range(0, 512)) AS i)))
  SELECT {PIX}, red, green, blue, CASE WHEN ndvi IS NULL THEN 0 ELSE 255 END AS alpha FROM ix
  JOIN lut ON slot = coalesce(CAST(floor(({S.clip(f'(ndvi - {_LO}) / ({_HI - _LO})')}) * 511) AS INT), 0)""")
def b19(spark, sf):
    return V.colormap_pixels(B.px_indices(spark, sf), "ndvi").select("row", "col", "scene", *V.CHANNELS, "alpha")


@query("b20_truecolor_pixels", f"""WITH {S.REFL} SELECT {PIX}, """ + ", ".join(
    f"coalesce(CAST(floor(CASE WHEN {b} IS NOT NULL THEN least(1.0, least(1.0, {b} / 0.25) * 1.35) END * 255) AS INT), 0) AS {n}"
    for n, b in zip(V.CHANNELS, ("b04", "b03", "b04"))) + ", CASE WHEN valid THEN 255 ELSE 0 END AS alpha FROM rf")
def b20(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS).withColumn("b02", F.col("b04"))
    return V.truecolor_pixels(px).select("row", "col", "scene", *V.CHANNELS, "alpha")


@query("b21_class_rgba", f"""WITH {S.LABELS}, pal AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b}, {c})' for k, (a, b, c) in [*C.FIGURE_COLOURS.items(), (-1, C.IGNORED_COLOUR)])}) t(label, red, green, blue))
  SELECT {PIX}, red, green, blue, 255 AS alpha, CASE WHEN review THEN 170 ELSE 0 END AS mask_alpha FROM lab JOIN pal USING (label)""")
def b21(spark, sf):
    lab = weak_label(B.px_indices(spark, sf))
    mask = V.mask_pixels(lab.select("row", "col", "scene", "review"), "review").withColumnRenamed("alpha", "mask_alpha").drop(*V.CHANNELS, "review")
    out = V.class_rgba(lab.select("row", "col", "scene", "label"))
    return out.join(mask, ["row", "col", "scene"]).select("row", "col", "scene", *V.CHANNELS, "alpha", "mask_alpha")


# --- resampling ---------------------------------------------------------------------

def half_grid(spark, sf):
    from marshgrid.operators.scale import with_scalar
    px = R.reflectance(B.px_masked(spark, sf), BANDS).select("row", "col", "scene", "scl", "b08")
    return with_scalar(px, B.frame(spark, sf), ["height", "width"])


@query("c12_resample_nearest", f"""WITH {S.REFL} SELECT CAST(r * 2 + i AS INT) AS "row", CAST(c * 2 + j AS INT) AS col, scene, scl FROM rf,
  (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""")
def c12_nearest(spark, sf):
    return Z.upsample(half_grid(spark, sf), ["scl"], 2, "nearest", ["scene"], categorical=True)


@query("c12_resample_bilinear", f"""WITH {S.REFL}, {S.FRAME}, k AS (SELECT * FROM (VALUES (-1, 0.25::DOUBLE), (0, 0.75::DOUBLE), (1, 0.75::DOUBLE), (2, 0.25::DOUBLE)) t(d, w)),
  s AS (SELECT r * 2 + a.d AS tr, c * 2 + b.d AS tc, scene, b08, a.w * b.w AS w FROM rf, k a, k b)
  SELECT CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, scene, {r('sum(w * b08) / sum(CASE WHEN b08 IS NOT NULL THEN w END)', 9)} AS b08
  FROM s, fr WHERE tr >= 0 AND tr < hh * 2 AND tc >= 0 AND tc < ww * 2 GROUP BY tr, tc, scene""")
def c12_bilinear(spark, sf):
    return Z.upsample(half_grid(spark, sf), ["b08"], 2, "bilinear", ["scene"]).withColumn("b08", rr("b08", 9))


@query("c12_resample_cubic", f"""WITH {S.REFL}, {S.FRAME}, k AS (SELECT d, CASE WHEN x <= 1 THEN (1.5 * x - 2.5) * x * x + 1 ELSE ((-0.5 * x + 2.5) * x - 4) * x + 2 END AS w
    FROM (SELECT d, CAST(abs((d - 0.5) / 2) AS DOUBLE) AS x FROM (SELECT unnest(range(-3, 5)) AS d))),
  s AS (SELECT r * 2 + a.d AS tr, c * 2 + b.d AS tc, scene, b08, a.w * b.w AS w FROM rf, k a, k b),
  g AS (SELECT tr, tc, scene, sum(w * b08) AS s, sum(CASE WHEN b08 IS NOT NULL THEN w END) AS n FROM s, fr
        WHERE tr >= 0 AND tr < hh * 2 AND tc >= 0 AND tc < ww * 2 GROUP BY tr, tc, scene)
  SELECT CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, scene, {r('CASE WHEN abs(n) > 1e-12 THEN s / n END + 1e-11', 9)} AS b08 FROM g""")
def c12_cubic(spark, sf):
    # Weights are fractions of two, so values often lie half way between two roundings and are moved off it.
    return Z.upsample(half_grid(spark, sf), ["b08"], 2, "cubic", ["scene"]).withColumn("b08", F.round(F.col("b08") + 1e-11, 9))


@query("c12_resample_average", f"""WITH {S.REFL} SELECT CAST(floor(r / 2.0) AS INT) AS "row", CAST(floor(c / 2.0) AS INT) AS col, scene, {r('avg(b08)')} AS b08
  FROM rf GROUP BY 1, 2, 3""")
def c12_average(spark, sf):
    return Z.downsample(half_grid(spark, sf), ["b08"], 2, "average", ["scene"]).withColumn("b08", rr("b08"))


@query("c12_resample_mode", f"""WITH {S.REFL}, t AS (SELECT CAST(floor(r / 2.0) AS INT) AS tr, CAST(floor(c / 2.0) AS INT) AS tc, scene, scl, count(*) AS n FROM rf GROUP BY 1, 2, 3, 4)
  SELECT tr AS "row", tc AS col, scene, scl FROM t QUALIFY row_number() OVER (PARTITION BY tr, tc, scene ORDER BY n DESC, scl) = 1""")
def c12_mode(spark, sf):
    return Z.downsample(half_grid(spark, sf), ["scl"], 2, "mode", ["scene"], categorical=True)


# --- padding, augmentation, chips ---------------------------------------------------

@query("b18_pad_and_crop", f"""WITH {S.REFL}, {S.FRAME} SELECT scene, CAST(count(*) FILTER (WHERE b08 IS NOT NULL) AS BIGINT) AS values, {r('sum(b08)', 4)} AS total,
  CAST(max(ceil(hh / 64.0) * ceil(ww / 64.0)) * 64 * 64 AS BIGINT) AS padded, CAST(max(hh * ww) AS BIGINT) AS cropped FROM rf, fr GROUP BY scene""")
def b18_pad(spark, sf):
    # Every scene's whole frame in tiles of 64; those at the bottom and the right are ragged.
    at = {"tr": F.expr("row div 64"), "tc": F.expr("col div 64"), "row": F.expr("row % 64"), "col": F.expr("col % 64")}
    px = R.reflectance(B.px_masked(spark, sf), BANDS).select("scene", "b08", *[c.cast("int").alias(n) for n, c in at.items()])
    steps = [F.explode(F.sequence(F.lit(0), F.expr(f"({n} - 1) div 64").cast("int"))) for n in ("height", "width")]
    tiles = B.scene_frames(spark, sf).withColumn("tr", steps[0]).withColumn("tc", steps[1])
    tiles = tiles.select("scene", "tr", "tc", F.expr("least(64, height - tr * 64)").alias("height"), F.expr("least(64, width - tc * 64)").alias("width"))
    padded = T.pad_to_tile(tiles, px, ["scene", "tr", "tc"], 64, ["b08"], 0.0)
    cropped = T.crop_from_padding(padded)
    a = padded.groupBy("scene").agg(F.count(F.lit(1)).alias("padded"))
    b = cropped.groupBy("scene").agg(F.count(F.lit(1)).alias("cropped"), F.count("b08").alias("values"), F.sum("b08").alias("total"))
    return a.join(b, "scene").withColumn("total", rr("total", 4))


@query("b15_augment_tiles")
def b15(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS).select("row", "col", "scene", *BANDS)
    frame = B.frame(spark, sf)
    from marshgrid.operators.scale import with_scalar
    tp = T.assign_tiles(with_scalar(px, frame, ["height", "width"]), SIZE, STRIDE)
    tp = tp.withColumn("key", F.concat_ws("/", "scene", "top", "left")) \
           .withColumns({"row": F.col("row") - F.col("top"), "col": F.col("col") - F.col("left")})
    out = T.augment_tiles(tp, SIZE, BANDS, "key", 7, 1)
    return out.select("key", "row", "col", *[rr(b) for b in BANDS])


@query("b10_assert_reflectance", f"""WITH {S.REFL} SELECT scene, CAST(floor(r / 32.0) AS INT) AS tr, CASE WHEN count(b08) = 0 THEN 'empty' ELSE 'not reflectance' END AS problem
  FROM rf GROUP BY scene, 2 HAVING count(b08) = 0 OR max(greatest(b08, b04)) * CASE WHEN scene % 2 = 0 THEN 10000 ELSE 1 END > 2""")
def b10(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS).withColumn("tr", F.floor(F.col("row") / 32.0).cast("int"))
    scale = F.when(F.col("scene") % 2 == 0, 10000.0).otherwise(1.0)
    px = px.withColumns({b: F.col(b) * scale for b in BANDS})
    return T.assert_reflectance(px, ["scene", "tr"], ["b08", "b04"]).select("scene", "tr", "problem")


@query("b17_check_store_grid", """WITH o AS (SELECT o_custkey AS store, 10 + CASE WHEN o_orderkey % 50 = 0 THEN 10 ELSE 0 END AS gsd FROM orders)
  SELECT store, count(DISTINCT gsd) AS grids FROM o GROUP BY store HAVING count(DISTINCT gsd) > 1 OR max(abs(gsd - 10)) > 1e-6""")
def b17(spark, sf):
    o = B.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("store"), F.lit("EPSG:32636").alias("crs"),
        F.when(F.col("o_orderkey") % 50 == 0, 20.0).otherwise(10.0).alias("gsd"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        F.lit(120).alias("width"), F.lit(120).alias("height"))
    return T.check_store_grid(o, ["store"], 10.0).select("store", "grids")


# --- classification -----------------------------------------------------------------

def training_data(spark, sf):
    px = B.labelled(spark, sf)
    fp = footprints(spark, sf)
    tiles = materialise(Sp.geographic_split(fp, [], 16, seed=1))
    return px, tiles, materialise(T.split_pixels(px, tiles, BANDS, ["scene"], SIZE, STRIDE))


def fit(data, bands):
    px, tiles, seen = data
    return K.train_pixel_classifier(px, tiles, seen, bands, ["scene"], SIZE, STRIDE, max_iter=30)


@query("k1_train_and_evaluate")
def k1(spark, sf):
    data = training_data(spark, sf)
    return K.evaluate(fit(data, BANDS), data[2], "test")


@query("k2_predict_pixels")
def k2(spark, sf):
    data = training_data(spark, sf)
    return K.predict_pixels(fit(data, BANDS), data[0], BANDS).select("row", "col", "scene", "label", "prediction")


@query("k3_compare_arms")
def k3(spark, sf):
    # Both arms learn from the same split and the same pixels.
    data = training_data(spark, sf)
    return K.compare_arms(*[M.segmentation_report(K.evaluate(fit(data, bands), data[2], "test"))
                            for bands in (BANDS, ["b04", "b03"])])


@query("k4_model_provenance", """WITH """ + S.PX + ", " + S.FRAME + """ SELECT count(*) AS tiles, count(DISTINCT key) AS keys FROM (
   SELECT concat(s.scene, '/r', ty.k * 16, '_c', tx.k * 16) AS key FROM (SELECT DISTINCT scene FROM px) s, fr,
    (SELECT unnest(range(0, 100000)) AS k) ty, (SELECT unnest(range(0, 8)) AS k) tx WHERE ty.k * 16 + 32 <= fr.hh AND tx.k * 16 + 32 <= fr.ww)""")
def k4(spark, sf):
    tiles = Sp.geographic_split(footprints(spark, sf), [], 16, seed=1)
    return K.provenance(tiles).agg(F.count(F.lit(1)).alias("tiles"), F.countDistinct("key").alias("keys"))


@query("k5_score_pack")
def k5(spark, sf):
    data = training_data(spark, sf)
    model, tiles = fit(data, BANDS), data[1]
    test = tiles.where(F.col("split") == "test")
    # Observations meet the chips as stored; only those inside are labelled and predicted.
    inside = T.tiles_over_pixels(B.px_obs(spark, sf), test.select("scene", "top", "left", "key"), ["scene"], SIZE, STRIDE)
    refl = R.reflectance(R.mask_observations(inside, BANDS), BANDS)
    inside = weak_label(R.with_indices(refl, BANDS)).select("row", "col", "tiles", "label", "trainable", *BANDS)
    # A pixel is predicted once and then goes to the chips over it, which predictions and labels both read.
    chips = T.with_mask(K.predict_pixels(model, inside, BANDS)).select(
        F.explode("tiles.key").alias("key"), "row", "col", "prediction", F.col("mask").alias("class_code"))
    chips = materialise(chips)
    labels = chips.select("key", "row", "col", "class_code")
    return K.score_pack(chips.select("key", "row", "col", "prediction"), labels, test, model.provenance)["per_tile"]


@query("d26_run_metrics")
def d26(spark, sf):
    data = training_data(spark, sf)
    model, tiles = fit(data, BANDS), data[1]
    report = M.segmentation_report(K.evaluate(model, data[2], "test"))
    out = K.run_metrics(model, tiles, report)
    return out.select("train_tiles", "val_tiles", "test_tiles", "boundary_tiles_omitted", "mean_iou", "both_met", "reason")


# Tile corners are checked against the projection golden in the tests.
@query("h14_tile_corners")
def corners(spark, sf):
    fp = footprints(spark, sf)
    grid = F.struct(F.lit(20.0).alias("gsd"), F.lit(260000.0).alias("x0"), F.lit(3500000.0).alias("y0"))
    return fp.select("key", F.to_json(G.tile_corners(grid, F.col("top"), F.col("left"), SIZE, F.lit(32636))).alias("corners"))


