"""Pixel, index, label, mosaic and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import bindings as B
from harness import sqltext as S
from harness.registry import query
from harness.sqltext import r
from marshgrid import contract as C
from marshgrid.functions import pixels as P
from marshgrid.operators import labels as L
from marshgrid.operators import raster as R
from marshgrid.operators import tiles as T

BANDS = B.BANDS5
INDEX = ["ndvi", "ndwi", "ndre", "ndmi"]
SIZE, STRIDE = 32, 16
PIX = 'r AS "row", c AS col, scene'


def rr(name, digits=6, alias=None):
    """Rounded output column with negative zero folded into zero."""
    c = F.col(name) if isinstance(name, str) else name
    return (F.round(c, digits) + F.lit(0.0)).alias(alias or name)


# --- masks and reflectance ------------------------------------------------------

@query("b6_mask_scl", f"WITH {S.MASKED} SELECT {PIX}, scl IN {S.INVALID} AS masked FROM m")
def mask_scl(spark, sf):
    return B.px_obs(spark, sf).select("row", "col", "scene", P.scl_invalid(F.col("scl")).alias("masked"))


@query("b7_mask_fill", f"WITH {S.MASKED} SELECT {PIX}, valid, "
       + ", ".join(f"CASE WHEN valid THEN d{b[1:]} END AS {b}" for b in BANDS) + " FROM m")
def mask_fill(spark, sf):
    return B.px_masked(spark, sf).select("row", "col", "scene", "valid", *BANDS)


@query("b8_to_reflectance", f"WITH {S.REFL} SELECT {PIX}, "
       + ", ".join(f"{r(b)} AS {b}, {r(b + ' - 0.1')} AS {b}_offset" for b in BANDS) + " FROM rf")
def to_reflectance(spark, sf):
    px = B.px_masked(spark, sf)
    return px.select("row", "col", "scene",
                     *[rr(P.to_reflectance(F.col(b)), alias=b) for b in BANDS],
                     *[rr(P.to_reflectance(F.col(b), "offset_applied"), alias=f"{b}_offset") for b in BANDS])


@query("b9_encode_reflectance", f"""WITH {S.REFL} SELECT {PIX}, coalesce(CAST(round(b03 * 10000) AS INT), 0) AS code,
  {r('coalesce(CAST(round(b03 * 10000) AS INT), 0) / 10000.0')} AS back,
  CAST(CASE WHEN b08 IS NULL THEN 0 WHEN b08 * 20 > 6.5535 THEN 65535 ELSE round(b08 * 20 * 10000) END AS INT) AS bright
  FROM rf""")
def encode(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS)
    code = P.encode_reflectance(F.col("b03"))
    return px.select("row", "col", "scene", code.alias("code"), rr(P.decode_reflectance(code), alias="back"),
                     P.encode_reflectance(F.col("b08") * 20).alias("bright"))


@query("b2_select_bands", f"WITH {S.REFL} SELECT {PIX}, {r('b04')} AS b04, {r('b03')} AS b03, {r('b04')} AS b02 FROM rf")
def select_rgb(spark, sf):
    from marshgrid.operators.catalog import select_bands
    px = R.reflectance(B.px_masked(spark, sf), BANDS).withColumn("b02", F.col("b04"))
    rgb = select_bands(px, ["row", "col", "scene"], [b.lower() for b in C.BANDS_RGB])
    return rgb.select("row", "col", "scene", *[rr(b) for b in ("b04", "b03", "b02")])


# --- indices --------------------------------------------------------------------

@query("h1_normalized_difference", f"WITH {S.MASKED} SELECT {PIX}, "
       f"{r('CASE WHEN abs(d08 + d04) > 1e-6 THEN (d08 - d04) / CAST(d08 + d04 AS DOUBLE) END')} AS nd FROM m")
def normalized(spark, sf):
    px = B.px_obs(spark, sf)
    return px.select("row", "col", "scene", rr(P.normalized_difference(F.col("b08"), F.col("b04")), alias="nd"))


@query("h2_spectral_indices", f"WITH {S.INDICES} SELECT {PIX}, " + ", ".join(f"{r(i)} AS {i}" for i in INDEX) + " FROM ix")
def spectral(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS)
    b = {n: F.col(n) for n in BANDS}
    return px.select("row", "col", "scene", rr(P.ndvi(b["b08"], b["b04"]), alias="ndvi"),
                     rr(P.ndwi(b["b03"], b["b08"]), alias="ndwi"), rr(P.ndre(b["b08"], b["b05"]), alias="ndre"),
                     rr(P.ndmi(b["b08"], b["b11"]), alias="ndmi"))


@query("h3_compute_indices", f"WITH {S.INDICES} SELECT {PIX}, {r('ndvi')} AS ndvi, {r('ndwi')} AS ndwi FROM ix")
def computable(spark, sf):
    # b05 and b11 are withheld, so the indices that need them are skipped.
    px = R.with_indices(R.reflectance(B.px_masked(spark, sf), BANDS), ["b03", "b04", "b08"],
                        ["NDVI", "ndwi", "ndre", "ndmi"])
    return px.select("row", "col", "scene", *[rr(c) for c in px.columns if c in INDEX])


# --- rule engine ----------------------------------------------------------------

for _name, _col in (("h4_water_score", "s0"), ("h5_crops_score", "s1"), ("h6_halophyte_score", "s2"),
                    ("h7_reed_score", "s3")):
    def _score(spark, sf, _i=int(_col[1])):
        px = B.px_indices(spark, sf)
        v, w, e, m = (F.col(n) for n in INDEX)
        score = [P.water_score(v, w, e), P.crops_score(v, w, e), P.halophyte_score(v, w, e),
                 P.reed_score(v, w, e, m)][_i]
        return px.where(score.isNotNull()).select("row", "col", "scene", rr(score, alias="score"))
    query(_name, f"WITH {S.INDICES} {S.scores()} SELECT {PIX}, {r(_col)} AS score FROM sc")(_score)


@query("h8_weak_label", f"""WITH {S.LABELS} SELECT {PIX}, usable, label, {r('conf')} AS confidence, {r('margin')} AS margin,
  amb AS ambiguous, review, trainable FROM lab""")
def weak(spark, sf):
    out = L.weak_label(B.px_indices(spark, sf))
    return out.select("row", "col", "scene", "usable", "label", rr("confidence"), rr("margin"),
                      F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "review", "trainable")


@query("d7_label_statistics", f"""WITH {S.LABELS} SELECT scene, count(*) FILTER (WHERE usable) AS usable_px,
  count(*) FILTER (WHERE trainable) AS trainable_px, count(*) FILTER (WHERE usable AND NOT trainable) AS dropped_px,
  {r('count(*) FILTER (WHERE usable AND NOT trainable) / count(*) FILTER (WHERE usable)', 5)} AS dropped_fraction,
  count(*) FILTER (WHERE review) AS review_px,
  {r('count(*) FILTER (WHERE review) / count(*) FILTER (WHERE usable)', 5)} AS review_fraction,
  {r('avg(conf)', 4)} AS mean_confidence,
  """ + ", ".join(f"count(*) FILTER (WHERE label = {c}) AS class_{c}_px, "
                  f"{r(f'count(*) FILTER (WHERE label = {c}) / count(*) FILTER (WHERE usable)', 5)} AS class_{c}_fraction"
                  for c in range(4)) + " FROM lab GROUP BY scene")
def label_stats(spark, sf):
    return L.label_statistics(L.weak_label(B.px_indices(spark, sf)), ["scene"])


@query("c11_apply_priors", f"""WITH {S.INDICES} {S.scores("CASE WHEN (r + c) % 5 = 0 THEN 0.05 ELSE 0 END")} {S.LABEL_TAIL}
  SELECT {PIX}, label, {r('conf')} AS confidence, trainable FROM lab""")
def priors(spark, sf):
    px = B.px_indices(spark, sf)
    votes = (B.px_obs(spark, sf).where((F.col("row") + F.col("col")) % 5 == 0).select("row", "col").distinct()
             .select("row", "col", F.lit(C.REED).alias("class_code"), F.lit(0.05).alias("bonus")))
    out = L.weak_label(L.apply_priors(px, votes, []))
    return out.select("row", "col", "scene", "label", rr("confidence"), "trainable")


# --- mosaic ---------------------------------------------------------------------

MOSAIC = f"""WITH {S.MASKED}, {S.FRAME}, sd AS ({B.SCENE_DIM}),
 srk AS (SELECT scene, row_number() OVER (ORDER BY cloud ASC NULLS LAST, acq_day) AS k FROM sd),
 win AS (SELECT m.*, srk.k FROM m JOIN srk USING (scene) WHERE valid
         QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY srk.k) = 1),
 hist AS (SELECT k, count(*) AS px FROM win GROUP BY k),
 cum AS (SELECT k, px, sum(px) OVER (ORDER BY k) / (SELECT hh * ww FROM fr) AS cov FROM hist),
 cut AS (SELECT coalesce(min(CASE WHEN cov >= 0.75 THEN k END), max(k)) AS last FROM cum)"""


def mosaic(spark, sf, target=0.75):
    return R.mosaic_clearest_first(B.px_masked(spark, sf), B.scene_dim(spark, sf), B.frame(spark, sf), BANDS,
                                   [], target)


@query("e1_mosaic_clearest_first", MOSAIC + f"""
 SELECT {PIX}, {', '.join(f'd{b[1:]} AS {b}' for b in BANDS)} FROM win WHERE k <= (SELECT last FROM cut)""")
def e1(spark, sf):
    return mosaic(spark, sf).select("row", "col", "scene", *BANDS)


@query("e1_mosaic_coverage_by_rank", MOSAIC + f" SELECT k AS rank, px, {r('cov')} AS coverage FROM cum")
def e1_cum(spark, sf):
    ranks = R.rank_scenes(B.scene_dim(spark, sf), [])
    win = R.mosaic_winners(B.px_masked(spark, sf), ranks, BANDS, [])
    return R.coverage_cut(win, B.frame(spark, sf), [], 0.75, BANDS).select(
        F.col("rank").cast("long").alias("rank"), "px", rr("coverage"))


@query("d5_scene_contribution", MOSAIC + f""" SELECT scene, count(*) AS px,
  {r('count(*) / (SELECT hh * ww FROM fr)')} AS share FROM win WHERE k <= (SELECT last FROM cut) GROUP BY scene""")
def d5(spark, sf):
    return R.scene_contribution(mosaic(spark, sf), B.frame(spark, sf), []).select("scene", "px", rr("share"))


@query("c1_assemble_bands", f"WITH {S.PX} SELECT {PIX}, {', '.join(BANDS)}, scl FROM px")
def c1(spark, sf):
    return R.assemble_bands(B.px_samples(spark, sf), [*BANDS, "scl"])


@query("a5_scan_observations", f"""WITH {S.MASKED} SELECT {PIX}, valid, {', '.join(
    f'CASE WHEN valid THEN d{b[1:]} END AS {b}' for b in BANDS)} FROM m WHERE r >= 20 AND r < 84 AND c >= 10 AND c < 74""")
def a5(spark, sf):
    return R.scan_observations(B.px_samples(spark, sf, "SCL"), BANDS, (20, 10, 84, 74)).select("row", "col", "scene", "valid", *BANDS)


# --- raster statistics ----------------------------------------------------------

_LONG = S.REFL + ", lg AS (" + " UNION ALL ".join(f"SELECT scene, {b} AS x FROM rf" for b in BANDS) + ")"


@query("d1_reflectance_check", f"""WITH {_LONG}, {S.FRAME}, cv AS (SELECT scene, count(*) FILTER (WHERE valid) AS v FROM rf GROUP BY scene)
  SELECT scene, count(x) AS n, {r('avg(CASE WHEN x < 0 THEN 1.0 WHEN x >= 0 THEN 0.0 END)')} AS negative_fraction,
  {r('min(x)')} AS min, {r('median(x)')} AS median, {r('max(x)')} AS max,
  {r('(SELECT v FROM cv WHERE cv.scene = lg.scene) / (SELECT hh * ww FROM fr)')} AS coverage,
  false AS too_negative, max(x) > 1.5 AS too_bright FROM lg GROUP BY scene""")
def d1(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS)
    out = R.reflectance_check(px, BANDS, B.scene_frames(spark, sf), ["scene"])
    return out.select("scene", "n", *[rr(c) for c in ("negative_fraction", "min", "median", "max", "coverage")],
                      "too_negative", "too_bright")


@query("d2_index_summary", f"""WITH {S.INDICES}, lg AS ({' UNION ALL '.join(f"SELECT scene, '{i}' AS index, {i} AS x FROM ix" for i in INDEX)})
  SELECT scene, index, {r('min(x)', 4)} AS min, {r('quantile_cont(x, 0.1)', 4)} AS p10, {r('quantile_cont(x, 0.5)', 4)} AS median,
  {r('quantile_cont(x, 0.9)', 4)} AS p90, {r('max(x)', 4)} AS max FROM lg WHERE x IS NOT NULL GROUP BY scene, index""")
def d2(spark, sf):
    out = R.index_summary(B.px_indices(spark, sf), INDEX, ["scene"])
    return out.select("scene", "index", *[rr(c, 4) for c in ("min", "p10", "median", "p90", "max")])


@query("d2_index_summary_overall", f"""WITH {S.INDICES}, lg AS ({' UNION ALL '.join(f"SELECT '{i}' AS index, {i} AS x FROM ix" for i in INDEX)})
  SELECT index, {r('quantile_cont(x, 0.1)', 4)} AS p10, {r('quantile_cont(x, 0.5)', 4)} AS median,
  {r('quantile_cont(x, 0.9)', 4)} AS p90 FROM lg WHERE x IS NOT NULL GROUP BY index""")
def d2_all(spark, sf):
    out = R.index_summary(B.px_indices(spark, sf), INDEX, [])
    return out.select("index", *[rr(c, 4) for c in ("p10", "median", "p90")])


@query("d3_index_histogram", f"""WITH {S.INDICES}, e AS (SELECT unnest(range(0, 40)) AS bin),
  n AS (SELECT scene, count(ndvi) AS n FROM ix WHERE ndvi IS NOT NULL GROUP BY scene)
  SELECT n.scene, CAST(e.bin AS INT) AS bin, {r('e.bin * 0.05 - 1', 3)} AS bin_start, count(ix.ndvi) AS px, max(n.n) AS count
  FROM n CROSS JOIN e LEFT JOIN ix ON ix.scene = n.scene AND ix.ndvi >= e.bin * 0.05 - 1
    AND (ix.ndvi < (e.bin + 1) * 0.05 - 1 OR (e.bin = 39 AND ix.ndvi = 1))
  GROUP BY n.scene, e.bin""")
def d3(spark, sf):
    return R.index_histogram(B.px_indices(spark, sf), "ndvi", ["scene"]).select(
        "scene", "bin", rr("bin_start", 3), "px", "count")


@query("d4_coverage", f"""WITH {S.MASKED}, {S.FRAME} SELECT scene, count(*) FILTER (WHERE valid) AS valid_px,
  (SELECT hh * ww FROM fr) AS total_px, {r('count(*) FILTER (WHERE valid) / (SELECT hh * ww FROM fr)')} AS coverage,
  count(*) FILTER (WHERE valid) / (SELECT hh * ww FROM fr) < 0.5 AS low_coverage FROM m GROUP BY scene""")
def d4(spark, sf):
    return R.coverage(B.px_masked(spark, sf), B.scene_frames(spark, sf), ["scene"]).select(
        "scene", "valid_px", "total_px", rr("coverage"), "low_coverage")


@query("b22_percentile_stretch", f"""WITH {S.REFL}, q AS (SELECT scene, quantile_cont(b04, 0.02) AS lo, quantile_cont(b04, 0.98) AS hi
    FROM rf WHERE b04 IS NOT NULL GROUP BY scene)
  SELECT {PIX}, {r(S.clip('(b04 - lo) / (hi - lo)'))} AS stretched FROM rf JOIN q USING (scene)""")
def b22(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS)
    return R.percentile_stretch(px, "b04", ["scene"]).select("row", "col", "scene", rr("stretched"))


# --- tiles ----------------------------------------------------------------------

def tallies(spark, sf):
    t = T.tile_tallies(B.labelled(spark, sf), ["scene"], SIZE, STRIDE)
    return T.all_tiles(B.scene_frames(spark, sf), t, ["scene"], SIZE, STRIDE)


TILE = 'top, lft AS "left", scene'


@query("c6_assign_tiles", f"""WITH {S.TILES} SELECT {PIX}, CAST(top AS INT) AS top, CAST(lft AS INT) AS "left",
  CAST(floor(top / 32.0) AS INT) AS block_row, CAST(floor(lft / 32.0) AS INT) AS block_col FROM tp""")
def c6(spark, sf):
    px = B.labelled(spark, sf).select("row", "col", "scene", "height", "width")
    return T.assign_tiles(px, SIZE, STRIDE).drop("height", "width")


@query("c6_tile_tallies", f"WITH {S.TALLY} SELECT {TILE}, px, usable AS usable_px, trainable AS trainable_px, review AS review_px, "
       + ", ".join(f"label_{c} AS label_{c}_px, mask_{c} AS mask_{c}_px" for c in range(4)) + " FROM ta")
def c6_tallies(spark, sf):
    return tallies(spark, sf).withColumns({"top": F.col("top").cast("long"), "left": F.col("left").cast("long")})


@query("b13_drop_empty_tiles", f"WITH {S.TALLY} SELECT {TILE} FROM ta WHERE label_3 > 0")
def b13(spark, sf):
    return T.drop_empty_tiles(tallies(spark, sf)).select(
        F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "scene")


@query("b11_tile_inputs", f"""WITH {S.TILES} SELECT tp.r AS "row", tp.c AS col, tp.scene, CAST(tp.top AS INT) AS top, CAST(tp.lft AS INT) AS "left",
  {', '.join(f'{r(f"coalesce(rf.{b}, 0)")} AS {b}' for b in BANDS)}, tp.mask, tp.label AS rule_label, tp.usable, tp.review
  FROM tp JOIN rf ON rf.r = tp.r AND rf.c = tp.c AND rf.scene = tp.scene""")
def b11(spark, sf):
    tp = T.assign_tiles(B.labelled(spark, sf), SIZE, STRIDE)
    out = T.tile_inputs(tp, BANDS)
    return out.select("row", "col", "scene", "top", "left", *[rr(b) for b in BANDS], "mask", "rule_label",
                      "usable", "review")


@query("d8_shard_counts", f"WITH {S.TALLY} SELECT scene, count(*) AS tiles, "
       + ", ".join(f"CAST(sum(mask_{c}) AS BIGINT) AS class_{c}" for c in range(4))
       + ", CAST(sum(trainable) AS BIGINT) AS trainable_px, CAST(sum(usable) AS BIGINT) AS tile_usable_px, "
         "CAST(sum(review) AS BIGINT) AS tile_review_px FROM ta GROUP BY ROLLUP (scene)")
def d8(spark, sf):
    return T.shard_counts(tallies(spark, sf), "scene")


@query("d9_unique_ground", f"""WITH {S.LABELS} SELECT scene, count(*) FILTER (WHERE usable) AS usable_px,
  count(*) FILTER (WHERE review) AS review_px FROM lab GROUP BY scene""")
def d9(spark, sf):
    return T.unique_ground(B.labelled(spark, sf), ["scene"])


_BAL = f"""WITH {S.TALLY}, sel AS (SELECT * FROM ta WHERE (top + lft) % 64 = 0),
 cc AS (""" + " UNION ALL ".join(
    f"SELECT {c} AS class_code, '{C.CLASS_NAMES[c]}' AS class_name, CAST(coalesce(sum(mask_{c}), 0) AS BIGINT) AS px FROM sel"
    for c in range(4)) + ")"


def subset_balance(spark, sf):
    t = tallies(spark, sf)
    return T.class_balance(t, t.where((F.col("top") + F.col("left")) % 64 == 0), ["scene", "top", "left"])


@query("d10_class_balance", _BAL + f""" SELECT class_code, class_name, px, {r('px / sum(px) OVER ()')} AS fraction,
  CAST(sum(px) OVER () AS BIGINT) AS total_px FROM cc""")
def d10(spark, sf):
    return subset_balance(spark, sf).withColumn("fraction", rr("fraction"))


@query("d11_class_weights", _BAL.replace("WHERE (top + lft) % 64 = 0", "") + f""", raw AS (SELECT class_code, greatest(0.05, least(50.0, sum(px) OVER () / (px * 4.0))) AS a,
   greatest(0.05, least(50.0, sqrt(sum(px) OVER () / (px * 4.0)))) AS b FROM cc)
  SELECT class_code, {r('a / avg(a) OVER ()')} AS inverse_frequency, {r('b / avg(b) OVER ()')} AS sqrt_inverse,
   CAST(1.0 AS DOUBLE) AS uniform FROM raw""")
def d11(spark, sf):
    t = tallies(spark, sf)
    bal = T.class_balance(t, t, ["scene", "top", "left"])
    return T.class_weight_table(bal).select("class_code", *[rr(w) for w in T.WEIGHT_SCHEMES])


@query("d12_band_statistics", f"""WITH {S.TILES},
  v AS (SELECT rf.* FROM tl JOIN tp USING (scene, top, lft) JOIN rf ON rf.r = tp.r AND rf.c = tp.c AND rf.scene = tp.scene WHERE tp.usable)
  """ + " UNION ALL ".join(f"SELECT '{b}' AS band, {r(f'avg({b})')} AS mean, {r(f'greatest(stddev_pop({b}), 1e-4)')} AS std, count(*) AS usable_px FROM v"
                           for b in BANDS))
def d12(spark, sf):
    px = B.labelled(spark, sf)
    tiles = T.grid_tiles(B.scene_frames(spark, sf), SIZE, STRIDE)
    return T.band_statistics(px, tiles, BANDS, ["scene"], SIZE, STRIDE).select(
        "band", rr("mean"), rr("std"), "usable_px")


@query("d13_review_fraction", f"""WITH {S.LABELS} SELECT {r('count(*) FILTER (WHERE review) / count(*) FILTER (WHERE usable)', 5)}
  AS review_fraction FROM lab""")
def d13(spark, sf):
    return T.review_fraction(T.unique_ground(B.labelled(spark, sf), ["scene"])).select(rr("review_fraction", 5))


@query("d13_tile_review_density", f"""WITH {S.TALLY} SELECT {TILE}, {r('CASE WHEN usable > 0 THEN review / usable END')} AS review_density,
  {r('review / 1024.0')} AS review_fraction FROM ta""")
def d13_tiles(spark, sf):
    t = T.tile_review_density(tallies(spark, sf))
    return t.select(F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "scene",
                    rr("review_density"), rr(F.col("review_px") / float(SIZE * SIZE), alias="review_fraction"))


@query("d14_reed_support", f"""WITH {S.TALLY} SELECT scene, CAST(sum(mask_3) AS BIGINT) AS reed_px, sum(mask_3) >= 500 AS sufficient
  FROM ta GROUP BY scene""")
def d14(spark, sf):
    return T.reed_support(tallies(spark, sf), ["scene"])


@query("d22_class_fractions", f"WITH {S.TALLY} SELECT {TILE}, " + ", ".join(
    f"{r(f'CASE WHEN mask_0 + mask_1 + mask_2 + mask_3 > 0 THEN mask_{c} / (mask_0 + mask_1 + mask_2 + mask_3) ELSE 0 END')} AS fraction_{c}"
    for c in range(4)) + " FROM ta")
def d22(spark, sf):
    t = T.class_fractions(tallies(spark, sf))
    return t.select(F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "scene",
                    *[rr(f"fraction_{c}") for c in range(4)])


@query("d25_describe_store", f"""WITH {S.TALLY}, g AS (SELECT count(*) FILTER (WHERE usable) AS u, count(*) FILTER (WHERE review) AS v FROM lab)
  SELECT count(DISTINCT scene) AS shards, count(*) AS tiles, 'whole store' AS scope, """
       + ", ".join(f"CAST(sum(mask_{c}) AS BIGINT) AS class_{c}" for c in range(4)) + f""",
  CAST(sum(mask_0 + mask_1 + mask_2 + mask_3) AS BIGINT) AS trainable_px, CAST(0 AS BIGINT) AS holdout_tiles_excluded,
  (SELECT u FROM g) AS usable_px, (SELECT v FROM g) AS review_px, {r('(SELECT v / u FROM g)', 5)} AS review_fraction FROM ta""")
def d25(spark, sf):
    return T.describe_store(tallies(spark, sf), T.unique_ground(B.labelled(spark, sf), ["scene"]), "scene") \
            .withColumn("review_fraction", rr("review_fraction", 5))


@query("f5_batches", f"""WITH {S.TALLY} SELECT {TILE}, CAST(floor((row_number() OVER (ORDER BY scene, top, lft) - 1) / 10.0) AS BIGINT) AS batch FROM ta""")
def f5(spark, sf):
    t = tallies(spark, sf).select(F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "scene")
    return T.batches(t, 10, ("scene", "top", "left"))


@query("f4_truncate_tiles", f"WITH {S.TALLY} SELECT {TILE} FROM ta ORDER BY scene, top, lft LIMIT 25")
def f4(spark, sf):
    t = tallies(spark, sf).select(F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "scene")
    return T.truncate_tiles(t, 25, ("scene", "top", "left"))


@query("e8_linspace_sample", f"""WITH {S.TALLY}, o AS (SELECT scene, top, lft, row_number() OVER (ORDER BY scene, top, lft) - 1 AS p FROM ta),
  q AS (SELECT DISTINCT CAST(floor(i * ((SELECT count(*) FROM o) - 1) / 39.0) AS BIGINT) AS p FROM (SELECT unnest(range(0, 40)) AS i))
  SELECT {TILE}, p AS position FROM o JOIN q USING (p)""")
def e8(spark, sf):
    t = tallies(spark, sf).select(F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "scene")
    return T.linspace_sample(t, [F.col("scene"), F.col("top"), F.col("left")], 40)


@query("d12_channel_statistics", f"WITH {S.REFL} " + " UNION ALL ".join(
    f"SELECT '{b}' AS band, {r(f'avg({b})')} AS mean, {r(f'greatest(stddev_pop({b}), 1e-3)')} AS std FROM rf" for b in BANDS))
def d12_channels(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS)
    return T.channel_statistics(px, BANDS).select("band", rr("mean"), rr("std"))


@query("b14_standardise_bands", f"WITH {S.REFL}, z AS (SELECT "
       + ", ".join(f"round(avg({b}), 6) AS m{b}, round(greatest(stddev_pop({b}), 1e-3), 6) AS s{b}" for b in BANDS)
       + f" FROM rf) SELECT {PIX}, " + ", ".join(f"{r(f'({b} - m{b}) / s{b}', 4)} AS {b}" for b in BANDS) + " FROM rf, z")
def b14(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS)
    stats = T.channel_statistics(px, BANDS).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
    return T.standardise_bands(px, stats, BANDS).select("row", "col", "scene", *[rr(b, 4) for b in BANDS])


@query("b18_extract_tile", f"""WITH {S.REFL} SELECT r - 40 AS "row", c - 24 AS col, scene, {r('b08')} AS b08 FROM rf
  WHERE r >= 40 AND r < 72 AND c >= 24 AND c < 56""")
def b18(spark, sf):
    px = R.reflectance(B.px_masked(spark, sf), BANDS)
    return T.extract_tile(px, 40, 24, 32).select("row", "col", "scene", rr("b08"))


FLAGSHIP = MOSAIC + f""", kept AS (SELECT r, c, 0 AS scene, true AS valid, {', '.join(f'd{b[1:]}' for b in BANDS)}
   FROM win WHERE k <= (SELECT last FROM cut)),
 m2 AS (SELECT * FROM kept), rf AS (SELECT r, c, scene, valid, {', '.join(f'd{b[1:]} * 1e-4 AS {b}' for b in BANDS)} FROM m2),
 ix AS (SELECT *, {S.nd('b08', 'b04')} AS ndvi, {S.nd('b03', 'b08')} AS ndwi, {S.nd('b08', 'b05')} AS ndre,
   {S.nd('b08', 'b11')} AS ndmi FROM rf) {S.scores()} {S.LABEL_TAIL.replace('FROM m LEFT', 'FROM kept m LEFT')}
 SELECT count(*) FILTER (WHERE usable) AS usable_px, count(*) FILTER (WHERE trainable) AS trainable_px,
  count(*) FILTER (WHERE review) AS review_px, {r('avg(conf)', 4)} AS mean_confidence,
  """ + ", ".join(f"count(*) FILTER (WHERE label = {c}) AS class_{c}_px" for c in range(4)) + " FROM lab"


@query("flagship_composite_labels", FLAGSHIP)
def flagship(spark, sf):
    """Composite the observations, label every pixel, report the classes."""
    from marshgrid.plans.composite import composite
    comp = composite(B.px_obs(spark, sf), B.scene_dim(spark, sf), B.frame(spark, sf), BANDS, [], 0.75)
    out = L.label_statistics(L.weak_label(comp), [])
    return out.select("usable_px", "trainable_px", "review_px", "mean_confidence",
                      *[f"class_{c}_px" for c in range(4)])
