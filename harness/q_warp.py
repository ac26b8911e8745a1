"""Grid-to-grid queries: offset grids, another zone, bands of several resolutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import bindings as B
from harness import sqltext as S
from harness.q_pixels import BANDS, rr
from harness.registry import query
from harness.sqltext import r
from marshgrid.functions import geo as G
from marshgrid.operators import raster as R
from marshgrid.operators import warp as W

# Fixed values of the binding: the pixel grid lies at the eastern edge of zone 35, at 20 m.
SRC = {"gsd": 20.0, "x0": 785000.0, "y0": 3430000.0, "epsg": 32635}
#: A grid of zone 36 over it; rows are as many as the source has, and 60 more for the turn between the zones.
ZONE = {"gsd": 20.0, "x0": 206000.0, "y0": 3430100.0, "epsg": 32636, "width": 420}


def _frames(spark, sf, dst: dict, rows: str, cols: str):
    """Source and target grid of every scene; ``rows`` and ``cols`` say the target's extent."""
    each = B.scene_frames(spark, sf)
    return each.select("scene", W.grid(SRC["gsd"], SRC["x0"], SRC["y0"], F.col("height"), F.col("width"), SRC["epsg"]).alias("src"),
                       W.grid(dst["gsd"], dst["x0"], dst["y0"], F.expr(rows), F.expr(cols), dst["epsg"]).alias("dst"))


def _observed(spark, sf):
    return R.reflectance(B.px_masked(spark, sf), BANDS).select("row", "col", "scene", "scl", "b08")


def _cubic_sql(d: str) -> str:
    x = f"abs({d})"
    return f"CASE WHEN {x} <= 1 THEN (1.5 * {x} - 2.5) * {x} * {x} + 1 WHEN {x} < 2 THEN ((-0.5 * {x} + 2.5) * {x} - 4) * {x} + 2 ELSE 0 END"


def _offset_sql(weight: str, reach: int) -> str:
    """10 m pixels whose centres lie at v = t / 2 of the source axis: every second one on a sample."""
    return f"""WITH {S.REFL}, {S.FRAME}, k AS (SELECT unnest(range({-reach * 2}, {reach * 2 + 1})) AS d),
  w AS (SELECT d, CAST({weight.replace('@', '(d / 2.0)')} AS DOUBLE) AS w FROM k),
  s AS (SELECT r * 2 + a.d AS tr, c * 2 + b.d AS tc, scene, b08, a.w * b.w AS w FROM rf, w a, w b WHERE a.w <> 0 AND b.w <> 0),
  g AS (SELECT tr, tc, scene, sum(w * b08) AS s, sum(CASE WHEN b08 IS NOT NULL THEN w END) AS n FROM s, fr
        WHERE tr >= 0 AND tr < hh * 2 - 1 AND tc >= 0 AND tc < ww * 2 - 1 GROUP BY tr, tc, scene)
  SELECT CAST(tr AS INT) AS "row", CAST(tc AS INT) AS col, scene, {r('CASE WHEN abs(n) > 1e-12 THEN s / n END + 1e-11', 9)} AS b08 FROM g"""


def _off_ties(name):
    """Rounded to nine places; weights are fractions of two, so values often lie half way and are moved off it first."""
    return F.round(F.col(name) + 1e-11, 9)


def _offset(spark, sf, method):
    # The target's origin lies a half target pixel inside the source's.
    dst = {"gsd": 10.0, "x0": SRC["x0"] + 5.0, "y0": SRC["y0"] - 5.0, "epsg": SRC["epsg"]}
    return W.warp(_observed(spark, sf), _frames(spark, sf, dst, "height * 2", "width * 2"), ["b08"], ["scene"], method).withColumn("b08", _off_ties("b08"))


@query("c12_warp_offset_bilinear", _offset_sql("greatest(0.0, 1 - abs(@))", 1))
def c12_warp_offset_bilinear(spark, sf):
    return _offset(spark, sf, "bilinear")


@query("c12_warp_offset_cubic", _offset_sql(_cubic_sql("@"), 2))
def c12_warp_offset_cubic(spark, sf):
    return _offset(spark, sf, "cubic")


def _series(terms, text):
    return " + ".join(f"{c!r} * " + text.format(j=2 * j) for j, c in enumerate(terms, start=1))


#: Centres of the zone 36 grid, brought to longitude and latitude and on to zone 35, one step of the series a line.
_PLACES = f"""t AS (SELECT CAST(tr.i AS INT) AS tr, CAST(tc.i AS INT) AS tc FROM fr, (SELECT unnest(range(0, {ZONE['width']})) AS i) tc, (SELECT unnest(range(0, 200000)) AS i) tr WHERE tr.i < hh + 60),
  p0 AS (SELECT tr, tc, ({ZONE['y0']} - (tr + 0.5) * {ZONE['gsd']}) / {G.K0 * G._RADIUS!r} AS xi, ({ZONE['x0']} + (tc + 0.5) * {ZONE['gsd']} - {G.FALSE_EAST}) / {G.K0 * G._RADIUS!r} AS eta FROM t),
  p1 AS (SELECT tr, tc, xi - ({_series(G._BETA, 'sin({j} * xi) * cosh({j} * eta)')}) AS a, eta - ({_series(G._BETA, 'cos({j} * xi) * sinh({j} * eta)')}) AS b FROM p0),
  p2 AS (SELECT tr, tc, radians(33) + atan2(sinh(b), cos(a)) AS lon, asin(sin(a) / cosh(b)) AS chi FROM p1),
  p3 AS (SELECT tr, tc, lon - radians(27) AS dl, sin(chi + {_series(G._DELTA, 'sin({j} * chi)')}) AS s FROM p2),
  p4 AS (SELECT tr, tc, dl, sinh(atanh(s) - {G._E!r} * atanh({G._E!r} * s)) AS t FROM p3),
  p5 AS (SELECT tr, tc, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM p4),
  p6 AS (SELECT tr, tc, {G.FALSE_EAST} + {G.K0 * G._RADIUS!r} * (eta + {_series(G._ALPHA, 'cos({j} * xi) * sinh({j} * eta)')}) AS x,
           {G.K0 * G._RADIUS!r} * (xi + {_series(G._ALPHA, 'sin({j} * xi) * cosh({j} * eta)')}) AS y FROM p5),
  spot AS (SELECT tr, tc, ({SRC['y0']} - y) / {SRC['gsd']} - 0.5 AS v, (x - {SRC['x0']}) / {SRC['gsd']} - 0.5 AS u FROM p6, fr
         WHERE floor(({SRC['y0']} - y) / {SRC['gsd']}) BETWEEN 0 AND hh - 1 AND floor((x - {SRC['x0']}) / {SRC['gsd']}) BETWEEN 0 AND ww - 1)"""


def _zone_frames(spark, sf):
    return _frames(spark, sf, ZONE, "height + 60", str(ZONE["width"]))


@query("c12_warp_zone_nearest", f"""WITH {S.PX}, {S.FRAME}, {_PLACES}
  SELECT tr AS "row", tc AS col, scene, scl, b08 FROM spot JOIN px ON px.r = CAST(floor(v + 0.5) AS INT) AND px.c = CAST(floor(u + 0.5) AS INT)""")
def c12_warp_zone_nearest(spark, sf):
    return W.warp(B.px_obs(spark, sf), _zone_frames(spark, sf), ["scl", "b08"], ["scene"], "nearest", categorical=True)


@query("c12_warp_zone_bilinear", f"""WITH {S.REFL}, {S.FRAME}, {_PLACES},
  near AS (SELECT tr, tc, floor(v) + i.d AS nr, floor(u) + j.d AS nc, (1 - abs(v - floor(v) - i.d)) * (1 - abs(u - floor(u) - j.d)) AS w
           FROM spot, (VALUES (0), (1)) i(d), (VALUES (0), (1)) j(d))
  SELECT tr AS "row", tc AS col, scene, {r('sum(w * b08) / sum(CASE WHEN b08 IS NOT NULL THEN w END)', 4)} AS b08
  FROM near JOIN rf ON rf.r = CAST(nr AS INT) AND rf.c = CAST(nc AS INT) WHERE w <> 0 GROUP BY tr, tc, scene""")
def c12_warp_zone_bilinear(spark, sf):
    return W.warp(_observed(spark, sf), _zone_frames(spark, sf), ["b08"], ["scene"], "bilinear").withColumn("b08", rr("b08", 4))


#: Two bands at 10 m and two, with the mask, at 20 m.
_MIXED = [("b04", "red", 10, "bilinear"), ("b08", "nir", 10, "bilinear"), ("b05", "rededge1", 20, "bilinear"), ("b11", "swir16", 20, "bilinear")]
_UP = " + ".join(f"coalesce({w} * {{b}}{i}{j}, 0)" for i, j, w in ((0, 0, "y0 * x0"), (0, 1, "y0 * x1"), (1, 0, "y1 * x0"), (1, 1, "y1 * x1")))
_UPW = " + ".join(f"CASE WHEN {{b}}{i}{j} IS NULL THEN 0 ELSE {w} END" for i, j, w in ((0, 0, "y0 * x0"), (0, 1, "y0 * x1"), (1, 0, "y1 * x0"), (1, 1, "y1 * x1")))


@query("a5_scan_to_grid", f"""WITH {S.PX}, {S.FRAME},
  tp AS (SELECT px.r, px.c, px.scene, px.b04, px.b08, coalesce(n.scl, 0) AS scl,
    {', '.join(f'q{i}{j}.{b} AS {b}{i}{j}' for b in ('b05', 'b11') for i in (0, 1) for j in (0, 1))},
    CASE WHEN px.r % 2 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS y0, CASE WHEN px.r % 2 = 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS y1,
    CASE WHEN px.c % 2 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS x0, CASE WHEN px.c % 2 = 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS x1
    FROM px LEFT JOIN px n ON n.scene = px.scene AND n.r = px.r // 2 AND n.c = px.c // 2
    {' '.join(f'LEFT JOIN px q{i}{j} ON q{i}{j}.scene = px.scene AND q{i}{j}.r = (px.r + 1) // 2 - 1 + {i} AND q{i}{j}.c = (px.c + 1) // 2 - 1 + {j}' for i in (0, 1) for j in (0, 1))}),
  v AS (SELECT r, c, scene, scl, b04, b08, {', '.join(f"CAST(round_even(({_UP.format(b=b)}) / nullif({_UPW.format(b=b)}, 0), 0) AS INT) AS {b}" for b in ('b05', 'b11'))} FROM tp),
  ok AS (SELECT *, coalesce(scl NOT IN {S.INVALID} AND NOT (b04 = 0 AND b08 = 0 AND b05 = 0 AND b11 = 0) AND b05 IS NOT NULL AND b11 IS NOT NULL, false) AS valid FROM v)
  SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, scene, scl, {', '.join(f'CASE WHEN valid THEN {b} END AS {b}' for b in ('b04', 'b08', 'b05', 'b11'))}, valid FROM ok""")
def a5_scan_to_grid(spark, sf):
    px = B.px_obs(spark, sf)
    bands = [b for b, *_ in _MIXED]
    long = px.select("scene", "row", "col", F.expr(f"stack({len(bands) + 1}, " + ", ".join(f"'{b}', {b}" for b in [*bands, "scl"]) + ") as (band, dn)"))
    each = B.scene_frames(spark, sf)
    target = W.grid(10.0, 0.0, 0.0, F.col("height"), F.col("width"), SRC["epsg"])
    # The coarse bands use the same table as a grid of twice the extent, cut to what the target covers.
    frames = each.select("scene", F.explode(F.array(F.lit(10.0), F.lit(20.0))).alias("gsd"), "height", "width").select(
        "scene", "gsd", W.grid(F.col("gsd"), 0.0, 0.0, F.col("height"), F.col("width"), SRC["epsg"]).alias("src"), target.alias("dst"))
    out = W.scan_to_grid(long, frames, bands, ["scene"], _MIXED, ("scl", "scl", 20, "nearest"))
    here = px.select("scene", "row", "col")  # targets without a fine sample are left out, as in the SQL
    return out.join(here, ["scene", "row", "col"], "left_semi")
