"""Scene catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import bindings as B
from harness import sqltext as S
from harness.q_pixels import rr
from harness.registry import query
from harness.sqltext import r
from marshgrid import contract as C
from marshgrid.functions import keys as K
from marshgrid.operators import catalog as Cat
from marshgrid.operators import grids as Gr
from marshgrid.sources import catalog as Src
from marshgrid.sources import geojson as GJ

SC = f"sc AS ({B.SCENES})"


def scenes(spark, sf):
    df = B.scenes(spark, sf)
    return df.withColumn("bbox", F.struct("west", "south", (F.col("west") + 0.1).alias("east"),
                                          (F.col("south") + 0.1).alias("north")))


def day(name, alias=None):
    return F.date_format(name, "yyyy-MM-dd").alias(alias or name)


# --- landed records ---------------------------------------------------------------

def stac_items(spark, sf):
    """Orders written as STAC item JSON, with every irregularity the reader handles."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    west, south = 30.0 + (k % 40) / 10.0, 30.0 + (k % 30) / 10.0
    ring = F.array(*[F.array(x, y) for x, y in ((west, south), (west + 1, south), (west + 1, south + 1),
                                                (west, south + 1), (west, south))])
    def asset(name, scale=None):
        bands = F.array(F.struct(F.lit(scale).alias("scale"), F.lit(-0.1).alias("offset"))) if scale else \
            F.lit(None).cast("array<struct<scale:double,offset:double>>")
        return F.struct(F.concat(F.lit(f"s3://land/{name}/"), o.cast("string")).alias("href"), bands.alias("raster:bands"))
    names = [a for _, a, _, _ in C.BANDS]
    full = [x for n in names for x in (F.lit(n), asset(n, 0.0002 if n == "red" else None))]
    mask = [F.lit("scl"), asset("scl")]
    assets = F.when(k % 11 == 0, F.create_map(F.lit("thumbnail"), asset("thumbnail"))) \
        .when(k % 2 == 0, F.create_map(*full[:4], *mask)).otherwise(F.create_map(*full, *mask))
    props = F.struct(
        F.when(o % 17 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:30:00Z"))).alias("datetime"),
        F.when(o % 3 != 0, "sentinel-2a").alias("platform"), F.when(o % 9 != 0, "sentinel-2").alias("constellation"),
        F.when(o % 7 != 0, (o % 1000) / 10.0).alias("eo:cloud_cover"), F.when(o % 2 == 0, 32636).alias("proj:epsg"),
        F.when(o % 2 == 1, "EPSG:32635").alias("proj:code"), F.when(o % 4 == 0, "MGRS-36RUV").alias("grid:code"),
        F.lit("36RTV").alias("s2:mgrs_tile"))
    return B.spread(spark, B.table(spark, sf, "orders"), "o_orderkey").select(F.to_json(F.struct(
        o.cast("string").alias("id"), F.lit("sentinel-2-l2a").alias("collection"),
        F.when(o % 5 != 0, F.array(west, south, west + 1, south + 1)).alias("bbox"),
        F.when(o % 10 != 0, F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"),
        props.alias("properties"), assets.alias("assets"))).alias("value"))


@query("a1_scenes_from_stac", f"""
 SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS acquired,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'sentinel-2a' WHEN o_orderkey % 9 <> 0 THEN 'sentinel-2' ELSE 'unknown' END AS platform,
  {r('CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 1000) / 10.0 END')} AS cloud_cover,
  {r('30 + (o_custkey % 40) / 10.0')} AS west, {r('31 + (o_custkey % 30) / 10.0')} AS north,
  CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 11 END AS assets, o_custkey % 2 <> 0 AS usable,
  CASE WHEN o_orderkey % 2 = 0 THEN 32636 ELSE 32635 END AS epsg,
  CASE WHEN o_orderkey % 4 = 0 THEN 'MGRS-36RUV' ELSE '36RTV' END AS grid_code,
  {r('CASE WHEN o_custkey % 2 = 0 THEN 0.0001 ELSE 0.0002 END')} AS scale
 FROM orders WHERE o_orderkey % 17 <> 0 AND o_custkey % 11 <> 0 AND o_orderkey % 10 <> 0""")
def a1(spark, sf):
    s = Src.scenes_from_stac(stac_items(spark, sf))
    missing = F.array_except(F.array(*[F.lit(b) for b in C.required_bands()]), F.map_keys("assets"))
    return s.select("id", day("acquired"), "platform", rr("cloud_cover"), rr("bbox.west", alias="west"),
                    rr("bbox.north", alias="north"), F.size("assets").alias("assets"),
                    (F.size(missing) == 0).alias("usable"), "epsg", "grid_code", rr("scale"))


@query("b1_has_bands", """SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
 WHERE o_orderkey % 17 <> 0 AND o_custkey % 11 <> 0 AND o_orderkey % 10 <> 0 AND o_custkey % 2 <> 0""")
def b1(spark, sf):
    return Cat.has_bands(Src.scenes_from_stac(stac_items(spark, sf))).select("id")


def odata_products(spark, sf):
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    west, south = 30.0 + (k % 40) / 10.0, 30.0 + (k % 30) / 10.0
    ring = F.array(*[F.array(x, y) for x, y in ((west, south + 1), (west + 1, south), (west, south), (west, south + 1))])
    name = F.concat(F.when(o % 2 == 0, "S2A").otherwise("S2B"), F.lit("_MSIL2A_2023_N0509_R064_"),
                    F.when(o % 6 != 0, F.concat(F.lit("T36RU"), F.lit("_36RU"), F.chr((o % 26) + 65))).otherwise("NOTILE"),
                    F.lit("_x.SAFE"))
    attrs = F.array(F.struct(F.lit("orbit").alias("Name"), F.lit("64").alias("Value")),
                    F.struct(F.when(o % 7 != 0, "cloudCover").otherwise("other").alias("Name"),
                             ((o % 1000) / 10.0).cast("string").alias("Value")))
    return B.spread(spark, B.table(spark, sf, "orders"), "o_orderkey").select(F.to_json(F.struct(
        F.when(o % 13 != 0, o.cast("string")).alias("Id"), name.alias("Name"),
        F.struct(F.when(o % 17 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:30:00.000Z")))
                 .alias("Start")).alias("ContentDate"),
        F.struct(F.lit("Polygon").alias("type"), F.when(o % 19 != 0, F.array(ring)).alias("coordinates")).alias("GeoFootprint"),
        attrs.alias("Attributes"))).alias("value"))


@query("a2_scenes_from_odata", f"""
 SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS acquired,
  CASE WHEN o_orderkey % 2 = 0 THEN 'S2A' ELSE 'S2B' END AS platform,
  {r('CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 1000) / 10.0 END')} AS cloud_cover,
  {r('30 + (o_custkey % 40) / 10.0')} AS west, {r('30 + (o_custkey % 30) / 10.0')} AS south,
  {r('31 + (o_custkey % 40) / 10.0')} AS east,
  CASE WHEN o_orderkey % 6 <> 0 THEN concat('36RU', chr(CAST(o_orderkey % 26 + 65 AS INT))) END AS grid_code,
  false AS remote_readable
 FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0""")
def a2(spark, sf):
    s = Src.scenes_from_odata(odata_products(spark, sf))
    return s.select("id", day("acquired"), "platform", rr("cloud_cover"), rr("bbox.west", alias="west"),
                    rr("bbox.south", alias="south"), rr("bbox.east", alias="east"), "grid_code", "remote_readable")


def archive_listing(spark, sf):
    """Every order as an archive: decoy files first, then the real members."""
    o = F.col("o_orderkey")
    members = [F.lit("p.SAFE/manifest.xml")]
    for n, _, g, _ in C.BANDS:
        members.append(F.lit(f"p.SAFE/IMG/R60m/T36RUV_{n}_60m.jp2"))
        members.append(F.when(~((n == "B12") & (o % 5 == 0)), F.lit(f"p.SAFE/IMG/R{g}m/T36RUV_{n}_{g}m.jp2")))
        members.append(F.lit(f"p.SAFE/IMG/R{g}m/{n}_copy.jp2"))
    members.append(F.lit("p.SAFE/IMG/R20m/SCL_20m.jp2"))
    rows = B.spread(spark, B.table(spark, sf, "orders"), "o_orderkey").select(
        o.alias("scene_id"), F.concat(o.cast("string"), F.lit(".zip")).alias("archive"),
        F.posexplode(F.array(*members)).alias("position", "member"))
    # Archives of every fifth order lose their B12 members entirely.
    return rows.where(F.col("member").isNotNull() & ~((o % 5 == 0) & F.col("member").contains("/B12_")))


@query("a3_resolve_archive_assets", """SELECT o_orderkey AS scene_id,
  concat(CAST(o_orderkey AS VARCHAR), '.zip!/p.SAFE/IMG/R20m/T36RUV_B8A_20m.jp2') AS b8a,
  concat(CAST(o_orderkey AS VARCHAR), '.zip!/p.SAFE/IMG/R20m/SCL_20m.jp2') AS scl,
  CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 11 END AS assets, CASE WHEN o_orderkey % 5 = 0 THEN 'B12' ELSE '' END AS missing
  FROM orders""")
def a3(spark, sf):
    out = Src.resolve_archive_assets(archive_listing(spark, sf))
    return out.select("scene_id", F.col("assets")["B8A"].alias("b8a"), F.col("assets")["SCL"].alias("scl"),
                      F.size("assets").alias("assets"), F.array_join("missing", ",").alias("missing"))


_BANDROWS = " UNION ALL ".join(f"SELECT '{n.lower()}' AS band, '{a}' AS asset, CAST({g} AS DOUBLE) AS gsd, '{m}' AS resample"
                               for n, a, g, m in [*C.BANDS, C.MASK_BAND])


@query("a4_band_dim", f"""WITH {S.PX}, bd AS ({_BANDROWS}), lg AS ({' UNION ALL '.join(f"SELECT '{b}' AS band, {b} AS dn FROM px" for b in [*S.BANDS, 'scl'])})
  SELECT band, asset, gsd, resample, count(*) AS samples, CAST(max(dn) AS BIGINT) AS peak FROM lg JOIN bd USING (band) GROUP BY ALL""")
def a4_bands(spark, sf):
    px = B.px_obs(spark, sf)
    samples = px.unpivot(["scene", "row", "col"], [*B.BANDS5, "scl"], "band", "dn")
    per = samples.groupBy("band").agg(F.count(F.lit(1)).alias("samples"), F.max("dn").cast("long").alias("peak"))
    dim = C.band_dim(spark).select(F.lower("band").alias("band"), "asset", "gsd", "resample")
    return per.join(F.broadcast(dim), "band")


_AREAROWS = " UNION ALL ".join(f"SELECT '{k}' AS key, '{role}' AS role, {w} AS w, {s} AS s, {e} AS e, {n} AS n"
                               for k, _, role, w, s, e, n, _ in C.STUDY_AREAS)


@query("a4_area_dim", f"""WITH {SC}, ar AS ({_AREAROWS}) SELECT key, role, count(*) AS scenes FROM sc
  JOIN ar ON greatest(west, w) < least(west + 0.1, e) AND greatest(south, s) < least(south + 0.1, n) GROUP BY key, role""")
def a4_areas(spark, sf):
    # The dimension is the configured handful of areas, so it is broadcast.
    areas = C.area_dim(spark).select("key", "role", F.col("bbox").alias("aoi"))
    hit = scenes(spark, sf).join(F.broadcast(areas), Cat.intersects(F.col("bbox"), F.col("aoi")))
    return hit.groupBy("key", "role").agg(F.count(F.lit(1)).alias("scenes"))


@query("a11_bbox_geojson", f"""WITH {SC}, v AS (SELECT id, 8 + (id * 0) AS n, round(west, 1) AS w, round(south, 1) AS s, round(west + 0.1, 1) AS e,
   round(south + 0.1, 1) AS nn FROM sc)
  SELECT id, concat('{{"type":"Polygon","coordinates":[[[', w, ',', s, '],[', e, ',', s, '],[', e, ',', nn, '],[', w, ',', nn, '],[', w, ',', s, ']]]}}') AS geojson FROM v""")
def a11(spark, sf):
    r1 = lambda c: F.round(c, 1)
    box = F.struct(r1(F.col("west")).alias("west"), r1(F.col("south")).alias("south"),
                   r1(F.col("west") + 0.1).alias("east"), r1(F.col("south") + 0.1).alias("north"))
    return B.scenes(spark, sf).withColumn("b", box).select("id", GJ.bbox_polygon(F.col("b")).alias("geojson"))


# --- filters ----------------------------------------------------------------------

AOI = (30.75, 31.15, 31.05, 31.45)


@query("b3_bbox_intersects", f"""WITH {SC} SELECT id, {r(f'greatest(west, {AOI[0]})')} AS west, {r(f'least(west + 0.1, {AOI[2]})')} AS east,
  {r(f'greatest(south, {AOI[1]})')} AS south, {r(f'least(south + 0.1, {AOI[3]})')} AS north FROM sc
  WHERE greatest(west, {AOI[0]}) < least(west + 0.1, {AOI[2]}) AND greatest(south, {AOI[1]}) < least(south + 0.1, {AOI[3]})""")
def b3(spark, sf):
    aoi = F.struct(*[F.lit(v).alias(n) for n, v in zip(("west", "south", "east", "north"), AOI)])
    hit = scenes(spark, sf).where(Cat.intersects(F.col("bbox"), aoi)).withColumn("i", Cat.intersection(F.col("bbox"), aoi))
    return hit.select("id", *[rr(f"i.{n}", alias=n) for n in ("west", "east", "south", "north")])


@query("b4_date_window", f"""WITH {SC} SELECT id, strftime(acquired, '%Y-%m-%d') AS acquired FROM sc
  WHERE acquired BETWEEN DATE '1995-06-12' AND DATE '1995-06-18'""")
def b4(spark, sf):
    return Cat.date_window(B.scenes(spark, sf), "1995-06-15", 3).select("id", day("acquired"))


@query("b5_cloud_filter", f"WITH {SC} SELECT id, {r('cloud_cover')} AS cloud_cover FROM sc WHERE cloud_cover < 10")
def b5(spark, sf):
    return Cat.cloud_filter(B.scenes(spark, sf)).select("id", rr("cloud_cover"))


_AREAS = " UNION ALL ".join(f"SELECT '{k}' AS key, {w} AS w, {s} AS s, {e} AS e, {n} AS n"
                            for k, _, _, w, s, e, n, _ in C.STUDY_AREAS)


@query("c2_scenes_for_areas", f"""WITH {SC}, ar AS ({_AREAS}), dt AS (SELECT DISTINCT CAST(date_trunc('month', acquired) AS DATE) AS d FROM sc)
  SELECT ar.key AS area_key, strftime(dt.d, '%Y-%m-%d') AS target_date, sc.id, {r('greatest(west, w)')} AS overlap_west
  FROM sc JOIN ar ON greatest(west, w) < least(west + 0.1, e) AND greatest(south, s) < least(south + 0.1, n)
  JOIN dt ON sc.acquired BETWEEN dt.d - 3 AND dt.d + 3 WHERE cloud_cover < 60""")
def c2(spark, sf):
    s = scenes(spark, sf)
    areas = C.area_dim(spark)
    dates = s.select(F.trunc("acquired", "month").alias("target_date")).distinct() \
             .withColumn("key", F.explode(F.array(*[F.lit(a[0]) for a in C.STUDY_AREAS])))
    out = Cat.scenes_for_areas(s, areas, dates, 3, 60.0)
    return out.select("area_key", day("target_date"), "id", rr("overlap.west", alias="overlap_west"))


@query("d6_available_dates", f"""WITH {SC} SELECT area, strftime(acquired, '%Y-%m-%d') AS date, count(*) AS scenes,
  string_agg(DISTINCT grid_code, ',' ORDER BY grid_code) AS tiles, {r('min(cloud_cover)')} AS best_cloud_cover
  FROM sc GROUP BY area, acquired""")
def d6(spark, sf):
    out = Cat.available_dates(B.scenes(spark, sf), ["area"])
    return out.select("area", day("date"), "scenes", F.array_join("tiles", ",").alias("tiles"), rr("best_cloud_cover"))


for _period, _fmt in (("month", "%Y-%m"), ("day", "%Y-%m-%d")):
    def _best(spark, sf, _p=_period):
        out = Cat.best_per_period(B.scenes(spark, sf), _p, ["area"], seq="id")
        return out.select("area", "period", "id", rr("cloud_cover"))
    query(f"e2_best_per_{_period}", f"""WITH {SC} SELECT area, strftime(acquired, '{_fmt}') AS period, id, {r('cloud_cover')} AS cloud_cover FROM sc
      QUALIFY row_number() OVER (PARTITION BY area, strftime(acquired, '{_fmt}') ORDER BY cloud_cover ASC NULLS LAST, id) = 1""")(_best)


@query("e7_evenly_spaced", f"""WITH {SC}, d AS (SELECT DISTINCT area, acquired FROM sc),
  o AS (SELECT area, acquired, row_number() OVER (PARTITION BY area ORDER BY acquired) - 1 AS p, count(*) OVER (PARTITION BY area) AS n FROM d),
  k AS (SELECT area, n, unnest(range(0, 12)) AS i FROM (SELECT DISTINCT area, n FROM o))
  SELECT o.area, strftime(o.acquired, '%Y-%m-%d') AS acquired FROM o JOIN k ON k.area = o.area
    AND o.p = CAST(round_even(k.i * ((k.n - 1) / 11.0), 0) AS BIGINT)""")
def e7(spark, sf):
    from marshgrid.operators.tiles import evenly_spaced
    dates = B.scenes(spark, sf).select("area", "acquired").distinct()
    return evenly_spaced(dates, [F.col("acquired")], 12, ["area"]).select("area", day("acquired"))


@query("f2_order_scenes", f"""WITH {SC} SELECT id, strftime(acquired, '%Y-%m-%d') AS acquired, {r('coalesce(cloud_cover, 0)')} AS cloud FROM sc""")
def f2(spark, sf):
    return Cat.order_scenes(B.scenes(spark, sf)).select("id", day("acquired"), rr(F.coalesce("cloud_cover", F.lit(0.0)), alias="cloud"))


@query("f3_search_limit", f"""WITH {SC} SELECT id, strftime(acquired, '%Y-%m-%d') AS acquired, true AS truncated FROM sc
  ORDER BY acquired, id LIMIT 250""")
def f3(spark, sf):
    s = B.scenes(spark, sf)
    return Cat.search_limit(s, 250, [s["acquired"].asc(), s["id"].asc()]).select("id", day("acquired"), "truncated")


@query("h25_period_keys", f"""WITH {SC} SELECT id, strftime(acquired, '%Y-%m-%d') AS day, strftime(acquired, '%Y-%m') AS month,
  strftime(acquired, '%Y-%m-%dT00:00:00.000Z') AS utc FROM sc""")
def h25(spark, sf):
    a = F.col("acquired")
    return B.scenes(spark, sf).select("id", K.iso_day(a).alias("day"), K.month_key(a).alias("month"),
                                      K.iso_utc(a.cast("timestamp")).alias("utc"))


# --- grids over scene boxes -----------------------------------------------------------

def scene_boxes(spark, sf):
    s = B.spread(spark, scenes(spark, sf), "id")
    return s.select("id", "bbox", F.lit("EPSG:32636").alias("crs"))


@query("h11_grid_from_bbox")
def h11(spark, sf):
    g = Gr.grid_from_bbox(scene_boxes(spark, sf), 30)
    return g.select("id", "grid.gsd", "grid.x0", "grid.y0", "grid.width", "grid.height")


@query("h12_choose_grid")
def h12(spark, sf):
    g = Gr.choose_grid(scene_boxes(spark, sf), ["id"], 10, 256)
    return g.select("id", "grid.gsd", "grid.width", "grid.height")


@query("h13_window_for")
def h13(spark, sf):
    from marshgrid.functions import geo as G
    aoi = C.area_dim(spark).where(F.col("key") == "burullus").select(F.col("bbox"), "crs")
    grid = Gr.grid_from_bbox(aoi, 30).select("grid")
    from marshgrid.operators.scale import with_scalar
    s = with_scalar(scene_boxes(spark, sf), grid)
    b = F.col("bbox")
    box = G.hull_of_corners(b["west"], b["south"], b["east"], b["north"], F.lit(32636))
    s = s.withColumn("box", box).withColumn("w", G.window_for(F.col("grid"), F.col("box")))
    x, y = G.pixel_center(F.col("grid"), F.col("w.row_off"), F.col("w.col_off"))
    return s.select("id", "w.row_off", "w.col_off", "w.height", "w.width", rr(x, 3, "x"), rr(y, 3, "y"))


@query("h14_project_utm")
def h14(spark, sf):
    from marshgrid.functions import geo as G
    s = scenes(spark, sf)
    x, y = G.project_utm(F.col("west"), F.col("south"), F.lit(32636))
    p = s.select("id", "west", "south", x.alias("x"), y.alias("y"))
    lon, lat = G.unproject_utm(F.col("x"), F.col("y"), F.lit(32636))
    return p.select("id", rr("x", 3), rr("y", 3), rr(lon - F.col("west"), 9, "lon_error"),
                    rr(lat - F.col("south"), 9, "lat_error"))
