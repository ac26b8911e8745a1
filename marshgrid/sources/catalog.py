"""Landed catalogue records to the scene table.

Both normalisers take one JSON document per row, parse it once with a fixed
schema and stay row-local: no record ever meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import geo as G

STAC_ITEM = """
id string, collection string, bbox array<double>, geometry struct<type:string,coordinates:string>,
properties struct<datetime:string,platform:string,constellation:string,`eo:cloud_cover`:double,
  `proj:epsg`:int,`proj:code`:string,`grid:code`:string,`s2:mgrs_tile`:string,
  `processing:version`:string,`s2:processing_baseline`:string>,
assets map<string,struct<href:string,`raster:bands`:array<struct<scale:double,offset:double>>>>
"""

ODATA_PRODUCT = """
Id string, Name string, ContentDate struct<Start:string>,
GeoFootprint struct<type:string,coordinates:string>,
Attributes array<struct<Name:string,Value:string>>
"""

SCENE_COLUMNS = ["id", "acquired", "platform", "cloud_cover", "bbox", "assets", "epsg", "grid_code",
                 "scale", "offset", "remote_readable", "source", "extra"]


def read_stac(spark: SparkSession, path: str) -> DataFrame:
    """Scenes from files holding one STAC item per line."""
    return scenes_from_stac(spark.read.text(path), "value")


def read_odata(spark: SparkSession, path: str) -> DataFrame:
    """Scenes from files holding one product record per line."""
    return scenes_from_odata(spark.read.text(path), "value")


def _box(west, south, east, north) -> Column:
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"),
                    F.lit("EPSG:4326").alias("crs"))


def _ring_box(ring: Column) -> Column:
    """Envelope of a ring of coordinate arrays; NULL for an empty or missing ring."""
    xs, ys = F.transform(ring, lambda p: F.get(p, 0)), F.transform(ring, lambda p: F.get(p, 1))
    return F.when(F.size(ring) > 0, _box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def _ring0(coordinates: Column) -> Column:
    return F.get(F.from_json(coordinates, "array<array<array<double>>>"), 0)


def _filled(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(c != "", c)


def scenes_from_stac(items: DataFrame, json: str = "value") -> DataFrame:
    """STAC items as scenes; items without a known asset, a time or a footprint are dropped.

    The band contract is a fixed ten-plus-one entries, so it is written into the
    expression instead of being joined.
    """
    # ``inline`` keeps the parse below every later filter, so a record is parsed once.
    item = items.select(F.inline(F.array(F.from_json(json, STAC_ITEM))))
    bands = [(n, a) for n, a, _, _ in C.BANDS] + [(C.MASK_BAND[0], C.MASK_BAND[1])]
    have = {name: F.try_element_at("assets", F.lit(asset)) for name, asset in bands}
    pairs = F.filter(F.array(*[F.when(have[n].isNotNull(), F.struct(F.lit(n).alias("key"), have[n]["href"].alias("value")))
                               for n, _ in bands]), lambda e: e.isNotNull())
    p = F.col("properties")
    four = F.size("bbox") == 4
    given = F.when(four, _box(*[F.get("bbox", i) for i in range(4)]))
    box = F.coalesce(given, _ring_box(_ring0(F.col("geometry.coordinates"))))
    # The first contract band whose asset declares a scale decides both values.
    declared = [F.get(have[n]["raster:bands"], 0) for n in C.BANDS_8]
    first = F.coalesce(*[F.when(d["scale"].isNotNull(), F.struct(
        d["scale"].alias("scale"), F.coalesce(d["offset"], F.lit(0.0)).alias("offset"))) for d in declared])
    code = F.regexp_extract(F.coalesce(p["proj:code"], F.lit("")), r"(?i)^EPSG:\s*(\d+)\s*$", 1).try_cast("int")
    # Generated columns again: the closing filter reads them instead of repeating them.
    out = item.select(F.inline(F.array(F.struct(
        "id", F.try_to_timestamp(p["datetime"]).alias("acquired"),
        F.coalesce(_filled(p["platform"]), _filled(p["constellation"]), F.lit("unknown")).alias("platform"),
        p["eo:cloud_cover"].alias("cloud_cover"), box.alias("bbox"), F.map_from_entries(pairs).alias("assets"),
        F.coalesce(p["proj:epsg"], code).alias("epsg"),
        F.coalesce(_filled(p["grid:code"]), _filled(p["s2:mgrs_tile"])).alias("grid_code"),
        F.coalesce(first["scale"], F.lit(C.REFLECTANCE_SCALE)).alias("scale"),
        F.coalesce(first["offset"], F.lit(C.DECLARED_OFFSET)).alias("offset"),
        F.lit(True).alias("remote_readable"), F.lit("stac").alias("source"),
        F.create_map(F.lit("collection"), F.col("collection"), F.lit("processing_baseline"),
                     F.coalesce(_filled(p["processing:version"]), _filled(p["s2:processing_baseline"]))).alias("extra")))))
    return out.where((F.size("assets") > 0) & F.col("acquired").isNotNull() & F.col("bbox").isNotNull())


def stac_rejects(items: DataFrame, json: str = "value") -> DataFrame:
    """Counts of items that cannot become scenes: records, broken JSON, times that cannot be read."""
    item = items.select(F.inline(F.array(F.struct(F.col(json).alias("raw"), F.from_json(json, STAC_ITEM).alias("item")))))
    time = F.col("item.properties")["datetime"]
    return item.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("item.id").isNull()).alias("broken_json"),
                    F.count_if(time.isNotNull() & F.try_to_timestamp(time).isNull()).alias("bad_datetime"))


def mgrs_from_name(name: Column) -> Column:
    """First five-character token of two digits and three letters."""
    return F.get(F.filter(F.split(name, "_"), lambda t: t.rlike("^[0-9]{2}[A-Za-z]{3}$")), 0)


def scenes_from_odata(products: DataFrame, json: str = "value") -> DataFrame:
    """Archive products as scenes; rows without id, date or ring are dropped."""
    item = products.select(F.inline(F.array(F.from_json(json, ODATA_PRODUCT))))
    clouds = F.filter(F.coalesce("Attributes", F.array()), lambda a: a["Name"] == "cloudCover")
    # The last attribute of that name wins.
    cloud = F.try_element_at(clouds, F.lit(-1))["Value"].try_cast("double")
    out = item.select(
        _filled(F.col("Id")).alias("id"), F.try_to_timestamp("ContentDate.Start").alias("acquired"),
        F.coalesce(_filled(F.substring(F.coalesce("Name", F.lit("")), 1, 3)), F.lit("unknown")).alias("platform"),
        cloud.alias("cloud_cover"), _ring_box(_ring0(F.col("GeoFootprint.coordinates"))).alias("bbox"),
        F.create_map().cast("map<string,string>").alias("assets"), F.lit(32636).alias("epsg"),
        mgrs_from_name(F.coalesce("Name", F.lit(""))).alias("grid_code"),
        F.lit(C.REFLECTANCE_SCALE).alias("scale"), F.lit(C.DECLARED_OFFSET).alias("offset"),
        F.lit(False).alias("remote_readable"), F.lit("cdse").alias("source"),
        F.create_map(F.lit("name"), F.col("Name")).alias("extra"))
    return out.where(F.col("id").isNotNull() & F.col("acquired").isNotNull() & F.col("bbox").isNotNull())


def resolve_archive_assets(listing: DataFrame, by=("scene_id",)) -> DataFrame:
    """Archive member listings (by..., archive, position, member) to band assets.

    The first member in listing order wins per band.  ``missing`` lists required
    bands not found; :func:`require_assets` turns that into an error.  Members that match meet once, in one
    row an archive; a listing that is already laid out by ``by`` is not exchanged at all.
    """
    # The contract is eleven rows, so matching is a row-local explode, not a join.
    bands = [(n, int(g)) for n, _, g, _ in C.BANDS] + [(C.MASK_BAND[0], int(C.MASK_BAND[2]))]
    names = F.array(*[F.lit(n) for n, _ in bands])
    member, filename = F.col("member"), F.col("filename")
    # The explode of one element keeps the file name from being spelt out for every band.
    images = listing.where(member.endswith(".jp2")).select(
        *by, "archive", "position", "member", F.explode(F.array(F.substring_index(member, "/", -1))).alias("filename"))
    matches = [F.when(member.contains(f"/R{gsd}m/") & (filename.contains(f"_{name}_") | filename.startswith(f"{name}_")), F.lit(i))
               for i, (name, gsd) in enumerate(bands)]
    found = images.select(*by, "archive", "position", "member", F.explode(F.array(*matches)).alias("band")).where(F.col("band").isNotNull())
    hits = found.groupBy(*by).agg(F.collect_list(F.struct(
        "band", F.col("position").isNull().alias("unplaced"), "position", "archive", "member")).alias("hits"))

    def first(h):
        kept = F.filter(h, lambda x, i: (i == 0) | (x["band"] != F.get(h, i - 1)["band"]))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(
            F.get(names, x["band"]).alias("band"), F.concat(x["archive"], F.lit("!/"), x["member"]).alias("href"))))

    # A generator again: the map is read by two columns.
    per = hits.select(*by, F.explode(F.array(G.let(F.sort_array("hits"), first))).alias("assets"))
    everyone = listing.select(*by).distinct()
    joined = everyone.join(per, list(by), "left").withColumn(
        "assets", F.coalesce("assets", F.create_map().cast("map<string,string>")))
    required = F.array(*[F.lit(b) for b in C.BANDS_8])
    return joined.withColumn("missing", F.array_except(required, F.map_keys("assets")))


def require_assets(resolved: DataFrame) -> DataFrame:
    """Fail at run time on any archive that lacks a required band."""
    lacking = F.concat(F.lit("archive lacks required bands "), F.array_join("missing", ", "))
    return resolved.withColumn("assets", F.when(F.size("missing") == 0, F.col("assets")).otherwise(
        F.raise_error(lacking).cast("map<string,string>")))
