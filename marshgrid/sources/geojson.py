"""GeoJSON text built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marshgrid.functions import geo as G
from marshgrid.functions.pixels import class_name


def polygon(points: Column) -> Column:
    """Polygon geometry from an open list of coordinate pairs; the ring is closed."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(G.close_ring(points)).alias("coordinates"))


def bbox_polygon(box: Column) -> Column:
    ring = G.bbox_ring(box["west"], box["south"], box["east"], box["north"])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                              properties.alias("properties")), {"ignoreNullFields": "false"})


def detection_feature(rings: Column) -> Column:
    """Feature of a detection row; hectares are NULL when the area is zero or unknown."""
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    area = F.col("area_m2")
    props = F.struct(
        "area_key", F.date_format("scene_date", "yyyy-MM-dd").alias("scene_date"), "class_code",
        class_name(F.col("class_code")).alias("class_name"), "confidence", "area_m2",
        F.when(area != 0, area / 10000.0).alias("area_ha"), "model_version")
    return feature(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")), props)
