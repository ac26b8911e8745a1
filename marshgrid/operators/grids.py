"""Target grids of study areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid.functions import geo as G


def _with_hull(areas: DataFrame) -> DataFrame:
    """Add ``epsg`` and the projected envelope ``_hull`` of ``bbox``.

    ``inline`` makes the envelope a generated row, so it is computed once per area
    however many expressions read it afterwards.
    """
    code = G.epsg_of(F.col("crs"))
    epsg = F.when(G.is_utm(code), code).otherwise(
        F.raise_error(F.concat(F.lit("not a UTM CRS: "), F.coalesce("crs", F.lit("null")))).cast("int"))
    b = F.col("bbox")
    hull = G.hull_of_corners(b["west"], b["south"], b["east"], b["north"], F.col("epsg"))
    return areas.withColumn("epsg", epsg).select("*", F.inline(F.array(F.struct(hull.alias("_hull")))))


def _gridded(hulls: DataFrame, gsd: Column) -> DataFrame:
    snapped = hulls.withColumn("_snap", G.snap_bounds(F.col("_hull"), gsd))
    return snapped.withColumn("grid", G.grid_from_box(F.col("_snap"), gsd)).drop("_hull", "_snap")


def grid_from_bbox(areas: DataFrame, gsd) -> DataFrame:
    """Canonical snapped grid of each area row (``bbox``, ``crs``); ``gsd`` a number or Column."""
    gsd = F.lit(float(gsd)) if isinstance(gsd, (int, float)) else gsd
    return _gridded(_with_hull(areas), gsd)


def choose_grid(areas: DataFrame, key: list[str], gsd: float = 30.0, max_size: int = 2048) -> DataFrame:
    """Finest doubling of ``gsd`` (up to seven) whose grid fits; an area that never fits is an error."""
    tries = _with_hull(areas).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(7)))) \
                             .withColumn("_try", F.lit(float(gsd)) * F.pow(F.lit(2.0), F.col("_k")))
    grids = _gridded(tries, F.col("_try"))
    fits = F.greatest(F.col("grid.width"), F.col("grid.height")) <= max_size
    best = grids.groupBy(*key).agg(F.min_by(F.when(fits, F.col("grid")), F.when(fits, F.col("_k"))).alias("grid"),
                                   F.first("epsg").alias("epsg"))
    return best.withColumn("grid", F.when(F.col("grid").isNotNull(), F.col("grid")).otherwise(
        F.raise_error(F.lit(f"an area does not fit {max_size} px at any tried resolution"))
        .cast(best.schema["grid"].dataType)))
