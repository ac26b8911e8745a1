"""Composites: mosaic, reflectance and indices in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.operators import raster, season


def composite(px: DataFrame, scenes: DataFrame, frame: DataFrame, bands: list[str], by: list[str],
              target: float = 0.999, indices=None, scl: str | None = "scl", **kw) -> DataFrame:
    """Clearest-first mosaic as reflectance plus spectral indices.

    Masking and winner selection run on stored integers; only the surviving pixels
    are converted.
    """
    masked = raster.mask_observations(px, bands, scl)
    won = raster.mosaic_clearest_first(masked, scenes, frame, bands, by, target, **kw)
    refl = raster.reflectance(won, bands).withColumn("valid", F.lit(True))
    return raster.with_indices(refl, bands, indices)


def season_composites(px: DataFrame, scenes: DataFrame, targets: DataFrame, frame: DataFrame, bands: list[str],
                      by: list[str], window_days: int = 3, target: float = 0.999, indices=None,
                      scl: str | None = "scl", **kw) -> DataFrame:
    """:func:`composite` for every area and target date at once (see ``operators/season.py``)."""
    masked = raster.mask_observations(px, bands, scl)
    won = season.season_mosaics(masked, scenes, targets, frame, bands, by, window_days, target, **kw)
    refl = raster.reflectance(won, bands).withColumn("valid", F.lit(True))
    return raster.with_indices(refl, bands, indices)


def composite_summary(comp: DataFrame, scenes: DataFrame, frame: DataFrame, by: list[str],
                      scene: str = "scene", bands: list[str] = (), indices: list[str] = ()) -> DataFrame:
    """One row per composite: candidate scenes, contributing scenes, coverage and warnings.

    Scene lists are as long as one composite's revisits.  ``bands`` are checked for negative
    reflectance, ``indices`` for those the bands cannot give.  A composite without a candidate
    keeps its row, with NULL lists.
    """
    negative = [F.when(F.col(b) < 0, 1).otherwise(0) for b in bands]
    used = comp.groupBy(*by, scene).agg(F.count(F.lit(1)).alias("px"), F.sum(sum(negative, F.lit(0))).alias("negatives"))
    per = used.groupBy(*by).agg(F.array_sort(F.collect_set(scene)).alias("contributing"),
                                F.sum("px").alias("valid_px"), F.sum("negatives").alias("negatives"))
    cand = scenes.groupBy(*by).agg(F.array_sort(F.collect_set(scene)).alias("candidates"))
    joined = frame.select(*by, "total_px").join(cand, by, "left").join(per, by, "left")
    share = F.coalesce("valid_px", F.lit(0)) / F.col("total_px")
    wrong = F.coalesce(F.col("negatives") / (F.col("valid_px") * max(1, len(bands))), F.lit(0.0))
    missing = [i for i in indices if i.lower() not in comp.columns]
    warnings = F.array(F.when(wrong > C.MAX_NEGATIVE_FRACTION, F.lit("negative reflectance: the archive's convention may have changed")),
                       F.lit(f"indices without their bands: {', '.join(missing)}" if missing else None),
                       F.when(share < 0.5, F.lit("coverage below one half")))
    return joined.select(*by, "candidates", "contributing", share.alias("coverage"), F.array_compact(warnings).alias("warnings"))
