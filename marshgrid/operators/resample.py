"""Bringing samples of another resolution onto the target grid.

The ratio between the two grids is an integer factor; ``warp`` takes any two grids.
Interpolation runs in blocks with a halo, rows first and columns then, so a sample moves
once and no pixel is multiplied by the kernel's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.operators import warp as W


def _check(method: str, categorical: bool) -> None:
    if method not in C.VALID_RESAMPLE:
        raise ValueError(f"resample {method!r} is not one of {C.VALID_RESAMPLE}")
    if categorical and method not in ("nearest", "mode"):
        raise ValueError("class codes cannot be interpolated; use nearest")


def upsample(px: DataFrame, values: list[str], factor: int, method: str, by: list[str],
             height: str = "height", width: str = "width", categorical: bool = False) -> DataFrame:
    """Finer grid by ``factor``; ``height`` and ``width`` are the source extent columns.

    Missing neighbours drop out and the remaining weights are renormalised.
    """
    _check(method, categorical)
    k = int(factor)
    if method == "nearest":
        steps = F.sequence(F.lit(0), F.lit(k - 1))
        out = px.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
        return out.select(*by, (F.col("row") * k + F.col("_i")).alias("row"),
                          (F.col("col") * k + F.col("_j")).alias("col"), *values)
    if method not in ("bilinear", "cubic"):
        raise ValueError(f"{method} does not apply to upsampling")
    # The finer grid shares the origin; only the frame's extent is read from the samples' columns.
    extents = px.groupBy(*by).agg(F.max(height).alias("_h"), F.max(width).alias("_w"))
    zone = 32601  # both grids share it, so it is never used
    frames = extents.select(*by, W.grid(1.0, 0.0, 0.0, F.col("_h"), F.col("_w"), zone).alias("src"),
                            W.grid(1.0 / k, 0.0, 0.0, F.col("_h") * k, F.col("_w") * k, zone).alias("dst"))
    return W.warp(px, frames, values, by, method)


def downsample(px: DataFrame, values: list[str], factor: int, method: str, by: list[str],
               categorical: bool = False) -> DataFrame:
    """Coarser grid by ``factor``: nearest (centre sample), average or mode (lowest value wins ties)."""
    _check(method, categorical)
    k = int(factor)
    row, col = F.floor(F.col("row") / float(k)).cast("int"), F.floor(F.col("col") / float(k)).cast("int")
    keys = [*by, row.alias("row"), col.alias("col")]
    if method == "average":
        return px.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    if method == "nearest":
        centre = math.floor(k / 2)
        return px.where((F.pmod("row", F.lit(k)) == centre) & (F.pmod("col", F.lit(k)) == centre)) \
                 .select(*keys, *values)
    if method == "mode":
        out = None
        for v in values:
            # At most factor * factor distinct values meet in one target pixel.
            tally = px.where(F.col(v).isNotNull()).groupBy(*keys, F.col(v).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
            best = tally.groupBy(*by, "row", "col").agg(F.max(F.struct(F.col("_n"), -F.col("_v"))).alias("_m"))
            one = best.select(*by, "row", "col", (-F.col("_m.col2")).alias(v))
            out = one if out is None else out.join(one, [*by, "row", "col"], "full")
        return out
    raise ValueError(f"{method} does not apply to downsampling")
