"""Display colours as columns (red, green, blue, alpha)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions.pixels import clip, known

CHANNELS = ["red", "green", "blue"]


def _ramp(position: Column, anchors, channel: int) -> Column:
    """Piecewise-linear colour at a 0..1 position, truncated to an integer."""
    expr = F
    for (x0, c0), (x1, c1) in zip(anchors, anchors[1:]):
        y0, y1 = float(c0[channel]), float(c1[channel])
        expr = expr.when(position <= x1, F.lit(y0) + F.lit((y1 - y0) / (x1 - x0)) * (position - x0))
    return F.floor(expr.otherwise(F.lit(float(anchors[-1][1][channel])))).cast("int")


def colour_table(spark: SparkSession, index: str) -> DataFrame:
    """The 512-entry lookup table of an index."""
    anchors = C.COLOUR_ANCHORS.get(index, C.DEFAULT_ANCHORS)
    ids = spark.range(C.LUT_SIZE).select(F.col("id").cast("int").alias("slot"),
                                         (F.col("id") / float(C.LUT_SIZE - 1)).alias("x"))
    return ids.select("slot", *[_ramp(F.col("x"), anchors, i).alias(n) for i, n in enumerate(CHANNELS)])


def colormap_pixels(px: DataFrame, index: str, vmin: float | None = None, vmax: float | None = None,
                    alpha: int = 255, transparent_invalid: bool = True) -> DataFrame:
    """Colour an index column; missing values are transparent.

    The table is 512 rows whatever the input, so it is broadcast.
    """
    low, high = C.INDEX_RANGES.get(index, (0.0, 1.0))
    low, high = (low if vmin is None else float(vmin)), (high if vmax is None else float(vmax))
    if high <= low:
        raise ValueError(f"vmin {low} must be below vmax {high}")
    share = clip((F.col(index) - low) / (high - low))
    slot = F.coalesce(F.floor(share * (C.LUT_SIZE - 1)).cast("int"), F.lit(0))
    joined = px.withColumn("slot", slot).join(F.broadcast(colour_table(px.sparkSession, index)), "slot")
    hidden = 0 if transparent_invalid else alpha
    return joined.withColumn("alpha", F.when(F.col(index).isNotNull(), alpha).otherwise(hidden)).drop("slot")


def legend(spark: SparkSession, index: str) -> DataFrame:
    """Stops of the colour scale: value and hex colour."""
    low, high = C.INDEX_RANGES.get(index, (0.0, 1.0))
    rows = [(i, round(low + (high - low) * stop, 4), "#%02x%02x%02x" % colour)
            for i, (stop, colour) in enumerate(C.COLOUR_ANCHORS.get(index, C.DEFAULT_ANCHORS))]
    return spark.createDataFrame(rows, "position int, value double, colour string")


def truecolor_pixels(px: DataFrame, bands=("b04", "b03", "b02"), vmin: float = 0.0, vmax: float = 0.25,
                     gamma: float = 1.0) -> DataFrame:
    """Natural colour with a 1.35 gain; transparent where any band is missing."""
    missing = [b for b in bands if b not in px.columns]
    if missing:
        raise ValueError(f"true colour needs the bands {missing}")
    out = px
    for name, band in zip(CHANNELS, bands):
        value = clip((F.col(band) - vmin) / (vmax - vmin))
        if gamma != 1.0:
            value = F.pow(value, 1.0 / gamma)
        out = out.withColumn(name, F.coalesce(F.floor(clip(value * 1.35) * 255).cast("int"), F.lit(0)))
    return out.withColumn("alpha", F.when(known(*[F.col(b) for b in bands]), 255).otherwise(0))


def mask_pixels(px: DataFrame, mask: str, colour=(255, 60, 60), alpha: int = 170) -> DataFrame:
    """One translucent colour where a boolean column holds."""
    on = F.coalesce(F.col(mask), F.lit(False))
    return px.select("*", *[F.when(on, v).otherwise(0).alias(n)
                            for n, v in zip([*CHANNELS, "alpha"], [*colour, alpha])])


def class_rgba(px: DataFrame, label: str = "label", colours=None) -> DataFrame:
    """Opaque class colours; ignored pixels grey, unknown codes the nodata colour."""
    colours = C.FIGURE_COLOURS if colours is None else colours
    def channel(i):
        start = F.when(F.col(label) < 0, C.IGNORED_COLOUR[i])
        return reduce(lambda e, c: e.when(F.col(label) == c, colours[c][i]), colours, start) \
            .otherwise(C.NODATA_COLOUR[i])
    return px.select("*", *[channel(i).alias(n) for i, n in enumerate(CHANNELS)], F.lit(255).alias("alpha"))
