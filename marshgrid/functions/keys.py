"""Names and keys of tiles, mosaics and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_name(row: Column, col: Column) -> Column:
    return F.concat(F.lit("r"), row.cast("string"), F.lit("_c"), col.cast("string"))


def store_key(date: Column, row: Column, col: Column, area: Column | None = None) -> Column:
    """Tile key inside a store, prefixed by date (and area) so two of them never collide."""
    lead = [] if area is None else [area]
    return F.concat_ws("/", *lead, date.cast("string"), F.lit("c0"), tile_name(row, col))


def _grid_part(crs: Column, gsd: Column) -> Column:
    res = F.regexp_replace(F.format_string("%.6f", gsd.cast("double")), r"\.?0+$", "")
    return F.concat(crs, F.lit("/"), res, F.lit("x"), res)


def tile_key(date: Column, crs: Column, gsd: Column, size: Column, row: Column, col: Column,
             bands: list[str] | None = None) -> Column:
    """Identity of one tile: same position at another resolution is another tile."""
    parts = [F.lit("tile"), F.date_format(date, "yyyy-MM-dd"), _grid_part(crs, gsd),
             F.concat(F.lit("s"), size.cast("string")), tile_name(row, col)]
    if bands:
        parts.append(F.lit("+".join(bands)))
    return F.concat_ws("/", *parts)


def mosaic_key(date: Column, crs: Column, gsd: Column, width: Column, height: Column,
               bands: list[str], suffix: str = "") -> Column:
    shape = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    body = F.concat_ws("/", F.lit("mosaic"), F.date_format(date, "yyyy-MM-dd"), _grid_part(crs, gsd),
                       shape, F.lit("+".join(bands)))
    return F.concat(body, F.lit(suffix))


def safe_name(key: Column) -> Column:
    """File-system friendly form of a key."""
    return F.replace(key, F.lit("/"), F.lit("__"))


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def iso_utc(ts: Column) -> Column:
    """RFC 3339 text in UTC (the session time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.'000Z'")
