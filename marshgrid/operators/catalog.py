"""Scene catalogue: filters, joins with areas and dates, ordering, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import keys as K
from marshgrid.functions.pixels import index_names

DEFAULT_MAX_CLOUD = 10.0


def has_bands(scenes: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Scenes carrying every required band (the eight and the mask by default)."""
    required = C.required_bands() if required is None else required
    missing = F.array_except(F.array(*[F.lit(b) for b in required]), F.map_keys("assets"))
    return scenes.where(F.size(missing) == 0)


def select_bands(px: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Project bands in the requested order; a missing band is an error."""
    missing = [b for b in bands if b not in px.columns]
    if missing:
        raise ValueError(f"bands {missing} are not in the table, which holds "
                         f"{[c for c in px.columns if c not in keys]}")
    return px.select(*keys, *bands)


def resolve_bands(bands: list[str] | None, indices: list[str]) -> list[str]:
    """Bands to read: an explicit list as given, else only those the indices need."""
    if bands is not None:
        return list(bands)
    known = {n for n, _, _ in C.INDICES}
    wanted = [n for n in index_names([i for i in indices if i.lower() in known])]
    needed = {b for n, first, second in C.INDICES if n in wanted for b in (first, second)}
    return [b for b in C.BANDS_8 if b in needed] or list(C.BANDS_8)


def intersects(a: Column, b: Column) -> Column:
    """Strict overlap of two boxes: touching edges are disjoint."""
    return ((F.greatest(a["west"], b["west"]) < F.least(a["east"], b["east"]))
            & (F.greatest(a["south"], b["south"]) < F.least(a["north"], b["north"])))


def intersection(a: Column, b: Column) -> Column:
    return F.when(intersects(a, b), F.struct(
        F.greatest(a["west"], b["west"]).alias("west"), F.greatest(a["south"], b["south"]).alias("south"),
        F.least(a["east"], b["east"]).alias("east"), F.least(a["north"], b["north"]).alias("north")))


def in_window(acquired: Column, target: Column, window_days: int) -> Column:
    """Whole days within ``window_days`` of the target, both ends included."""
    return ((acquired >= F.date_sub(target, window_days).cast("timestamp"))
            & (acquired < F.date_add(target, window_days + 1).cast("timestamp")))


def date_window(scenes: DataFrame, target: str, window_days: int = 3) -> DataFrame:
    """Scenes around one day; the bounds are literals, so they push to the scan."""
    day = F.to_date(F.lit(target))
    lo, hi = F.date_sub(day, window_days), F.date_add(day, window_days + 1)
    return scenes.where((F.col("acquired") >= lo) & (F.col("acquired") < hi))


def cloud_filter(scenes: DataFrame, max_cloud: float | None = DEFAULT_MAX_CLOUD) -> DataFrame:
    """Strictly below the limit; an unknown cloud share fails any limit."""
    return scenes if max_cloud is None else scenes.where(F.col("cloud_cover") < max_cloud)


def scenes_for_areas(scenes: DataFrame, areas: DataFrame, dates: DataFrame, window_days: int = 3,
                     max_cloud: float | None = None, required: list[str] | None = None,
                     cell_deg: float = 1.0) -> DataFrame:
    """Scenes usable for each (area, target date): box overlap, date window, cloud, bands.

    The two range conditions become equalities first: boxes are cut into degree
    cells and every target day into the days of its window, so the join hashes on
    (cell, day) and neither side has to be small.
    """
    usable = cloud_filter(scenes, max_cloud)
    if "assets" in scenes.columns:
        usable = has_bands(usable, required)
    left = usable.withColumn("_day", F.to_date("acquired")).withColumn("_cell", _cells(F.col("bbox"), cell_deg)) \
                 .withColumn("_cell", F.explode("_cell"))
    targets = areas.select(F.col("key").alias("area_key"), F.col("bbox").alias("area_bbox")) \
        .join(dates.withColumnRenamed("key", "area_key"), "area_key")
    right = targets.withColumn("_day", F.explode(F.sequence(F.date_sub("target_date", window_days),
                                                            F.date_add("target_date", window_days)))) \
                   .withColumn("_cell", F.explode(_cells(F.col("area_bbox"), cell_deg)))
    box = F.col("bbox")
    area = F.col("area_bbox")
    # A pair sharing several cells is kept only in the cell of its intersection's corner.
    corner = F.struct(F.floor(F.greatest(box["west"], area["west"]) / cell_deg).cast("int").alias("x"),
                      F.floor(F.greatest(box["south"], area["south"]) / cell_deg).cast("int").alias("y"))
    joined = left.join(right, ["_day", "_cell"]).where(intersects(box, area) & (F.col("_cell") == corner))
    return joined.withColumn("overlap", intersection(box, area)).drop("_day", "_cell")


def _cells(box: Column, side: float) -> Column:
    xs = F.sequence(F.floor(box["west"] / side).cast("int"), F.floor(box["east"] / side).cast("int"))
    ys = F.sequence(F.floor(box["south"] / side).cast("int"), F.floor(box["north"] / side).cast("int"))
    return F.flatten(F.transform(xs, lambda x: F.transform(
        ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def available_dates(scenes: DataFrame, by: list[str], required: list[str] | None = None) -> DataFrame:
    """Per date: scene count, sorted distinct grid codes, clearest known cloud share.

    Scenes collapse to one row per grid code before the codes are listed, so the
    list is as long as the codes of one date, not its scenes.
    """
    usable = has_bands(scenes, required) if "assets" in scenes.columns else scenes
    day = F.to_date("acquired").alias("date")
    per = usable.groupBy(*by, day, F.nullif(F.col("grid_code"), F.lit("")).alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.min("cloud_cover").alias("cloud"))
    return per.groupBy(*by, "date").agg(
        F.sum("n").alias("scenes"), F.array_sort(F.collect_set("code")).alias("tiles"),
        F.min("cloud").alias("best_cloud_cover")).orderBy(*by, "date")


def best_per_period(scenes: DataFrame, period: str = "month", by: list[str] | None = None,
                    required: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Least cloudy scene per month or day; NULL cloud last, first seen wins ties.

    ``min_by`` combines on the map side, so a crowded month is not sorted in one task.
    """
    if period not in ("month", "day"):
        raise ValueError(f"unknown period {period!r}; expected 'month' or 'day'")
    usable = has_bands(scenes, required) if "assets" in scenes.columns else scenes
    key = (K.month_key if period == "month" else K.iso_day)(F.col("acquired"))
    order = F.struct(F.col("cloud_cover").isNull(), F.coalesce("cloud_cover", F.lit(0.0)), F.col(seq))
    row = F.struct(*[F.col(c) for c in usable.columns])
    best = usable.groupBy(*(by or []), key.alias("period")).agg(F.min_by(row, order).alias("_b"))
    return best.select("period", "_b.*").orderBy(*(by or []), "period")


def order_scenes(scenes: DataFrame) -> DataFrame:
    """By acquisition, then cloud with unknown counted as zero."""
    return scenes.orderBy("acquired", F.coalesce("cloud_cover", F.lit(0.0)))


def search_limit(scenes: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """First ``limit`` scenes, each row saying whether the search was cut short.

    Takes ``limit + 1`` rows as a top-k and numbers only those.
    """
    top = scenes.orderBy(*order).limit(limit + 1)
    numbered = top.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    cut = F.max("_rn").over(Window.partitionBy()) > limit
    return numbered.withColumn("truncated", cut).where(F.col("_rn") <= limit).drop("_rn")
