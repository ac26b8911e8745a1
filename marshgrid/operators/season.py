"""Clearest-first composites of many target dates whose windows overlap.

A scene serves every target date within ``window_days`` of it, and the mosaic order of an
area's scenes is the same for all dates.  Which observation a pixel shows is therefore a
sliding-window minimum over its acquisitions.  An observation wins for the days of its own
window that no better observation's window holds.  All windows are equally long, so those
days are one interval between its nearest better neighbours before and after it.  Each
observation is shuffled once and leaves at most one row, whatever the number of dates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marshgrid.operators.raster import coverage_cut, rank_scenes

#: Pixels on a block's side; a block's observations over all dates are one group.
BLOCK = 32


def nearest_better(pixel: np.ndarray, day: np.ndarray, rank: np.ndarray, reach: int) -> np.ndarray:
    """Day of the nearest row before each that has its pixel and a smaller rank; -1 << 40: none within ``reach`` days.

    Rows are ordered by pixel and ``day``.  Each step looks one row further back for those
    still without an answer, at most as often as a pixel has observations within reach.
    """
    found = np.full(len(day), -1 << 40, dtype=np.int64)
    open_ = np.arange(len(day))
    back = 1
    while len(open_):
        open_ = open_[open_ >= back]
        at = open_ - back
        near = (pixel[at] == pixel[open_]) & (day[at] >= day[open_] - reach)
        open_, at = open_[near], at[near]
        better = rank[at] < rank[open_]
        found[open_[better]] = day[at[better]]
        open_ = open_[~better]
        back += 1
    return found


def winning_days(row, col, day, rank, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, first day, last day) of the observations that win on some day."""
    order = np.lexsort((rank, day, col, row))
    r, c, d, k = (x[order].astype(np.int64) for x in (row, col, day, rank))
    step = np.ones(len(r), dtype=np.int64)
    step[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    pixel = np.cumsum(step)
    first = np.maximum(d - window, nearest_better(pixel, d, k, 2 * window) + window + 1)
    # Seen backwards in time, the next better observation is the one before.
    after = -nearest_better(pixel[::-1], -d[::-1], k[::-1], 2 * window)[::-1]
    last = np.minimum(d + window, after - window - 1)
    won = first <= last
    return order[won], first[won], last[won]


def winners_by_day(px: DataFrame, scenes: DataFrame, bands: list[str], by: list[str], window_days: int = 3,
                   scene: str = "scene", size: int = BLOCK) -> DataFrame:
    """by..., row, col, ``scene``, rank, bands and the target days ``first_day`` to ``last_day`` it wins.

    ``px`` is masked (``valid``), with one row per (by, scene, row, col); ``scenes`` has
    by..., ``scene``, ``acquired`` and ``cloud``.  ``rank`` orders all scenes of an area.
    Scenes without a date and rows with a null in ``by`` serve no date.
    """
    if window_days < 0:
        raise ValueError("the window must be non-negative")
    if not by:
        raise ValueError("name the grouping columns of an area")
    dated = scenes.where(F.col("acquired").isNotNull())
    ranks = rank_scenes(dated, by, scene, bands).join(
        dated.select(*by, scene, F.unix_date(F.to_date("acquired")).alias("_day")), [*by, scene])
    ranked = (px.where("valid").select(*by, scene, "row", "col", *bands).join(ranks, [*by, scene])
              .withColumns({f"_b{c[0]}": F.floor(F.col(c) / float(size)).cast("int") for c in ("row", "col")}))
    schema = T.StructType([*[px.schema[b] for b in [*by, scene, "row", "col", *bands]], T.StructField("rank", T.IntegerType()),
                           T.StructField("first_day", T.DateType()), T.StructField("last_day", T.DateType())])
    arrow = to_arrow_schema(schema)
    kept = [*by, scene, "row", "col", *bands, "rank"]

    def intervals(block: pa.Table) -> pa.Table:
        at, first, last = winning_days(*(block.column(c).to_numpy() for c in ("row", "col", "_day", "rank")), window_days)
        out = block.select(kept).take(pa.array(at)).columns
        days = [pa.array(x.astype(np.int32)).cast(pa.date32()) for x in (first, last)]
        return pa.table([x.cast(f.type) for x, f in zip([*out, *days], arrow)], schema=arrow)

    return ranked.groupBy(*by, "_br", "_bc").applyInArrow(intervals, schema)


def on_dates(winners: DataFrame, targets: DataFrame, by: list[str], date: str = "target_date") -> DataFrame:
    """The winners of each wanted date: one row per pixel and date.

    Days are joined by equality; a winner has at most ``2 * window + 1`` of them and they
    meet the dates behind the shuffle.
    """
    days = winners.withColumn(date, F.explode(F.sequence("first_day", "last_day"))).drop("first_day", "last_day")
    return days.join(targets.select(*by, date).distinct(), [*by, date])


def season_mosaics(px: DataFrame, scenes: DataFrame, targets: DataFrame, frame: DataFrame, bands: list[str],
                   by: list[str], window_days: int = 3, target: float = 0.999, scene: str = "scene",
                   date: str = "target_date", size: int = BLOCK) -> DataFrame:
    """Clearest-first composite of every (area, date), each stopping at ``target`` coverage.

    ``targets`` has by... and ``date``, ``frame`` by... and ``total_px``.  The rows are those
    of one mosaic per date from the scenes in its window: by..., date, row, col, scene, bands.
    A date whose window holds no scene has none.
    """
    won = on_dates(winners_by_day(px, scenes, bands, by, window_days, scene, size), targets, by, date)
    group = [*by, date]
    frames = targets.select(*group).distinct().join(frame.select(*by, "total_px"), by)
    cuts = coverage_cut(won, frames, group, target, bands)
    stops = cuts.groupBy(*group).agg(F.coalesce(F.min("cut"), F.max("rank")).alias("_last"))
    return won.join(stops, group).where(F.col("rank") <= F.col("_last")).select(*group, "row", "col", scene, *bands)


def scenes_on_dates(scenes: DataFrame, targets: DataFrame, by: list[str], window_days: int = 3,
                    date: str = "target_date") -> DataFrame:
    """Every scene once per wanted date within ``window_days`` of it."""
    day = F.to_date("acquired")
    near = scenes.withColumn(date, F.explode(F.sequence(F.date_sub(day, window_days), F.date_add(day, window_days))))
    return near.join(targets.select(*by, date).distinct(), [*by, date])
