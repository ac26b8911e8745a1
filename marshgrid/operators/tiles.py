"""Overlapping tiles: assignment, per-tile tallies, store summaries, model inputs.

Tile tallies never explode pixels.  Pixels are first added up in cells cut at the
edges of tiles only, whatever size and stride have in common, and the few cells are
sent to every tile that covers them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import keys as K
from marshgrid.functions import pixels as P
from marshgrid.operators.scale import global_rank, rank_within, with_scalar

N_CLASSES = len(C.CLASS_NAMES)
TALLIES = ["px", "usable_px", "trainable_px", "review_px",
           *[f"label_{c}_px" for c in range(N_CLASSES)], *[f"mask_{c}_px" for c in range(N_CLASSES)]]


def _starts(pos: Column, extent: Column, size: int, stride: int) -> Column:
    """Offsets of the full tiles that contain ``pos`` along one axis."""
    first = F.greatest(F.lit(0), F.ceil((pos + 1 - size) / F.lit(float(stride)))).cast("int")
    last = F.least(F.floor(pos / F.lit(float(stride))),
                   F.floor((extent - size) / F.lit(float(stride)))).cast("int")
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * stride))


def assign_tiles(px: DataFrame, size: int, stride: int | None = None, height: str = "height",
                 width: str = "width", row: str = "row", col: str = "col") -> DataFrame:
    """Send every pixel (or cell, by its start) to each full tile covering it.

    ``height`` and ``width`` name the grid extent columns.  Adds ``top``, ``left``
    and the block position; purely row-local, no exchange.
    """
    stride = stride or size
    tops = px.withColumn("top", F.explode(_starts(F.col(row), F.col(height), size, stride)))
    both = tops.withColumn("left", F.explode(_starts(F.col(col), F.col(width), size, stride)))
    return both.withColumn("block_row", F.floor(F.col("top") / float(size)).cast("int")) \
               .withColumn("block_col", F.floor(F.col("left") / float(size)).cast("int"))


def grid_tiles(grids: DataFrame, size: int, stride: int | None = None, full_only: bool = True) -> DataFrame:
    """Tile table of every grid row (``height``, ``width``), row-major; ragged tiles on request."""
    stride = stride or size
    def offsets(extent):
        limit = F.col(extent) - size if full_only else F.col(extent) - 1
        return F.when(limit >= 0, F.sequence(F.lit(0), limit.cast("int"), F.lit(stride)))
    return (grids.withColumn("top", F.explode(offsets("height")))
            .withColumn("left", F.explode(offsets("width")))
            .withColumn("tile_height", F.least(F.lit(size), F.col("height") - F.col("top")))
            .withColumn("tile_width", F.least(F.lit(size), F.col("width") - F.col("left"))))


def full_tile_count(height: Column, width: Column, size: int) -> Column:
    return F.floor(height / float(size)) * F.floor(width / float(size))


def with_mask(labelled: DataFrame) -> DataFrame:
    """Training mask: the label where trainable, -1 elsewhere."""
    return labelled.withColumn("mask", F.when(F.col("trainable"), F.col("label")).otherwise(F.lit(C.IGNORE)))


def tile_tallies(labelled: DataFrame, by: list[str], size: int, stride: int | None = None) -> DataFrame:
    """Per tile: pixels, usable, trainable, review, label and mask counts per class.

    ``labelled`` carries label, usable, review, trainable, height and width.
    """
    stride = stride or size
    src = with_mask(labelled)
    cells = (src.groupBy(*by, cell_start(F.col("row"), size, stride).alias("row"),
                         cell_start(F.col("col"), size, stride).alias("col"))
             .agg(F.max("height").alias("height"), F.max("width").alias("width"),
                  F.count(F.lit(1)).alias("px"), F.count_if("usable").alias("usable_px"),
                  F.count_if("trainable").alias("trainable_px"), F.count_if("review").alias("review_px"),
                  *[F.count_if(F.col("label") == c).alias(f"label_{c}_px") for c in range(N_CLASSES)],
                  *[F.count_if(F.col("mask") == c).alias(f"mask_{c}_px") for c in range(N_CLASSES)]))
    tiles = assign_tiles(cells, size, stride)
    return tiles.groupBy(*by, "top", "left").agg(*[F.sum(t).alias(t) for t in TALLIES])


def all_tiles(frames: DataFrame, tallies: DataFrame, by: list[str], size: int,
              stride: int | None = None) -> DataFrame:
    """Every full tile of every frame with its tallies, zero where nothing was observed."""
    grid = grid_tiles(frames.select(*by, "height", "width"), size, stride).select(*by, "top", "left")
    return grid.join(tallies, [*by, "top", "left"], "left").fillna(0, TALLIES)


def drop_empty_tiles(tallies: DataFrame) -> DataFrame:
    """Tiles whose labels (not the gated mask) hold at least one reed pixel."""
    return tallies.where(F.col(f"label_{C.REED}_px") > 0)


def drop_empty_tile_pixels(tile_px: DataFrame, tallies: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of the tiles kept by :func:`drop_empty_tiles`."""
    return tile_px.join(drop_empty_tiles(tallies).select(*by, "top", "left"), [*by, "top", "left"], "left_semi")


def tile_inputs(tile_px: DataFrame, bands: list[str]) -> DataFrame:
    """Model inputs: missing band values 0, gated mask, ungated label, usable and review."""
    drop = {*bands, "label", "mask"}
    keep = [c for c in tile_px.columns if c not in drop]
    src = with_mask(tile_px)
    return src.select(*keep, *[F.coalesce(P.nan_to_null(F.col(b).cast("double")), F.lit(0.0)).alias(b)
                               for b in bands], "mask", F.col("label").alias("rule_label"))


# --- store-level tallies --------------------------------------------------------

def shard_counts(tallies: DataFrame, date: str = "date") -> DataFrame:
    """Per-date shard rows plus the store total (NULL date) in one rollup."""
    return tallies.rollup(date).agg(
        F.count(F.lit(1)).alias("tiles"),
        *[F.sum(f"mask_{c}_px").alias(f"class_{c}") for c in range(N_CLASSES)],
        F.sum("trainable_px").alias("trainable_px"),
        F.sum("usable_px").alias("tile_usable_px"), F.sum("review_px").alias("tile_review_px"))


def unique_ground(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Usable and review pixels counted once per date on the composite grid."""
    return labelled.groupBy(*by).agg(F.count_if("usable").alias("usable_px"),
                                     F.count_if("review").alias("review_px"))


def class_balance(tallies: DataFrame, subset: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Pixels and share per class over the chosen tiles (all by default)."""
    src = tallies if subset is None else tallies.join(subset.select(*on).distinct(), on, "left_semi")
    sums = src.agg(*[F.coalesce(F.sum(f"mask_{c}_px"), F.lit(0)).alias(f"c{c}") for c in range(N_CLASSES)])
    total = sum((F.col(f"c{c}") for c in range(1, N_CLASSES)), F.col("c0"))
    pairs = F.array(*[F.struct(F.lit(c).alias("class_code"), F.col(f"c{c}").alias("px"))
                      for c in range(N_CLASSES)])
    rows = sums.select(total.alias("total_px"), F.inline(pairs))
    share = F.when(F.col("total_px") > 0, F.round(F.col("px") / F.col("total_px"), 6)).otherwise(0.0)
    return rows.select("class_code", P.class_name(F.col("class_code")).alias("class_name"), "px",
                       share.alias("fraction"), "total_px")


WEIGHT_SCHEMES = ("inverse_frequency", "sqrt_inverse", "uniform")


def class_weight_table(balance: DataFrame, schemes=WEIGHT_SCHEMES) -> DataFrame:
    """Loss weights of every scheme as a column: clipped to [.05, 50], mean one.

    The class counts are a handful of rows: one aggregate turns them into an array, and
    all schemes are computed on it.
    """
    unknown = [x for x in schemes if x not in WEIGHT_SCHEMES]
    if unknown:
        raise ValueError(f"unknown class weighting scheme {unknown[0]!r}")
    n = F.when(F.col("px") == 0, 1.0).otherwise(F.col("px").cast("double"))
    one = balance.agg(F.sort_array(F.collect_list(F.struct("class_code", n.alias("n")))).alias("c"))
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
    one = one.select("c", add(F.col("c.n")).alias("s"), F.size("c").alias("k"))
    def raw(scheme, x):
        base = F.col("s") / (x["n"] * F.col("k"))
        return P.clip({"inverse_frequency": base, "sqrt_inverse": F.sqrt(base), "uniform": F.lit(1.0)}[scheme], 0.05, 50.0)
    one = one.select("k", F.transform("c", lambda x: F.struct(x["class_code"].alias("class_code"), *[raw(w, x).alias(w) for w in schemes])).alias("w"))
    means = [(add(F.col(f"w.{w}")) / F.col("k")).alias(f"m_{w}") for w in schemes]
    return one.select("w", *means).select(F.inline(F.transform("w", lambda x: F.struct(
        x["class_code"].alias("class_code"), *[(x[w] / F.col(f"m_{w}")).alias(w) for w in schemes]))))


def class_weights(balance: DataFrame, scheme: str = "inverse_frequency") -> DataFrame:
    """Loss weights from the class counts under one scheme."""
    return class_weight_table(balance, [scheme]).withColumnRenamed(scheme, "weight")


def linspace_positions(total: int, limit: int) -> list[int]:
    """Truncated, evenly spread positions of ``min(limit, total)`` items (``limit`` is small)."""
    k = min(limit, total)
    if k <= 1:
        return [0] * k
    step = (total - 1) / (k - 1)
    return [total - 1 if i == k - 1 else int(i * step) for i in range(k)]


def linspace_sample(items: DataFrame, order: list[Column], limit: int, by: list[str] | None = None) -> DataFrame:
    """Keep ``min(limit, n)`` items at truncated linspace positions of the order."""
    by = by or []
    if limit < 1:
        raise ValueError("limit must be positive")
    ranked = rank_within(items, by, order, "_rn")
    total = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = ranked.join(total, by) if by else with_scalar(ranked, total)
    k = F.least(F.lit(limit), F.col("_n"))
    step = (F.col("_n") - 1) / F.when(k > 1, k - 1).otherwise(1).cast("double")
    pos = F.col("_rn") - 1
    # Position p is picked when some i has trunc(i * step) = p; only two i can qualify.
    i = F.ceil(pos / F.when(step > 0, step).otherwise(1.0))
    def hit(j):
        at = F.when(j == k - 1, F.col("_n") - 1).otherwise(F.floor(j * step))
        return (j >= 0) & (j <= k - 1) & (at == pos)
    keep = F.when(k >= F.col("_n"), True).when(k == 1, pos == 0).otherwise(hit(i - 1) | hit(i) | hit(i + 1))
    return sized.where(keep).withColumn("position", pos).drop("_rn", "_n")


def evenly_spaced(items: DataFrame, order: list[Column], count: int, by: list[str] | None = None) -> DataFrame:
    """Pick ``count`` items spread over the order: all if few, the middle one if one."""
    by = by or []
    ranked = rank_within(items, by, order, "_rn")
    total = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = ranked.join(total, by) if by else with_scalar(ranked, total)
    n, pos = F.col("_n"), F.col("_rn") - 1
    if count == 1:
        keep = pos == F.floor(n / 2)
    else:
        step = (n - 1) / F.lit(float(count - 1))
        i = F.rint(pos / F.when(step > 0, step).otherwise(1.0))
        def hit(j):
            return (j >= 0) & (j <= count - 1) & (F.rint(j * step) == pos)
        keep = hit(i - 1) | hit(i) | hit(i + 1)
    return sized.where((n <= count) | keep).withColumn("position", pos).drop("_rn", "_n")


def cell_start(pos: Column, size: int, stride: int) -> Column:
    """The last tile edge at or before ``pos`` along one axis.

    Tiles begin at ``k * stride`` and end at ``k * stride + size``.  No edge lies inside a cell that is
    cut at both, so a cell is in a tile or out of it as a whole.
    """
    begins = F.floor(pos / F.lit(float(stride))) * stride
    ends = F.floor((pos - size) / F.lit(float(stride))) * stride + size
    return F.greatest(begins, ends).cast("int")


def with_cells(px: DataFrame, size: int, stride: int) -> DataFrame:
    """Append ``_cr`` and ``_cc``, where the cell of ``row`` and ``col`` starts."""
    return px.withColumn("_cr", cell_start(F.col("row"), size, stride)) \
             .withColumn("_cc", cell_start(F.col("col"), size, stride))


def tile_cells(tiles: DataFrame, size: int, stride: int) -> DataFrame:
    """One row for every cell of every tile: at most ``2 * ceil(size / stride)`` an axis, whatever their sizes."""
    offsets = sorted({*range(0, size, stride), *range(size % stride, size, stride)})
    starts = F.array(*[F.lit(o) for o in offsets])
    def cell(edge):
        return F.explode(F.transform(starts, lambda o: F.col(edge) + o))
    return tiles.withColumn("_cr", cell("top")).withColumn("_cc", cell("left"))


def tile_cover(tiles: DataFrame, by: list[str], size: int, stride: int, keep: list[str] | None = None) -> DataFrame:
    """How many of the given tiles cover each cell, apart for every value of the tile columns ``keep``."""
    return tile_cells(tiles, size, stride).groupBy(*by, "_cr", "_cc", *(keep or [])).agg(F.count(F.lit(1)).alias("cover"))


def covered_pixels(px: DataFrame, tiles: DataFrame, by: list[str], size: int, stride: int,
                   keep: list[str] | None = None) -> DataFrame:
    """Pixels inside the tiles with ``cover``, the number of tiles over each, apart for every value of ``keep``."""
    cover = tile_cover(tiles, by, size, stride, keep)
    return with_cells(px, size, stride).join(cover, [*by, "_cr", "_cc"]).drop("_cr", "_cc")


def distinct_pixels(px: DataFrame, tiles: DataFrame, values: list[str], by: list[str], size: int, stride: int,
                    counted: str) -> DataFrame:
    """The different combinations of ``values`` among the ``counted`` pixels of the tiles, with their number ``n``.

    A pixel counts once for every tile over it.  Stored bands are 16-bit integers, so equal pixels are many; they
    combine on the map side, and what is left is never more than the pixels.  The condition is summed and no
    filter, for the reason given in :func:`band_statistics`.
    """
    seen = covered_pixels(px.select(*by, "row", "col", counted, *values), tiles, by, size, stride)
    return seen.groupBy(*values).agg(F.sum(F.when(F.col(counted), F.col("cover"))).alias("n")).where(F.col("n") > 0)


def split_pixels(px: DataFrame, tiles: DataFrame, bands: list[str], by: list[str], size: int, stride: int) -> DataFrame:
    """The different pixels of every split: label, usable, trainable and bands, with their number ``n``.

    A pixel counts once for every tile of the split over it.  Training, its statistics and weights, and the scores
    of every split are sums over these rows, so the pixels themselves are read once for all of them.
    """
    values = ["label", "usable", "trainable", *bands]
    placed = tiles.where(F.col("split").isNotNull())
    seen = covered_pixels(px.select(*by, "row", "col", *values), placed, by, size, stride, ["split"])
    return seen.groupBy("split", *values).agg(F.sum("cover").alias("n"))


def tiles_over_pixels(px: DataFrame, tiles: DataFrame, by: list[str], size: int, stride: int) -> DataFrame:
    """The pixels inside the tiles, each once, with ``tiles``: the tiles over it (the columns besides ``by``).

    At most ``ceil(size / stride)`` squared tiles are over a pixel.  Pixels are exchanged here: what made them and
    what follows, labels for one, are too large for the compiler as one method, which a broadcast would leave.
    """
    rest = [c for c in tiles.columns if c not in by]
    cells = tile_cells(tiles, size, stride).groupBy(*by, "_cr", "_cc").agg(F.collect_list(F.struct(*rest)).alias("tiles"))
    return with_cells(px, size, stride).join(cells.hint("merge"), [*by, "_cr", "_cc"]).drop("_cr", "_cc")


def pixels_of_tiles(px: DataFrame, tiles: DataFrame, by: list[str], size: int, stride: int) -> DataFrame:
    """The pixels of the given tiles, one row per (tile, pixel) with the tile's columns.

    Pixels meet the cells of these tiles before they are repeated, so a short list of tiles costs one
    pass over the pixels.  A list of bounded length may be broadcast by the caller.
    """
    cells = tile_cells(tiles.drop("row", "col"), size, stride)
    return with_cells(px, size, stride).join(cells, [*by, "_cr", "_cc"]).drop("_cr", "_cc")


def band_statistics(px: DataFrame, tiles: DataFrame, bands: list[str], by: list[str], size: int,
                    stride: int | None = None, sample_limit: int | None = None, floor: float = 1e-4) -> DataFrame:
    """Mean and population deviation per band over usable pixels of the tiles.

    ``tiles`` is the supplied split (by..., top, left).  Pixels shared by overlapping
    tiles count once per tile, as they do when tiles are read one by one: a pixel is read
    once and weighted by the tiles over it.  ``sample_limit`` takes that many evenly
    spread tiles instead of all of them.
    """
    chosen = tiles.select(*by, "top", "left").distinct()
    if sample_limit is not None:
        order = [*[F.col(b) for b in by], F.col("top"), F.col("left")]
        chosen = linspace_sample(chosen, order, sample_limit).select(*by, "top", "left")
    step = stride or size
    # Pixels are added up in cells on the map side; only cells meet the tiles.  Missing bands are left out inside
    # the sums: as a filter the test is rewritten down to the stored integers, and a function that spells every
    # band out so often is too large to be compiled.
    known = P.known(*[F.col(b) for b in bands])
    # Deviations from a fixed middle value keep the two sums of the variance small.
    off = {b: F.when(known, F.col(b).cast("double") - 0.25) for b in bands}
    powers = {(b, k): off[b] if k == 1 else off[b] * off[b] for b in bands for k in (1, 2)}
    cells = (with_cells(px.where("usable").select(*by, "row", "col", *bands), size, step).groupBy(*by, "_cr", "_cc")
             .agg(F.count_if(known).alias("_px"), *[F.sum(v).alias(f"_{k}_{b}") for (b, k), v in powers.items()]))
    return _moments(cells.join(tile_cover(chosen, by, size, step), [*by, "_cr", "_cc"]), chosen, bands, floor)


def _moments(seen: DataFrame, tiles: DataFrame, bands: list[str], floor: float) -> DataFrame:
    """Mean and deviation per band of rows with ``cover``, ``_px`` and the two sums of every band."""
    n = F.nullif(F.sum(F.col("cover") * F.col("_px")), F.lit(0))
    def moment(b, k):
        return F.sum(F.col("cover") * F.col(f"_{k}_{b}")) / n
    stats = seen.agg(F.coalesce(n, F.lit(0)).alias("usable_px"), *[(moment(b, 1) + 0.25).alias(f"m_{b}") for b in bands],
                     *[F.sqrt(F.greatest(moment(b, 2) - F.pow(moment(b, 1), 2), F.lit(0.0))).alias(f"s_{b}") for b in bands])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(b).alias("band"), F.col(f"m_{b}").alias("mean"),
                              F.col(f"s_{b}").alias("std")) for i, b in enumerate(bands)])
    # A store without tiles has no statistics; tiles without usable pixels are an error.
    out = with_scalar(stats, tiles.agg(F.count(F.lit(1)).alias("_tiles"))).where((F.col("usable_px") > 0) | (F.col("_tiles") > 0))
    out = out.select("usable_px", F.inline(rows))
    empty = F.raise_error(F.lit("the tiles hold no usable pixels"))
    return out.select("position", "band",
                      F.when(F.col("usable_px") > 0, F.round("mean", 6)).otherwise(empty.cast("double")).alias("mean"),
                      F.round(F.greatest(F.col("std"), F.lit(floor)), 6).alias("std"), "usable_px")


def statistics_of_distinct(seen: DataFrame, tiles: DataFrame, bands: list[str], floor: float = 1e-4) -> DataFrame:
    """:func:`band_statistics` of the ``tiles`` from the rows of :func:`split_pixels` that lie in them."""
    ok = F.col("usable") & P.known(*[F.col(b) for b in bands])
    off = {b: F.col(b).cast("double") - 0.25 for b in bands}
    sums = seen.where(ok).select(F.col("n").alias("cover"), F.lit(1).alias("_px"),
                                 *[v.alias(f"_1_{b}") for b, v in off.items()],
                                 *[(v * v).alias(f"_2_{b}") for b, v in off.items()])
    return _moments(sums, tiles, bands, floor)


def channel_statistics(px: DataFrame, bands: list[str], floor: float = 1e-3) -> DataFrame:
    """Per-channel moments over each channel's own finite values; an empty channel gives (0, 1)."""
    stats = px.agg(*[F.avg(b).alias(f"m_{b}") for b in bands], *[F.stddev_pop(b).alias(f"s_{b}") for b in bands])
    return stats.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(b).alias("band"), F.coalesce(f"m_{b}", F.lit(0.0)).alias("mean"),
        F.when(F.col(f"m_{b}").isNull(), F.lit(1.0)).otherwise(F.greatest(F.col(f"s_{b}"), F.lit(floor))).alias("std"))
        for i, b in enumerate(bands)])))


def standardise_bands(px: DataFrame, stats: DataFrame, bands: list[str]) -> DataFrame:
    """(x - mean) / std per band; a non-positive std is an error."""
    wide = stats.agg(*[F.max(F.when(F.col("band") == b, F.col(c))).alias(f"_{c}_{b}")
                       for b in bands for c in ("mean", "std")])
    joined = with_scalar(px, wide)
    keep = [c for c in px.columns if c not in bands]
    def scaled(b):
        std = F.col(f"_std_{b}")
        return F.when(std > 0, (F.col(b) - F.col(f"_mean_{b}")) / std).otherwise(
            F.raise_error(F.lit(f"standard deviation of {b} must be positive")).cast("double")).alias(b)
    return joined.select(*keep, *[scaled(b) for b in bands])


def review_fraction(ground: DataFrame, filtered: bool = False) -> DataFrame:
    """Review share of unique ground, capped at one; NULL on a filtered view."""
    sums = ground.agg(F.sum("review_px").alias("review_px"), F.sum("usable_px").alias("usable_px"))
    value = F.when(F.col("usable_px") > 0, F.round(F.least(F.lit(1.0), F.col("review_px") / F.col("usable_px")), 5))
    if filtered:
        value = F.lit(None).cast("double")
    return sums.select(value.alias("review_fraction"))


def tile_review_density(tallies: DataFrame) -> DataFrame:
    """Review share over usable pixels (ranking) and over the whole tile (pack)."""
    return tallies.withColumn("review_density", F.when(F.col("usable_px") > 0, F.col("review_px") / F.col("usable_px")))


def reed_support(tallies: DataFrame, by: list[str]) -> DataFrame:
    """Reed pixels of the gated mask per group of tiles and whether they suffice to measure an IoU."""
    return tallies.groupBy(*by).agg(F.sum(f"mask_{C.REED}_px").alias("reed_px")) \
                  .withColumn("sufficient", F.col("reed_px") >= C.MIN_REED_PIXELS)


def class_fractions(tallies: DataFrame) -> DataFrame:
    """Class share over supervised pixels of each tile, zeros where there are none."""
    total = sum((F.col(f"mask_{c}_px") for c in range(1, N_CLASSES)), F.col("mask_0_px"))
    return tallies.select(
        *[c for c in tallies.columns if c not in TALLIES],
        *[F.when(total > 0, F.col(f"mask_{c}_px") / total).otherwise(0.0).alias(f"fraction_{c}")
          for c in range(N_CLASSES)])


def describe_store(tallies: DataFrame, ground: DataFrame, date: str = "date", filtered: bool = False,
                   excluded: DataFrame | None = None) -> DataFrame:
    """One row describing a store view; unique-ground figures are NULL on a filtered view."""
    view = tallies.agg(F.countDistinct(date).alias("shards"), F.count(F.lit(1)).alias("tiles"),
                       *[F.coalesce(F.sum(f"mask_{c}_px"), F.lit(0)).alias(f"class_{c}") for c in range(N_CLASSES)])
    whole = ground.agg(F.sum("usable_px").alias("usable_px"), F.sum("review_px").alias("review_px"))
    out = with_scalar(view, whole)
    if excluded is not None:
        out = with_scalar(out, excluded.agg(F.count(F.lit(1)).alias("holdout_tiles_excluded")))
    else:
        out = out.withColumn("holdout_tiles_excluded", F.lit(0).cast("long"))
    null = F.lit(None)
    trainable = sum((F.col(f"class_{c}") for c in range(1, N_CLASSES)), F.col("class_0"))
    fraction = F.when(F.col("usable_px") > 0, F.round(F.least(F.lit(1.0), F.col("review_px") / F.col("usable_px")), 5))
    return out.select(
        "shards", "tiles", F.lit("filtered view" if filtered else "whole store").alias("scope"),
        *[F.col(f"class_{c}") for c in range(N_CLASSES)], trainable.alias("trainable_px"), "holdout_tiles_excluded",
        (null.cast("long") if filtered else F.col("usable_px")).alias("usable_px"),
        (null.cast("long") if filtered else F.col("review_px")).alias("review_px"),
        (null.cast("double") if filtered else fraction).alias("review_fraction"))


def truncate_tiles(tiles: DataFrame, max_tiles: int, order=("date", "top", "left")) -> DataFrame:
    """First tiles in store order, for smoke runs."""
    return tiles.orderBy(*order).limit(max_tiles)


def batches(tiles: DataFrame, batch_size: int, order=("date", "top", "left")) -> DataFrame:
    """Number fixed-size batches of tiles in store order."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    ranked = global_rank(tiles, [F.col(o) for o in order], "_rn")
    return ranked.withColumn("batch", F.floor((F.col("_rn") - 1) / batch_size)).drop("_rn")


# --- windows, padding, augmentation ----------------------------------------------

def extract_tile(px: DataFrame, top: int, left: int, size: int) -> DataFrame:
    """Pixels of one window, re-based to its corner."""
    inside = px.where((F.col("row") >= top) & (F.col("row") < top + size)
                      & (F.col("col") >= left) & (F.col("col") < left + size))
    return inside.withColumn("row", F.col("row") - top).withColumn("col", F.col("col") - left)


#: Cells of a strip of a tile, unless one row of it has more.
STRIP_CELLS = 1 << 12


def pad_to_tile(tiles: DataFrame, px: DataFrame, by: list[str], size: int, values: list[str], fill=0) -> DataFrame:
    """Dense ``size`` x ``size`` frame per tile; bottom and right filled with ``fill``.

    ``tiles`` is (by..., height, width); an oversize tile is an error.  Strips of whole rows of a tile, of
    ``STRIP_CELLS`` cells, meet their pixels in one exchange.  Empty cells are made only behind it, by the row
    before them: no row makes more cells than its strip has, as a task holds all that one row makes.
    """
    def side(name):
        return F.when(F.col(name) <= size, F.col(name)).otherwise(
            F.raise_error(F.lit(f"{name} exceeds the tile size {size}")).cast("int"))
    rows = max(1, STRIP_CELLS // size)
    sides = F.struct(side("height").alias("height"), side("width").alias("width"))
    # A strip starts with a row of its own, one cell ahead; it carries the sides of its tile, a list as tiles may repeat.
    starts = tiles.groupBy(*by).agg(F.collect_list(sides).alias("_sides")) \
        .withColumn("_strip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((size - 1) // rows).cast("long")))) \
        .withColumn("_at", F.col("_strip") * (rows * size) - 1)
    inside = F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1)
    for b in by:
        inside = inside & F.col(b).isNotNull()
    cells = px.where(inside).select(
        *by, F.floor(F.col("row") / rows).alias("_strip"), (F.col("row").cast("long") * size + F.col("col")).alias("_at"),
        *values)
    order = Window.partitionBy(*by, "_strip").orderBy("_at")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.least(F.lit(size), (F.col("_strip") + 1) * rows) * size
    met = starts.unionByName(cells, allowMissingColumns=True).select(
        *by, *values, "_at", (F.col("_at") + F.col("_sides").isNotNull().cast("int")).alias("_from"),
        F.greatest("_at", F.coalesce(F.lead("_at").over(order), end) - 1).alias("_to"),
        F.first("_sides").over(before).alias("_sides"))

    def whole(at):
        return F.expr(f"cast({at} div {size} as int)")
    spans = met.where("_from <= _to").select(
        *by, *values, F.inline("_sides"), "_at", whole("_from").alias("_first"), whole("_to").alias("_last"),
        F.expr(f"cast(_from % {size} as int)").alias("_left"), F.expr(f"cast(_to % {size} as int)").alias("_right"))
    dense = spans.withColumn("row", F.explode(F.sequence("_first", "_last"))).withColumn("col", F.explode(F.sequence(
        F.when(F.col("row") == F.col("_first"), F.col("_left")).otherwise(0),
        F.when(F.col("row") == F.col("_last"), F.col("_right")).otherwise(size - 1))))
    outside = (F.col("row") >= F.col("height")) | (F.col("col") >= F.col("width"))
    seen = F.col("row").cast("long") * size + F.col("col") == F.col("_at")
    return dense.select(*[F.col(b).cast(tiles.schema[b].dataType).alias(b) for b in by], "height", "width", "row", "col",
                        *[F.when(outside, F.lit(fill)).otherwise(F.when(seen, F.col(v))).alias(v) for v in values])


def crop_from_padding(padded: DataFrame) -> DataFrame:
    """Undo :func:`pad_to_tile`."""
    return padded.where((F.col("row") < F.col("height")) & (F.col("col") < F.col("width")))


def augment_tiles(tile_px: DataFrame, size: int, bands: list[str], key: str, seed: int, epoch: int) -> DataFrame:
    """Flips, quarter turns and band gains drawn per (seed, tile, epoch).

    Draws come from hashes of the tile key, so a re-run task repeats them exactly.
    """
    def uniform(salt: str) -> Column:
        h = F.xxhash64(F.lit(seed), F.col(key), F.lit(epoch), F.lit(salt))
        return F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    last = size - 1
    r, c = F.col("row"), F.col("col")
    # Draws are fixed columns so the remap below reads one consistent value per tile.
    drawn = tile_px.select("*", (uniform("h") < 0.5).alias("_h"), (uniform("v") < 0.5).alias("_v"),
                           F.floor(uniform("k") * 4).alias("_k"), (uniform("g") < 0.5).alias("_g"))
    c1 = F.when(F.col("_h"), last - c).otherwise(c)
    r1 = F.when(F.col("_v"), last - r).otherwise(r)
    moved = drawn.withColumn("_r", r1).withColumn("_c", c1)
    k, r2, c2 = F.col("_k"), F.col("_r"), F.col("_c")
    row = F.when(k == 1, last - c2).when(k == 2, last - r2).when(k == 3, c2).otherwise(r2)
    col = F.when(k == 1, r2).when(k == 2, last - c2).when(k == 3, last - r2).otherwise(c2)
    def gain(b):
        # Box-Muller on two hashed uniforms gives N(1, .05).
        u1 = F.greatest(uniform("n1" + b), F.lit(1e-12))
        normal = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.pi() * uniform("n2" + b))
        return F.when(F.col("_g"), 1 + 0.05 * normal).otherwise(F.lit(1.0))
    keep = [x for x in tile_px.columns if x not in {*bands, "row", "col"}]
    return moved.select(*keep, row.cast("int").alias("row"), col.cast("int").alias("col"),
                        *[(F.col(b) * gain(b)).alias(b) for b in bands])


def assert_reflectance(px: DataFrame, chip: list[str], bands: list[str]) -> DataFrame:
    """Chips that are empty or hold stored integers instead of reflectance."""
    top = px.groupBy(*chip).agg(
        F.max(F.greatest(*[F.col(b) for b in bands])).alias("peak"),
        F.sum(sum((F.col(b).isNotNull().cast("long") for b in bands[1:]),
                  F.col(bands[0]).isNotNull().cast("long"))).alias("values"))
    return top.where((F.col("values") == 0) | (F.col("peak") > C.CHIP_CEILING)) \
              .withColumn("problem", F.when(F.col("values") == 0, "empty").otherwise("not reflectance"))


def check_store_grid(grids: DataFrame, store: list[str], requested_gsd: float) -> DataFrame:
    """Stores whose dates disagree on the grid, or whose gsd is not the requested one."""
    per = grids.groupBy(*store).agg(
        F.countDistinct("crs", "gsd", "x0", "y0", "width", "height").alias("grids"),
        F.max(F.abs(F.col("gsd") - F.lit(float(requested_gsd)))).alias("gsd_error"))
    return per.where((F.col("grids") > 1) | (F.col("gsd_error") > 1e-6))
