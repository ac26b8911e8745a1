"""Pixel observations: assembling bands, masking, mosaicking, summarising.

A pixel table has grouping columns (``by``: area, date, ...), ``row``, ``col``
and one column per band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshgrid import contract as C
from marshgrid.functions import pixels as P
from marshgrid.operators.scale import exact_percentiles, with_scalar

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def scan_observations(samples: DataFrame, bands: list[str], window: tuple[int, int, int, int] | None = None,
                      by=("scene",)) -> DataFrame:
    """Band samples of a window as wide, masked observations.

    ``samples`` is long (by..., band, row, col, dn).  The window and band filters
    sit directly on the scan, where they reach the file statistics.
    """
    src = samples
    if window is not None:
        top, left, bottom, right = window
        src = src.where((F.col("row") >= top) & (F.col("row") < bottom)
                        & (F.col("col") >= left) & (F.col("col") < right))
    wide = assemble_bands(src, [*bands, C.MASK_BAND[0]], by)
    return mask_observations(wide, bands, scl=C.MASK_BAND[0])


def assemble_bands(samples: DataFrame, bands: list[str], by=("scene",)) -> DataFrame:
    """One wide row per pixel, bands in the requested order.

    Conditional maxima combine on the map side and need a single exchange.
    """
    return (samples.where(F.col("band").isin(bands))
            .groupBy(*by, "row", "col")
            .agg(*[F.max(F.when(F.col("band") == b, F.col("dn"))).alias(b) for b in bands]))


def mask_observations(px: DataFrame, bands: list[str], scl: str | None = "scl") -> DataFrame:
    """Add ``valid`` and blank the bands of every pixel that is masked, fill or incomplete."""
    ok = P.observed([F.col(b) for b in bands], F.col(scl) if scl else None)
    flagged = px.withColumn("valid", ok)
    return flagged.select(*[c for c in px.columns if c not in bands],
                          *[F.when(F.col("valid"), F.col(b)).alias(b) for b in bands], "valid")


def reflectance(px: DataFrame, bands: list[str], mode: str = C.REFLECTANCE_MODE) -> DataFrame:
    """Replace stored integers by reflectance in the configured convention."""
    keep = [c for c in px.columns if c not in bands]
    return px.select(*keep, *[P.to_reflectance(F.col(b), mode).alias(b) for b in bands])


def rank_scenes(scenes: DataFrame, by: list[str], scene: str = "scene",
                bands: list[str] | None = None) -> DataFrame:
    """Mosaic order of the scenes of each composite: clearest first, NULL cloud last.

    The partition is one composite's candidate scenes (a few dozen revisits inside
    the date window), so the window stays small whatever the number of composites.
    A scene that cannot be read remotely is an error; one lacking a band is skipped.
    """
    src = scenes
    if "remote_readable" in scenes.columns:
        src = src.withColumn(scene, F.when(F.coalesce("remote_readable", F.lit(True)), F.col(scene)).otherwise(
            F.raise_error(F.concat(F.lit("scene is not remotely readable: "), F.col(scene).cast("string")))))
    if bands is not None and "assets" in scenes.columns:
        src = src.where(has_all(F.map_keys("assets"), bands))
    order = [F.col("cloud").asc_nulls_last(), F.col("acquired").asc(), F.col(scene).asc()]
    win = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return src.select(*by, scene, F.row_number().over(win).alias("rank"))


def has_all(have: Column, required: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), have)) == 0


def mosaic_winners(px: DataFrame, ranks: DataFrame, bands: list[str], by: list[str],
                   scene: str = "scene") -> DataFrame:
    """The clearest valid observation of every pixel: by..., row, col, rank, bands.

    Stored integers are 16-bit, so the rank and three bands fit one long and
    ``min`` on it stays a hash aggregate with map-side combine; a minimum over
    structs would sort every observation first.  Other band types take ``min_by``.
    (scene, row, col) must be unique, as :func:`assemble_bands` leaves it.
    """
    on = [*[b for b in by if b in ranks.columns], scene]
    ranked = px.where("valid").join(ranks.select(*on, "rank"), on)
    types = {f.name: f.dataType for f in px.schema.fields}
    if not all(isinstance(types[b], INTEGERS) for b in bands):
        best = F.min_by(F.struct("rank", *bands), F.col("rank")).alias("_w")
        return ranked.groupBy(*by, "row", "col").agg(best).select(*by, "row", "col", "_w.*")

    def field(c: Column, top: int, what: str) -> Column:
        return F.when((c >= 0) & (c <= top), c.cast("long")).otherwise(
            F.raise_error(F.lit(f"{what} outside 0..{top}")))

    rank = F.shiftleft(field(F.col("rank"), 32767, "scene rank"), 48)
    groups = [bands[i:i + 3] for i in range(0, len(bands), 3)]
    packs = []
    for i, group in enumerate(groups):
        word = rank
        for j, b in enumerate(group):
            word = word.bitwiseOR(F.shiftleft(field(F.col(b), 65535, b), 16 * j))
        packs.append(F.min(word).alias(f"_p{i}"))
    packed = ranked.groupBy(*by, "row", "col").agg(*packs)
    out = [F.shiftright("_p0", 48).cast("int").alias("rank")]
    for i, group in enumerate(groups):
        for j, b in enumerate(group):
            out.append(F.shiftright(f"_p{i}", 16 * j).bitwiseAND(F.lit(65535)).cast("int").alias(b))
    return packed.select(*by, "row", "col", *out)


def coverage_cut(winners: DataFrame, frame: DataFrame, by: list[str], target: float,
                 bands: list[str] = ()) -> DataFrame:
    """Per composite, cumulative coverage by rank and the rank the mosaic stops at.

    ``frame`` carries by... and ``total_px``.  The running sum is over one row per
    scene, not per pixel.  ``bands`` keeps the band columns referenced so that this
    branch and the output branch share one exchange instead of shuffling twice.
    """
    alive = [F.min(F.greatest(*[F.col(b) for b in bands]) if len(bands) > 1 else F.col(bands[0]))
             .alias("_alive")] if bands else [F.lit(0).alias("_alive")]
    hist = winners.groupBy(*by, "rank").agg(F.count(F.lit(1)).alias("px"), *alive) \
                  .where(F.col("_alive").isNotNull())
    withtotal = hist.join(frame.select(*by, "total_px"), by) if by else with_scalar(hist, frame, ["total_px"])
    order = Window.partitionBy(*by).orderBy("rank") if by else Window.orderBy("rank")
    cum = withtotal.withColumn(
        "coverage", F.sum("px").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total_px"))
    stop = Window.partitionBy(*by) if by else Window.partitionBy()
    return cum.select(*by, "rank", "px", "total_px", "coverage", F.min(
        F.when(F.col("coverage") >= target, F.col("rank"))).over(stop).alias("cut"))


def mosaic_clearest_first(px: DataFrame, scenes: DataFrame, frame: DataFrame, bands: list[str],
                          by: list[str], target: float = 0.999, scene: str = "scene",
                          scene_by: list[str] | None = None) -> DataFrame:
    """Composite each group from its scenes, clearest first, stopping at ``target`` coverage.

    Returns by..., row, col, scene and the band columns; pixels no kept scene
    supplies are absent.
    """
    ranks = rank_scenes(scenes, by if scene_by is None else scene_by, scene, bands)
    winners = mosaic_winners(px, ranks, bands, by, scene)
    cuts = coverage_cut(winners, frame, by, target, bands)
    last = F.coalesce(F.min("cut"), F.max("rank")).alias("_last")
    if by:
        stops = cuts.groupBy(*by).agg(last)
        kept = winners.join(stops, by).where(F.col("rank") <= F.col("_last")).drop("_last")
    else:
        kept = with_scalar(winners, cuts.agg(last), ["_last"]).where(F.col("rank") <= F.col("_last")).drop("_last")
    on = [*[b for b in by if b in ranks.columns], "rank"]
    return kept.join(ranks, on).select(*by, "row", "col", scene, *bands)


def scene_contribution(mosaic: DataFrame, frame: DataFrame, by: list[str], scene: str = "scene") -> DataFrame:
    """Share of the frame each contributing scene supplied."""
    counts = mosaic.groupBy(*by, scene).agg(F.count(F.lit(1)).alias("px"))
    joined = counts.join(frame.select(*by, "total_px"), by) if by else with_scalar(counts, frame, ["total_px"])
    return joined.select(*by, scene, "px", (F.col("px") / F.col("total_px")).alias("share"))


def coverage(px: DataFrame, frame: DataFrame, by: list[str], low: float = 0.5) -> DataFrame:
    """Valid share of the grid per composite, flagged when below ``low``."""
    counts = px.groupBy(*by).agg(F.count_if("valid").alias("valid_px"))
    joined = frame.select(*by, "total_px").join(counts, by, "left") if by else with_scalar(
        frame.select("total_px"), counts, ["valid_px"])
    share = F.coalesce("valid_px", F.lit(0)) / F.greatest(F.col("total_px"), F.lit(1))
    return joined.select(*by, F.coalesce("valid_px", F.lit(0)).alias("valid_px"), "total_px",
                         share.alias("coverage"), (share < low).alias("low_coverage"))


def with_indices(px: DataFrame, bands: list[str], requested=None) -> DataFrame:
    """Append the requested spectral indices; those whose bands are absent are skipped.

    The indices are generated columns (``inline``): a later filter on one compares it
    where it is, instead of being rewritten down to the stored integers.
    """
    cols, _ = P.index_columns(bands, requested)
    return px.select("*", F.inline(F.array(F.struct(*cols)))) if cols else px


def unpivot(px: DataFrame, by: list[str], columns: list[str], name: str = "name") -> DataFrame:
    return px.select(*by, *columns).unpivot(by, columns, name, "value")


def reflectance_check(px: DataFrame, bands: list[str], frame: DataFrame, by: list[str]) -> DataFrame:
    """Plausibility of the reflectance of every composite, with the two warnings."""
    stats = exact_percentiles(unpivot(px, by, bands), by, "value", [0.5], ["median"])
    cover = coverage(px, frame, by).select(*by, "coverage")
    base = cover.join(stats, by, "left") if by else with_scalar(cover, stats)
    share = F.coalesce(F.col("negatives") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    base = base.withColumn("negative_fraction", share)
    return base.select(
        *by, F.coalesce("n", F.lit(0)).alias("n"),
        "negative_fraction",
        F.col("vmin").alias("min"), "median", F.col("vmax").alias("max"),
        F.when(F.col("n") > 0, F.col("coverage")).alias("coverage"),
        (F.col("negative_fraction") > C.MAX_NEGATIVE_FRACTION).alias("too_negative"),
        F.coalesce(F.col("vmax") > C.MAX_PHYSICAL_REFLECTANCE, F.lit(False)).alias("too_bright"))


def index_summary(px: DataFrame, indices: list[str], by: list[str]) -> DataFrame:
    """min, p10, median, p90, max per composite and index; all-missing indices are omitted."""
    values = unpivot(px, by, indices, "index")
    stats = exact_percentiles(values, [*by, "index"], "value", [0.1, 0.5, 0.9], ["p10", "median", "p90"])
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return stats.select(*by, "index", r4("vmin", "min"), r4("p10", "p10"), r4("median", "median"),
                        r4("p90", "p90"), r4("vmax", "max"))


def index_summary_approx(px: DataFrame, indices: list[str], by: list[str], accuracy: int = 10000) -> DataFrame:
    """One-pass variant of :func:`index_summary` with sketched percentiles."""
    values = unpivot(px, by, indices, "index").where(F.col("value").isNotNull())
    q = values.groupBy(*by, "index").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile_approx("value", [0.1, 0.5, 0.9], accuracy).alias("q"))
    return q.select(*by, "index", "min", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"),
                    F.col("q")[2].alias("p90"), "max")


def index_histogram(px: DataFrame, index: str, by: list[str], bins: int = 40) -> DataFrame:
    """Equal bins over [-1, 1], the last closed on the right; empty bins appear with zero.

    ``count`` is every finite value of the composite, including any outside the range.
    """
    width = 2.0 / bins
    x = F.col(index)
    # (x + 1) / width can round up onto the next edge; the comparison puts it back.
    guess = F.floor((x + 1) / width).cast("int")
    fixed = F.when(x < guess * F.lit(width) - 1, guess - 1).when(x >= (guess + 1) * F.lit(width) - 1, guess + 1) \
             .otherwise(guess)
    inside = (x >= -1) & (x <= 1)
    # One row per composite and bin after the partial aggregate.
    tally = (px.where(x.isNotNull())
             .groupBy(*by, F.when(inside, F.least(fixed, F.lit(bins - 1))).alias("bin"))
             .agg(F.count(F.lit(1)).alias("c")))
    per = tally.groupBy(*by).agg(
        F.sum("c").alias("count"),
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "c")))).alias("m"))
    return per.select(*by, "count", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")) \
              .select(*by, "bin", F.round(F.col("bin") * F.lit(width) - 1, 3).alias("bin_start"),
                      F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("px"), "count")


def percentile_stretch(px: DataFrame, band: str, by: list[str], low: float = 2.0, high: float = 98.0,
                       out: str = "stretched") -> DataFrame:
    """Rescale a reflectance band to 0..1 between two percentiles of its composite; zero when flat."""
    q = exact_percentiles(px, by, band, [low / 100, high / 100], ["_lo", "_hi"]).select(*by, "_lo", "_hi")
    joined = px.join(q, by, "left") if by else with_scalar(px, q, ["_lo", "_hi"])
    span = F.col("_hi") - F.col("_lo")
    value = F.when(F.coalesce(span, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(
        P.clip((F.col(band) - F.col("_lo")) / F.when(span > 0, span)))
    return joined.withColumn(out, value).drop("_lo", "_hi")
