"""Choosing tiles for annotation, reading the labels back, scoring against them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshgrid import contract as C
from marshgrid.functions import geo as G
from marshgrid.operators.scale import rank_within, with_scalar

STRATEGIES = ["uncertainty", "reed", "random"]
#: Pixel rows of a tile that are burnt together, pixels burnt at a time and pixels of a batch that goes back.
STRIP, CANVAS, PIXELS_OUT = 16, 1 << 22, 1 << 17
#: Place of a run without a class, below that of every feature; place of a pixel that no run covers.
UNCLASSED, UNCOVERED = -(1 << 62), -(1 << 63)


def annotation_scores(tallies: DataFrame, strategy: str = "uncertainty", seed: int = 0,
                      key: str = "key") -> DataFrame:
    """Candidate tiles with their score; tiles that cannot be candidates are dropped.

    ``random`` draws from a hash of the seed and the tile key, so it repeats on retry;
    its score orders the tiles but is not a count.
    """
    name = strategy.strip().lower()
    if name not in STRATEGIES:
        raise ValueError(f"unknown annotation strategy {strategy!r}; expected one of {STRATEGIES}")
    if name == "random":
        draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        return tallies.withColumn("score", draw)
    if name == "reed":
        scored = tallies.withColumn("score", F.col(f"mask_{C.REED}_px").cast("double"))
    else:
        if "usable_px" not in tallies.columns:
            raise ValueError("review density needs the validity mask; rebuild the store")
        scored = tallies.withColumn("score", F.when(F.col("usable_px") > 0, F.col("review_px") / F.col("usable_px")))
    return scored.where(F.col("score") > 0)


def annotation_ranking(tallies: DataFrame, order: list[str], strategy: str = "uncertainty", seed: int = 0,
                       key: str = "key") -> DataFrame:
    """Every candidate ranked best first; ties keep store order."""
    scored = annotation_scores(tallies, strategy, seed, key)
    return rank_within(scored, [], [F.col("score").desc(), *[F.col(o).asc() for o in order]], "rank")


def annotation_topk(tallies: DataFrame, order: list[str], limit: int = 20, min_score: float = 0.0,
                    strategy: str = "uncertainty", seed: int = 0, key: str = "key") -> DataFrame:
    """Score, keep ``score >= min_score``, then the first ``limit`` as a distributed top-k."""
    from pyspark.sql import Window
    scored = annotation_scores(tallies, strategy, seed, key).where(F.col("score") >= min_score)
    by = [F.col("score").desc(), *[F.col(o).asc() for o in order]]
    top = scored.orderBy(*by).limit(limit)
    # The window numbers the ``limit`` rows that are left.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by))) \
              .withColumn("score", F.round("score", 5)).withColumn("reed_px", F.col(f"mask_{C.REED}_px"))


# --- reading labels back -----------------------------------------------------------

FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def parse_annotations(documents: DataFrame, key: str = "key", document: str = "document") -> DataFrame:
    """GeoJSON label documents (one per tile) to polygons with a class.

    Columns: key, feature_pos, class_code, rings.  A feature without a class is an
    error; documents without geometry give no rows, which reads as "not yet".
    """
    # One pass over a document; what that does not read, such as a single feature without brackets, is cut out first.
    features = F.coalesce(F.from_json(document, f"features array<{FEATURE}>")["features"],
                          F.from_json(F.get_json_object(document, "$.features"), f"array<{FEATURE}>"))
    rows = documents.select(key, F.posexplode(features).alias("feature_pos", "f"))
    code = class_of(F.col("f.properties"))
    checked = F.when(code.isNotNull(), code).otherwise(
        F.raise_error(F.concat(F.lit("a feature has no class in "), F.col(key).cast("string"))).cast("int"))
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    single = F.array(F.from_json(coords, "array<array<array<double>>>"))
    many = F.from_json(coords, "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", many)
    parts = rows.where(F.col("f.geometry").isNotNull()).select(
        key, "feature_pos", checked.alias("class_code"), F.explode(polygons).alias("p"))
    rings = F.transform("p", lambda ring: F.transform(ring, lambda xy: F.struct(
        F.get(xy, 0).alias("x"), F.get(xy, 1).alias("y"))))
    return parts.select(key, "feature_pos", "class_code", rings.alias("rings"))


def class_of(props: Column) -> Column:
    """Class from ``class_code``, else ``class_name``, else ``class`` (a name or a code)."""
    names = F.create_map(*[F.lit(v) for i, n in enumerate(C.CLASS_NAMES) for v in (n, i)])
    def prop(k):
        return F.try_element_at(props, F.lit(k))
    def named(v):
        return F.try_element_at(names, F.coalesce(v, F.lit("")))
    loose = F.coalesce(named(prop("class")), prop("class").try_cast("int"))
    return F.coalesce(prop("class_code").try_cast("int"), named(prop("class_name")), loose)


def polygons_to_pixels(polygons: DataFrame, chips: DataFrame, key: str = "key") -> DataFrame:
    """Lon/lat rings to fractional chip pixels; ``chips`` is (key, grid, epsg, height, width)."""
    joined = polygons.join(chips, key)
    def move(p):
        return G.let(G.project_point(p["x"], p["y"], F.col("epsg")), lambda q: F.struct(
            ((q["x"] - F.col("grid.x0")) / F.col("grid.gsd")).alias("x"),
            ((F.col("grid.y0") - q["y"]) / F.col("grid.gsd")).alias("y")))
    rings = F.transform("rings", lambda ring: F.transform(ring, move))
    return joined.select(key, "feature_pos", "class_code", rings.alias("rings"), "height", "width")


def rasterize_polygons(polygons: DataFrame, key: str = "key") -> DataFrame:
    """Burn polygons onto pixel centres, later features over earlier ones.

    Rings are in pixel units.  The edges of all polygons that cross a strip of ``STRIP`` pixel rows of
    one tile meet; strips are burnt by scan line, many at a time (:func:`burn_strips`).  Only covered
    pixels are produced, each once, and none is exchanged; a group holds the edges of one strip.
    Holes come out by the even-odd rule.
    """
    edges = F.filter(F.flatten(F.transform("rings", lambda ring: F.zip_with(
        ring, G.next_points(ring), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))))),
        lambda e: e["y0"] != e["y1"])
    # position * 256 + code keeps the overwrite a plain numeric maximum; a code that does not
    # fit a byte would spill into the position.
    code = F.when(F.col("class_code").between(0, 255), F.col("class_code")).when(F.col("class_code").isNotNull(), F.raise_error(
        F.concat(F.lit("class code outside 0..255: "), F.col("class_code").cast("string"))).cast("int"))
    m = F.coalesce(F.col("feature_pos").cast("long") * 256 + code, F.lit(UNCLASSED))
    # A generator evaluates its argument once; a column that a filter reads would be spelt out again.
    sides = [F.coalesce(n, F.lit((1 << 31) - 1)).alias(n) for n in ("height", "width")]
    src = polygons.select(key, m.alias("m"), *sides, F.explode(F.array(edges)).alias("edges"))
    ys = F.concat(F.col("edges.y0"), F.col("edges.y1"))
    first = F.greatest(F.lit(0), F.ceil(F.array_min(ys) - 0.5).cast("int"))
    last = F.least(F.col("height") - 1, F.floor(F.array_max(ys) - 0.5).cast("int"))
    strips = F.when(last >= first, F.sequence(F.floor(first / STRIP).cast("int"), F.floor(last / STRIP).cast("int")))
    cut = src.where(F.size("edges") > 0).select(key, "m", "height", "width", "edges", F.explode(strips).alias("strip"))
    top = F.col("strip") * STRIP
    inside = F.filter("edges", lambda e: (F.greatest(e["y0"], e["y1"]) > top) & (F.least(e["y0"], e["y1"]) < top + STRIP))
    met = cut.groupBy(key, "strip").agg(F.collect_list(F.struct("m", "height", "width", inside.alias("edges"))).alias("polygons"))
    schema = T.StructType([polygons.schema[key], *[T.StructField(n, T.IntegerType()) for n in ("row", "col", "class_code")]])
    return met.mapInArrow(burn_strips, schema)


def burn_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, strip, polygons) to (key, row, col, class_code), at most about ``CANVAS`` pixels at a time."""
    for batch in batches:
        widest = pc.max(batch.column(2).flatten().field("width")).as_py() or 1
        step = max(1, CANVAS // (STRIP * max(widest, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            tile, row, col, m = _burn(part.column(1).to_numpy(), part.column(2))
            for i in range(0, len(m), PIXELS_OUT):
                s = slice(i, i + PIXELS_OUT)
                columns = [part.column(0).take(pa.array(tile[s])), *[pa.array(v[s].astype(np.int32)) for v in (row, col)],
                           pa.array((m[s] & 255).astype(np.int32), mask=m[s] == UNCLASSED)]
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "row", "col", "class_code"])


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n``: the item of every repetition, and its place among those of the item."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)


def _burn(strip: np.ndarray, polygons: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Pixels of strips as (place of the strip, row, col, greatest m over the pixel)."""
    group, _ = _places(np.diff(polygons.offsets.to_numpy()))
    poly = polygons.flatten()
    m, height, width = (poly.field(n).to_numpy() for n in ("m", "height", "width"))
    lists = poly.field("edges")
    owner, _ = _places(np.diff(lists.offsets.to_numpy()))
    x0, y0, x1, y1 = (lists.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("x0", "y0", "x1", "y1"))
    # The rows whose centre an edge crosses.
    top = strip[group].astype(np.int64) * STRIP
    lo = np.maximum(np.ceil(np.minimum(y0, y1) - 0.5), top[owner])
    hi = np.minimum(np.ceil(np.maximum(y0, y1) - 0.5) - 1, np.minimum(top + STRIP, height)[owner] - 1)
    e, k = _places(np.maximum(hi - lo + 1, 0).astype(np.int64))
    row = lo[e].astype(np.int64) + k
    x = x0[e] + (row + 0.5 - y0[e]) / (y1 - y0)[e] * (x1 - x0)[e]
    line = owner[e] * STRIP + row % STRIP
    order = np.lexsort((x, line))
    x, line = x[order], line[order]
    # Crossings of one line of one polygon, sorted, bound its runs two by two.
    start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][:len(line)])
    _, rank = _places(np.diff(np.r_[start, len(line)]))
    a = np.flatnonzero((rank[:-1] % 2 == 0) & (line[1:] == line[:-1]))
    p = line[a] // STRIP
    c0 = np.fmax(0, np.ceil(x[a] - 0.5))
    c1 = np.fmin(width[p] - 1, np.ceil(x[a + 1] - 0.5) - 1)
    # Later features are painted later, so that they stay.
    some = np.flatnonzero(c1 >= c0)
    some = some[np.argsort(m[p[some]], kind="stable")]
    p, c0, c1, at = p[some], c0[some].astype(np.int64), c1[some].astype(np.int64), line[a][some] % STRIP
    at += group[p] * STRIP
    left = np.full(len(strip) * STRIP, np.iinfo(np.int64).max)
    right = np.full(len(strip) * STRIP, -1)
    np.minimum.at(left, at, c0)
    np.maximum.at(right, at, c1)
    size = np.where(right >= 0, right - left + 1, 0)
    begin = np.cumsum(size) - size
    canvas = np.full(int(size.sum()), UNCOVERED)
    length = c1 - c0 + 1
    block = np.cumsum(length) // CANVAS
    for b in np.unique(block):
        s = slice(*np.searchsorted(block, [b, b + 1]))
        run, k = _places(length[s])
        canvas[(begin[at[s]] + c0[s] - left[at[s]])[run] + k] = m[p[s]][run]
    lines, k = _places(size)
    px = np.flatnonzero(canvas != UNCOVERED)
    lines, k = lines[px], k[px]
    return lines // STRIP, strip[lines // STRIP] * STRIP + lines % STRIP, left[lines] + k, canvas[px]


def read_annotations(raster_labels: DataFrame | None, burnt: DataFrame | None, chips: DataFrame,
                     key: str = "key", polygons: DataFrame | None = None) -> DataFrame:
    """Human labels per pixel: the raster table where a tile has one, else its polygons.

    Give the polygons burnt, or as ``polygons`` in pixel units: then those of raster tiles are dropped
    before they become pixels.
    A raster label off the chip grid is an error.  Unlabelled tiles have no rows.
    """
    parts = []
    if raster_labels is not None:
        on_grid = raster_labels.join(chips.select(key, "height", "width"), key)
        inside = (F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width"))
        parts.append(on_grid.select(key, "row", "col", F.when(inside, F.col("class_code")).otherwise(
            F.raise_error(F.lit("raster labels are not on the chip grid")).cast("int")).alias("class_code")))
    for drawn, burn in ((burnt, lambda df: df), (polygons, lambda df: rasterize_polygons(df, key))):
        if drawn is None:
            continue
        rest = drawn if raster_labels is None else drawn.join(
            raster_labels.select(key).distinct(), key, "left_anti")
        parts.append(burn(rest).select(key, "row", "col", "class_code"))
    if not parts:
        raise ValueError("no annotation source given")
    return reduce(DataFrame.unionByName, parts)


def join_predictions(predictions: DataFrame, labels: DataFrame, tile: list[str]) -> DataFrame:
    """Predicted pixels with a human label in the class set."""
    good = labels.where(F.col("class_code").between(0, len(C.CLASS_NAMES) - 1))
    return predictions.join(good.select(*tile, "row", "col", F.col("class_code").alias("target")),
                            [*tile, "row", "col"])


def still_unlabelled(tiles: DataFrame, labels: DataFrame, tile: list[str]) -> DataFrame:
    """Pack tiles without a single labelled pixel."""
    good = labels.where(F.col("class_code").between(0, len(C.CLASS_NAMES) - 1))
    return tiles.select(*tile).join(good.select(*tile).distinct(), tile, "left_anti")


def check_independence(annotated: DataFrame, provenance: DataFrame, key: str = "key") -> DataFrame:
    """One row: is the annotated ground shown to be unseen by the model?

    ``provenance`` is (key, split) as recorded with the model.
    """
    keys = annotated.select(key).distinct()
    known = provenance.agg(F.count_if(F.col("split") == "train").alias("train_tiles"),
                           F.count_if(F.col("split") == "val").alias("val_tiles"))
    def shared(split, name):
        hit = keys.join(provenance.where(F.col("split") == split).select(key), key, "left_semi")
        return hit.agg(F.count(F.lit(1)).alias(name), F.min(key).alias(name + "_example"))
    row = with_scalar(with_scalar(with_scalar(known, shared("train", "in_train")), shared("val", "in_val")),
                      keys.agg(F.count(F.lit(1)).alias("annotated")))
    blank = (F.col("train_tiles") == 0) & (F.col("val_tiles") == 0)
    status = (F.when(blank, "unverified").when(F.col("in_train") > 0, "trained_on")
              .when(F.col("in_val") > 0, "used_for_selection").otherwise("verified"))
    detail = (F.when(blank, F.lit("the model records no split provenance"))
              .when(F.col("in_train") > 0, F.format_string("%d annotated tile(s) were trained on, e.g. %s",
                                                           F.col("in_train"), F.col("in_train_example").cast("string")))
              .when(F.col("in_val") > 0, F.format_string("%d annotated tile(s) were used for model selection, e.g. %s",
                                                         F.col("in_val"), F.col("in_val_example").cast("string")))
              .otherwise(F.format_string("none of the %d annotated tile(s) was used in training", F.col("annotated"))))
    return row.select(status.alias("status"), detail.alias("detail"), "annotated", "in_train", "in_val")


def key_intersection(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return a.select(key).intersect(b.select(key))
