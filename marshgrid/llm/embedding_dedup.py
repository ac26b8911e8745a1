"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated onto their principal axes, largest first (the
second-moment matrix is one small distributed sum).  Equal vectors are folded.  Tiles are cut
by splitting at the median along the leading axes in turn, so a tile is a small box there.

A pair of tiles is compared unless its boxes lie too far apart: cos >= t for unit vectors
means a distance of at most sqrt(2 - 2t) along any set of axes.  Sibling tiles are shipped
together as blocks, so a vector travels once per block near its own; inside a task the tiles
of two blocks are told apart by their boxes again.  Within a tile pair products
are accumulated over the leading dimensions first; the rest of a product is at most the
product of the two suffix norms, so a pair is dropped as soon as the sum so far plus that
bound stays below the threshold.  What is left is decided by the cosine of the original
vectors in double precision.

Tile pairs never emit their links: they send how many links each vector has and a spanning
forest, at most one link per vector, which is all that counts and classes need.

Vectors of different widths never link; all this is done once for each width that occurs.

Defined results: null, zero-length, zero and non-finite vectors link with nothing; equal vectors link with one another; ids that
repeat count as vectors of their own in the links of others; a null id is not returned; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshgrid.llm import common as C
from marshgrid.llm.components import components

THRESHOLD = 0.95
#: Vectors in a tile, about, and tiles in a block, which is what tasks are given.
TILE, TILES = 512, 16
#: Leading axes by which tiles are cut and compared.
AXES = 6
#: Dimensions accumulated at a time.
STEP = 16
#: Slack for rounding in everything but the exact cosine at the end.
SLACK = 1e-9


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _moment_batches(width):
    def run(batches):
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            x = unit_rows(_matrix(batch.column("v"), width))
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width), pa.int32()), pa.array(np.tile(np.arange(width), width), pa.int32()),
                                              pa.array(total.ravel())], names=["i", "j", "s"])
    return run


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def axes_of(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes (columns, largest first) of the unit vectors; width squared numbers reach the driver."""
    sums = vectors.select("v").mapInArrow(_moment_batches(width), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    moment = np.zeros((width, width))
    for i, j, s in sums:
        moment[i, j] = s
    # Rounding to a grid keeps reruns on the same axes whatever the order of the sum.
    values, axes = np.linalg.eigh(np.round((moment + moment.T) / 2, 6))
    return axes[:, np.argsort(-values)]


def _rotate_batches(axes: np.ndarray, lead: int):
    def run(batches):
        for batch in batches:
            p = unit_rows(_matrix(batch.column("v"), len(axes))) @ axes[:, :lead]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("copies"), batch.column("v"),
                                              *[pa.array(p[:, k]) for k in range(lead)]],
                                             names=["vec_id", "copies", "v", *[f"p{k}" for k in range(lead)]])
    return run


def _tiles(rotated: DataFrame, n: int, lead: int) -> DataFrame:
    """Add ``tile``: halves at the median along the leading axes in turn until tiles are small."""
    levels = max(0, int(np.ceil(np.log2(max(1, n) / TILE))))
    out = rotated.withColumn("tile", F.lit(1).cast("long"))
    for level in range(levels):
        axis = f"p{level % lead}"
        # Medians are sketched per tile with map-side combine; tiles of equal size are not needed for right results.
        middle = out.groupBy("tile").agg(F.percentile_approx(axis, 0.5, 1000).alias("m"))
        out = out.join(middle, "tile").withColumn("tile", F.col("tile") * 2 + (F.col(axis) > F.col("m")).cast("long")).drop("m")
        if level % 4 == 3:
            out = C.saved(out, "tiles")
    return out


def compare(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine >= threshold, by leading dimensions first."""
    ux, uy = unit_rows(x), unit_rows(y)
    px, py = ux @ axes, uy @ axes
    width = px.shape[1]
    tail_x, tail_y = (np.sqrt(np.maximum(0, (p * p)[:, ::-1].cumsum(1)[:, ::-1])) for p in (px, py))
    first = min(STEP, width)
    sums = px[:, :first] @ py[:, :first].T
    bound = np.outer(tail_x[:, first], tail_y[:, first]) if first < width else 0.0
    i, j = np.nonzero(sums + bound >= threshold - SLACK)
    part = sums[i, j]
    at = first
    while at < width and len(i):
        end = min(width, at + STEP)
        part = part + np.einsum("ij,ij->i", px[i, at:end], py[j, at:end])
        rest = tail_x[i, end] * tail_y[j, end] if end < width else 0.0
        keep = part + rest >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
        at = end
    if len(i):
        # The verdict is the cosine of the vectors as they are.
        norm_x, norm_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        keep = np.einsum("ij,ij->i", x[i], y[j]) / (norm_x[i] * norm_y[j]) >= threshold
        i, j = i[keep], j[keep]
    return i, j


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a, b)."""
    root: dict[int, int] = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v
    kept = []
    for u, v in zip(a.tolist(), b.tolist()):
        r, s = find(u), find(v)
        if r != s:
            root[max(r, s)] = min(r, s)
            kept.append((u, v))
    return kept


def _compare_blocks(axes: np.ndarray, threshold: float, lead: int):
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "tile", "vec_id"])
        sides = []
        for k in (0, 1):
            part = rows[rows.side == k]
            if len(part):
                x = np.stack(part.v.to_numpy()).astype(np.float64)
                place = unit_rows(x) @ axes[:, :lead]
                # Strips end where tiles do, and a tile of many equal projections is cut.
                edge = np.unique([0, *(np.flatnonzero(np.diff(part.tile.to_numpy())) + 1), *range(0, len(part), TILE), len(part)])
                strips = [(lo, hi, place[lo:hi].min(0), place[lo:hi].max(0)) for lo, hi in zip(edge, edge[1:])]
                sides.append((part.vec_id.to_numpy(), part.copies.to_numpy(), x, strips, np.zeros(len(part), np.int64)))
        one, two = sides[0], sides[-1]
        links = []
        for lo, hi, low, high in one[3]:
            for at, to, low2, high2 in two[3]:
                gap = np.maximum(0, np.maximum(low - high2, low2 - high))
                if (two is one and at < lo) or gap @ gap > reach * reach:
                    continue
                i, j = compare(one[2][lo:hi], two[2][at:to], axes, threshold)
                i, j = i + lo, j + at
                if two is one and at == lo:
                    i, j = i[i < j], j[i < j]
                np.add.at(one[4], i, two[1][j])
                np.add.at(two[4], j, one[1][i])
                links += _forest(one[0][i], two[0][j])
        links = _forest(*np.array(links).reshape(-1, 2).T) if links else []
        out = [(int(v), None, int(d)) for ids, _, _, _, degree in ([one] if two is one else [one, two]) for v, d in zip(ids, degree) if d]
        return pd.DataFrame(out + [(a, b, None) for a, b in links], columns=["a", "b", "n"]).astype("Int64")
    return run


def _links_of_width(folded: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, n) of the distinct vectors of one width: links of a spanning forest (a, b) and numbers of links (a, n)."""
    lead = min(AXES, width)
    axes = axes_of(folded, width)
    fields = "vec_id long, copies long, v array<double>, " + ", ".join(f"p{k} double" for k in range(lead))
    rotated = folded.mapInArrow(_rotate_batches(axes, lead), fields)
    tiled = C.saved(_tiles(rotated, folded.count(), lead), "tiled")

    # Boxes of the blocks: a few numbers for thousands of vectors, joined on overlap of the leading axes.
    tiled = tiled.withColumn("block", F.floor(F.col("tile") / TILES).cast("long"))
    box = tiled.groupBy("block").agg(*[f(f"p{k}").alias(f"{n}{k}") for k in range(lead) for n, f in (("lo", F.min), ("hi", F.max))])
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    pairs = _near_boxes(box, lead, reach)
    sides = pairs.select(F.explode(F.when(F.col("t") == F.col("u"), F.array(F.struct(F.col("t").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("t").alias("block"), F.lit(0).alias("side")), F.struct(F.col("u").alias("block"), F.lit(1).alias("side"))))).alias("s"), "t", "u")
    work = sides.select("t", "u", "s.block", "s.side").join(tiled.select("block", "tile", "vec_id", "copies", "v"), "block").drop("block")
    return C.saved(work.groupBy("t", "u").applyInPandas(_compare_blocks(axes, threshold, lead), "a long, b long, n long"), "found")


def link_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; one without an id stands alone, without a component."""
    C.ship(table.sparkSession)
    nameless = table.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return _link_named(table, id_col, vector_col, threshold).unionByName(nameless)


def _link_named(table: DataFrame, id_col: str, vector_col: str, threshold: float) -> DataFrame:
    """``link_vectors`` of the rows that have an id."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    ids = rows.select("vec_id")
    good = rows.where(usable)
    widths = sorted(r[0] for r in good.select(F.size("v")).distinct().collect())
    if not widths:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Equal vectors are one; +0.0 folds the two zeros.
    folded = C.saved(good.withColumn("v", F.transform("v", lambda x: x + 0.0)).groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "vectors")
    owner = good.select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v")).join(
        folded.where("copies > 1").select(F.col("vec_id").alias("rep"), "v", "copies"), "v").select("vec_id", "rep", "copies")
    # Vectors of different widths have no cosine: each width has axes, tiles and comparisons of its own.
    found = reduce(DataFrame.unionByName, [_links_of_width(folded.where(F.size("v") == w), w, threshold) for w in widths])

    degree = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("vec_id"), "n")
    same = owner.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    root = components(found.where("b is not null").select("a", "b").unionByName(same))
    # A vector has the links of its representative, and its own copies.
    own = owner.groupBy("vec_id").agg(F.min("rep").alias("rep"), F.max("copies").alias("copies"))
    out = (ids.join(own, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
           .join(degree.withColumnRenamed("vec_id", "rep"), "rep", "left").join(root.withColumnRenamed("id", "vec_id"), "vec_id", "left"))
    return out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                      F.coalesce("root", "vec_id").alias("component_id"), (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"))


def _near_boxes(box: DataFrame, lead: int, reach: float) -> DataFrame:
    """Pairs (t <= u) of blocks whose boxes come within ``reach``: meeting cells of the first axis, then distance."""
    cell = lambda x: F.floor(x / reach).cast("long")
    x = box.select(*[F.col(c).alias(f"a_{c}") for c in box.columns], F.explode(F.sequence(cell(F.col("lo0")), cell(F.col("hi0") + reach))).alias("cell"))
    y = box.select(*[F.col(c).alias(f"b_{c}") for c in box.columns], F.explode(F.sequence(cell(F.col("lo0")), cell(F.col("hi0") + reach))).alias("cell"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")), 2) for k in range(lead)), F.lit(0.0))
    met = x.join(y, "cell").where((F.col("a_block") <= F.col("b_block")) & (gap <= reach * reach))
    return met.select(F.col("a_block").alias("t"), F.col("b_block").alias("u")).distinct()
