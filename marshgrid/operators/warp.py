"""Moving samples from one grid to another: any resolution, offset or UTM zone.

The source is cut into square blocks.  Every sample goes to its own block and, near an edge,
to the blocks it borders (the halo), so one exchange brings each block all that its kernels
reach.  A target pixel belongs to the block that holds the source pixel under its centre; the
centre is mapped back into the source grid.  Where both grids share a projection the kernel
is separable and a block is two matrix products, over rows and then over columns; otherwise
each target pixel gathers its few neighbours.

Missing neighbours drop out and the remaining weights are renormalised.  A target pixel
comes out where any sample lies under its kernel with a weight other than zero; its value is
null if none of these samples has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marshgrid import contract as C
from marshgrid.functions import geo as G
from marshgrid.operators.raster import mask_observations

#: Pixels on a block's side: a block with its halo and its targets is some megabytes.
BLOCK = 128
#: Pixels that a kernel may reach beyond the one under the target's centre.
REACH = {"nearest": 0, "bilinear": 1, "cubic": 2}


def grid(gsd, x0, y0, height, width, epsg) -> Column:
    """A grid as one column; every part is a number or a Column."""
    parts = {"gsd": gsd, "x0": x0, "y0": y0, "height": height, "width": width, "epsg": epsg}
    kinds = {"gsd": "double", "x0": "double", "y0": "double"}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds.get(k, "int")).alias(k) for k, v in parts.items()])


def kernel(method: str, d: np.ndarray) -> np.ndarray:
    """Weights at distances ``d`` in source pixels; cubic convolution has a = -0.5."""
    x = np.abs(d)
    if method == "bilinear":
        return np.maximum(0.0, 1 - x)
    if method == "cubic":
        return np.where(x <= 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    return (np.floor(d + 0.5) == 0).astype(float)


def lonlat_of(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Radians of longitude and latitude; the series of ``functions.geo`` on arrays."""
    meridian, north0 = np.radians((epsg % 100) * 6 - 183), G.FALSE_NORTH if epsg // 100 == 327 else 0.0
    xi, eta = (y - north0) / (G.K0 * G._RADIUS), (x - G.FALSE_EAST) / (G.K0 * G._RADIUS)
    a, b = xi.copy(), eta.copy()
    for j, k in enumerate(G._BETA, start=1):
        a -= k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        b -= k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(G._DELTA, start=1))
    return meridian + np.arctan2(np.sinh(b), np.cos(a)), lat


def utm_of(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing of radians."""
    meridian, north0 = np.radians((epsg % 100) * 6 - 183), G.FALSE_NORTH if epsg // 100 == 327 else 0.0
    s = np.sin(lat)
    t = np.sinh(np.arctanh(s) - G._E * np.arctanh(G._E * s))
    xi, eta = np.arctan2(t, np.cos(lon - meridian)), np.arctanh(np.sin(lon - meridian) / np.sqrt(1 + t * t))
    east, north = eta.copy(), xi.copy()
    for j, k in enumerate(G._ALPHA, start=1):
        east += k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        north += k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return G.FALSE_EAST + G.K0 * G._RADIUS * east, north0 + G.K0 * G._RADIUS * north


def moved(row: np.ndarray, col: np.ndarray, of: dict, to: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pixel coordinates (centres at whole numbers) in grid ``to`` of those in grid ``of``."""
    x, y = of["x0"] + (col + 0.5) * of["gsd"], of["y0"] - (row + 0.5) * of["gsd"]
    if of["epsg"] != to["epsg"]:
        x, y = utm_of(*lonlat_of(np.asarray(x, float), np.asarray(y, float), of["epsg"]), to["epsg"])
    return (to["y0"] - y) / to["gsd"] - 0.5, (x - to["x0"]) / to["gsd"] - 0.5


def _targets(block: tuple[int, int], size: int, src: dict, dst: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the target grid that the block may own."""
    edge = np.linspace(-0.5, size - 0.5, 17)
    near, far = np.full(17, -0.5), np.full(17, size - 0.5)
    rows = np.concatenate([edge, edge, near, far]) + block[0] * size
    cols = np.concatenate([near, far, edge, edge]) + block[1] * size
    r, c = moved(rows, cols, src, dst)
    spans = [(max(0, int(np.floor(x.min())) - 1), min(n, int(np.ceil(x.max())) + 2)) for x, n in ((r, dst["height"]), (c, dst["width"]))]
    return tuple(np.arange(a, max(a, b)) for a, b in spans)


def _owned(pos: np.ndarray, first: int, size: int, extent: int) -> np.ndarray:
    """Whether the source pixel under a position lies in the block and in the source."""
    under = np.floor(pos + 0.5)
    return (under >= first) & (under < min(first + size, extent))


def warp_block(src: dict, dst: dict, block: tuple[int, int], size: int, method: str, row, col, planes: list[np.ndarray]):
    """(rows, columns, planes) of the block's target pixels from its samples; NaN is no value."""
    reach = REACH[method]
    top, left, side = block[0] * size - reach, block[1] * size - reach, size + 2 * reach
    here = np.zeros((side, side))
    here[row - top, col - left] = 1.0
    full = []
    for p in planes:
        a = np.full((side, side), np.nan)
        a[row - top, col - left] = p
        full.append(a)
    rows, cols = _targets(block, size, src, dst)
    if src["epsg"] == dst["epsg"]:
        v, u = moved(rows, np.zeros(len(rows)), dst, src)[0], moved(np.zeros(len(cols)), cols, dst, src)[1]
        rows, v = (x[_owned(v, block[0] * size, size, src["height"])] for x in (rows, v))
        cols, u = (x[_owned(u, block[1] * size, size, src["width"])] for x in (cols, u))
        at = np.arange(side)
        down, across = kernel(method, v[:, None] - top - at), kernel(method, u[:, None] - left - at).T

        def through(a):
            return down @ a @ across
        touched = ((down != 0).astype(float) @ here @ (across != 0).astype(float)).reshape(-1) > 0
        r, c = (x.reshape(-1) for x in np.meshgrid(rows, cols, indexing="ij"))
    else:
        r, c = (x.reshape(-1) for x in np.meshgrid(rows, cols, indexing="ij"))
        v, u = moved(r, c, dst, src)
        own = _owned(v, block[0] * size, size, src["height"]) & _owned(u, block[1] * size, size, src["width"])
        r, c, v, u = r[own], c[own], v[own] - top, u[own] - left
        near = np.floor(v if method != "nearest" else v + 0.5).astype(int), np.floor(u if method != "nearest" else u + 0.5).astype(int)
        steps = range(1 - reach, reach + 1) if reach else (0,)
        taps = []
        for i in steps:
            for j in steps:
                y, x = near[0] + i, near[1] + j
                taps.append((np.clip(y, 0, side - 1), np.clip(x, 0, side - 1), kernel(method, v - y) * kernel(method, u - x)))

        def through(a):
            return sum((w * a[y, x] for y, x, w in taps), np.zeros(len(r)))
        touched = sum(((w != 0) * here[y, x] for y, x, w in taps), np.zeros(len(r))) > 0
    out = []
    for a in full:
        known = ~np.isnan(a)
        weight = through(known.astype(float)).reshape(-1)
        total = through(np.where(known, a, 0.0)).reshape(-1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(np.where(np.abs(weight) > 1e-12, total / weight, np.nan)[touched])
    return r[touched], c[touched], out


def halo(px: DataFrame, size: int, reach: int) -> DataFrame:
    """Rows of ``px`` for each block that holds or borders them: ``_br``, ``_bc``."""
    def blocks(c: str) -> Column:
        ends = [F.floor((F.col(c) + d) / float(size)).cast("int") for d in ((-reach, reach) if reach else (0,))]
        return F.explode(F.array_distinct(F.array(*ends)))
    return px.withColumn("_br", blocks("row")).withColumn("_bc", blocks("col"))


def _params(g) -> dict:
    return {k: (int(v) if k in ("height", "width", "epsg") else float(v)) for k, v in g.items()}


def warp(px: DataFrame, frames: DataFrame, values: list[str], by: list[str], method: str = "bilinear",
         categorical: bool = False, size: int = BLOCK) -> DataFrame:
    """``px`` (by..., row, col, values) on the target grid of its group.

    ``frames`` has one row per group: by..., ``src`` and ``dst`` (see ``grid``).  Values keep
    their type under ``nearest`` and are doubles otherwise.
    """
    if method not in C.VALID_RESAMPLE or method not in REACH:
        raise ValueError(f"{method!r} does not move samples between grids")
    if categorical and method != "nearest":
        raise ValueError("class codes cannot be interpolated; use nearest")
    reach = REACH[method]
    kinds = [px.schema[v].dataType if method == "nearest" else T.DoubleType() for v in values]
    schema = T.StructType([*[px.schema[b] for b in by], T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
                           *[T.StructField(v, k) for v, k in zip(values, kinds)]])
    whole = [isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in kinds]
    keys = [*by, "_br", "_bc"]
    last = [F.floor((F.col(f"src.{n}") - 1) / float(size)).cast("int") for n in ("height", "width")]
    blocks = (frames.select(*by, "src", "dst").withColumn("_br", F.explode(F.sequence(F.lit(0), last[0])))
              .withColumn("_bc", F.explode(F.sequence(F.lit(0), last[1]))))
    arrow = to_arrow_schema(schema)

    def move(key, samples: pa.Table, frame: pa.Table) -> pa.Table:
        if not samples.num_rows or not frame.num_rows:
            return arrow.empty_table()
        # Nulls are NaN inside a block and nulls again behind it.
        planes = [samples.column(v).cast(pa.float64()).to_numpy() for v in values]
        r, c, out = warp_block(*(_params(frame.column(g)[0].as_py()) for g in ("src", "dst")), (key[-2].as_py(), key[-1].as_py()), size, method,
                               samples.column("row").to_numpy().astype(int), samples.column("col").to_numpy().astype(int), planes)
        if any(whole):
            out = [np.rint(o) if w else o for o, w in zip(out, whole)]
        cols = [pa.repeat(k, len(r)) for k in key[:-2]] + [r, c] + [pa.array(o, mask=np.isnan(o)) for o in out]
        return pa.table([(x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(cols, arrow)], schema=arrow)

    left = halo(px.select(*by, "row", "col", *values), size, reach).groupBy(*keys)
    return left.cogroup(blocks.groupBy(*keys)).applyInArrow(move, schema)


def scan_to_grid(samples: DataFrame, frames: DataFrame, bands: list[str], by: list[str], contract=None, mask=C.MASK_BAND) -> DataFrame:
    """Band samples of several native resolutions as masked observations on one target grid.

    ``samples`` is long (by..., band, row, col, dn), ``frames`` has by..., ``gsd``, ``src`` and
    ``dst`` for each native resolution.  The band contract (name, asset, gsd, resampling) says
    how a band moves; stored integers stay integers.  Bands of one resolution and method move
    together, and one aggregate brings all of them into a row.
    """
    contract = [*(C.BANDS if contract is None else contract), mask]
    spec = {name: (float(gsd), method) for name, _, gsd, method in contract}
    unknown = [b for b in bands if b not in spec]
    if unknown:
        raise ValueError(f"the band contract does not define {unknown}")
    names, out = [*bands, mask[0]], None
    for gsd, method in sorted({spec[n] for n in names}):
        group = [n for n in names if spec[n] == (gsd, method)]
        wide = samples.where(F.col("band").isin(group)).groupBy(*by, "row", "col").agg(
            *[F.max(F.when(F.col("band") == b, F.col("dn"))).alias(b) for b in group])
        moved_ = warp(wide, frames.where(F.col("gsd") == gsd), group, by, method, categorical=mask[0] in group)
        part = moved_.select(*by, "row", "col", *[(F.rint(n) if n in group else F.lit(None)).cast("int").alias(n) for n in names])
        out = part if out is None else out.unionByName(part)
    whole = out.groupBy(*by, "row", "col").agg(*[F.max(n).alias(n) for n in names])
    # Where the scene has no mask there is no data: code 0.
    whole = whole.withColumn(mask[0], F.coalesce(mask[0], F.lit(0)))
    return mask_observations(whole, bands, scl=mask[0])
