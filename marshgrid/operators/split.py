"""Ground overlap and geographic splits.

A footprint is half-open: ``top <= row < bottom``, ``left <= col < right``.
Overlap joins hash on grid cells; a pair is emitted only in the cell that holds
the corner of its intersection, so no de-duplication pass follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marshgrid import contract as C

BOX = ["top", "left", "bottom", "right"]
SPLITS = ["train", "val", "test"]


def distinct_footprints(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unique ground positions over all dates."""
    return tiles.select(*(by or []), *BOX).distinct()


def overlaps(a: dict, b: dict, buffer=0) -> Column:
    """Strict overlap of two half-open boxes, the second grown by ``buffer``."""
    return ((a["top"] < b["bottom"] + buffer) & (a["bottom"] > b["top"] - buffer)
            & (a["left"] < b["right"] + buffer) & (a["right"] > b["left"] - buffer))


def _box(prefix: str) -> dict:
    return {k: F.col(prefix + k) for k in BOX}


def _into_cells(df: DataFrame, prefix: str, cell: int, buffer: int = 0) -> DataFrame:
    """Repeat each box once per grid cell its (grown) pixels touch."""
    b, side = _box(prefix), float(cell)
    def span(lo, hi):
        return F.sequence(F.floor((lo - buffer) / side), F.floor((hi + buffer - 1) / side))
    return df.withColumn("_cr", F.explode(span(b["top"], b["bottom"]))) \
             .withColumn("_cc", F.explode(span(b["left"], b["right"])))


def overlapping_pairs(a: DataFrame, b: DataFrame, by: list[str] | None = None, cell: int = 512,
                      buffer: int = 0) -> DataFrame:
    """Pairs of footprints (``a_*``, ``b_*``) sharing at least one pixel, ``b`` grown by ``buffer``.

    Feed distinct footprints: their number per cell is set by tile size and stride,
    not by the number of dates.  Extra columns of either side are kept, prefixed.
    """
    by = by or []
    left = _into_cells(a.select(*by, *[F.col(c).alias("a_" + c) for c in a.columns if c not in by]), "a_", cell)
    right = _into_cells(b.select(*by, *[F.col(c).alias("b_" + c) for c in b.columns if c not in by]), "b_", cell,
                        buffer)
    A, B = _box("a_"), _box("b_")
    home_r = F.floor(F.greatest(A["top"], B["top"] - buffer) / float(cell))
    home_c = F.floor(F.greatest(A["left"], B["left"] - buffer) / float(cell))
    joined = left.join(right, [*by, "_cr", "_cc"])
    return joined.where(overlaps(A, B, buffer) & (F.col("_cr") == home_r) & (F.col("_cc") == home_c)) \
                 .drop("_cr", "_cc")


def missing_reserved(reserved: DataFrame, tiles: DataFrame, key: str = "key") -> DataFrame:
    """Reserved keys absent from the store."""
    return reserved.select(key).distinct().join(tiles.select(key), key, "left_anti")


def excluded_tiles(tiles: DataFrame, reserved: DataFrame, buffer: int = 0, by: list[str] | None = None,
                   cell: int = 512) -> DataFrame:
    """Every tile, on every date, touching a reserved footprint grown by ``buffer``."""
    by = by or []
    if buffer < 0:
        raise ValueError("the spatial buffer must be non-negative")
    hit = overlapping_pairs(distinct_footprints(tiles, by), distinct_footprints(reserved, by), by, cell, buffer)
    touched = hit.select(*by, *[F.col("a_" + k).alias(k) for k in BOX]).distinct()
    return tiles.join(touched, [*by, *BOX], "left_semi")


def exclude_reserved(tiles: DataFrame, reserved_keys: DataFrame, buffer: int = 0, key: str = "key",
                     by: list[str] | None = None, cell: int = 512) -> DataFrame:
    """Tiles left after removing reserved ground on every date.

    Runs two small checks first: an unknown reserved key, or nothing left of a store that
    has tiles, is an error.  An empty store stays empty.
    """
    by = by or []
    unknown = missing_reserved(reserved_keys, tiles, key).limit(5).collect()
    if unknown:
        raise ValueError(f"reserved keys not in the store: {[u[0] for u in unknown]}")
    reserved = tiles.join(reserved_keys.select(key).distinct(), key, "left_semi")
    gone = excluded_tiles(tiles, reserved, buffer, by, cell).select(*by, *BOX).distinct()
    kept = tiles.join(gone, [*by, *BOX], "left_anti")
    if kept.isEmpty() and not tiles.isEmpty():
        raise ValueError("the reserved ground and its buffer cover every tile")
    return kept


def excluded_keys(tiles: DataFrame, retained: DataFrame, key: str = "key") -> DataFrame:
    """Keys of tiles not retained (reserved neighbours, or boundary tiles of a split)."""
    return tiles.select(key).join(retained.select(key), key, "left_anti")


def leaks(split_tiles: DataFrame, by: list[str] | None = None, cell: int = 512) -> DataFrame:
    """Distinct footprint pairs of different splits that share ground, with tile-pair counts."""
    by = by or []
    per = split_tiles.where(F.col("split").isNotNull()).groupBy(*by, *BOX, "split").agg(F.count(F.lit(1)).alias("n"))
    pairs = overlapping_pairs(per, per, by, cell).where(F.col("a_split") < F.col("b_split"))
    return pairs.withColumn("tile_pairs", F.col("a_n") * F.col("b_n"))


def assert_disjoint(split_tiles: DataFrame, by: list[str] | None = None, cell: int = 512) -> None:
    """Raise when two splits share a pixel; collects one summary row."""
    found = leaks(split_tiles, by, cell)
    row = found.agg(F.sum("tile_pairs").alias("n"),
                    F.min(F.struct("a_split", "b_split", *["a_" + k for k in BOX], *["b_" + k for k in BOX]))
                    .alias("example")).first()
    if row["n"]:
        raise ValueError(f"{row['n']} tile pairs share ground between splits, e.g. {row['example'].asDict()}")


# --- geographic split ------------------------------------------------------------

def buffer_ladder(start: int) -> list[int]:
    """Requested buffer, then halves down to zero."""
    if start < 0:
        raise ValueError("the split buffer must be non-negative")
    ladder = [start]
    while ladder[-1] > 0:
        ladder.append(ladder[-1] // 2)
    return ladder


#: First cuts that one task tries against all second ones.
SLICE = 512


def thinned(cuts: np.ndarray, most: int | None) -> np.ndarray:
    """All sorted cut positions, or at most ``most`` of them at truncated linspace positions."""
    if most is None or len(cuts) <= most:
        return cuts
    at = np.floor(np.arange(most) * ((len(cuts) - 1) / float(most - 1))).astype(int)
    at[-1] = len(cuts) - 1
    return cuts[np.unique(at)]


def best_pair(start: np.ndarray, end: np.ndarray, n: np.ndarray, cuts: np.ndarray, buffer: int,
              fractions, tried: range) -> tuple | None:
    """Best (error, waste, c1, c2, train, val, test) with ``cuts[i]``, i in ``tried``, as first cut.

    Footprints are given as counts ``n`` by start and end.  The sweep takes first cuts from the
    last to the first: footprints that start behind the cut come in, counted by the first cut
    at or behind their end, and one running sum then holds the middle strip for every second
    cut.  Memory is that of the counts.
    """
    m = len(cuts)
    by_end = np.searchsorted(cuts, end, "left")
    train = np.cumsum(np.bincount(by_end, n, m + 1).astype(np.int64))[:m]
    order = np.argsort(-start, kind="stable")
    start, by_end, n = start[order], by_end[order], n[order]
    # Footprints that start at c + buffer or later are the first ``behind`` ones.
    behind = np.searchsorted(-start, -(cuts + buffer), "right")
    test = np.concatenate([[0], np.cumsum(n)])[behind]
    total, inside, seen, best = int(n.sum()), np.zeros(m + 1, dtype=np.int64), 0, None
    for i in reversed(tried):
        np.add.at(inside, by_end[seen:behind[i]], n[seen:behind[i]])
        seen = max(seen, behind[i])
        second = np.searchsorted(cuts, cuts[i] + buffer, "right")
        if train[i] == 0 or second == m:
            continue
        val, rest = np.cumsum(inside)[second:m], test[second:]
        kept = train[i] + val + rest
        error = (np.abs(train[i] / kept - fractions[0]) + np.abs(val / kept - fractions[1])) + np.abs(rest / kept - fractions[2])
        error[(val == 0) | (rest == 0)] = np.inf
        least = error.min()
        if np.isinf(least) or (best is not None and least > best[0]):
            continue
        ties = np.flatnonzero(error == least)
        j = ties[np.argmax(kept[ties])]  # least waste, then the first cut
        found = (float(least), int(total - kept[j]), int(cuts[i]), int(cuts[second + j]), int(train[i]), int(val[j]), int(rest[j]))
        best = found if best is None or found < best else best
    return best


def split_cuts(footprints: DataFrame, by: list[str], buffers: list[int],
               fractions=(0.70, 0.15, 0.15), seed: int = 0, max_cuts: int | None = None) -> DataFrame:
    """The winning cut pair of every (group, buffer) that admits a three-way split.

    ``footprints`` are distinct.  Both axes and all buffers are evaluated in one job:
    footprints collapse to counts by start and end, as many as tile positions along one axis
    of one area, and a sweep over them sizes the strips of every pair of cuts.  A task takes
    ``SLICE`` first cuts of one (group, axis, buffer); the best candidate is the minimum of
    the five-part rank.  Every distinct tile end is a cut.  ``max_cuts`` thins them evenly
    where that is too many, which may change the split.
    """
    f = [float(x) for x in fractions]
    if len(f) != 3 or min(f) <= 0 or abs(sum(f) - 1.0) > 1e-8:
        raise ValueError("fractions must be three positive values summing to 1")
    if seed < 0 or min(buffers) < 0:
        raise ValueError("seed and buffers must be non-negative")
    if max_cuts is not None and max_cuts < 2:
        raise ValueError("a split needs two cuts")
    reverse = bool(np.random.default_rng(seed).integers(0, 2))
    spans = footprints.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_all"), (F.max("bottom") - F.min("top")).alias("_h"),
        (F.max("right") - F.min("left")).alias("_w"))
    def axis(name, lo, hi):
        start, end = F.col(lo), F.col(hi)
        if reverse:
            start, end = -F.col(hi), -F.col(lo)
        return F.struct(F.lit(name).alias("axis"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    hist = (footprints.select(*by, F.explode(F.array(axis(0, "top", "bottom"), axis(1, "left", "right"))).alias("x"))
            .groupBy(*by, F.col("x.axis").alias("axis"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
            .agg(F.count(F.lit(1)).alias("n")))
    count = F.least(F.count_distinct("end"), F.lit(max_cuts or (1 << 62)))
    tasks = (hist.groupBy(*by, "axis").agg(F.ceil(count / F.lit(float(SLICE))).cast("int").alias("_slices"))
             .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
             .withColumn("buffer", F.explode(F.array(*[F.lit(int(b)) for b in buffers]))).drop("_slices"))
    keys = [*by, "axis", "buffer", "_slice"]
    names = ["error", "waste", "c1", "c2", "train", "val", "test"]
    schema = T.StructType([*[footprints.schema[b] for b in by], T.StructField("axis", T.IntegerType()),
                           T.StructField("buffer", T.IntegerType()), T.StructField("error", T.DoubleType()),
                           *[T.StructField(c, T.LongType()) for c in names[1:]]])
    arrow = to_arrow_schema(schema)

    def sweep(key: tuple[pa.Scalar, ...], counts: pa.Table) -> pa.Table:
        start, end, n = (counts.column(c).to_numpy() for c in ("start", "end", "n"))
        cuts, buffer, at = thinned(np.unique(end), max_cuts), key[-2].as_py(), key[-1].as_py() * SLICE
        best = best_pair(start, end, n, cuts, buffer, f, range(at, min(at + SLICE, len(cuts))))
        if best is None:
            return arrow.empty_table()
        row = [*(k.as_py() for k in key[:-1]), *best]
        return pa.table([pa.array([x], t.type) for x, t in zip(row, arrow)], schema=arrow)

    cand = hist.join(tasks, [*by, "axis"]).groupBy(*keys).applyInArrow(sweep, schema)
    cand = cand.join(spans, by) if by else _attach(cand, spans)
    # The longer axis is tried first; rows win ties.
    turn = F.when((F.col("axis") == 0) == (F.col("_h") >= F.col("_w")), 0).otherwise(1)
    rank = F.struct(turn.alias("turn"), "error", (F.col("waste") / F.col("n_all")).alias("waste_share"),
                    "waste", "c1", "c2", "axis", "train", "val", "test")
    best = cand.where(F.col("n_all") >= 3).groupBy(*by, "buffer").agg(F.min(rank).alias("b"))
    return best.select(*by, "buffer", F.col("b.axis").alias("axis"), F.col("b.c1").alias("c1"), F.col("b.c2").alias("c2"),
                       F.lit(reverse).alias("reverse"), F.col("b.error").alias("error"), F.col("b.waste").alias("waste"),
                       F.col("b.train").alias("train"), F.col("b.val").alias("val"), F.col("b.test").alias("test"))


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    from marshgrid.operators.scale import with_scalar
    return with_scalar(df, one_row)


def split_label(cuts: bool = True) -> Column:
    """Split of a tile given its cut columns (axis, c1, c2, buffer, reverse)."""
    lo = F.when(F.col("axis") == 0, F.col("top")).otherwise(F.col("left"))
    hi = F.when(F.col("axis") == 0, F.col("bottom")).otherwise(F.col("right"))
    start = F.when(F.col("reverse"), -hi).otherwise(lo)
    end = F.when(F.col("reverse"), -lo).otherwise(hi)
    return (F.when(end <= F.col("c1"), "train")
            .when((start >= F.col("c1") + F.col("buffer")) & (end <= F.col("c2")), "val")
            .when(start >= F.col("c2") + F.col("buffer"), "test"))


def geographic_split(tiles: DataFrame, by: list[str], buffer: int, fractions=(0.70, 0.15, 0.15), seed: int = 0,
                     ladder: bool = True, max_cuts: int | None = None) -> DataFrame:
    """Label every tile train, val, test or NULL (in a gap), with the buffer used.

    With ``ladder`` the widest feasible halving of ``buffer`` applies per group.  A
    group admitting no split has NULL everywhere; :func:`require_split` turns that
    into an error.
    """
    buffers = buffer_ladder(buffer) if ladder else [buffer]
    cuts = split_cuts(distinct_footprints(tiles, by), by, buffers, fractions, seed, max_cuts)
    cols = ["axis", "c1", "c2", "reverse"]
    widest = cuts.groupBy(*by).agg(F.max_by(F.struct(*cols, "buffer"), F.col("buffer")).alias("k")).select(
        *by, *[F.col("k")[c].alias(c) for c in [*cols, "buffer"]])
    joined = tiles.join(widest, by, "left") if by else _attach(tiles, widest)
    return joined.withColumn("split", split_label()).withColumnRenamed("buffer", "buffer_used").drop(*cols)


def require_split(labelled: DataFrame) -> DataFrame:
    """Raise unless every split holds a tile and no two splits share ground."""
    have = {row[0] for row in labelled.select("split").where(F.col("split").isNotNull()).distinct().collect()}
    if have != set(SPLITS):
        raise ValueError("this store cannot supply three non-empty geographic regions; use a larger area, "
                         "smaller tiles or a narrower buffer")
    return labelled


def split_support(split_tallies: DataFrame) -> DataFrame:
    """Class counts per split, flagged when empty or short of reed; one row per split."""
    n = len(C.CLASS_NAMES)
    out = split_tallies.where(F.col("split").isNotNull()).groupBy("split").agg(
        *[F.sum(f"mask_{c}_px").alias(f"class_{c}") for c in range(n)])
    total = sum((F.col(f"class_{c}") for c in range(1, n)), F.col("class_0"))
    return out.withColumn("empty", total == 0).withColumn("few_reed", F.col(f"class_{C.REED}") < C.MIN_REED_PIXELS)
