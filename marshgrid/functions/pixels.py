"""Per-pixel expressions: clipping, reflectance, masks, indices, class scores.

Missing values are NULL throughout, never NaN.  ``greatest`` and ``least`` skip
NULLs, so clipping goes through :func:`clip` which keeps a NULL a NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marshgrid import contract as C


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def nan_to_null(x: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


# --- stored integers, reflectance, masks -------------------------------------

def to_reflectance(dn: Column, mode: str = C.REFLECTANCE_MODE, scale: float = C.REFLECTANCE_SCALE) -> Column:
    """Stored integer to reflectance; the configured convention beats item metadata."""
    offset = C.reflectance_offset(mode)
    scaled = dn * F.lit(scale)
    return scaled + F.lit(offset) if offset else scaled


def encode_reflectance(x: Column) -> Column:
    """Reflectance to the stored integer: non-finite to 0, clipped, half-even rounding."""
    clean = F.coalesce(nan_to_null(x), F.lit(0.0))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(C.STORE_CEILING), clean))
    return F.rint(bounded * C.STORE_SCALE).cast("int")


def decode_reflectance(dn: Column) -> Column:
    return dn / F.lit(float(C.STORE_SCALE))


def scl_invalid(scl: Column) -> Column:
    """True where the scene classification rules the pixel out; NULL masks nothing."""
    return F.coalesce(scl.isin(C.SCL_INVALID), F.lit(False))


def is_fill(dns: list[Column]) -> Column:
    """True where every stored band value is exactly zero (tested before any offset)."""
    return F.coalesce(reduce(lambda a, b: a & b, [d == 0 for d in dns]), F.lit(False))


def observed(dns: list[Column], scl: Column | None) -> Column:
    """A pixel is observed when no band is missing, it is not fill and not masked."""
    present = reduce(lambda a, b: a & b, [d.isNotNull() for d in dns])
    ok = present & ~is_fill(dns)
    return ok if scl is None else ok & ~scl_invalid(scl)


# --- spectral indices ---------------------------------------------------------

def normalized_difference(a: Column, b: Column, eps: float = C.INDEX_EPS) -> Column:
    """(a-b)/(a+b), NULL where |a+b| <= eps or an operand is missing or not finite."""
    size = F.abs(a + b)
    return F.when((size > F.lit(eps)) & (size < F.lit(float("inf"))), (a - b) / (a + b))


def ndvi(b08: Column, b04: Column) -> Column:
    return normalized_difference(b08, b04)


def ndwi(b03: Column, b08: Column) -> Column:
    return normalized_difference(b03, b08)


def ndre(b08: Column, b05: Column) -> Column:
    return normalized_difference(b08, b05)


def ndmi(b08: Column, b11: Column) -> Column:
    return normalized_difference(b08, b11)


def index_names(requested=None) -> list[str]:
    """Requested index names, case-folded; an unknown name is an error."""
    known = [name for name, _, _ in C.INDICES]
    if requested is None:
        return known
    wanted = [r.lower() for r in requested]
    unknown = [w for w in wanted if w not in known]
    if unknown:
        raise ValueError(f"unknown index {unknown}; known: {known}")
    return wanted


def index_columns(available: list[str], requested=None, prefix: str = "") -> tuple[list[Column], list[str]]:
    """Index columns computable from ``available`` bands, and the names that are not."""
    have = {b.upper(): b for b in available}
    pairs = {name: (first, second) for name, first, second in C.INDICES}
    cols, missing = [], []
    for name in index_names(requested):
        first, second = pairs[name]
        if first in have and second in have:
            cols.append(normalized_difference(
                F.col(prefix + have[first]), F.col(prefix + have[second])).alias(name))
        else:
            missing.append(name)
    return cols, missing


# --- rule-engine class scores -------------------------------------------------
# Thresholds and weights below are fixed values of the rule engine.
#
# Each score tests its inputs for NULL once, at the top.  Inside that guard the
# terms are bounded with plain greatest/least, which mention their argument once:
# a guard per term would double the expression at every nesting level.

def _bounded(x: Column, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(hi), x))


def known(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])


def water_score(ndvi: Column, ndwi: Column, ndre: Column) -> Column:
    wet = _bounded((ndwi - 0.10) / 0.35)
    bare = _bounded((0.35 - ndvi) / 0.35)
    flat_edge = _bounded((0.0 - ndre) / 0.15)
    return F.when(known(ndvi, ndwi, ndre), _bounded(0.45 * wet + 0.30 * bare + 0.25 * flat_edge))


def crops_score(ndvi: Column, ndwi: Column, ndre: Column) -> Column:
    vigour = _bounded((ndvi - 0.35) / 0.35)
    dry = _bounded((0.0 - ndwi) / 0.35)
    low_edge = _bounded((0.28 - ndre) / 0.25)
    total = 0.45 * vigour + 0.25 * dry + 0.30 * low_edge * F.greatest(vigour, dry)
    return F.when(known(ndvi, ndwi, ndre), _bounded(total))


def halophyte_score(ndvi: Column, ndwi: Column, ndre: Column) -> Column:
    growth = _bounded((ndvi - 0.20) / 0.25)
    not_reed = _bounded(_bounded((0.55 - ndvi) / 0.20) + _bounded((0.28 - ndre) / 0.20))
    near_water = _bounded((ndwi + 0.20) / 0.40)
    return F.when(known(ndvi, ndwi, ndre),
                  _bounded(0.55 * F.least(growth, not_reed) + 0.45 * near_water, 0.7))


def reed_score(ndvi: Column, ndwi: Column, ndre: Column, ndmi: Column) -> Column:
    weakest = F.least(_bounded((ndvi - 0.55) / 0.30), _bounded((ndre - 0.28) / 0.25),
                      _bounded((ndmi - 0.08) / 0.25), _bounded((0.25 - ndwi) / 0.30))
    return F.when(known(ndvi, ndwi, ndre, ndmi), weakest)


# Confidence and margin cuts.
REVIEW_CONFIDENCE = 0.60
TRAIN_MARGIN = 0.08
AGREEMENT_BAND = 0.10
MAX_AGREEING = 2


def class_name(code: Column) -> Column:
    """Class name for a code, ``class_<code>`` when the code is not in the contract."""
    names = F.create_map(*[F.lit(v) for pair in enumerate(C.CLASS_NAMES) for v in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")),
                      F.concat(F.lit("class_"), code.cast("string")))
