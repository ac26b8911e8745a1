"""Threat, growth and phenology expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions.pixels import clip

# Component weights, canal widths, band limits.
WEIGHT_COVERAGE, WEIGHT_WIDTH, WEIGHT_PRIORITY = 0.55, 0.25, 0.20
WIDTH_CRITICAL_M, WIDTH_TOLERANT_M = 8.0, 120.0
MODIFIER_POINTS = 5.0
BANDS = [(75.0, "critical"), (50.0, "high"), (25.0, "moderate")]


def width_urgency(width_m: Column) -> Column:
    """1 for narrow channels, 0 for wide ones, square-root decay between."""
    share = (width_m - WIDTH_CRITICAL_M) / (WIDTH_TOLERANT_M - WIDTH_CRITICAL_M)
    return (F.when(width_m <= WIDTH_CRITICAL_M, F.lit(1.0))
            .when(width_m >= WIDTH_TOLERANT_M, F.lit(0.0))
            .when(width_m.isNotNull(), 1 - F.sqrt(share)))


def threat_score(coverage: Column, width_m: Column, priority: Column,
                 biomass: Column | None = None, pressure: Column | None = None) -> Column:
    """Score out of 100; optional modifiers move it by at most 2.5 points each."""
    score = 100.0 * (WEIGHT_COVERAGE * clip(coverage) + WEIGHT_WIDTH * width_urgency(width_m)
                     + WEIGHT_PRIORITY * clip(priority))
    for modifier in (biomass, pressure):
        if modifier is not None:
            score = score + F.coalesce(MODIFIER_POINTS * (clip(modifier) - 0.5), F.lit(0.0))
    return clip(score, 0.0, 100.0)


def threat_band(score: Column) -> Column:
    expr = F
    for floor, name in BANDS:
        expr = expr.when(score >= floor, F.lit(name))
    return expr.when(score.isNotNull(), F.lit("low"))


def threat_notes(coverage: Column, width_m: Column,
                 biomass: Column | None = None, pressure: Column | None = None) -> Column:
    """Remarks that explain a score, in a fixed order."""
    notes = [F.when(coverage > 1, F.format_string("coverage %.3f is above 1 and was clamped", coverage))]
    for name, modifier in (("biomass", biomass), ("downstream pressure", pressure)):
        if modifier is not None:
            notes.append(F.when(modifier.isNotNull(), F.format_string(
                name + " moved the score by %+.1f", MODIFIER_POINTS * (clip(modifier) - 0.5))))
    notes.append(F.when(width_urgency(width_m) < 0.15,
                        F.format_string("a %.0f m channel closes slowly", width_m)))
    return F.filter(F.array(*notes), lambda n: n.isNotNull())


# --- growth -------------------------------------------------------------------

INF = float("inf")


def doubling_time(rate: Column) -> Column:
    return F.when(rate > 0, F.lit(math.log(2.0)) / rate).when(rate.isNotNull(), F.lit(INF))


def logistic_predict(day: Column, k: Column, r: Column, t0: Column) -> Column:
    return k / (1 + F.exp(-r * (day - t0)))


def day_at_fraction(fraction: Column, r: Column, t0: Column) -> Column:
    f = clip(fraction, 0.01, 0.999)
    return F.when(r != 0, t0 + F.ln(f / (1 - f)) / r)


def max_growth_day(t0: Column) -> Column:
    return t0


def project_coverage(coverage: Column, rate: Column, days: Column) -> Column:
    grown = coverage * F.exp(rate * days)
    return F.when(grown.isNotNull(), F.least(F.lit(1.0), grown))


def time_to_blockage(coverage: Column, rate: Column, threshold: float = 0.75) -> Column:
    """Days until coverage reaches ``threshold``, with the reason when there is no answer."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    bad = coverage.isNull() | ~((coverage > 0) & (coverage <= 1))
    done = ~bad & (coverage >= threshold)
    static = ~bad & ~done & (rate <= 0)
    unknown = ~bad & ~done & rate.isNull()
    days = F.when(done, F.lit(0.0)).when(~bad & (rate > 0), F.round(F.ln(threshold / coverage) / rate, 1))
    return F.struct(days.alias("days"), F.coalesce(done, F.lit(False)).alias("already_blocked"),
                    F.when(bad, F.lit("coverage outside (0, 1]"))
                    .when(static, F.lit("coverage is not growing"))
                    .when(unknown, F.lit("the growth rate is unknown")).alias("reason"))


# --- phenology ----------------------------------------------------------------

def _knots() -> list[tuple[float, float]]:
    """Month midpoints on the day-of-year axis, wrapped by one month at either end."""
    mids, start = [], 0
    for length in C.DAYS_IN_MONTH:
        mids.append(start + length / 2.0)
        start += length
    pts = list(zip(mids, C.NUTRIENT_BY_MONTH))
    return [(pts[-1][0] - 365, pts[-1][1]), *pts, (pts[0][0] + 365, pts[0][1])]


def nutrient_content(day: Column) -> Column:
    """Nutrient content as a share of the season's maximum, by day of year."""
    doy = F.pmod(F.dayofyear(day), F.lit(365)).cast("double")
    knots = _knots()
    expr = F
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        expr = expr.when(doy <= x1, F.lit(y0) + F.lit((y1 - y0) / (x1 - x0)) * (doy - x0))
    return expr.otherwise(F.lit(None).cast("double"))


def prior_peak(year: Column) -> Column:
    return F.make_date(year, F.lit(C.PEAK_MONTH), F.lit(C.PEAK_DAY))
