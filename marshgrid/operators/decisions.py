"""Detections, threat queues, growth curves, harvest windows, constraint checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import decision as D
from marshgrid.functions import geo as G
from marshgrid.operators.scale import rank_within

MIN_OBSERVATIONS = 4
#: Solver steps; fits settle within a few dozen.
MAX_STEPS = 20_000


# --- detections ---------------------------------------------------------------------

def detections_query(detections: DataFrame, area_key: str, on: str | None = None) -> DataFrame:
    hit = detections.where(F.col("area_key") == area_key)
    return hit if on is None else hit.where(F.col("scene_date") == F.to_date(F.lit(on)))


def detection_area(detections: DataFrame, areas: DataFrame) -> DataFrame:
    """Fill a missing ``area_m2`` from the polygon, in the CRS of its area."""
    joined = detections.join(areas.select(F.col("key").alias("area_key"), F.col("crs").alias("_crs")), "area_key", "left")
    measured = G.polygon_area_m2(F.col("rings"), G.epsg_of(F.col("_crs")))
    filled = F.when(F.col("area_m2").isNull() & F.col("_crs").isNotNull(), measured).otherwise(F.col("area_m2"))
    return joined.withColumn("area_m2", filled).drop("_crs")


def coverage_trend(detections: DataFrame) -> DataFrame:
    """Reed patches, area and mean confidence per area and date."""
    return detections.where(F.col("class_code") == C.REED).groupBy("area_key", "scene_date").agg(
        F.count(F.lit(1)).alias("patch_count"), F.sum("area_m2").alias("total_area_m2"),
        (F.sum("area_m2") / 10000.0).alias("total_area_ha"), F.avg("confidence").alias("mean_confidence"))


def coverage_summary(detections: DataFrame, area_key: str) -> DataFrame:
    """Trend of one area, oldest first."""
    return coverage_trend(detections.where(F.col("area_key") == area_key)).orderBy("scene_date")


def coverage_view(detections: DataFrame) -> DataFrame:
    """Trend of all areas, newest first within each."""
    return coverage_trend(detections).orderBy(F.col("area_key").asc(), F.col("scene_date").desc())


# --- threat -------------------------------------------------------------------------

def score_threats(inputs: DataFrame) -> DataFrame:
    """Score, components, band and notes for each candidate patch."""
    cov, width, prio = F.col("coverage"), F.col("canal_width_m"), F.col("upstream_priority")
    bio = F.col("biomass_density") if "biomass_density" in inputs.columns else None
    press = F.col("downstream_pressure") if "downstream_pressure" in inputs.columns else None
    from marshgrid.functions.pixels import clip
    scored = inputs.withColumn("score", D.threat_score(cov, width, prio, bio, press))
    return scored.select("*", clip(cov).alias("coverage_component"), D.width_urgency(width).alias("width_component"),
                         clip(prio).alias("priority_component"), D.threat_band(F.col("score")).alias("band"),
                         D.threat_notes(cov, width, bio, press).alias("notes"))


def rank_by_threat(scored: DataFrame, by: list[str] | None = None, key: str = "id") -> DataFrame:
    """Most urgent first; the unclamped coverage, then the key, break ties."""
    order = [F.col("score").desc(), F.col("coverage").desc(), F.col(key).asc()]
    return rank_within(scored, by or [], order, "rank")


# --- growth -------------------------------------------------------------------------

def expansion_rate(observations: DataFrame, by: list[str]) -> DataFrame:
    """Exponential rate between the first and last observation of every group.

    Groups without an answer keep a row with the reason.
    """
    finite = F.when(~F.isnan("value") & (F.abs("value") < D.INF), F.col("value")).otherwise(
        F.raise_error(F.lit("non-finite observation")).cast("double"))
    obs = observations.withColumn("value", F.when(F.col("value").isNotNull(), finite))
    at = F.struct("observed_on", "value")
    ends = obs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("observed_on").alias("_d0"),
                                F.max("observed_on").alias("_d1"), F.min_by("value", at).alias("first_value"),
                                F.max_by("value", at).alias("last_value"))
    span = F.datediff("_d1", "_d0")
    a, z = F.col("first_value"), F.col("last_value")
    ok = (F.col("n") >= 2) & (span > 0)
    positive = (a > 0) & (z > 0)
    rate = F.when(ok & positive, F.ln(F.when(positive, z / a)) / F.when(span > 0, span)) \
            .when(ok, (z - a) / F.when(span > 0, span))
    out = ends.select(*by, "n", span.alias("span_days"), "first_value", "last_value", rate.alias("daily_rate"),
                      positive.alias("_pos"), ok.alias("_ok"))
    return out.select(
        *by, "n", "span_days", "first_value", "last_value", "daily_rate",
        F.when(F.col("_ok"), F.when(F.col("_pos"), D.doubling_time(F.col("daily_rate"))).otherwise(D.INF))
        .alias("doubling_time_days"),
        F.when(F.col("_ok"), F.when(a != 0, z / F.when(a != 0, a)).otherwise(D.INF)).alias("relative_gain"),
        F.when(F.col("n") < 2, "fewer than two observations")
        .when(~F.col("_ok"), "observations span no time").alias("reason"))


def daily_sums(observations: DataFrame, by: list[str]) -> DataFrame:
    """Observations reduced to count, sum and sum of squares per day.

    A least-squares fit needs nothing more, and a group then holds at most one row per
    calendar day however many observations it has.
    """
    return observations.groupBy(*by, "observed_on").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"),
        F.min("kind").alias("kmin"), F.max("kind").alias("kmax"))


def _logistic(t, k, r, t0):
    return k / (1.0 + np.exp(-np.clip(r * (t - t0), -500, 500)))


def _least_squares(t, n, s, ss, start, lo, hi, steps):
    """Box-bounded Levenberg-Marquardt on daily sums; returns (params, sse, converged)."""
    def sse(p):
        f = _logistic(t, *p)
        return float(np.sum(ss - 2 * f * s + n * f * f))
    p, damp = np.clip(np.asarray(start, float), lo, hi), 1e-3
    best, done = sse(p), False
    for _ in range(steps):
        f = _logistic(t, *p)
        g = f / p[0] if p[0] > 0 else _logistic(t, 1.0, p[1], p[2])
        slope = p[0] * g * (1 - g)
        jac = np.stack([g, slope * (t - p[2]), -slope * p[1]], axis=1)
        grad = jac.T @ (s - n * f)
        hess = (jac * n[:, None]).T @ jac
        # Parameters held at a bound they push against take no step.
        free = ~(((p <= lo) & (grad < 0)) | ((p >= hi) & (grad > 0)))
        if not free.any():
            return p, best, True
        h = hess[np.ix_(free, free)]
        step = np.zeros(3)
        step[free] = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), grad[free], rcond=None)[0]
        trial = np.clip(p + step, lo, hi)
        value = sse(trial)
        if value < best:
            small = best - value <= 1e-10 * (abs(best) + 1e-300)
            p, best, damp = trial, value, max(damp / 5, 1e-12)
            done = done or small
            if small:
                return p, best, True
        else:
            damp *= 4
            if damp > 1e10:
                return p, best, True
    return p, best, done


def _weighted_median(t, n):
    order, total = np.argsort(t), int(n.sum())
    cum = np.cumsum(n[order])
    low = t[order][np.searchsorted(cum, (total - 1) // 2 + 1)]
    high = t[order][np.searchsorted(cum, total // 2 + 1)]
    return float(low + high) / 2.0


def _fit_days(pdf: pd.DataFrame, max_steps: int = MAX_STEPS) -> dict:
    pdf = pdf.sort_values("observed_on")
    origin = pd.Timestamp(pdf["observed_on"].iloc[0])
    t = (pd.to_datetime(pdf["observed_on"]) - origin).dt.days.to_numpy(float)
    n, s, ss = (pdf[c].to_numpy(float) for c in ("n", "s", "ss"))
    total, span = int(n.sum()), float(t.max() - t.min())
    kinds = {pdf["kmin"].min(), pdf["kmax"].max()}
    out = {"origin": origin.date(), "n_observations": total, "proxy_kind": kinds.pop() if len(kinds) == 1 else "mixed",
           "k": None, "r": None, "t0": None, "r_squared": None, "converged": False, "note": ""}
    if total < MIN_OBSERVATIONS:
        return {**out, "note": "fewer than four observations"}
    if span == 0:
        return {**out, "note": "all observations fall on one date"}
    peak, middle = float(pdf["vmax"].max()), _weighted_median(t, n)
    k0 = peak * 1.2 or 1.0
    if k0 >= 0:
        lo, hi = np.array([0.0, 1e-6, t.min() - span]), np.array([np.inf, 1.0, t.max() + span])
        p, sse, ok = _least_squares(t, n, s, ss, (k0, 1.0 / max(span / 4.0, 1.0), middle), lo, hi, max_steps)
        if ok and np.isfinite(p).all():
            spread = float(ss.sum() - s.sum() ** 2 / total)
            r2 = 1.0 - sse / spread if spread > 0 else 0.0
            return {**out, "k": p[0], "r": p[1], "t0": p[2], "r_squared": r2, "converged": True,
                    "note": "weak fit" if r2 < 0.5 else "fitted to a spectral proxy"}
    first, last = float(pdf["vmin"].iloc[0]), float(pdf["vmax"].iloc[-1])
    rate = np.log(last / first) / span if first > 0 and last > 0 else (last - first) / span
    return {**out, "k": peak, "r": float(rate), "t0": middle, "note": "no convergence; rate from first and last"}


def fit_growth_curves(observations: DataFrame, by: list[str], max_steps: int = MAX_STEPS) -> DataFrame:
    """Logistic fit per group, over daily sums.

    The solver is iterative, so it runs in a grouped map; its input is bounded by the
    calendar (see :func:`daily_sums`).  A fit that has not settled after ``max_steps`` is
    reported as not converged, with the rate between the first and the last value.
    """
    def fit(key, pdf):
        return pd.DataFrame([{**dict(zip(by, key)), **_fit_days(pdf, max_steps)}])
    kinds = {f.name: f.dataType.simpleString() for f in observations.schema.fields}
    schema = ", ".join([f"{b} {kinds[b]}" for b in by] + [
        "origin date", "n_observations long", "proxy_kind string", "k double", "r double", "t0 double",
        "r_squared double", "converged boolean", "note string"])
    # The rows are few but each group costs solver time: a fixed partition count keeps the
    # groups spread, where size-based coalescing would pack them into one task.
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return daily_sums(observations, by).repartition(parts, *by).groupBy(*by).applyInPandas(fit, schema)


def harvest_windows(observations: DataFrame, by: list[str], season_year: Column | None = None, lead_days: int = 14,
                    peak_fraction: float = 0.95) -> DataFrame:
    """Cutting window per group: the fitted peak when plausible, else the published one."""
    if lead_days < 0:
        raise ValueError("lead_days must be >= 0")
    latest = observations.groupBy(*by).agg(F.max("observed_on").alias("latest"), F.count(F.lit(1)).alias("n"))
    fits = fit_growth_curves(observations, by)
    base = latest.join(fits, by)
    year = F.year("latest") if season_year is None else season_year
    base = base.withColumn("season_year", year).withColumn("prior", D.prior_peak(F.col("season_year")))
    day = F.rint(D.day_at_fraction(F.lit(peak_fraction), F.col("r"), F.col("t0")))
    # A day count beyond any calendar cannot be added to a date.
    offset = F.when(F.abs(day) < 200000, day.cast("int"))
    base = base.withColumn("_fit", F.date_add(F.col("origin"), offset))
    plausible = (F.col("n") >= 4) & F.col("_fit").isNotNull() & (
        (F.year("_fit") == F.col("season_year")) | (F.abs(F.datediff("_fit", "origin")) < 400))
    base = base.withColumn("_cand", F.coalesce(F.when(plausible, F.col("_fit")), F.col("prior")))
    far = F.abs(F.datediff("_cand", "prior")) > 60
    base = base.withColumn("peak_date", F.when(far, F.col("prior")).otherwise(F.col("_cand"))) \
               .withColumn("window_start", F.date_sub("peak_date", lead_days)) \
               .withColumn("fraction", D.nutrient_content(F.col("peak_date")))
    fitted = F.col("k").isNotNull()
    warnings = F.array(
        F.when((F.col("n") >= 4) & ~fitted, F.lit("no growth curve could be fitted")),
        F.when(fitted & (F.coalesce("r_squared", F.lit(0.0)) < 0.5), F.lit("the growth curve fit is weak")),
        F.when(~plausible, F.lit("peak placed from published phenology")),
        F.when(far, F.lit("fitted peak is over 60 days from published phenology")),
        F.when(F.year("window_start") != F.year("peak_date"), F.lit("window starts in the previous year")))
    return base.select(
        *by, "season_year", "window_start", F.col("peak_date").alias("window_end"), "peak_date",
        (F.datediff("peak_date", "window_start") + 1).alias("days"), F.lit(lead_days).alias("lead_days"),
        F.round("fraction", 4).alias("expected_nutrient_fraction"),
        F.round(F.col("fraction") * C.SENESCENCE_RELEASE, 4).alias("senescence_loss_avoided"),
        F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))


def senescence_curve(starts: DataFrame, days: int = 400) -> DataFrame:
    """Nutrient fraction for each of ``days`` days from ``start``."""
    dates = F.sequence(F.col("start"), F.date_add("start", days - 1), F.expr("interval 1 day"))
    return starts.withColumn("date", F.explode(dates)) \
                 .withColumn("nutrient_fraction", F.round(D.nutrient_content(F.col("date")), 4))


# --- constraints --------------------------------------------------------------------

def check_violations(df: DataFrame, name: str, check: Column, key: list[str]) -> DataFrame:
    """Rows failing a CHECK; as in SQL a NULL check passes."""
    return _violations(df.where(~F.coalesce(check, F.lit(True))), name, key)


def unique_violations(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    many = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return _violations(many, name, key)


def foreign_key_violations(df: DataFrame, name: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-NULL references without a parent row."""
    orphans = df.where(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return _violations(orphans, name, [key])


def _violations(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    return df.select(F.lit(name).alias("constraint"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"))


def check_constraints(areas: DataFrame | None = None, detections: DataFrame | None = None,
                      threats: DataFrame | None = None, composites: DataFrame | None = None,
                      biomass: DataFrame | None = None, harvests: DataFrame | None = None) -> DataFrame:
    """Every violated constraint of the decision tables, one row per offending key."""
    found = []
    if areas is not None:
        found += [check_violations(areas, "areas.role", F.col("role").isin(C.AREA_ROLES), ["key"]),
                  unique_violations(areas, "areas.key", ["key"])]
    if detections is not None:
        found += [check_violations(detections, "detections.class_code", F.col("class_code").between(0, 3), ["detection_id"]),
                  check_violations(detections, "detections.confidence", F.col("confidence").between(0, 1), ["detection_id"])]
        if areas is not None:
            found.append(foreign_key_violations(detections, "detections.area_key", "area_key", areas, "key"))
        if composites is not None and "composite_id" in detections.columns:
            found.append(foreign_key_violations(detections, "detections.composite_id", "composite_id", composites, "id"))
    if threats is not None:
        found += [check_violations(threats, "threat_scores.score", F.col("score").between(0, 100), ["detection_id"]),
                  unique_violations(threats, "threat_scores.detection_id", ["detection_id"])]
        if detections is not None:
            found.append(foreign_key_violations(threats, "threat_scores.fk", "detection_id", detections, "detection_id"))
    if composites is not None:
        found.append(unique_violations(composites, "composites.unique", ["area_key", "target_date", "window_days", "gsd"]))
    if biomass is not None:
        found.append(unique_violations(biomass, "biomass.unique", ["area_key", "observed_on", "proxy_kind"]))
    if harvests is not None:
        found.append(unique_violations(harvests, "harvest_windows.unique", ["area_key", "season_year"]))
    for name, df in (("composites", composites), ("biomass", biomass), ("harvest_windows", harvests)):
        if df is not None and areas is not None:
            found.append(foreign_key_violations(df, f"{name}.area_key", "area_key", areas, "key"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
