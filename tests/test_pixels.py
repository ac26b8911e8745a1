"""Goldens for masks, codec, indices, rule engine, mosaic and percentiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import pixels as P
from marshgrid.operators import labels as L
from marshgrid.operators import raster as R
from marshgrid.operators import scale as Sc
from marshgrid.operators import tiles as T


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.4,), (3.0,)], "x double")
    assert one(df, P.clip(F.col("x"))) == [None, 0.0, 0.4, 1.0]
    # Negative control: the unguarded form invents a value.
    assert one(df, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x"))))[0] == 1.0


def test_normalized_difference(spark):
    df = spark.createDataFrame([(.4, .1), (0.0, 0.0), (None, .2), (float("nan"), .1)], "a double, b double")
    got = one(df, P.normalized_difference(F.col("a"), F.col("b")))
    assert got[0] == pytest.approx(.6) and got[1:] == [None, None, None]
    tight = spark.createDataFrame([(1e-4, -1e-4)], "a double, b double")
    assert one(tight, P.normalized_difference(F.col("a"), F.col("b"), 1e-3)) == [None]


def test_codec(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1e6,), (.12346,), (.99999,), (None,)], "x double")
    code = P.encode_reflectance(F.col("x"))
    assert one(df, code) == [0, 0, 0, 65535, 1235, 10000, 0]
    assert one(df, P.decode_reflectance(code))[4:6] == [pytest.approx(.1235), 1.0]


RULES = [  # ndvi, ndre, ndmi, ndwi -> label, confidence, trainable, review
    (.78, .50, .30, -.12, 3, .7667, True, False),
    (.78, .50, .30, -.35, 3, None, False, True),
    (.62, .25, .08, -.30, 1, .5923, True, True),
    (.30, .10, .05, .05, 2, .5012, True, True),
    (.05, .02, -.10, .60, 0, .7071, True, None),
    (-.021, -.0882, .0523, .033, 0, .447, True, True),
]


def test_weak_label_goldens(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(RULES)], "i int, ndvi double, ndre double, ndmi double, ndwi double")
    got = {r["i"]: r for r in L.weak_label(df).collect()}
    for i, (_, _, _, _, label, conf, trainable, review) in enumerate(RULES):
        assert got[i]["label"] == label and got[i]["trainable"] is trainable
        if conf is not None:
            assert got[i]["confidence"] == pytest.approx(conf, abs=1e-4)
        if review is not None:
            assert got[i]["review"] is review
    assert got[0]["margin"] == pytest.approx(.2310, abs=1e-4)
    assert got[1]["margin"] == pytest.approx(.0667, abs=1e-4) and got[1]["ambiguous"]


def test_weak_label_missing(spark):
    df = spark.createDataFrame([(.3, None, .1, .2, True), (.3, .1, .1, .2, False)],
                               "ndvi double, ndre double, ndmi double, ndwi double, valid boolean")
    for r in L.weak_label(df).collect():
        assert (r["label"], r["usable"], r["review"], r["trainable"], r["confidence"]) == (-1, False, False, False, None)
    with pytest.raises(ValueError):
        L.weak_label(df.drop("ndvi"))
    empty = L.label_statistics(L.weak_label(df), []).first()
    assert empty["usable_px"] == 0 and empty["review_fraction"] == 0.0 and empty["trainable_px"] is None


def paint(obs, order, total, target):
    """Sequential painting, scene by scene."""
    out, done = {}, 0
    for s in order:
        new = {p: (s, v) for (sc, p), v in obs.items() if sc == s and p not in out}
        out.update(new)
        if len(out) / total >= target:
            break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mosaic_equals_painting(spark, seed):
    rng = random.Random(seed)
    total, scenes = 40, {1: 5.0, 2: None, 3: 1.0, 4: 1.0}
    obs = {(s, p): rng.randint(1, 60000) for s in scenes for p in range(total) if rng.random() < .5}
    px = spark.createDataFrame([(s, p // 8, p % 8, v, v % 7, True) for (s, p), v in obs.items()],
                               "scene int, row int, col int, b1 int, b2 int, valid boolean")
    dim = spark.createDataFrame([(s, c, s) for s, c in scenes.items()], "scene int, cloud double, acquired int")
    frame = spark.createDataFrame([(total,)], "total_px long")
    for target in (.6, .999):
        got = R.mosaic_clearest_first(px, dim, frame, ["b1", "b2"], [], target).collect()
        want = paint(obs, [3, 4, 1, 2], total, target)
        assert {r["row"] * 8 + r["col"]: (r["scene"], r["b1"]) for r in got} == want
        # Floating bands take the other path and must agree.
        dbl = R.mosaic_clearest_first(px.withColumn("b1", F.col("b1").cast("double")), dim, frame, ["b1"], [], target)
        assert {r["row"] * 8 + r["col"]: (r["scene"], int(r["b1"])) for r in dbl.collect()} == want


def test_mosaic_per_group_and_unreadable(spark):
    px = spark.createDataFrame([("a", 1, 0, 0, 5, True), ("b", 1, 0, 0, 6, True), ("b", 2, 0, 0, 7, True)],
                               "area string, scene int, row int, col int, b1 int, valid boolean")
    dim = spark.createDataFrame([("a", 1, 1.0, 1, True), ("b", 1, 3.0, 1, True), ("b", 2, 2.0, 2, True)],
                                "area string, scene int, cloud double, acquired int, remote_readable boolean")
    frame = spark.createDataFrame([("a", 1), ("b", 1)], "area string, total_px long")
    got = {r["area"]: r["b1"] for r in R.mosaic_clearest_first(px, dim, frame, ["b1"], ["area"]).collect()}
    assert got == {"a": 5, "b": 7}
    with pytest.raises(Exception, match="not remotely readable"):
        R.rank_scenes(dim.withColumn("remote_readable", F.lit(False)), ["area"]).collect()


def test_exact_percentiles(spark):
    rng = np.random.default_rng(0)
    groups = {"u": rng.normal(size=3000), "hot": np.where(rng.random(4000) < .4, .5, rng.random(4000)), "one": np.array([2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("u", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in Sc.exact_percentiles(df, ["g"], "v", [.02, .5, .9], ["a", "b", "c"]).collect()}
    for g, vs in groups.items():
        want = np.percentile(vs, [2, 50, 90])
        assert [got[g][k] for k in "abc"] == pytest.approx(list(want), abs=1e-12)
        assert got[g]["n"] == len(vs) and got[g]["negatives"] == int((vs < 0).sum())
    flat = Sc.exact_percentiles(df, [], "v", [.5], ["m"]).first()
    assert flat["m"] == pytest.approx(np.percentile(np.concatenate(list(groups.values())), 50))


def test_ordinal_orders_like_the_doubles(spark):
    rng = np.random.default_rng(1)
    drawn = rng.integers(0, 2 ** 63, 4000, dtype=np.uint64).view(np.float64)
    near = [s * np.nextafter(2.0 ** e, d) for e in (-1074, -1022, -1, 0, 1, 52, 1023) for d in (0, np.inf) for s in (1, -1)]
    values = np.unique(np.concatenate([drawn[np.isfinite(drawn)], -drawn[np.isfinite(drawn)], near, [0.0, 5e-324, np.inf, -np.inf]]))
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    keys = [r["k"] for r in Sc.with_ordinal(rows, "v", "k").orderBy("i").collect()]
    bits = values.view(np.int64)
    assert keys == [int(b) if b >= 0 else -int(b & 0x7FFFFFFFFFFFFFFF) for b in bits]
    odd = Sc.with_ordinal(spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)], "v double"), "v", "k").collect()
    assert [r["k"] for r in odd] == [0, 0, keys[-1] + 1]


def test_percentiles_of_any_magnitude(spark):
    rng = np.random.default_rng(2)
    groups = {None: 1.0 + rng.integers(0, 9, 500) * 2.0 ** -52,  # apart in the last bits only
              "wide": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 300)), 10.0 ** rng.uniform(-320, 300, 301)]),
              "ends": np.array([-np.inf, -np.inf, 0.0, np.inf, np.inf]), "pair": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    plan = Sc.exact_percentiles(df.repartition(5), ["g"], "v", [0.0, .1, .5, 1.0], list("abcd"))
    got = {r["g"]: r for r in plan.collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        kept = np.sort(vs)
        assert (got[g]["a"], got[g]["d"], got[g]["vmin"], got[g]["vmax"]) == (kept[0], kept[-1], kept[0], kept[-1])
        for p, k in ((.1, "b"), (.5, "c")):
            at = p * (len(kept) - 1)
            low, high = kept[int(np.floor(at))], kept[int(np.ceil(at))]
            want = low if low == high else low + (high - low) * (at - np.floor(at))
            assert got[g][k] == want or np.isclose(got[g][k], want, rtol=1e-15)
    none = Sc.exact_percentiles(df.where("v is null"), [], "v", [.5], ["m"])
    assert none.collect() == []


def test_percentile_windows_hold_bins_only(spark):
    """No job while the plan is built, and the input is read once."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7).alias("v"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = Sc.exact_percentiles(df, ["g"], "v", [.25, .75], ["a", "b"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Range (0, 1000") == 1 and "ReusedExchange" in text


def test_global_rank_with_hot_value(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("v"))
    got = {r["id"]: r["rn"] for r in Sc.global_rank(df, [F.col("v").desc(), F.col("id").asc()]).collect()}
    rows = sorted(((-(1 if i % 3 > 0 else i), i) for i in range(5000)))
    assert [got[i] for _, i in rows] == list(range(1, 5001))


def test_histogram_equals_numpy(spark):
    # The definition is numpy's, whose bin edges carry rounding: .05 lies below edge 21.
    edges = [round(-1 + i * .05, 2) for i in range(41)]
    values = [*edges, 1.5, -1.2, *np.random.default_rng(1).uniform(-1, 1, 500)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "ndvi double")
    got = {r["bin"]: r for r in R.index_histogram(df, "ndvi", []).collect()}
    want, _ = np.histogram(values, bins=40, range=(-1.0, 1.0))
    assert [got[i]["px"] for i in range(40)] == list(want)
    assert got[0]["count"] == len(values)


def test_linspace_and_even(spark):
    for n, k in ((7, 3), (10, 10), (5, 9), (9, 1), (97, 96), (250, 200)):
        items = spark.range(n)
        want = sorted({int(x) for x in np.linspace(0, n - 1, min(k, n), dtype=int)})
        got = sorted(r["position"] for r in T.linspace_sample(items, [F.col("id")], k).collect())
        assert got == want, (n, k)
    for n, k in ((10, 4), (4, 9), (7, 1), (12, 5)):
        want = list(range(n)) if k >= n else [n // 2] if k == 1 else [round(i * (n - 1) / (k - 1)) for i in range(k)]
        got = sorted(r["id"] for r in T.evenly_spaced(spark.range(n), [F.col("id")], k).collect())
        assert got == want, (n, k)


def test_pixel_plan_has_no_python_or_cartesian(spark, sf):
    from harness import q_pixels
    for fn in (q_pixels.weak, q_pixels.e1, q_pixels.c6_tallies):
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "CartesianProduct" not in plan


def test_contract_validation(spark):
    assert C.band_dim(spark).count() == 11 and C.area_dim(spark).count() == 3
    with pytest.raises(ValueError):
        C.band_dim(spark, mask=("SCL", "scl", 20, "bilinear"))
    with pytest.raises(ValueError):
        C.band_dim(spark, bands=[("B02", "blue", 10, "spline")])
    with pytest.raises(ValueError):
        C.area_dim(spark, [("k", "n", "wetland", 1.0, 1.0, 1.0, 2.0, "EPSG:32636")])


def test_band_resolution():
    from marshgrid.operators.catalog import resolve_bands
    assert resolve_bands(None, ["ndvi"]) == ["B04", "B08"]
    assert resolve_bands(None, ["ndvi", "ndwi", "ndre", "ndmi"]) == ["B03", "B04", "B05", "B08", "B11"]
    assert resolve_bands(None, []) == C.BANDS_8 and resolve_bands(["B02"], ["ndvi"]) == ["B02"]
    assert math.isclose(C.reflectance_offset("offset_applied"), -0.1)
