"""Composites of overlapping date windows against one-by-one painting."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshgrid.operators import raster as R
from marshgrid.operators import season as Se
from marshgrid.plans import composite as Co

DAY0 = dt.date(2024, 3, 1)
PX = "area string, scene int, row int, col int, b1 int, b2 int, valid boolean"


def season_data(seed):
    rng = random.Random(seed)
    scenes = {(a, s): (DAY0 + dt.timedelta(rng.randint(0, 14)), rng.choice([None, 1.0, 2.0, rng.random() * 9]))
              for a in "ab" for s in range(12)}
    px = [(a, s, p // 7, p % 7, rng.randint(1, 60000), s, rng.random() < .8) for a, s in scenes for p in range(49) if rng.random() < .5]
    targets = [(a, DAY0 + dt.timedelta(k)) for a in "ab" for k in range(-6, 22) if rng.random() < .7]
    return scenes, px, targets


def paint(scenes, px, targets, window, target):
    """Each date on its own, scene by scene."""
    out = {}
    for a, day in targets:
        near = [(c is None, c or 0, d, s) for (b, s), (d, c) in scenes.items() if b == a and abs((d - day).days) <= window]
        done = {}
        for *_, s in sorted(near):
            done.update({(r, c): (s, v) for b, t, r, c, v, _, ok in px if (b, t) == (a, s) and ok and (r, c) not in done})
            if len(done) / 49 >= target:
                break
        out.update({(a, day, *p): w for p, w in done.items()})
    return out


@pytest.mark.parametrize("seed,window,target,size", [(1, 3, .999, 32), (2, 3, .5, 2), (3, 0, .999, 4), (4, 9, .7, 3)])
def test_equals_one_by_one(spark, seed, window, target, size):
    scenes, px, targets = season_data(seed)
    dim = spark.createDataFrame([(a, s, d, c) for (a, s), (d, c) in scenes.items()], "area string, scene int, acquired date, cloud double")
    frame = spark.createDataFrame([("a", 49), ("b", 49)], "area string, total_px long")
    want = paint(scenes, px, targets, window, target)
    got = Se.season_mosaics(spark.createDataFrame(px, PX), dim, spark.createDataFrame(targets, "area string, target_date date"), frame,
                            ["b1", "b2"], ["area"], window, target, size=size).collect()
    assert len(got) == len(want)
    assert {(r["area"], r["target_date"], r["row"], r["col"]): (r["scene"], r["b1"]) for r in got} == want
    assert all(r["b2"] == r["scene"] for r in got)


def test_each_observation_leaves_one_interval_at_most():
    rng = np.random.default_rng(0)
    n, w = 400, 4
    row, day, rank = rng.integers(0, 9, n), rng.integers(0, 40, n), rng.permutation(n)
    at, first, last = Se.winning_days(row, np.zeros(n), day, rank, w)
    assert len(set(at)) == len(at) <= n
    for p in range(9):
        for t in range(-w, 40 + w):
            near = [i for i in range(n) if row[i] == p and abs(day[i] - t) <= w]
            won = [i for i, f, z in zip(at, first, last) if row[i] == p and f <= t <= z]
            assert won == ([min(near, key=lambda i: rank[i])] if near else [])


def test_empty_undated_and_unusable(spark):
    dim = spark.createDataFrame([("a", 1, DAY0, 1.0), ("a", 2, None, 0.0), (None, 3, DAY0, 0.0)],
                                "area string, scene int, acquired date, cloud double")
    px = spark.createDataFrame([("a", 1, 0, 0, 5, 5, True), ("a", 2, 0, 0, 6, 6, True), (None, 3, 0, 0, 7, 7, True)], PX)
    targets = spark.createDataFrame([("a", DAY0), ("a", DAY0), ("a", DAY0 + dt.timedelta(60)), ("gone", DAY0)], "area string, target_date date")
    frame = spark.createDataFrame([("a", 1), ("gone", 1)], "area string, total_px long")
    args = (dim, targets, frame, ["b1", "b2"], ["area"])
    assert [(r["area"], r["target_date"], r["b1"]) for r in Se.season_mosaics(px, *args).collect()] == [("a", DAY0, 5)]
    assert Se.season_mosaics(px.limit(0), *args).count() == 0
    for bad in (dict(by=[]), dict(by=["area"], window_days=-1)):
        with pytest.raises(ValueError):
            Se.winners_by_day(px, dim, ["b1"], **bad)


def test_plan_shuffles_observations_once(spark):
    """One row an observation reaches the blocks, and no date is joined before that."""
    _, px, _ = season_data(5)
    dim = spark.createDataFrame([(a, s, DAY0, 1.0) for a in "ab" for s in range(12)], "area string, scene int, acquired date, cloud double")
    won = Se.winners_by_day(spark.createDataFrame(px, PX), dim, ["b1", "b2"], ["area"], 30)
    plan = won._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    assert won.count() <= sum(x[-1] for x in px)


def test_summary_warns(spark):
    comp = spark.createDataFrame([("a", 1, -0.2), ("a", 2, 0.1)], "area string, scene int, b04 double")
    dim = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "area string, scene int")
    frame = spark.createDataFrame([("a", 5), ("none", 4)], "area string, total_px long")
    got = {r["area"]: r for r in Co.composite_summary(comp, dim, frame, ["area"], bands=["b04"], indices=["ndvi"]).collect()}
    assert (got["a"]["candidates"], got["a"]["contributing"], got["a"]["coverage"]) == ([1, 2, 3], [1, 2], .4)
    assert [w.split(":")[0] for w in got["a"]["warnings"]] == ["negative reflectance", "indices without their bands", "coverage below one half"]
    assert got["none"]["candidates"] is None and got["none"]["coverage"] == 0.0
    fine = Co.composite_summary(comp.where("b04 > 0"), dim, frame.where("area = 'a'").withColumn("total_px", F.lit(2)), ["area"], bands=["b04"]).first()
    assert fine["warnings"] == [] and fine["coverage"] == .5
