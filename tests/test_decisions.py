"""Threat, growth, harvest, metrics, sinks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import decision as D
from marshgrid.operators import decisions as Dec
from marshgrid.operators import metrics as M
from marshgrid.sources import detections as Det


def test_threat(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 1.0), (2, 0.0, 200.0, 0.0), (3, 1.5, 60.0, 0.5)],
                               "id int, coverage double, canal_width_m double, upstream_priority double")
    got = {r["id"]: r for r in Dec.score_threats(df).collect()}
    assert got[1]["score"] > 90 and got[1]["band"] == "critical" and got[2]["score"] < 10 and got[2]["band"] == "low"
    assert got[3]["coverage_component"] == 1.0 and any("clamped" in n for n in got[3]["notes"])
    ranks = {r["id"]: r["rank"] for r in Dec.rank_by_threat(Dec.score_threats(df)).collect()}
    assert ranks == {1: 1, 3: 2, 2: 3}


def obs(spark, rows):
    return spark.createDataFrame([(a, dt.date(2023, 1, 1) + dt.timedelta(days=d), float(v), "ndvi") for a, d, v in rows],
                                 "area string, observed_on date, value double, kind string")


def test_expansion(spark):
    df = obs(spark, [("a", 0, 10), ("a", 10, 20), ("b", 0, 0), ("b", 10, 5), ("c", 0, 1)])
    got = {r["area"]: r for r in Dec.expansion_rate(df, ["area"]).collect()}
    assert got["a"]["doubling_time_days"] == pytest.approx(10) and got["b"]["daily_rate"] == .5
    assert math.isinf(got["b"]["doubling_time_days"]) and got["c"]["daily_rate"] is None and got["c"]["reason"]


def test_time_to_blockage(spark):
    df = spark.createDataFrame([(.25, .01), (.9, .01), (.3, 0.0), (1.2, .1)], "c double, r double")
    got = [r[0] for r in df.select(D.time_to_blockage(F.col("c"), F.col("r"))).collect()]
    assert got[0]["days"] == pytest.approx(109.9) and got[1]["already_blocked"] and got[1]["days"] == 0
    assert got[2]["days"] is None and "not growing" in got[2]["reason"] and "outside" in got[3]["reason"]


def test_nutrient_matches_interp(spark):
    mids = np.cumsum(C.DAYS_IN_MONTH) - np.array(C.DAYS_IN_MONTH) / 2.0
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as d")
    for r in days.select("d", D.nutrient_content(F.col("d")).alias("v")).collect():
        want = np.interp(r["d"].timetuple().tm_yday, mids, C.NUTRIENT_BY_MONTH, period=365)
        assert r["v"] == pytest.approx(want)


def test_logistic_recovery_and_harvest(spark):
    rng = np.random.default_rng(0)
    rows = [("g", t, .85 / (1 + math.exp(-.05 * (t - 90))) + rng.normal(0, .01)) for t in range(0, 200, 8)]
    rows += [("few", 0, 1.0), ("few", 5, 2.0), ("flat", 0, .5), ("flat", 10, .5), ("flat", 20, .5)]
    rows += [("down", 0, -1.0), ("down", 10, -2.0), ("down", 20, -2.0), ("down", 30, -3.0)]
    got = {r["area"]: r for r in Dec.fit_growth_curves(obs(spark, rows), ["area"]).collect()}
    g = got["g"]
    assert abs(g["k"] - .85) < .85 * .15 and abs(g["r"] - .05) < .05 * .25 and abs(g["t0"] - 90) < 20 and g["r_squared"] > .95
    assert got["few"]["k"] is None and not got["down"]["converged"] and got["down"]["r_squared"] is None
    win = {r["area"]: r for r in Dec.harvest_windows(obs(spark, rows), ["area"]).collect()}
    assert win["flat"]["peak_date"] == dt.date(2023, 8, 15) and win["flat"]["days"] == 15 and win["flat"]["warnings"]
    assert all(w["peak_date"] for w in win.values())
    with pytest.raises(ValueError):
        Dec.harvest_windows(obs(spark, rows), ["area"], lead_days=-1)


def conf(spark, m):
    return spark.createDataFrame([(t, p, n) for t, row in enumerate(m) for p, n in enumerate(row) if n], "target int, prediction int, n long")


def test_metrics(spark):
    m = [[1, 1, 0, 0], [0] * 4, [0] * 4, [0] * 4]
    got = {r["class_code"]: r for r in M.class_scores(conf(spark, m)).collect()}
    assert got[0]["iou"] == .5 and got[2]["iou"] is None
    m = [[0, 0, 0, 2], [0] * 4, [0] * 4, [0, 0, 0, 8]]
    got = {r["class_code"]: r for r in M.class_scores(conf(spark, m)).collect()}
    assert got[3]["f1"] == pytest.approx(.8889, abs=1e-4)
    rep = M.segmentation_report(M.class_scores(conf(spark, [[3, 1, 0, 0], [0] * 4, [0] * 4, [0] * 4]))).first()
    assert rep["pixel_accuracy"] == .75
    v = M.target_verdict(M.segmentation_report(M.class_scores(conf(spark, m))), False, "why").first()
    assert v["both_met"] is None and v["reason"] == "why"


@pytest.mark.parametrize("m,status,ok,text", [
    ([[0] * 4, [0] * 4, [0] * 4, [0, 0, 0, 900]], "verified", False, "1 class"),
    ([[50, 0, 0, 0], [0] * 4, [0] * 4, [5, 0, 0, 35]], "verified", False, "40 annotated reed"),
    ([[500, 0, 0, 0], [0] * 4, [0] * 4, [10, 0, 0, 900]], "unverified", False, "detail"),
    ([[0, 0, 0, 500], [0] * 4, [0] * 4, [0, 0, 0, 900]], "verified", False, "single class"),
    ([[500, 0, 0, 0], [0] * 4, [0] * 4, [10, 0, 0, 900]], "verified", True, "independent"),
])
def test_assess(spark, m, status, ok, text):
    ind = spark.createDataFrame([(status, "detail")], "status string, detail string")
    r = M.assess(M.class_scores(conf(spark, m)), ind).first()
    assert r["assessable"] is ok and text in r["verdict"]


def test_threat_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "threats")
    cols = "detection_id long, score double, coverage_component double, width_component double, priority_component double"
    Det.append_threat_scores(spark.createDataFrame([(1, 5.0, 1.0, 1.0, 1.0), (2, 6.0, 1.0, 1.0, 1.0)], cols), path, 1)
    Det.append_threat_scores(spark.createDataFrame([(1, 9.0, 1.0, 1.0, 1.0)], cols), path, 2)
    assert {r["detection_id"]: r["score"] for r in Det.read_threat_scores(spark, path).collect()} == {1: 9.0, 2: 6.0}
