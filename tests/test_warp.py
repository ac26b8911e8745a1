import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshgrid.functions import geo as G
from marshgrid.operators import warp as W

SRC = dict(gsd=20.0, x0=785000.0, y0=3430000.0, height=23, width=31, epsg=32635)
SHIFTED = dict(gsd=7.0, x0=784990.0, y0=3430033.0, height=60, width=80, epsg=32635)
OTHER = dict(gsd=15.0, x0=211800.0, y0=3430100.0, height=60, width=60, epsg=32636)


def weight(method, d):
    x = abs(d)
    if method == "bilinear":
        return max(0.0, 1 - x)
    if method == "cubic":
        return (1.5 * x - 2.5) * x * x + 1 if x <= 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0
    return float(math.floor(d + 0.5) == 0)


def brute(samples, src, dst, method):
    """Every target pixel from all samples near its centre, one at a time."""
    out = {}
    for r in range(dst["height"]):
        for c in range(dst["width"]):
            v, u = (float(x[0]) for x in W.moved(np.array([float(r)]), np.array([float(c)]), dst, src))
            if not (0 <= math.floor(v + 0.5) < src["height"] and 0 <= math.floor(u + 0.5) < src["width"]):
                continue
            total = have = 0.0
            touched = False
            for i in range(math.floor(v) - 2, math.floor(v) + 4):
                for j in range(math.floor(u) - 2, math.floor(u) + 4):
                    w = weight(method, v - i) * weight(method, u - j)
                    if w and (i, j) in samples:
                        touched = True
                        if samples[i, j] is not None:
                            total, have = total + w * samples[i, j], have + w
            if touched:
                out[r, c] = total / have if abs(have) > 1e-12 else None
    return out


def grid(g):
    return W.grid(*(g[k] for k in ("gsd", "x0", "y0", "height", "width", "epsg")))


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    return {(i, j): None if rng.random() < 0.1 else float(rng.integers(1, 500)) for i in range(23) for j in range(31) if rng.random() < 0.9}


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
def test_equals_brute_force(spark, samples, method):
    rows = [(g, i, j, v, 7) for g in ("a", "b", "empty") for (i, j), v in samples.items() if g != "empty"]
    px = spark.createDataFrame(rows, "area string, row int, col int, v double, other int")
    frames = spark.createDataFrame([("a",), ("b",), ("empty",)], "area string").select(
        "area", grid(SRC).alias("src"), F.when(F.col("area") == "a", grid(SHIFTED)).otherwise(grid(OTHER)).alias("dst"))
    got = {"a": {}, "b": {}}
    for r in W.warp(px, frames, ["v"], ["area"], method, size=8).collect():  # many blocks and halos
        got[r["area"]][r["row"], r["col"]] = r["v"]
    for area, dst in (("a", SHIFTED), ("b", OTHER)):
        want = brute(samples, SRC, dst, method)
        assert want and got[area].keys() == want.keys()
        for k, v in want.items():
            assert got[area][k] == (None if v is None else pytest.approx(v, rel=1e-6, abs=1e-6)), k


def test_projection_on_arrays_equals_columns(spark):
    pts = [(31.2, 30.9, 32636), (29.99, 31.4, 32635), (18.4, -33.9, 32734)]
    df = spark.createDataFrame(pts, "lon double, lat double, epsg int")
    for (lon, lat, epsg), r in zip(pts, df.select(G.project_point(F.col("lon"), F.col("lat"), F.col("epsg")).alias("p")).collect()):
        x, y = W.utm_of(np.radians(np.array([lon])), np.radians(np.array([lat])), epsg)
        assert (x[0], y[0]) == pytest.approx(tuple(r["p"]), abs=1e-6)
        back = np.degrees(np.array(W.lonlat_of(x, y, epsg)))[:, 0]
        assert tuple(back) == pytest.approx((lon, lat), abs=1e-9)


def test_integers_stay_and_codes_are_not_interpolated(spark):
    px = spark.createDataFrame([(0, 0, 5, None), (0, 1, 7, 3)], "row int, col int, code int, dn int")
    one = spark.range(1).select(W.grid(20, 0, 0, 1, 2, 32636).alias("src"), W.grid(10, 0, 0, 2, 4, 32636).alias("dst"), F.lit("x").alias("area"))
    got = W.warp(px.withColumn("area", F.lit("x")), one, ["code", "dn"], ["area"], "nearest", categorical=True)
    assert dict(got.dtypes)["code"] == "int"
    assert {(r["row"], r["col"]): (r["code"], r["dn"]) for r in got.collect()} == {(i, j): ((5, None) if j < 2 else (7, 3)) for i in range(2) for j in range(4)}
    for bad in (dict(method="bilinear", categorical=True), dict(method="average"), dict(method="lanczos")):
        with pytest.raises(ValueError):
            W.warp(px, one, ["code"], ["area"], **bad)


def test_scan_follows_the_contract(spark):
    contract = [("fine", "f", 10, "bilinear"), ("coarse", "c", 20, "bilinear")]
    rows = [("s", "fine", i, j, 100 * i + j) for i in range(4) for j in range(4)] + [("s", "coarse", i, j, 10 * i) for i in range(2) for j in range(2)]
    rows += [("s", "mask", i, j, 9 if (i, j) == (0, 0) else 4) for i in range(2) for j in range(2)] + [("s", "unused", 0, 0, 1)]
    long = spark.createDataFrame(rows, "scene string, band string, row int, col int, dn int")
    frames = spark.createDataFrame([("s", 10.0, 4), ("s", 20.0, 2)], "scene string, gsd double, n int").select(
        "scene", "gsd", W.grid(F.col("gsd"), 0, 0, F.col("n"), F.col("n"), 32636).alias("src"), W.grid(10, 0, 0, 4, 4, 32636).alias("dst"))
    got = {(r["row"], r["col"]): r for r in W.scan_to_grid(long, frames, ["fine", "coarse"], ["scene"], contract, ("mask", "m", 20, "nearest")).collect()}
    assert len(got) == 16 and not got[1, 1]["valid"] and got[1, 1]["fine"] is None and got[3, 2]["fine"] == 302
    assert [got[i, 2]["coarse"] for i in range(4)] == [0, 2, 8, 10]  # 2.5 and 7.5 go to the even neighbour
    with pytest.raises(ValueError):
        W.scan_to_grid(long, frames, ["unknown"], ["scene"], contract)
