"""Steps whose cost grew too fast: generated code that the JVM compiles, equal pixels met once."""

import contextlib
import io
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harness import bindings as B
from harness import q_annotate as Q
from harness import q_pixels  # noqa: F401
from harness.registry import QUERIES
from marshgrid import contract as C
from marshgrid.operators import annotate as A
from marshgrid.operators import classify as K
from marshgrid.operators import metrics as M
from marshgrid.operators import raster as R
from marshgrid.operators import tiles as T
from marshgrid.sources import catalog as S

#: Bytecodes of a method from which on the JVM interprets it for good.
HUGE = 8000
BANDS = ["a", "b"]


def code_size(df):
    """Largest generated method of the plan, exchanges fixed."""
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    adaptive = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.select("*").explain("codegen")
    finally:
        spark.conf.set(name, adaptive)
    return max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))


def pixels(spark):
    rows = [(s, r, c, r % 2, (r + c) % 5 != 0, (r * c) % 7 != 0, None if (r + c) % 11 == 0 else float(r % 3), float(c % 2))
            for s in (1, 2) for r in range(20) for c in range(20)]
    return rows, spark.createDataFrame(
        rows, "scene int, row int, col int, label int, trainable boolean, usable boolean, a double, b double")


def tiles(spark):
    rows = [(s, t, x) for s in (1, 2) for t in (0, 4, 8) for x in (0, 4, 12)]
    return rows, spark.createDataFrame(rows, "scene int, top int, left int")


def covers(tile_rows, scene, row, col, size=8):
    return sum(s == scene and t <= row < t + size and x <= col < x + size for s, t, x in tile_rows)


def test_training_code_is_compiled(spark, sf):
    px = B.labelled(spark, sf)
    fp = Q.footprints(spark, sf).select("scene", "top", "left")
    assert code_size(T.band_statistics(px, fp, Q.BANDS, ["scene"], Q.SIZE, Q.STRIDE)) < HUGE
    assert code_size(T.distinct_pixels(px, fp, ["label", *Q.BANDS], ["scene"], Q.SIZE, Q.STRIDE, "trainable")) < HUGE


def test_distinct_pixels_and_statistics_by_brute_force(spark):
    (rows, px), (at, tl) = pixels(spark), tiles(spark)
    want, moments = Counter(), []
    for s, r, c, label, trainable, usable, a, b in rows:
        n = covers(at, s, r, c)
        if trainable and n:
            want[(label, a, b)] += n
        if usable and a is not None:
            moments += [(a, b)] * n
    got = T.distinct_pixels(px, tl, ["label", *BANDS], ["scene"], 8, 4, "trainable").collect()
    assert {(x["label"], x["a"], x["b"]): x["n"] for x in got} == dict(want) and len(got) == len(want)
    for x in T.band_statistics(px, tl, BANDS, ["scene"], 8, 4).collect():
        v = [m[x["position"]] for m in moments]
        mean = sum(v) / len(v)
        assert x["usable_px"] == len(v) and x["mean"] == pytest.approx(mean, abs=1e-6)
        assert x["std"] == pytest.approx((sum((y - mean) ** 2 for y in v) / len(v)) ** 0.5, abs=1e-6)


def test_statistics_without_a_known_band_fail(spark):
    _, px = pixels(spark)
    _, tl = tiles(spark)
    none = px.withColumn("a", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no usable pixels"):
        T.band_statistics(none, tl, BANDS, ["scene"], 8, 4).collect()


def test_training_reads_the_pixels_once(spark):
    """Counts, statistics and weights of a split from one table of its different pixels, by brute force."""
    (rows, px), (at, tl) = pixels(spark), tiles(spark)
    named = [(*t, "train" if t[1] < 8 else "test") for t in at]
    split = spark.createDataFrame(named, "scene int, top int, left int, split string")
    seen = T.split_pixels(px, split, BANDS, ["scene"], 8, 4)
    want = Counter()
    for s, r, c, label, trainable, usable, a, b in rows:
        for name in ("train", "test"):
            n = covers([t[:3] for t in named if t[3] == name], s, r, c)
            if n:
                want[(name, label, usable, trainable, a, b)] += n
    got = {tuple(x[k] for k in ("split", "label", "usable", "trainable", *BANDS)): x["n"] for x in seen.collect()}
    assert got == dict(want)
    train = split.where("split = 'train'")
    part = seen.where("split = 'train'")
    assert sorted(T.statistics_of_distinct(part, train, BANDS).collect()) == sorted(
        T.band_statistics(px, train, BANDS, ["scene"], 8, 4).collect())


def test_predictions_are_those_of_the_fitted_model(spark):
    data = Q.training_data(spark, "/root/testdata/sf0.01")
    model = Q.fit(data, Q.BANDS)
    values = spark.range(500).select("id", *[(F.rand(i) * 0.6).alias(b) for i, b in enumerate(Q.BANDS)])
    scaled = T.standardise_bands(values, model.band_statistics, Q.BANDS)
    want = {x["id"]: int(x["prediction"]) for x in model.pipeline.transform(scaled).select("id", "prediction").collect()}
    got = {x["id"]: x["prediction"] for x in K.predict_pixels(model, values, Q.BANDS).collect()}
    assert got == want and len(set(got.values())) > 1
    broken = values.withColumn(Q.BANDS[0], F.lit(float("nan")))
    with pytest.raises(Exception, match="not a number"):
        K.predict_pixels(model, broken, Q.BANDS).collect()
    # Every split and score of both arms comes from the table of different pixels.
    assert {x["support_px"] > 0 for x in K.evaluate(model, data[2], "test").collect()} == {True}


def test_tile_agreement_of_counts(spark):
    rows = [("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("a", 1, None), ("b", 2, 3), ("b", -1, 2)]
    one = spark.createDataFrame(rows, "key string, target int, prediction int")
    counts = one.groupBy("key", "target", "prediction").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(map(tuple, M.tile_agreement(counts, ["key"], "n").collect()))
    assert got == sorted(map(tuple, M.tile_agreement(one, ["key"]).collect())) == [("a", 4, 0.6667), ("b", 1, 0.0)]


def test_pixels_meet_their_tiles_before_prediction(spark, sf):
    (rows, px), (at, tl) = pixels(spark), tiles(spark)
    got = {(x["scene"], x["row"], x["col"]): sorted(tuple(t) for t in x["tiles"])
           for x in T.tiles_over_pixels(px, tl, ["scene"], 8, 4).collect()}
    want = {(s, r, c): sorted((t, x) for z, t, x in at if covers([(z, t, x)], s, r, c)) for s, r, c, *_ in rows}
    assert got == {k: v for k, v in want.items() if v}
    keyed = Q.footprints(spark, sf).select("scene", "top", "left", "key")
    assert code_size(T.tiles_over_pixels(B.px_obs(spark, sf), keyed, ["scene"], Q.SIZE, Q.STRIDE)) < HUGE


def test_burnt_runs_by_brute_force(spark):
    """Overlapping boxes, a null class and a raster tile; no pixel is held by an aggregate."""
    rng = random.Random(5)
    boxes = [(k, f, rng.choice([0, 1, 3]), x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9))
             for k in range(6) for f in range(7) for x, y in [(rng.randrange(-3, 14), rng.randrange(-3, 14))]]
    rows = [(k, f, code, [[(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]], 16, 16)
            for k, f, code, x0, y0, x1, y1 in boxes]
    poly = spark.createDataFrame(rows, "key int, feature_pos int, class_code int, "
                                       "rings array<array<struct<x:double,y:double>>>, height int, width int")
    want = {}
    for k, f, code, x0, y0, x1, y1 in boxes:
        want.update({(k, r, c): code for r in range(max(y0, 0), min(y1, 16)) for c in range(max(x0, 0), min(x1, 16))})
    out = A.rasterize_polygons(poly)
    got = [((x["key"], x["row"], x["col"]), x["class_code"]) for x in out.collect()]
    assert dict(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [" in line and "col#" in line.split("],")[0] for line in plan.splitlines())
    raster = spark.createDataFrame([(2, 0, 0, 200)], "key int, row int, col int, class_code int")
    chips = spark.range(6).selectExpr("cast(id as int) as key", "16 as height", "16 as width")
    read = {tuple(x) for x in A.read_annotations(raster, None, chips, polygons=poly).collect()}
    assert read == {(*k, v) for k, v in want.items() if k[0] != 2} | {(2, 0, 0, 200)}


def test_strips_by_brute_force(spark, monkeypatch):
    """Holes, parts and null classes over several strips; edges meet by strip, and few pixels are burnt at a time."""
    rng = random.Random(7)
    rows = []
    for k in range(12):
        for f in range(5):
            rings = [[(rng.uniform(-6, 46), rng.uniform(-6, 46)) for _ in range(rng.randrange(3, 7))] for _ in range(rng.randrange(1, 3))]
            rows.append((f"t{k}", f, rng.choice([0, 1, 3, None]), rings, 40, 37))
    poly = spark.createDataFrame(rows, "key string, feature_pos int, class_code int, "
                                       "rings array<array<struct<x:double,y:double>>>, height int, width int")
    want = {}
    for unclassed in (True, False):
        for key, f, code, rings, h, w in rows:
            for r in range(h):
                y, xs = r + 0.5, []
                for ring in rings:
                    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                        if y0 <= y < y1 or y1 <= y < y0:
                            xs.append(x0 + (y - y0) / (y1 - y0) * (x1 - x0))
                xs.sort()
                if (code is None) == unclassed:
                    want.update({(key, r, c): code for c in range(w)
                                 for a, b in zip(xs[::2], xs[1::2]) if a <= c + 0.5 < b})
    out = A.rasterize_polygons(poly)
    got = [((x["key"], x["row"], x["col"]), x["class_code"]) for x in out.collect()]
    assert dict(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [" in line and "row#" in line.split("],")[0] for line in plan.splitlines())
    with monkeypatch.context() as small:
        small.setattr(A, "CANVAS", 1000)
        small.setattr(A, "PIXELS_OUT", 300)
        strips = {}
        for key, f, code, rings, h, w in rows:
            edges = [dict(x0=a[0], y0=a[1], x1=b[0], y1=b[1]) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
            for s in range(3):
                m = A.UNCLASSED if code is None else f * 256 + code
                strips.setdefault((key, s), []).append(dict(m=m, height=h, width=w, edges=edges))
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in strips]), pa.array([s for _, s in strips], pa.int32()),
                                            pa.array(list(strips.values()))], names=["key", "strip", "polygons"])
        parts = [x for part in A.burn_strips([batch]) for x in part.to_pylist()]
    assert {(x["key"], x["row"], x["col"]): x["class_code"] for x in parts} == want and len(parts) == len(want)


def test_odd_geometries_give_no_rows(spark):
    """Geometries that are not objects are skipped, and those around them are read."""
    good = '{"properties": {"class": 1}, "geometry": {"type": "%s", "coordinates": %s}}'
    ring = "[[0, 0], [4, 0], [4, 4.5]]"
    doc = '{"features": [{"properties": {"class": 1}, "geometry": "abc"}, {"geometry": 7}, {"geometry": null}, %s, %s, %s]}' % (
        good % ("Polygon", f"[{ring}]"), good % ("MultiPolygon", f"[[{ring}], [{ring}, {ring}]]"), good % ("Point", "[1, 2]"))
    docs = spark.createDataFrame([("a", doc), ("b", "{}"), ("c", "{broken"), ("d", None),
                                  ("e", '{"features": %s}' % (good % ("Polygon", f"[{ring}]"))),
                                  ("f", '{"features": [%s], "features": []}' % (good % ("Polygon", f"[{ring}]")))], "key string, document string")
    got = sorted((x["key"], x["feature_pos"], x["class_code"], len(x["rings"]), x["rings"][0][2]["y"])
                 for x in A.parse_annotations(docs).collect())
    assert got == [("a", 3, 1, 1, 4.5), ("a", 4, 1, 1, 4.5), ("a", 4, 1, 2, 4.5), ("e", 0, 1, 1, 4.5)]


def test_archives_meet_once(spark):
    """First member of a band in listing order; a listing laid out by archive is not exchanged again."""
    rng = random.Random(3)
    names = [n for n, *_ in C.BANDS] + [C.MASK_BAND[0]]
    gsd = {n: int(g) for n, _, g, _ in C.BANDS} | {C.MASK_BAND[0]: int(C.MASK_BAND[2])}
    rows = []
    for k in range(20):
        members = ["manifest.xml"]
        for _ in range(rng.randrange(0, 30)):
            a, b = rng.choice(names), rng.choice(names)
            members.append(rng.choice(["IMG", "x/IMG"]) + f"/R{rng.choice([10, 20, 60])}m/" + rng.choice(
                [f"T_{a}_20m.jp2", f"{a}_copy.jp2", f"T_{a}_{b}_x.jp2", f"T{a}.jp2", f"T_{a}_.tif"]))
        rows += [(k, f"{k}.zip", p, m) for p, m in enumerate(members)]
    rng.shuffle(rows)
    listing = spark.createDataFrame(rows, "scene_id int, archive string, position int, member string")
    want = {}
    for k, archive, _, m in sorted(rows):
        file, kept = m.rsplit("/", 1)[-1], want.setdefault(k, {})
        for n in names:
            if m.endswith(".jp2") and f"/R{gsd[n]}m/" in m and (f"_{n}_" in file or file.startswith(f"{n}_")):
                kept.setdefault(n, f"{archive}!/{m}")
    out = S.resolve_archive_assets(listing).collect()
    assert {x["scene_id"]: x["assets"] for x in out} == want and len(out) == len(want)
    assert all(sorted(x["missing"]) == sorted(set(C.BANDS_8) - set(x["assets"])) for x in out)
    laid = S.resolve_archive_assets(listing.repartition(3, "scene_id"))
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange (\w+)\(scene_id#\d+, (\d+)\)", plan)) == {("hashpartitioning", "3")}
    assert "Exchange" not in re.sub(r"Exchange hashpartitioning\(scene_id#\d+, 3\), REPARTITION_BY_NUM", "", plan)


def test_bands_meet_by_one_exchange_whose_tasks_follow_the_rows(spark, sf, monkeypatch):
    bands = [*B.BANDS5, "scl"]
    want = B.px_obs(spark, sf).select("scene", "row", "col", *bands)
    monkeypatch.setattr(B, "ROWS_A_TASK", 700)
    got = R.assemble_bands(B.px_samples(spark, sf), bands)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = B.table(spark, sf, "lineitem").count()
    plan = QUERIES["c1_assemble_bands"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    tasks = -(-rows // 700)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.findall(r"Exchange .*", plan) and all(f", {tasks})" in x for x in re.findall(r"Exchange .*", plan))
    assert len(re.findall(r"Exchange ", plan)) == 1
