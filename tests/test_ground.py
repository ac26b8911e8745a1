"""Grids, polygons, splits, holdouts, stores and packs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshgrid.functions import geo as G
from marshgrid.operators import annotate as A
from marshgrid.operators import classify as K
from marshgrid.operators import grids as Gr
from marshgrid.operators import resample as Z
from marshgrid.operators import split as Sp
from marshgrid.operators import tiles as T
from marshgrid.sources import packs, store


def area(spark, *box):
    return spark.createDataFrame([("x", *box)], "key string, w double, s double, e double, n double").select(
        "key", F.lit("EPSG:32636").alias("crs"),
        F.struct(F.col("w").alias("west"), F.col("s").alias("south"), F.col("e").alias("east"), F.col("n").alias("north")).alias("bbox"))


def test_grid_goldens(spark):
    g = Gr.grid_from_bbox(area(spark, 30.80, 31.45, 30.85, 31.50), 10).first()["grid"]
    assert (g["width"], g["height"]) == (487, 565)
    g = Gr.grid_from_bbox(area(spark, 30.55, 31.38, 31.15, 31.70), 30).first()["grid"]
    assert (g["width"], g["height"]) == (1923, 1221)
    c = Gr.choose_grid(area(spark, 30.55, 31.38, 31.15, 31.70), ["key"], 30, 8192).first()["grid"]
    assert c["gsd"] == 30
    with pytest.raises(Exception, match="does not fit"):
        Gr.choose_grid(area(spark, 30.55, 31.38, 31.15, 31.70), ["key"], 1, 10).collect()


def test_projection_round_trip_and_area(spark):
    df = spark.createDataFrame([(30.8, 31.45), (33.0, 0.5)], "lon double, lat double")
    p = df.withColumn("p", G.project_point(F.col("lon"), F.col("lat"), F.lit(32636)))
    back = p.withColumn("b", G.unproject_point(F.col("p.x"), F.col("p.y"), F.lit(32636))).collect()
    for r in back:
        assert r["b"]["x"] == pytest.approx(r["lon"], abs=1e-9) and r["b"]["y"] == pytest.approx(r["lat"], abs=1e-9)
    assert back[1]["p"]["x"] == pytest.approx(500000, abs=1e-6)
    ring = F.expr("array(struct(0D as x, 0D as y), struct(4D as x, 0D as y), struct(4D as x, 3D as y), struct(0D as x, 0D as y))")
    assert spark.range(1).select(G.ring_area(ring)).first()[0] == 6.0


def boxes(rows):
    return [(i, r, c, r + s, c + s) for i, (r, c, s) in enumerate(rows)]


FP = "k int, top int, left int, bottom int, right int"


def test_overlap_pairs_brute_force(spark):
    rng = np.random.default_rng(3)
    a = boxes([(int(r), int(c), 40) for r, c in rng.integers(0, 300, (60, 2))])
    b = boxes([(int(r), int(c), 25) for r, c in rng.integers(0, 300, (50, 2))])
    for buffer in (0, 7):
        got = sorted((r["a_k"], r["b_k"]) for r in Sp.overlapping_pairs(
            spark.createDataFrame(a, FP), spark.createDataFrame(b, FP), cell=32, buffer=buffer).collect())
        want = sorted((x[0], y[0]) for x in a for y in b if x[1] < y[3] + buffer and x[3] > y[1] - buffer
                      and x[2] < y[4] + buffer and x[4] > y[2] - buffer)
        assert got == want


def test_holdout_same_ground_on_every_date(spark):
    rows = [(f"d{d}/{i}", r, c, r + 64, c + 64) for d in range(3) for i, (r, c) in
            enumerate((r, c) for r in (0, 64, 128) for c in (0, 64, 128))]
    tiles = spark.createDataFrame(rows, "key string, top int, left int, bottom int, right int")
    kept = Sp.exclude_reserved(tiles, spark.createDataFrame([("d0/4",)], "key string"))
    assert sorted(r["key"] for r in Sp.excluded_keys(tiles, kept).collect()) == ["d0/4", "d1/4", "d2/4"]
    with pytest.raises(ValueError, match="not in the store"):
        Sp.exclude_reserved(tiles, spark.createDataFrame([("nope",)], "key string"))


def grid8(dates):
    return [(f"{d}/{r}_{c}", d, r, c, r + 256, c + 256) for d in range(dates) for r in range(0, 1024, 128) for c in range(0, 1024, 128)]


KEYED = "key string, date int, top int, left int, bottom int, right int"


@pytest.mark.parametrize("seed", [0, 1])
def test_geographic_split(spark, seed):
    found = []
    for dates in (1, 5):
        t = spark.createDataFrame(grid8(dates), KEYED)
        out = Sp.geographic_split(t, [], 128, seed=seed)
        Sp.assert_disjoint(Sp.require_split(out))
        rows = out.where("split is not null").select("top", "left", "split", "buffer_used").distinct().collect()
        assert {r["buffer_used"] for r in rows} == {128}
        found.append({(r["top"], r["left"]): r["split"] for r in rows})
    assert found[0] == found[1]


def test_split_brute_force(spark):
    rng = np.random.default_rng(5)
    pos = sorted({(int(r) * 8, int(c) * 8) for r, c in rng.integers(0, 30, (80, 2))})
    tiles = spark.createDataFrame(boxes([(r, c, 32) for r, c in pos]), FP)
    best = None
    rows = [(r, c, r + 32, c + 32) for r, c in pos]
    span = [max(x[2] for x in rows) - min(x[0] for x in rows), max(x[3] for x in rows) - min(x[1] for x in rows)]
    axis = 0 if span[0] >= span[1] else 1
    se = [(x[axis], x[axis + 2]) for x in rows]  # seed 1 keeps the direction
    cuts = sorted({e for _, e in se})
    for c1 in cuts:
        for c2 in cuts:
            if c2 <= c1 + 8:
                continue
            n = [sum(e <= c1 for s, e in se), sum(s >= c1 + 8 and e <= c2 for s, e in se), sum(s >= c2 + 8 for s, e in se)]
            if min(n) == 0:
                continue
            waste = len(rows) - sum(n)
            err = (abs(n[0] / sum(n) - .7) + abs(n[1] / sum(n) - .15)) + abs(n[2] / sum(n) - .15)
            rank = (err, waste / len(rows), waste, c1, c2)
            best = rank if best is None or rank < best else best
    got = Sp.split_cuts(Sp.distinct_footprints(tiles), [], [8], seed=1).first()
    assert (got["axis"], got["c1"], got["c2"], got["waste"]) == (axis, best[3], best[4], best[2])


def test_split_ladder_and_negative_control(spark):
    small = [(f"{r}_{c}", 0, r, c, r + 64, c + 64) for r in (0, 64, 128) for c in (0, 64)]
    out = Sp.require_split(Sp.geographic_split(spark.createDataFrame(small, KEYED), [], 32))
    assert {r["buffer_used"] for r in out.collect()} == {0}
    leaky = spark.createDataFrame(grid8(1), KEYED).withColumn("split", F.when(F.col("top") < 512, "train").otherwise("test"))
    with pytest.raises(ValueError, match="share ground"):
        Sp.assert_disjoint(leaky)
    with pytest.raises(ValueError, match="three non-empty"):
        Sp.require_split(Sp.geographic_split(spark.createDataFrame(small[:2], KEYED), [], 0))


def test_rasterize_half_chip_and_overwrite(spark):
    doc = ('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"class_code":3},"geometry":{"type":"Polygon",'
           '"coordinates":[[[0,0],[10,0],[10,20],[0,20],[0,0]]]}},{"type":"Feature","properties":{"class":"open_water"},'
           '"geometry":{"type":"Polygon","coordinates":[[[0,0],[5,0],[5,5],[0,5],[0,0]]]}}]}')
    docs = spark.createDataFrame([("t", doc)], "key string, document string")
    px = A.rasterize_polygons(A.parse_annotations(docs).withColumns({"height": F.lit(20), "width": F.lit(20)}))
    got = {(r["row"], r["col"]): r["class_code"] for r in px.collect()}
    assert len(got) == 200 and sum(v == 0 for v in got.values()) == 25
    bad = doc.replace('"class_code":3', '"note":"x"')
    with pytest.raises(Exception, match="no class"):
        A.parse_annotations(spark.createDataFrame([("t", bad)], "key string, document string")).collect()


def test_independence_table(spark):
    prov = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "val")], "key string, split string")
    def status(*keys, p=prov):
        return A.check_independence(spark.createDataFrame([(k,) for k in keys], "key string"), p).first()["status"]
    assert [status("b"), status("c"), status("d", "e"), status("d", p=prov.limit(0))] == \
        ["trained_on", "used_for_selection", "verified", "unverified"]


def test_cubic_reproduces_a_plane(spark):
    px = spark.createDataFrame([(r, c, 2.0 * r + c, 12, 12) for r in range(12) for c in range(12)],
                               "row int, col int, v double, height int, width int")
    for r in Z.upsample(px, ["v"], 2, "cubic", []).collect():
        if 6 <= r["row"] < 18 and 6 <= r["col"] < 18:
            assert r["v"] == pytest.approx(2 * ((r["row"] + .5) / 2 - .5) + (r["col"] + .5) / 2 - .5)
    with pytest.raises(ValueError):
        Z.upsample(px, ["v"], 2, "bilinear", [], categorical=True)


def synthetic(spark):
    """Two dates of a 64 x 64 area, class set by column, one corner unobserved."""
    px = spark.range(2 * 64 * 64).select(
        F.lit("lake").alias("area_key"), F.date_add(F.to_date(F.lit("2024-08-20")), (F.col("id") / 4096).cast("int")).alias("date"),
        (F.col("id") % 4096 / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"),
        F.lit(64).alias("height"), F.lit(64).alias("width"))
    label = (F.col("col") / 16).cast("int")
    ok = ~((F.col("row") < 8) & (F.col("col") < 8))
    return px.withColumns({"usable": ok, "review": ok & (F.col("row") > 40), "trainable": ok & (F.col("row") < 50)}) \
        .withColumn("label", F.when(ok, label).otherwise(-1)) \
        .withColumns({"B04": F.when(ok, 0.1 + label / 10.0), "B08": F.when(ok, 0.4 - label / 20.0)})


def test_store_and_pack_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    want = spark.createDataFrame([("lake", "2024-08-20"), ("lake", "2024-08-25")], "area_key string, date string") \
                .withColumn("date", F.to_date("date"))
    store.write_tile_store(synthetic(spark), path, ["B04", "B08"], 32, 16, requested=want)
    with pytest.raises(Exception):
        store.write_tile_store(synthetic(spark), path, ["B04", "B08"], 32, 16)
    s = store.read_tile_store(spark, path)
    assert s.bands == ["B04", "B08"] and s.tiles.count() == 2 * 9
    assert [r["skipped"] for r in s.manifest.orderBy("date").collect()] == [False, True]
    exploded = s.tile_pixels(["B08"])
    assert exploded.columns.index("B08") > 0 and exploded.count() == 2 * 9 * 32 * 32
    # Cell sums equal a direct count over the exploded pixels.
    direct = exploded.groupBy("date", "top", "left").agg(F.count_if(F.col("mask") == 3).alias("m3"), F.count_if("review").alias("r"))
    joined = s.tiles.join(direct, ["date", "top", "left"])
    assert joined.where((F.col("m3") != F.col("mask_3_px")) | (F.col("r") != F.col("review_px"))).count() == 0
    with pytest.raises(ValueError):
        s.tile_pixels(["B02"])
    with pytest.raises(ValueError):
        store.read_tile_store(spark, str(tmp_path / "absent"))
    pack = str(tmp_path / "pack")
    packs.write_annotation_pack(s, pack, limit=3)
    assert packs.reserved_keys(spark, pack).count() == 3
    with pytest.raises(Exception):
        packs.write_annotation_pack(s, pack, limit=3)
    chips = spark.read.parquet(pack + "/chips")
    assert chips.count() == 3 * 32 * 32 and chips.where("weak_label = 255 and review <> 255").count() == 0


def test_augment_is_a_permutation_and_repeats(spark):
    tp = synthetic(spark).where("row < 16 and col < 16 and usable").withColumn("key", F.date_format("date", "dd"))
    a = T.augment_tiles(tp, 16, ["B04", "B08"], "key", 3, 1)
    assert a.select("key", "row", "col").distinct().count() == tp.count()
    assert a.exceptAll(T.augment_tiles(tp, 16, ["B04", "B08"], "key", 3, 1)).isEmpty()


def test_cover_counts_tiles(spark):
    tiles = T.grid_tiles(spark.createDataFrame([(48, 48)], "height int, width int"), 32, 16)
    cover = {(r["_cr"], r["_cc"]): r["cover"] for r in T.tile_cover(tiles, [], 32, 16).collect()}
    assert cover[(0, 0)] == 1 and cover[(16, 16)] == 4 and cover[(16, 0)] == 2


@pytest.mark.parametrize("size,stride", [(13, 5), (12, 6), (7, 7), (6, 9), (16, 13)])
def test_edge_cells_of_any_size_and_stride(spark, size, stride):
    """Tallies, cover and statistics equal those of pixels sent to every tile."""
    px = synthetic(spark).where("row < 40 and col < 33").withColumn("height", F.lit(40)).withColumn("width", F.lit(33))
    px = px.withColumn("usable", F.col("usable") & F.col("B04").isNotNull())
    by, key = ["date"], ["date", "top", "left"]
    sent = T.assign_tiles(px, size, stride)
    want = {tuple(r) for r in sent.groupBy(*key).agg(F.count(F.lit(1)), F.count_if("usable"), F.count_if("review")).collect()}
    got = {tuple(r) for r in T.tile_tallies(px, by, size, stride).select(*key, "px", "usable_px", "review_px").collect()}
    assert got == want and got
    tiles = T.grid_tiles(px.select("date", "height", "width").distinct(), size, stride)
    place = ["date", "row", "col"]
    cover = {tuple(r) for r in T.covered_pixels(px, tiles, by, size, stride).select(*place, "cover").collect()}
    assert cover == {tuple(r) for r in sent.groupBy(*place).count().collect()}
    picked = tiles.where("top > 0").select("date", "top", "left")
    part = T.pixels_of_tiles(px, picked, by, size, stride).select(*key, "row", "col")
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, sent.where("top > 0").select(*key, "row", "col").collect()))
    flat = sent.where("usable").agg(F.avg("B04"), F.stddev_pop("B04"), F.count(F.lit(1))).first()
    stats = T.band_statistics(px, tiles, ["B04"], by, size, stride).first()
    assert (stats["mean"], stats["std"]) == pytest.approx((flat[0], flat[1]), abs=2e-6) and stats["usable_px"] == flat[2]
    assert T.tile_cells(tiles.limit(1), size, stride).count() <= (2 * -(-size // stride)) ** 2


def test_store_faults(spark, tmp_path):
    path, bands = str(tmp_path / "store"), ["B04", "B08"]
    both = synthetic(spark).withColumn("area_key", F.lit("001")).unionByName(synthetic(spark).withColumn("area_key", F.lit("002")))
    with pytest.raises(ValueError, match="empty"):
        store.write_tile_store(both.limit(0), path, bands, 32)
    assert not (tmp_path / "store").exists()
    store.write_tile_store(both, path, bands, 32)
    s = store.read_tile_store(spark, path)
    for df in (s.pixels, s.tiles, s.manifest):
        assert {r[0] for r in df.select("area_key").distinct().collect()} == {"001", "002"}
    assert s.tiles.count() == s.tiles.select("key").distinct().count() == 2 * 2 * 4
    # A rebuild of one area and date leaves the rest as it was.
    again = both.where("area_key = '002' and date = '2024-08-21'").withColumn("B04", F.lit(0.9))
    store.write_tile_store(again, path, bands, 32, rebuild=True)
    after = store.read_tile_store(spark, path)
    assert after.pixels.count() == 4 * 64 * 64 and after.tiles.count() == 16 and after.manifest.count() == 4
    changed = after.pixels.where("B04 = 9000").select("area_key", "date").distinct().collect()
    assert [(r[0], str(r[1])) for r in changed] == [("002", "2024-08-21")]
    with pytest.raises(ValueError, match="holds bands"):
        store.write_tile_store(again, path, ["B08"], 32, rebuild=True)


def test_all_cuts_count(spark):
    """More than 96 distinct ends: the best pair over all of them is found."""
    rows = [(f"t{k}", k * 8, 0, k * 8 + 8, 8) for k in range(300)]
    tiles = spark.createDataFrame(rows, "key string, top int, left int, bottom int, right int")
    best = Sp.split_cuts(tiles, [], [0]).first()
    assert (best.train, best.val, best.test) == (210, 45, 45)


def test_rejects_and_codes(spark):
    from marshgrid.sources import catalog, detections
    good = '{"id": "a", "bbox": [1, 2, 3, 4], "properties": {"datetime": "%s"}, "assets": {"red": {"href": "x"}}}'
    items = spark.createDataFrame([(good % "2024-01-01T00:00:00Z",), (good % "not a time",), ("{broken",)], "value string")
    assert catalog.scenes_from_stac(items).count() <= 1
    assert tuple(catalog.stac_rejects(items).first()) == (3, 1, 1)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "id long, v string")
    assert sorted(map(tuple, detections.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    ring = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    bad = spark.createDataFrame([("k", 0, 300, ring, 4, 4)], "key string, feature_pos int, class_code int, rings array<array<struct<x:double,y:double>>>, height int, width int")
    with pytest.raises(Exception, match="outside 0..255"):
        A.rasterize_polygons(bad).collect()
