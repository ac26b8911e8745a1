"""Padding of tiles to a fixed size, and the whole frames that are padded."""

import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harness import bindings as B
from marshgrid.operators import tiles as T

ITEMS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
#: The query over one scene of 2000 tiles with three pixels in it, in a heap that does not hold the cells of a scene.
#: Nothing is broadcast, as with as many pixels as such a scene has.
LONG_SCENE = """
import sys
from marshgrid.session import local_session
from harness.q_annotate import b18_pad
spark = local_session(2, "512m")
spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
spark.createDataFrame([(0, 1, 2, 1), (121, 1, 2, 1), (120 * 64000 - 1, 1, 2, 1)], "ITEMS").write.parquet(sys.argv[1] + "/lineitem.parquet")
print(*b18_pad(spark, sys.argv[1]).select("scene", "padded", "cropped", "values").first())
""".replace("ITEMS", ITEMS)


@pytest.mark.parametrize("size,strip", [(4, 1 << 12), (5, 10), (6, 4)])
def test_pad_equals_placing_each_pixel(spark, monkeypatch, size, strip):
    """Cells without and with several pixels, pixels beyond a tile, repeated tiles and null keys."""
    monkeypatch.setattr(T, "STRIP_CELLS", strip)
    tiles = [("a", 1, size, size), ("a", 2, 2, 3), ("a", 2, 3, 2), ("b", None, 1, 1), (None, 1, 0, size), ("c", 1, size, 1)]
    px = [("a", 1, 0, 0, 1.0), ("a", 1, 0, 0, 2.0), ("a", 1, size - 1, size - 1, 3.0), ("a", 1, size, 0, 4.0), ("a", 1, 0, -1, 5.0),
          ("a", 2, 1, 1, None), ("a", 2, 2, 1, 6.0), ("a", 2, 0, size - 1, 7.0), ("a", 2, 0, size - 1, 8.0), ("a", 2, None, 1, 9.0),
          ("b", None, 0, 0, 10.0), (None, 1, 0, 0, 11.0), ("d", 1, 0, 0, 12.0), ("c", 1, 1, 0, 13.0)]
    want = Counter()
    for k, n, h, w in tiles:
        for row in range(size):
            for col in range(size):
                at = [p[4] for p in px if None not in (k, n) and p[:4] == (k, n, row, col)]
                for v in at or [None]:
                    want[k, n, h, w, row, col, 0.5 if row >= h or col >= w else v] += 1
    padded = T.pad_to_tile(spark.createDataFrame(tiles, "k string, n int, height int, width int"),
                           spark.createDataFrame(px, "k string, n int, row int, col int, v double"), ["k", "n"], size, ["v"], 0.5)
    assert padded.columns == ["k", "n", "height", "width", "row", "col", "v"]
    assert Counter(map(tuple, padded.collect())) == want
    assert Counter(map(tuple, T.crop_from_padding(padded).collect())) == Counter(
        {r: n for r, n in want.items() if r[4] < r[2] and r[5] < r[3]})


@pytest.mark.parametrize("height,width", [(4, 3), (3, 4), (None, 3)])
def test_oversize_tile(spark, height, width):
    tiles = spark.createDataFrame([("a", height, width)], "k string, height int, width int")
    px = spark.createDataFrame([], "k string, row int, col int, v double")
    with pytest.raises(Exception, match="exceeds the tile size 3"):
        T.pad_to_tile(tiles, px, ["k"], 3, ["v"]).collect()


def test_cells_are_made_behind_the_exchange(spark):
    tiles = spark.range(3).select("id", F.lit(64).alias("height"), F.lit(60).alias("width"))
    px = spark.range(3).select("id", F.lit(1).alias("row"), F.lit(2).alias("col"), F.lit(0.5).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T.pad_to_tile(tiles, px, ["id"], 64, ["v"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    made = [line for line in plan.splitlines() if "Generate" in line or "Exchange" in line]
    assert any("[col#" in line for line in made)
    assert not any("[col#" in line or "[row#" in line for line in made[next(i for i, x in enumerate(made) if "Exchange" in x):])


def test_long_scene_in_a_small_heap(tmp_path):
    ran = subprocess.run([sys.executable, "-c", LONG_SCENE, str(tmp_path)], capture_output=True, text=True, timeout=150,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert ran.stdout.split() == ["1", str(2000 * 64 * 64), str(64000 * 120), "3"], ran.stderr[-2000:]


def test_frame_of_more_pixels_than_an_int_holds(spark, tmp_path):
    spark.createDataFrame([(3_000_000_000, 1, 1, 1)], ITEMS).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert tuple(B.frame(spark, str(tmp_path)).first()) == (25_000_001, 120, 3_000_000_120)
    assert B.scene_frames(spark, str(tmp_path)).first()["total_px"] == 3_000_000_120
