"""Footprint overlap, holdout and geographic split queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from harness import bindings as B
from harness import sqltext as S
from harness.q_pixels import SIZE, STRIDE, tallies
from harness.registry import query
from harness.sqltext import r
from marshgrid.operators import split as Sp
from marshgrid.operators import tiles as T

# Every full tile of every scene, from the observed grid.
FP = f"""{S.PX}, {S.FRAME}, tl AS (
  SELECT s.scene, ty.k * 16 AS top, tx.k * 16 AS lft, ty.k * 16 + 32 AS bot, tx.k * 16 + 32 AS rgt,
    concat(s.scene, '/r', ty.k * 16, '_c', tx.k * 16) AS key
  FROM (SELECT DISTINCT scene FROM px) s, fr, (SELECT unnest(range(0, 100000)) AS k) ty, (SELECT unnest(range(0, 8)) AS k) tx
  WHERE ty.k * 16 + 32 <= fr.hh AND tx.k * 16 + 32 <= fr.ww)"""


def footprints(spark, sf):
    t = T.grid_tiles(B.scene_frames(spark, sf), SIZE, STRIDE).select("scene", "top", "left")
    return t.select("scene", "top", "left", (F.col("top") + SIZE).alias("bottom"), (F.col("left") + SIZE).alias("right"),
                    F.concat(F.col("scene").cast("string"), F.lit("/r"), F.col("top").cast("string"), F.lit("_c"),
                             F.col("left").cast("string")).alias("key"))


def reserved(spark, sf):
    return footprints(spark, sf).where((F.col("scene") == 1) & ((F.col("top") + F.col("left")) % 400 == 0)).select("key")


_RES = "rs AS (SELECT * FROM tl WHERE scene = 1 AND (top + lft) % 400 = 0)"
_HIT = "a.top < b.bot + {0} AND a.bot > b.top - {0} AND a.lft < b.rgt + {0} AND a.rgt > b.lft - {0}"


@query("g2_distinct_footprints", f'WITH {FP} SELECT DISTINCT top, lft AS "left", bot AS bottom, rgt AS "right" FROM tl')
def g2(spark, sf):
    return Sp.distinct_footprints(footprints(spark, sf)).select(*[F.col(c).cast("long").alias(c) for c in Sp.BOX])


@query("c3_exclude_reserved", f"WITH {FP}, {_RES} SELECT key FROM tl a WHERE NOT EXISTS (SELECT 1 FROM rs b WHERE {_HIT.format(5)})")
def c3(spark, sf):
    return Sp.exclude_reserved(footprints(spark, sf), reserved(spark, sf), 5, cell=64).select("key")


@query("g3_excluded_keys", f"WITH {FP}, {_RES} SELECT key FROM tl a WHERE EXISTS (SELECT 1 FROM rs b WHERE {_HIT.format(5)})")
def g3(spark, sf):
    fp = footprints(spark, sf)
    return Sp.excluded_keys(fp, Sp.exclude_reserved(fp, reserved(spark, sf), 5, cell=64))


@query("c13_missing_reserved", f"WITH {FP}, {_RES} SELECT concat('x/', key) AS key FROM rs")
def c13(spark, sf):
    res = reserved(spark, sf)
    both = res.union(res.select(F.concat(F.lit("x/"), F.col("key"))))
    return Sp.missing_reserved(both, footprints(spark, sf))


@query("c4_overlapping_pairs", f"""WITH {FP}, d AS (SELECT DISTINCT top, lft, bot, rgt FROM tl)
  SELECT a.top AS a_top, a.lft AS a_left, b.top AS b_top, b.lft AS b_left FROM d a JOIN d b ON {_HIT.format(0)}""")
def c4(spark, sf):
    d = Sp.distinct_footprints(footprints(spark, sf))
    return Sp.overlapping_pairs(d, d, cell=64).select(
        *[F.col(c).cast("long").alias(c) for c in ("a_top", "a_left", "b_top", "b_left")])


@query("c5_leaking_pairs", f"""WITH {FP}, s AS (SELECT *, CASE WHEN top < 32 THEN 'train' WHEN top < 64 THEN 'val' ELSE 'test' END AS split FROM tl)
  SELECT a.split AS a_split, b.split AS b_split, count(*) AS tile_pairs FROM s a JOIN s b ON {_HIT.format(0)} AND a.split < b.split
  GROUP BY a.split, b.split""")
def c5(spark, sf):
    bad = footprints(spark, sf).withColumn(
        "split", F.when(F.col("top") < 32, "train").when(F.col("top") < 64, "val").otherwise("test"))
    return Sp.leaks(bad, cell=64).groupBy("a_split", "b_split").agg(F.sum("tile_pairs").alias("tile_pairs"))


def _search(seed: int, buffers: list[int], base: str = FP) -> str:
    """Brute-force cut search in SQL: every pair of cuts against every footprint."""
    rev = bool(np.random.default_rng(seed).integers(0, 2))
    def axis(n, lo, hi):
        s, e = (f"-{hi}", f"-{lo}") if rev else (lo, hi)
        return f"SELECT {n} AS axis, {s} AS s, {e} AS e FROM d"
    return f"""WITH {base}, d AS (SELECT DISTINCT top, lft, top + 32 AS bot, lft + 32 AS rgt FROM tl),
 ax AS ({axis(0, 'top', 'bot')} UNION ALL {axis(1, 'lft', 'rgt')}),
 cu AS (SELECT DISTINCT axis, e AS c FROM ax), bf AS (SELECT unnest({buffers}) AS buf),
 sp AS (SELECT max(bot) - min(top) AS h, max(rgt) - min(lft) AS w, count(*) AS n FROM d),
 ca AS (SELECT bf.buf, x.axis, x.c AS c1, y.c AS c2,
   (SELECT count(*) FROM ax WHERE ax.axis = x.axis AND ax.e <= x.c) AS tr,
   (SELECT count(*) FROM ax WHERE ax.axis = x.axis AND ax.s >= x.c + bf.buf AND ax.e <= y.c) AS va,
   (SELECT count(*) FROM ax WHERE ax.axis = x.axis AND ax.s >= y.c + bf.buf) AS te
  FROM cu x JOIN cu y ON x.axis = y.axis CROSS JOIN bf WHERE y.c > x.c + bf.buf),
 zc AS (SELECT ca.*, CASE WHEN (axis = 0) = (h >= w) THEN 0 ELSE 1 END AS turn, n - tr - va - te AS waste, n,
   abs(tr / (tr + va + te) - 0.7::DOUBLE) + abs(va / (tr + va + te) - 0.15::DOUBLE) + abs(te / (tr + va + te) - 0.15::DOUBLE) AS err
  FROM ca, sp WHERE tr > 0 AND va > 0 AND te > 0),
 best AS (SELECT * FROM zc QUALIFY row_number() OVER (PARTITION BY buf ORDER BY turn, err, waste / n, waste, c1, c2) = 1)"""


@query("e9_split_cuts", _search(0, [8, 3, 0]) + f""" SELECT CAST(buf AS INT) AS buffer, CAST(axis AS INT) AS axis, CAST(c1 AS BIGINT) AS c1,
  CAST(c2 AS BIGINT) AS c2, CAST(tr AS BIGINT) AS train, CAST(va AS BIGINT) AS val, CAST(te AS BIGINT) AS test, {r('err')} AS error FROM best""")
def e9(spark, sf):
    cuts = Sp.split_cuts(Sp.distinct_footprints(footprints(spark, sf)), [], [8, 3, 0], seed=0)
    return cuts.select("buffer", "axis", "c1", "c2", "train", "val", "test",
                       (F.round("error", 6) + F.lit(0.0)).alias("error"))


_LADDER = [64, 32, 16, 8, 4, 2, 1, 0]


@query("e10_geographic_split", _search(1, _LADDER) + """, w AS (SELECT * FROM best ORDER BY buf DESC LIMIT 1)
  SELECT tl.key, CASE WHEN e <= c1 THEN 'train' WHEN s >= c1 + buf AND e <= c2 THEN 'val' WHEN s >= c2 + buf THEN 'test' END AS split,
    CAST(buf AS INT) AS buffer_used
  FROM (SELECT tl.*, w.*, CASE WHEN axis = 0 THEN top ELSE lft END AS s, CASE WHEN axis = 0 THEN bot ELSE rgt END AS e FROM tl, w) tl""")
def e10(spark, sf):
    return Sp.geographic_split(footprints(spark, sf), [], 64, seed=1).select("key", "split", "buffer_used")


def split_tallies(spark, sf):
    t = tallies(spark, sf)
    fp = footprints(spark, sf)
    labelled = Sp.geographic_split(fp, [], 16, seed=1).select("scene", "top", "left", "split", "key")
    return t.join(labelled, ["scene", "top", "left"])


@query("d24_split_support", _search(1, [16, 8, 4, 2, 1, 0], S.TALLY) + """, w AS (SELECT * FROM best ORDER BY buf DESC LIMIT 1),
  g AS (SELECT mask_0, mask_1, mask_2, mask_3, CASE WHEN e <= c1 THEN 'train' WHEN s >= c1 + buf AND e <= c2 THEN 'val'
      WHEN s >= c2 + buf THEN 'test' END AS split
    FROM (SELECT ta.*, w.*, CASE WHEN axis = 0 THEN top ELSE lft END AS s, CASE WHEN axis = 0 THEN top ELSE lft END + 32 AS e FROM ta, w) z)
  SELECT split, """ + ", ".join(f"CAST(sum(mask_{c}) AS BIGINT) AS class_{c}" for c in range(4)) + """,
   sum(mask_0 + mask_1 + mask_2 + mask_3) = 0 AS empty, sum(mask_3) < 500 AS few_reed FROM g WHERE split IS NOT NULL GROUP BY split""")
def d24(spark, sf):
    return Sp.split_support(split_tallies(spark, sf))
