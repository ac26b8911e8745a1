"""Composites of two areas for every day of a season whose windows overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import bindings as B
from harness import sqltext as S
from harness.q_pixels import BANDS, INDEX, rr
from harness.registry import query
from harness.sqltext import r
from marshgrid.operators import raster as R
from marshgrid.operators import season
from marshgrid.plans.composite import composite_summary, season_composites

WINDOW, TARGET = 3, 0.65  # several dates stop before their last scene
# Fixed values of the binding: western and eastern half of the pixel grid, seven scenes each,
# acquired two days apart; the eastern half has two on one day. 16 and 12 wanted dates.
SEASON = """
SELECT area, scene, CAST(cloud AS DOUBLE) AS cloud, CAST(day AS DATE) AS acquired
FROM (VALUES ('west', 1, 4.0, '2024-06-01'), ('west', 2, 1.5, '2024-06-03'), ('west', 3, NULL, '2024-06-05'),
  ('west', 4, 0.2, '2024-06-07'), ('west', 5, 9.0, '2024-06-09'), ('west', 6, 1.5, '2024-06-11'), ('west', 7, 7.0, '2024-06-13'),
  ('east', 1, 2.0, '2024-06-02'), ('east', 2, 2.0, '2024-06-02'), ('east', 3, 8.0, '2024-06-04'), ('east', 4, 5.0, '2024-06-08'),
  ('east', 5, NULL, '2024-06-10'), ('east', 6, 0.5, '2024-06-15'), ('east', 7, 3.0, '2024-06-16')) AS t(area, scene, cloud, day)
"""
DATES = {"west": ("2024-05-27", 16), "east": ("2024-06-03", 12)}

ONE_BY_ONE = f"""WITH {S.MASKED}, {S.FRAME}, sn AS ({SEASON}),
 tg AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS area, CAST(DATE '{d}' + CAST(k AS INT) AS DATE) AS target_date FROM range(0, {n}) AS g(k)"
                                 for a, (d, n) in DATES.items()) + f"""),
 cd AS (SELECT tg.area, tg.target_date, sn.scene, row_number() OVER (PARTITION BY tg.area, tg.target_date
     ORDER BY cloud ASC NULLS LAST, acquired, sn.scene) AS k
   FROM tg JOIN sn ON sn.area = tg.area AND abs(date_diff('day', sn.acquired, tg.target_date)) <= {WINDOW}),
 ob AS (SELECT *, CASE WHEN c < 60 THEN 'west' ELSE 'east' END AS area FROM m WHERE valid),
 win AS (SELECT ob.*, cd.target_date, cd.k FROM ob JOIN cd USING (area, scene)
   QUALIFY row_number() OVER (PARTITION BY area, target_date, r, c ORDER BY cd.k) = 1),
 cum AS (SELECT area, target_date, k, sum(count(*)) OVER (PARTITION BY area, target_date ORDER BY k) / (SELECT hh * 60 FROM fr) AS cov
   FROM win GROUP BY area, target_date, k),
 cut AS (SELECT area, target_date, coalesce(min(CASE WHEN cov >= {TARGET} THEN k END), max(k)) AS last FROM cum GROUP BY ALL),
 mo AS (SELECT win.* FROM win JOIN cut USING (area, target_date) WHERE k <= last)"""


def inputs(spark, sf):
    """Pixels, scenes, wanted dates and extent by area."""
    px = B.px_obs(spark, sf).withColumn("area", F.when(F.col("col") < 60, "west").otherwise("east"))
    dates = spark.createDataFrame([(a, d, n) for a, (d, n) in DATES.items()], "area string, first string, n int")
    targets = dates.select("area", F.explode(F.sequence(F.to_date("first"), F.date_add(F.to_date("first"), F.col("n") - 1))).alias("target_date"))
    extent = B.frame(spark, sf).select(F.explode(F.array(F.lit("west"), F.lit("east"))).alias("area"),
                                       (F.col("height") * 60).cast("long").alias("total_px"))
    return px, spark.sql(SEASON), targets, extent


@query("e1_season_mosaics", ONE_BY_ONE + f""" SELECT area, target_date, r AS "row", c AS col, scene,
  {', '.join(f'd{b[1:]} AS {b}' for b in BANDS)} FROM mo""")
def e1_season(spark, sf):
    px, scenes, targets, extent = inputs(spark, sf)
    return season.season_mosaics(R.mask_observations(px, BANDS), scenes, targets, extent, BANDS, ["area"], WINDOW, TARGET)


def _composites(spark, sf):
    px, scenes, targets, extent = inputs(spark, sf)
    comp = season_composites(px, scenes, targets, extent, BANDS, ["area"], WINDOW, TARGET)
    return comp, season.scenes_on_dates(scenes, targets, ["area"], WINDOW), targets.join(extent, "area")


@query("e1_season_indices", ONE_BY_ONE + f""", rf AS (SELECT area, target_date, {', '.join(f'd{b[1:]} * 1e-4 AS {b}' for b in BANDS)} FROM mo)
  SELECT area, target_date, count(*) AS px, """ + ", ".join(f"{r(f'avg({x})')} AS {i}" for i, x in zip(
      INDEX, (S.nd("b08", "b04"), S.nd("b03", "b08"), S.nd("b08", "b05"), S.nd("b08", "b11")))) + " FROM rf GROUP BY area, target_date")
def e1_indices(spark, sf):
    comp, _, _ = _composites(spark, sf)
    per = comp.groupBy("area", "target_date").agg(F.count(F.lit(1)).alias("px"), *[F.avg(i).alias(i) for i in INDEX])
    return per.select("area", "target_date", "px", *[rr(i) for i in INDEX])


@query("e1_season_summary", ONE_BY_ONE + f""",
 ca AS (SELECT area, target_date, string_agg(scene, ',' ORDER BY scene) AS candidates FROM cd GROUP BY ALL),
 us AS (SELECT area, target_date, string_agg(scene, ',' ORDER BY scene) AS contributing, sum(n) AS n
   FROM (SELECT area, target_date, scene, count(*) AS n FROM mo GROUP BY ALL) GROUP BY ALL)
 SELECT area, target_date, candidates, contributing, {r('coalesce(n, 0) / (SELECT hh * 60 FROM fr)')} AS coverage,
  CASE WHEN coalesce(n, 0) / (SELECT hh * 60 FROM fr) < 0.5 THEN 'coverage below one half' ELSE '' END AS warnings
 FROM tg LEFT JOIN ca USING (area, target_date) LEFT JOIN us USING (area, target_date)""")
def e1_summary(spark, sf):
    comp, scenes, frames = _composites(spark, sf)
    out = composite_summary(comp, scenes, frames, ["area", "target_date"], bands=BANDS, indices=INDEX)
    text = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("candidates", "contributing", "warnings")]
    return out.select("area", "target_date", *text, rr("coverage"))
