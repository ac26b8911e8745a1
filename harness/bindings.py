"""Domain views derived from the given tables, as SQL both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid.operators import raster

BANDS5 = ["b03", "b04", "b05", "b08", "b11"]

PX_OBS = """
SELECT px_row, px_col, scene, scl,
  CAST(seen * floor(CASE arch WHEN 0 THEN 1000 WHEN 1 THEN 1930 WHEN 2 THEN 3300 WHEN 3 THEN 800 WHEN 4 THEN 1600 WHEN 5 THEN 2022 ELSE 2000 END * (975 + (h + 13) % 51) / 1000.0) AS INT) AS b03,
  CAST(seen * floor(CASE arch WHEN 0 THEN 400 WHEN 1 THEN 1880 WHEN 2 THEN 520 WHEN 3 THEN 400 WHEN 4 THEN 700 WHEN 5 THEN 520 ELSE 1000 END * (975 + (h + 29) % 51) / 1000.0) AS INT) AS b04,
  CAST(seen * floor(CASE arch WHEN 0 THEN 350 WHEN 1 THEN 2160 WHEN 2 THEN 1400 WHEN 3 THEN 1200 WHEN 4 THEN 1800 WHEN 5 THEN 1400 ELSE 1500 END * (975 + (h + 41) % 51) / 1000.0) AS INT) AS b05,
  CAST(seen * floor(CASE arch WHEN 0 THEN 250 WHEN 1 THEN 1810 WHEN 2 THEN 4200 WHEN 3 THEN 4200 WHEN 4 THEN 3000 WHEN 5 THEN 4200 ELSE 1860 END * (975 + (h + 7) % 51) / 1000.0) AS INT) AS b08,
  CAST(seen * floor(CASE arch WHEN 0 THEN 300 WHEN 1 THEN 1630 WHEN 2 THEN 2200 WHEN 3 THEN 2000 WHEN 4 THEN 2550 WHEN 5 THEN 2262 ELSE 1680 END * (975 + (h + 3) % 51) / 1000.0) AS INT) AS b11
FROM (
  SELECT CAST(floor(okey / 120.0) AS INT) AS px_row, CAST(okey % 120 AS INT) AS px_col,
         CAST(scene AS INT) AS scene, pk % 7 AS arch, (pk * 31 + sk * 17 + scene * 7) AS h,
         CASE WHEN sk % 23 = 0 THEN 0 ELSE 1 END AS seen,
         CASE WHEN (pk + sk) % 10 = 0 THEN 9 WHEN (pk + sk) % 10 = 1 THEN 3
              WHEN pk % 7 <= 1 THEN 6 ELSE 4 END AS scl
  FROM (SELECT l_orderkey AS okey, l_linenumber AS scene, min(l_partkey) AS pk, min(l_suppkey) AS sk
        FROM lineitem GROUP BY l_orderkey, l_linenumber) o) a
"""

SCENE_DIM = """
SELECT scene, CAST(cloud AS DOUBLE) AS cloud, acq_day
FROM (VALUES (1, 4.0, 0), (2, 1.5, 1), (3, NULL, 2), (4, 0.2, 3), (5, 9.0, 4), (6, 1.5, 5), (7, 7.0, 6))
  AS t(scene, cloud, acq_day)
"""

SCENES = """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS acquired, o_orderpriority AS platform,
  CASE o_orderstatus WHEN 'P' THEN NULL ELSE CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 10 END AS cloud_cover,
  concat('36R', CAST(o_custkey % 4 AS STRING)) AS grid_code, CAST(o_custkey % 3 AS INT) AS area,
  CAST(30.5 + (o_custkey % 10) * 0.1 AS DOUBLE) AS west, CAST(31.0 + (o_custkey % 7) * 0.1 AS DOUBLE) AS south
FROM orders
"""

DETECTIONS = """
SELECT l_orderkey * 10 + l_linenumber AS detection_id, min(l_returnflag) AS area_key,
  CAST(min(l_shipdate) AS DATE) AS scene_date, CAST(l_linenumber % 4 AS INT) AS class_code,
  min(l_discount) * 10 AS confidence, min(l_extendedprice) AS area_m2, min(l_linestatus) AS model_version
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

THREAT_IN = """
SELECT l_orderkey * 10 + l_linenumber AS id, min(l_discount) * 12 AS coverage,
  min(l_quantity) * 3 AS canal_width_m, min(l_tax) * 12 AS upstream_priority
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

OBSERVATIONS = """
SELECT user_id AS area, CAST(ts AS DATE) AS observed_on, round(avg(value), 6) AS value, min(event_type) AS kind
FROM events GROUP BY user_id, CAST(ts AS DATE)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Spread a one-file table over the cores before costly per-row work, as many files would be."""
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


#: Rows of a task where a step holds what it reads.
ROWS_A_TASK = 1 << 18


def laid_out(spark: SparkSession, df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over as many tasks as their number asks for: a larger table has more tasks, not larger ones."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ROWS_A_TASK)), *keys)


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a binding with its tables passed as DataFrames, so no global view is left behind."""
    text = sql
    frames = {}
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
        frames[t] = table(spark, sf_dir, t)
    return spark.sql(text, **frames) if frames else spark.sql(text)


# Fixed values of the pixel binding: level of each band per archetype, and its jitter phase.
LEVELS = {
    "b03": ([1000, 1930, 3300, 800, 1600, 2022, 2000], 13),
    "b04": ([400, 1880, 520, 400, 700, 520, 1000], 29),
    "b05": ([350, 2160, 1400, 1200, 1800, 1400, 1500], 41),
    "b08": ([250, 1810, 4200, 4200, 3000, 4200, 1860], 7),
    "b11": ([300, 1630, 2200, 2000, 2550, 2262, 1680], 3),
}


def px_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored integers per (scene, row, col): the rows of ``PX_OBS`` in integer arithmetic."""
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
    return _bands(keys.selectExpr("cast(l_orderkey div 120 as int) as row", "cast(l_orderkey % 120 as int) as col",
                                  "cast(l_linenumber as int) as scene", "pk", "sk"))


def _bands(keys: DataFrame) -> DataFrame:
    base = keys.selectExpr(
        "row", "col", "scene", "cast(pk % 7 as int) as arch",
        "pk * 31 + sk * 17 + scene * 7 as h", "if(sk % 23 = 0, 0, 1) as seen",
        "case when (pk + sk) % 10 = 0 then 9 when (pk + sk) % 10 = 1 then 3 when pk % 7 <= 1 then 6 else 4 end as scl")
    return base.selectExpr("row", "col", "scene", "scl", *[
        f"cast(seen * (array({', '.join(map(str, level))})[arch] * (975 + (h + {phase}) % 51) div 1000) as int) as {b}"
        for b, (level, phase) in LEVELS.items()])


def px_samples(spark: SparkSession, sf_dir: str, mask: str = "scl") -> DataFrame:
    """``px_obs`` as one row per band, laid out by pixel, so that its bands meet without another exchange."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey div 120 as int) as row", "cast(l_orderkey % 120 as int) as col",
        "cast(l_linenumber as int) as scene", "l_partkey", "l_suppkey")
    px = _bands(laid_out(spark, rows, "row", "col").groupBy("row", "col", "scene").agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk")))
    # ``unpivot`` would forget the layout.
    return px.select("scene", "row", "col", F.inline(F.array(*[
        F.struct(F.lit(name).alias("band"), F.col(c).alias("dn")) for c, name in [*zip(BANDS5, BANDS5), ("scl", mask)]])))


def scene_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SCENE_DIM).withColumnRenamed("acq_day", "acquired")


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of the pixel grid: one row."""
    rows = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("k"))
    return rows.select((F.floor(F.col("k") / 120.0) + 1).cast("int").alias("height"), F.lit(120).alias("width")) \
               .withColumn("total_px", F.col("height").cast("long") * F.col("width"))


def px_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked integers with ``valid``."""
    return raster.mask_observations(px_obs(spark, sf_dir), BANDS5)


def px_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    refl = raster.reflectance(px_masked(spark, sf_dir), BANDS5)
    return raster.with_indices(refl, BANDS5)


def scenes(spark, sf_dir):
    return view(spark, sf_dir, SCENES, "orders")


def detections(spark, sf_dir):
    return view(spark, sf_dir, DETECTIONS, "lineitem")


def threat_in(spark, sf_dir):
    return view(spark, sf_dir, THREAT_IN, "lineitem")


def observations(spark, sf_dir):
    return view(spark, sf_dir, OBSERVATIONS, "events")


def scene_frames(spark, sf_dir):
    """The frame repeated for every scene of the pixel table."""
    from marshgrid.operators.scale import with_scalar
    scenes = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("scene")).distinct()
    return with_scalar(scenes, frame(spark, sf_dir))


def labelled(spark, sf_dir):
    """Every observation with label columns and the grid extent; one scene is one date."""
    from marshgrid.operators.labels import weak_label
    from marshgrid.operators.scale import with_scalar
    return with_scalar(weak_label(px_indices(spark, sf_dir)), frame(spark, sf_dir), ["height", "width"])

