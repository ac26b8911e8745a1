"""Sinks for areas, detections and threat scores.

Areas are replaced or merged by key; detections are appended; threat scores are an
append-only log read as the latest version of each key, so no file is rewritten
while it is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid.functions.pixels import class_name
from marshgrid.operators.decisions import detection_area


def replace_areas(areas: DataFrame, path: str) -> None:
    areas.write.mode("overwrite").parquet(path)


def upsert(existing: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows not updated, plus the updates, one row per key.

    Of updates that repeat a key the greatest row (column by column) stays, so reruns agree.
    """
    rest = [c for c in updates.columns if c not in key]
    if rest:
        updates = updates.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*updates.columns)
    else:
        updates = updates.distinct()
    kept = existing.join(updates.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)


def append_detections(detections: DataFrame, areas: DataFrame, path: str) -> None:
    """Append detections, measuring those that carry no area."""
    measured = detection_area(detections, areas).withColumn("class_name", class_name(F.col("class_code")))
    measured.write.mode("append").partitionBy("area_key").parquet(path)


def append_threat_scores(scores: DataFrame, path: str, version: int) -> None:
    scores.select("detection_id", "score", "coverage_component", "width_component", "priority_component") \
          .withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def latest_by_key(log: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """Newest row per key, as a map-side combinable aggregate instead of a sort."""
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return newest.select(*key, "_r.*")


def read_threat_scores(spark: SparkSession, path: str) -> DataFrame:
    return latest_by_key(spark.read.parquet(path), ["detection_id"]).drop("version")
