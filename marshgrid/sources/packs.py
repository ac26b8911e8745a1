"""Annotation packs: selected tiles, their chips and a GeoJSON index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid import contract as C
from marshgrid.functions import keys as K
from marshgrid.operators import annotate as A
from marshgrid.sources.geojson import feature, polygon

PACK_VERSION = 1


def select_tiles(store, limit: int = 20, min_score: float = 0.0, strategy: str = "uncertainty",
                 seed: int = 0) -> DataFrame:
    """The pack's tiles: ranked, scored, with both review fractions."""
    size = float(store.tile_size * store.tile_size)
    top = A.annotation_topk(store.tiles, ["area_key", "date", "top", "left"], limit, min_score, strategy, seed)
    return top.withColumn("review_fraction", F.round(F.col("review_px") / size, 5)) \
              .withColumn("filename_stem", K.safe_name(F.col("key")))


def chips(store, selected: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Chip pixels: reflectance, weak label and review, 255 where unusable.

    The selection is at most ``limit`` rows, so it is broadcast.
    """
    wanted = list(bands or store.bands)
    keys = F.broadcast(selected.select("area_key", "date", "top", "left", "key"))
    px = store.tile_pixels(wanted, keys)
    u = F.coalesce("usable", F.lit(False))
    return px.select("key", "area_key", "date", (F.col("row") - F.col("top")).alias("row"),
                     (F.col("col") - F.col("left")).alias("col"), *wanted,
                     F.when(u, F.col("rule_label")).otherwise(C.UNLABELLED).alias("weak_label"),
                     F.when(u, F.col("review").cast("int")).otherwise(C.UNLABELLED).alias("review"))


def pack_index(selected: DataFrame) -> DataFrame:
    """One GeoJSON feature per tile; needs ``corners``."""
    props = F.struct("key", F.col("date").cast("string").alias("date"), "rank", "score", "review_fraction",
                     "reed_px", "filename_stem")
    return selected.select("key", feature(polygon(F.col("corners")), props).alias("value"))


def pack_summary(selected: DataFrame, candidates: DataFrame, strategy: str, bands: list[str]) -> DataFrame:
    """Manifest row: reserved keys, reed total and whether it suffices."""
    from marshgrid.operators.scale import with_scalar
    one = selected.agg(F.array_sort(F.collect_list("key")).alias("reserved_keys"),
                       F.sum("reed_px").alias("reed_px_total"))
    one = with_scalar(one, candidates.agg(F.count(F.lit(1)).alias("total_candidates_available")))
    return one.withColumns({
        "format_version": F.lit(PACK_VERSION), "strategy": F.lit(strategy),
        "imagery_bands": F.array(*[F.lit(b) for b in bands]), "unlabelled_value": F.lit(C.UNLABELLED),
        "reed_px_sufficient": F.coalesce("reed_px_total", F.lit(0)) >= C.MIN_REED_PIXELS})


def write_annotation_pack(store, path: str, limit: int = 20, min_score: float = 0.0,
                          bands: list[str] | None = None, overwrite: bool = False,
                          strategy: str = "uncertainty", seed: int = 0, corners=None) -> None:
    """Write chips, index and manifest; a non-empty target is refused unless ``overwrite``."""
    mode = "overwrite" if overwrite else "errorifexists"
    wanted = list(bands or store.bands)
    selected = select_tiles(store, limit, min_score, strategy, seed)
    selected.write.mode(mode).parquet(f"{path}/tiles")
    chosen = store.tiles.sparkSession.read.parquet(f"{path}/tiles")
    if chosen.isEmpty():
        raise ValueError(f"no tile qualifies under strategy {strategy!r} with min_score={min_score}")
    chips(store, chosen, wanted).write.mode(mode).partitionBy("key").parquet(f"{path}/chips")
    if corners is not None:
        pack_index(chosen.join(corners, "key")).select("value").write.mode(mode).text(f"{path}/annotation.geojsonl")
    scored = A.annotation_scores(store.tiles, strategy, seed)
    pack_summary(chosen, scored, strategy, wanted).coalesce(1).write.mode(mode).json(f"{path}/pack")


def load_pack(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a pack; another version is refused."""
    pack = spark.read.json(f"{path}/pack")
    head = pack.select("format_version").first()
    if head is None or head[0] != PACK_VERSION:
        raise ValueError(f"{path} is not a version {PACK_VERSION} annotation pack")
    return pack


def reserved_keys(spark: SparkSession, path: str) -> DataFrame:
    return load_pack(spark, path).select(F.explode("reserved_keys").alias("key"))


def read_label_documents(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON label files of a pack as (key, document); the file name is the tile key."""
    files = spark.read.text(path, wholetext=True).withColumn("_f", F.input_file_name())
    stem = F.regexp_extract("_f", r"([^/]+)\.geojson$", 1)
    return files.select(F.replace(stem, F.lit("__"), F.lit("/")).alias("key"), F.col("value").alias("document"))
