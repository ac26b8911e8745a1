"""Tile stores as Parquet: unique pixels, a tile table and a manifest.

Pixels are written once; overlapping tiles are expanded on read.  Everything is
partitioned by area and date, so one date of an area is one set of files and its rebuild
touches nothing else.  The manifest is written last: a store without one is unfinished,
is refused by readers and may be written again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from marshgrid import contract as C
from marshgrid.functions import keys as K
from marshgrid.functions import pixels as P
from marshgrid.operators import tiles as T

FORMAT_VERSION = 1
BY = ["area_key", "date"]


@dataclass(frozen=True)
class TileStore:
    """DataFrames of one opened store."""

    pixels: DataFrame
    tiles: DataFrame
    manifest: DataFrame
    bands: list[str]
    tile_size: int
    stride: int

    def decoded(self, bands: list[str] | None = None) -> DataFrame:
        """Decoded model inputs, one row per pixel; bands in the requested order."""
        wanted = list(bands or self.bands)
        missing = [b for b in wanted if b not in self.bands]
        if missing:
            raise ValueError(f"the store holds bands {self.bands}; {missing} were asked for")
        return self.pixels.select(*BY, "row", "col", "height", "width", "mask", "rule_label", "usable", "review",
                                  *[P.decode_reflectance(F.col(b)).alias(b) for b in wanted])

    def tile_pixels(self, bands: list[str] | None = None, tiles: DataFrame | None = None) -> DataFrame:
        """Decoded model inputs, one row per (tile, pixel), of all tiles or of those given by place."""
        px = self.decoded(bands)
        if tiles is None:
            return T.assign_tiles(px, self.tile_size, self.stride)
        return T.pixels_of_tiles(px, tiles, BY, self.tile_size, self.stride)


def write_tile_store(labelled: DataFrame, path: str, bands: list[str], tile_size: int = 256,
                     stride: int | None = None, rebuild: bool = False, requested: DataFrame | None = None,
                     drop_empty: bool = False) -> None:
    """Write labelled composites of any number of areas and dates.

    ``labelled`` is (area_key, date, row, col, height, width, reflectance bands, label,
    usable, review, trainable, scene).  A finished store is refused unless ``rebuild``, which
    replaces the given areas and dates and leaves others alone; bands and tiling must then be
    those of the store.  Requested (area_key, date) pairs without pixels are recorded as
    skipped; no pixels at all is an error, found before anything is written.
    """
    stride = stride or tile_size
    spark = labelled.sparkSession
    if _exists(spark, f"{path}/manifest"):
        if not rebuild:
            raise ValueError(f"{path} already holds a store")
        old = read_tile_store(spark, path)
        if (old.bands, old.tile_size, old.stride) != (list(bands), tile_size, stride):
            raise ValueError(f"{path} holds bands {old.bands} in tiles of {old.tile_size} by {old.stride}")
    if labelled.isEmpty():
        raise ValueError("no composite produced any pixel; the store would be empty")

    def write(df, part):
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if rebuild else "static")
         .partitionBy(*BY).parquet(f"{path}/{part}"))
    px = T.with_mask(labelled).select(
        *BY, "row", "col", "height", "width",
        *[P.encode_reflectance(F.col(b)).alias(b) for b in bands],
        F.col("mask").cast("tinyint").alias("mask"), F.col("label").cast("tinyint").alias("rule_label"),
        "usable", "review")
    # Spread each date over its pixel blocks: files follow ground, and one large date
    # is not one task.
    block = [F.floor(F.col("row") / 512.0), F.floor(F.col("col") / 512.0)]
    write(px.repartition(*BY, *block).sortWithinPartitions(*BY, "row", "col"), "pixels")
    stored = spark.read.schema(_pixel_schema(bands)).parquet(f"{path}/pixels")
    if rebuild:
        # One row per area and date that was just written.
        stored = stored.join(labelled.select(*BY).distinct(), BY, "left_semi")

    flags = stored.withColumn("label", F.col("rule_label").cast("int")) \
                  .withColumn("trainable", F.col("mask") >= 0)
    tallies = T.tile_tallies(flags, BY, tile_size, stride)
    frames = stored.groupBy(*BY).agg(F.max("height").alias("height"), F.max("width").alias("width"),
                                     F.count_if("usable").alias("usable_px"), F.count_if("review").alias("review_px"))
    tiles = T.all_tiles(frames, tallies, BY, tile_size, stride)
    if drop_empty:
        tiles = T.drop_empty_tiles(tiles)
    tiles = tiles.withColumn("key", K.store_key(F.col("date"), F.col("top"), F.col("left"), F.col("area_key"))) \
                 .withColumn("bottom", F.col("top") + tile_size).withColumn("right", F.col("left") + tile_size)
    write(tiles, "tiles")

    per = _read_parts(spark, f"{path}/tiles").groupBy(*BY).agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("trainable_px").alias("trainable_px"),
        *[F.sum(f"mask_{c}_px").alias(f"class_{c}") for c in range(len(C.CLASS_NAMES))])
    shard = frames.join(per, BY, "left").withColumn(
        "coverage", F.col("usable_px") / (F.col("height") * F.col("width")))
    if requested is not None:
        shard = requested.select(*BY).distinct().join(shard, BY, "left")
    shard = shard.withColumn("skipped", F.col("usable_px").isNull())
    meta = {"format_version": F.lit(FORMAT_VERSION), "tile_size": F.lit(tile_size), "stride": F.lit(stride),
            "bands": F.array(*[F.lit(b) for b in bands])}
    write(shard.withColumns(meta).repartition(*BY), "manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parquet under area and date folders; an area key such as 001 stays text."""
    found = spark.read.option("mergeSchema", "true").parquet(path).schema
    kinds = {"area_key": T_.StringType(), "date": T_.DateType()}
    schema = T_.StructType([T_.StructField(f.name, kinds.get(f.name, f.dataType), f.nullable) for f in found])
    return spark.read.schema(schema).parquet(path)


def _pixel_schema(bands: list[str]) -> str:
    return ("row int, col int, height int, width int, " + ", ".join(f"{b} int" for b in bands)
            + ", mask tinyint, rule_label tinyint, usable boolean, review boolean, area_key string, date date")


def read_tile_store(spark: SparkSession, path: str) -> TileStore:
    """Open a store; a missing manifest or another format version is refused.

    Reads one manifest row.  Stores without ``rule_label`` fall back to the mask.
    """
    try:
        manifest = _read_parts(spark, f"{path}/manifest")
        head = manifest.select("format_version", "tile_size", "stride", "bands").first()
    except Exception as exc:
        raise ValueError(f"{path} has no readable manifest") from exc
    if head is None or head["format_version"] != FORMAT_VERSION:
        raise ValueError(f"{path} has format version {head and head['format_version']}, expected {FORMAT_VERSION}")
    bands = list(head["bands"])
    pixels = _read_parts(spark, f"{path}/pixels")
    mask = F.when(F.col("mask") < 0, F.lit(C.IGNORE)).otherwise(F.col("mask").cast("int"))
    rule = F.coalesce(F.col("rule_label").cast("int"), mask) if "rule_label" in pixels.columns else mask
    extra = {"mask": mask, "rule_label": rule}
    for optional in ("usable", "review"):
        if optional not in pixels.columns:
            extra[optional] = F.lit(None).cast("boolean")
    return TileStore(pixels.withColumns(extra), _read_parts(spark, f"{path}/tiles"), manifest, bands, head["tile_size"], head["stride"])


def union_shards(*shards: DataFrame) -> DataFrame:
    """One store from separately built dates, columns matched by name."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def whole_store_counts(store: TileStore) -> DataFrame:
    """Class counts of the unfiltered store, from the manifest alone."""
    return store.manifest.agg(F.sum("tiles").alias("tiles"), *[
        F.sum(f"class_{c}").alias(f"class_{c}") for c in range(len(C.CLASS_NAMES))])
