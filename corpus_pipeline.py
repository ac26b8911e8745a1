"""From raw documents to token ids in five stages, each written as Parquet before the next.

Every stage but the last returns the columns of ``documents``.  What a stage drops is gone
for the later ones: quality rejects documents, near-dedup keeps the first of each class,
substring dedup cuts repeated passages (documents left without a word go), mixing repeats or
leaves out documents, and the last stage encodes what is there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid.llm.common import shared_folder
from marshgrid.llm.minhash import near_duplicates
from marshgrid.llm.mixing import mixed_rows
from marshgrid.llm.quality import quality
from marshgrid.llm.sentencepiece import encode
from marshgrid.llm.substring import remove_repeats


def _own(docs: DataFrame) -> DataFrame:
    """The whole input row as ``_row``, so that none of its names clashes, beside ``_id`` and ``_key`` (its text)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows that repeat id and text are judged alike.

    Null, empty and blank texts go; an empty table stays empty; extra columns stay as they are.
    """
    keyed = _own(docs).withColumn("_id", F.coalesce("_id", F.lit(-(1 << 63))))
    judged = quality(keyed.select(F.struct("_id", "_key").alias("row"), "_row.text", "_row.lang"), id_col="row")
    kept = judged.where("kept").select("doc_id._id", "doc_id._key").distinct()
    return keyed.join(kept, ["_id", "_key"], "left_semi").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; a row with a null id stands alone.

    Of rows that repeat id and text one stays; an empty table stays empty; extra columns stay as they are.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    one = _own(docs).join(kept, "_id", "left_semi").dropDuplicates(["_id", "_key"]).select("_row.*")
    return one.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages seen earlier; documents that lose every word go."""
    cut = remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, dealt to shards and shuffled there.

    Texts without a word are not drawn; null ids and sources are values like others; an empty
    table stays empty.  Input columns named as those of a draw come back as they are.
    """
    inner = {c: f"_given_{c}" for c in ("epoch", "shard", "place") if c in docs.columns}
    drawn = mixed_rows(docs.withColumnsRenamed(inner))
    return drawn.select(*[F.col(inner.get(c, c)).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every drawn document, their number, and whether they decode to the text."""
    read = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return read.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                       F.sha2(F.col("text"), 256).alias("text_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Sketches, hashed draws and piece merges are not to be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
