"""Queries over the given tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshgrid.llm import oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and the verdict by distance to the language references."""
    from marshgrid.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_substring_dedup", oracle.OP10)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from each document because they lie in a window seen earlier."""
    from marshgrid.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_source_mixing")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document, next to its source's target."""
    from marshgrid.llm.mixing import mix

    per_document, _ = mix(_table(spark, sf_dir, "documents"))
    return per_document.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document over verified links of similarity 0.8 or more."""
    from marshgrid.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each whole text, and whether they decode to it."""
    import public_tokenizers

    from marshgrid.llm.sentencepiece import encode

    read = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold of each document, read back from them."""
    import public_tokenizers

    from marshgrid.llm.token_store import read_tokens, write_tokens

    manifest = write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest, with_ids=False)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from the documents outside the held-out fifth."""
    from marshgrid.llm.language import identify, train

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = train(docs.where("not held_out"))
    found = identify(docs, model, F.struct("doc_id", "held_out"))
    return found.select("id.doc_id", "id.held_out", "lang_pred", "score")


@query("op3_warc", oracle.OP3)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as read back from the archives."""
    from marshgrid.llm.warc import read_records, write_archives

    index = write_archives(_table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_embedding_near_dedup", oracle.OP4)
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, class and verdict of each vector."""
    from marshgrid.llm.embedding_dedup import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings"))


@query("op6_chat_format", oracle.OP6)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text; -7 is made of control strings."""
    from marshgrid.llm.chat import format_chat, read_chat

    text = r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_chat(format_chat(turns.unionByName(extra)))


@query("op11_merkle_manifest", oracle.OP11)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of each document; where 7 divides the id's checksum, one was added to n_chars."""
    from marshgrid.llm.merkle import manifest, verified

    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    now = {"n_chars": F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return verified(manifest(_table(spark, sf_dir, "documents"), tampered=now)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_conversation_repair", oracle.OP12)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation, its cheapest edits and the digest of what they give."""
    from marshgrid.llm.repair import damaged, repair

    turns = _table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns)


@query("op13_privacy_spans", oracle.OP13)
def op13_privacy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document and the terms that disclose it."""
    from marshgrid.llm.privacy import sanitised_spans

    return sanitised_spans(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
