"""The registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop.llm import chat, forest, html_text, lines, packing, pieces, quality, rules, shards, simhash, toxicity, trie, whitening
from tallyshop.llm.common import remainder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(_table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_shared", "n_kept")


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(_table(spark, folder, "conversations"))


def op4_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.learn(docs, _table(spark, folder, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), quality.HOLDOUT) == quality.LEFT_OUT).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = _tokenizer("piece_bpe_32k.model")
    return pieces.round_trip(_table(spark, folder, "documents"), model).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.length("decoded").cast("long").alias("n_chars"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"), "same",
    )


def op7_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge(_table(spark, folder, "documents"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "log_perplexity")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.learn(docs, _table(spark, folder, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), toxicity.HOLDOUT) == toxicity.LEFT_OUT).alias("held_out"),
        F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    deduped = lines.dedup(_table(spark, folder, "documents").select("doc_id", "text"), whole=True)
    return deduped.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_dropped")


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digest(packing.pack(_table(spark, folder, "documents"), _tokenizer()))


def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.build_respliced(_table(spark, folder, "conversations"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(_table(spark, folder, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> (spark, folder) -> DataFrame."""
    return {"op1_simhash": op1_simhash, "op2_html": op2_html, "op3_chat": op3_chat, "op4_forest": op4_forest, "op5_quality": op5_quality, "op6_pieces": op6_pieces, "op7_rules": op7_rules, "op8_toxicity": op8_toxicity, "op9_lines": op9_lines, "op10_packing": op10_packing, "op11_trie": op11_trie, "op12_whitening": op12_whitening, "op13_sharding": op13_sharding}


def llm_oracles() -> dict[str, str]:
    """DuckDB twins of the queries that SQL can express."""
    return {"op3_chat": chat.ORACLE, "op11_trie": trie.ORACLE, "op13_sharding": shards.ORACLE}
