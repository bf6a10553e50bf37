"""From raw documents to packed sequences: five stages, each one of the operators in ``tallyshop.llm``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop.llm import lines, packing, rules, simhash, toxicity
from tallyshop.llm.common import released_shuffles, staged
from tallyshop.llm.queries import packed_digest


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, whose staged tables leave no shuffle files behind for the stages after it."""

    @wraps(stage)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with released_shuffles(spark):
            return stage(spark, docs, sf_dir)

    return tidy


@_tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not call toxic (score below 0.5)."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("toxicity < 0.5").drop("toxicity")


@_tidy
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and lie in the perplexity band of their language."""
    return rules.judge(docs).where("kept").select(*docs.columns)


@_tidy
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat a line of another or the same one; ``n_chars`` follows the text."""
    edited = lines.dedup(docs, whole=True).drop("n_dropped")
    return edited.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else edited


@_tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id."""
    return simhash.keep_one(docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of at most 1024 tokens with a checksum of their ids."""
    import public_tokenizers

    return packed_digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

# Compression lengths, SimHash components and tokenizer ids have no SQL form; tests run the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
