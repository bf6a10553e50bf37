"""What the operators share: the staging folder, label splits and small Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop.session import released_shuffles, shared_folder  # noqa: F401

# Bytes of text that one Arrow batch carries at most, so that long documents cannot fill a worker.
BATCH_BYTES = 8 << 20


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, safe against lost executors."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of ``df``'s session by bytes as well as by rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over byte-bounded batches."""
    return text_batches(df).mapInArrow(work, schema)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, target: str, holdout: int, left_out: int, per_label: int) -> DataFrame:
    """Rows (text, label, of) to learn ``target`` from, ``of`` being how many ids have the label: a bounded sample of ``docs`` whose ids ``labels`` marks 0 or 1.

    Rows whose crc32(id) mod ``holdout`` is ``left_out`` are never taken. At most ``per_label`` rows of each label are,
    the same ones on every run: those first by a hash. Labels without a document do not count.
    """
    def first(rows: DataFrame, *order: Column | str) -> DataFrame:
        """The first ``per_label`` rows of each label; every partition sends that many at most."""
        found = [rows.where(F.col("label") == value).orderBy(*order).limit(per_label) for value in (0, 1)]
        return found[0].unionByName(found[1])

    marks = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), holdout) != left_out))
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    )
    there = docs.select(F.col("doc_id").alias("doc_id")).distinct()
    marked = staged(marks.join(there, "doc_id"), "marked")
    sizes = marked.groupBy("label").agg(F.count("*").alias("of"))
    ids = first(marked, F.xxhash64("doc_id"), "doc_id")
    # Two labels times ``per_label`` ids at most: small enough to send to every task, whatever the input.
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    chosen = first(texts, F.xxhash64("doc_id", "text"))  # an id may have many rows
    return chosen.join(F.broadcast(sizes), "label").select("text", "label", "of")  # one size per label


def fit_in_task(sample: DataFrame, fit: Callable[[list[str], list[int], dict[int, int]], object]):
    """The model that ``fit`` makes of the texts, labels and label sizes of a bounded sample, fitted in one executor task."""
    import pickle

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, sizes = [], [], {}
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            sizes |= dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
        model = fit([texts[i] for i in order], [labels[i] for i in order], sizes)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    row = map_rows(sample.repartition(1), work, "model binary").first()
    return pickle.loads(row.model) if row else fit([], [], {})


def unrepeated(texts: list[str], words: int = 5) -> list[int]:
    """Positions of texts of which at most half of the word shingles occur in an earlier one: copies teach nothing new."""
    seen: set[int] = set()
    kept = []
    for i, text in enumerate(texts):
        found = text.split()
        shingles = {hash(tuple(found[j : j + words])) for j in range(max(1, len(found) - words + 1))}
        if 2 * len(shingles & seen) <= len(shingles):
            kept.append(i)
        seen |= shingles
    return kept
