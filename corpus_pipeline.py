"""Corpus pipeline: toxic documents go, common lines go, near copies go, contaminated documents go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and calls one operator of grainmill.llm on all rows it gets; all but the last
return the columns of `documents`, with n_chars counted anew where the text changes. `run` chains them, cutting the
lineage in the shared checkpoint folder after each stage. A stage called on its own lowers the session's number of rows in
an Arrow batch (whole texts in little memory), since the setting counts when its result is executed; `run` restores it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from grainmill.llm.common import cut, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold; the model learns from all labels."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model, thresholds = toxicity.train(docs, labels)
    return toxicity.score_toxicity(docs.select(*COLUMNS), model, thresholds).filter("NOT __flagged").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share (but in the one with the largest id)."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("__n_dropped") > 0
    return done.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs.select(*COLUMNS), width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. All but the last are done when this returns; the session's batch size is then as before."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = cut(docs)
    finally:
        spark.conf.set(batch, before)
    return docs
