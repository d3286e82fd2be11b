"""The corpus pipeline: quality, lines, near duplicates, benchmark passages, packing.

Each stage reads what its predecessor kept; run() writes every result as Parquet in the cluster's
shared folder and reads it again, and deletes the tables a stage no longer needs. Stages that filter
return the columns of documents.

Cases, for every stage: nulls in any column, empty and very long texts are allowed and told below;
rows that repeat an id are judged each, but for near duplicates; an empty table gives an empty
result; columns beside doc_id, text and n_chars pass through the filtering stages, whatever their
names, and play no part.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import decontaminate, line_dedup, near_dedup, packing, quality_model
from terrazzo.llm.shared import remove, scratch, sieved, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    A null or empty text is scored as a passage of zeros; equal texts stay or go together; without
    labels of both kinds the share of label 1 decides for all.
    """
    return quality_model.keep_good(docs, quality_model.fit_for(spark, docs, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that many documents share; n_chars follows the text.

    A null text becomes an empty one; a row without an id loses every such line; no row goes.
    """
    cleaned = line_dedup.dedup_lines(docs, n_lines="__n_lines", n_dropped="__n_dropped")
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of the least id.

    Rows without an id, and texts that are null, empty or without words, stay. Rows that repeat an id
    stay or go together.
    """
    with scratch(spark) as keep:
        gone = stored(near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")), "gone")
        keep(gone)
    told = sieved(docs, "doc_id", gone, "__gone")
    stay, asked = (told.where(x).drop("__may") for x in ("not __may", "__may"))  # only rows that may go are shuffled
    return stay.unionAll(asked.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; those without text stay, as do all without passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences; the result is that of the packing operator.

    A null or empty text is its end token alone; a text longer than a sequence is cut into pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), held=200_000)  # workers have held other tables before


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

ORACLE_SQL = None  # a trained classifier and packing are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as keep:
            docs = stored(stage(spark, before, sf_dir), "pipeline-" + name.replace(" ", "-"))
            keep(docs)
        remove(before)
    return docs
