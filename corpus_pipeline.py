"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from setweave.llm import decontaminate, line_dedup, near_dedup, sentencepiece_codec, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network, trained on the labelled rows that aren't held out, scores 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, shared.read_table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that are alike an earlier one are cut out; every document stays (a null text as it is), with its new length."""
    out = line_dedup.deduplicate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, in any order, go."""
    return decontaminate.drop_contaminated(docs, shared.read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and what they decode to."""
    coded = sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A trained network and trained merges have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
        shared.release(spark)
    return docs
